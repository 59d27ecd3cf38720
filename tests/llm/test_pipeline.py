"""The pipeline, stage by stage and as a whole, against plain forms of every stage."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from driftline.llm import line_dedup
from driftline.llm.tokenizing import WordEncoder, default_path

from .common import SCHEMA, documents, words
from .test_dedup import plain_classes
from .test_text_rules import plain_stats


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    where = str(tmp_path_factory.mktemp("sf"))
    items = [(i, words(rng, 40)) for i in range(12)]
    rows = [r for r in documents(seed=9) if r[0] not in (7, 8)]
    rows += [(2000 + i, f"{words(rng, 60)} {items[i % 12][1]} {words(rng, 60)}", "en", "s", 1) for i in range(18)]
    junk = [f"{words(rng, 1)}{mark}" for mark in ("***", "###", "%%%") for _ in range(10)]
    rows += [(3000 + i, " ".join(rng.choice(junk) for _ in range(60)), "en", "junk", 1) for i in range(20)]
    rows += [(4000 + i, "\n".join(words(rng, 9) for _ in range(12)), "en", "s", 1) for i in range(30)]
    rows += [(4100, rows[-1][1] + "\nthe end", "en", "s", 1)]
    labels = [(i, 1, 0) for i in range(50)] + [(4000 + i, 1, 0) for i in range(20)] + [(3000 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    return {r[0]: r for r in con.execute(f"select doc_id, text, n_removed_chunks from ({line_dedup.ORACLE_SQL})").fetchall()}


def test_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == source.columns
    first = [tuple(r) for r in source.collect()]
    kept = [tuple(r) for r in seen["quality rules"].collect()]
    stats = {r[0]: plain_stats(r[1]) for r in first}
    failed = {r[0] for r in first if stats[r[0]][0] < 20 or 100 * stats[r[0]][4] > 30 * stats[r[0]][0]}
    gone = {r[0] for r in first} - {r[0] for r in kept}
    assert failed - {None} <= gone and {3000 + i for i in range(20)} <= gone
    assert gone - failed <= {None, *range(3000, 3020), 506}
    assert len(kept) > 100

    lines = by_sql(kept)
    want = {i: t for i, t, n in lines.values() if not n or t.strip()}
    second = {r.doc_id: r for r in seen["line dedup"].collect()}
    assert {i: r.text for i, r in second.items()} == want and 4100 in second

    _, root = plain_classes([(i, r.text) for i, r in second.items()])
    third = {r.doc_id for r in seen["n-gram Jaccard join"].collect()}
    assert third == {i for i in second if i is None or root[i] == i}

    fourth = {r.doc_id: r.text for r in seen["benchmark decontamination"].collect()}
    assert set(fourth) == third - {2000 + i for i in range(18)}

    encoder = WordEncoder(default_path())
    pieces = defaultdict(list)
    for p in seen["packing"].collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(fourth)
    for doc, text in fourth.items():
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()), len(ids))
            at += p.length
        assert at == len(ids)


def test_run_is_the_stages(spark, sf):
    whole = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
    total = lambda df: sorted((r.doc_id or -1, r.start, r.length) for r in df.collect())
    one, two = total(whole), total(docs)
    assert {x[0] for x in one} == {x[0] for x in two} and sum(x[2] for x in one) == sum(x[2] for x in two)


def test_stages_of_no_rows(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_keep_every_document_they_should(spark, sf):
    """Ids that several texts share, null ids, repeated rows and columns named like those the operators add, in all stages."""
    from pyspark.sql import functions as F

    rng = random.Random(77)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    text = lambda n: "\n".join(words(rng, 30) for _ in range(n))
    same, leaked = text(3), f"{words(rng, 20)} {item} {words(rng, 20)}"
    clean = [(1, text(2)), (1, text(2)), (None, text(2)), (None, text(2)), (2, same), (2, text(2)), (None, text(2))]
    rows = [*clean, (3, same), (None, same), (1, leaked), (None, leaked), clean[0]]
    extra = ("own", "row", "class", "class_id", "node", "text_hash", "_id", "_hash", "key", "rest", "lines", "gone", "kept")
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], SCHEMA).select("*", *(F.lit(c).alias(c) for c in extra))
    stages, source = dict(corpus_pipeline.STAGES), docs
    for name in ("quality rules", "line dedup"):
        docs = stages[name](spark, docs, sf).persist()
        assert docs.columns == source.columns and all(r[c] == c for r in docs.select(*extra).collect() for c in extra), name
    docs, left = source, {}
    for name in ("n-gram Jaccard join", "benchmark decontamination"):
        docs = stages[name](spark, docs, sf).persist()
        assert docs.columns == source.columns and all(r[c] == c for r in docs.select(*extra).collect() for c in extra), name
        left[name] = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert left["n-gram Jaccard join"] == Counter([*clean, (1, leaked)]) and left["benchmark decontamination"] == Counter(clean)
    packed = stages["packing"](spark, docs, sf).collect()
    assert len({(p.doc_id, p.ids_crc32) for p in packed}) >= len(clean) and {*packed[0].asDict()} == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
