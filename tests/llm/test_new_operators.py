"""Language identification, the Merkle manifest and phrase collocations against plain forms."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import collocations, language_id, merkle
from driftline.llm.arrays import mixed

from .common import SCHEMA, documents, frame, words

SF = "/root/testdata/sf0.001"


# language identification


def plain_grams(text):
    """Bucket counts of a text."""
    low = [(x if len(x := c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text]
    chars = [ord(c) if c != " " else 0 for c in re.sub(" +", " ", " " + "".join(low) + " ")]
    out = Counter()
    for k in language_id.ORDERS:
        for i in range(len(chars) - k + 1):
            if k == 1 and not chars[i]:
                continue
            h = 0
            for c in chars[i : i + k]:
                h = (h * 0xD6E8FEB86659FD93 + c) % 2**64
            out[int(mixed(np.array([(h + k) % 2**64], np.uint64))[0]) >> (64 - language_id.BUCKET_BITS)] += 1
    return out


def plain_languages(rows):
    counts, docs = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang] += plain_grams(text or "")
            docs[lang] += 1
    size, out = 1 << language_id.BUCKET_BITS, []
    for i, text, *_ in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        if not any(unicodedata.category(c)[0] == "L" for c in text or "") or not counts:
            out.append((i, held, "und", 0.0))
            continue
        grams, logs = plain_grams(text), {}
        for lang, own in counts.items():
            total = sum(own.values()) + language_id.SMOOTHING * size
            logs[lang] = math.log(docs[lang] / docs.total()) + sum(n * math.log((own[b] + language_id.SMOOTHING) / total) for b, n in grams.items()) / len(language_id.ORDERS)
        best = min(logs, key=lambda x: (-logs[x], x))
        out.append((i, held, best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def language_rows():
    rng = random.Random(5)
    alphabets = {"de": "äöüßenrist", "fr": "éèçaeulnrs", "en": "thewandofi"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 30)), lang, "s", 1) for i in range(90) for lang in [rng.choice([*alphabets])]]
    rows += [(200, None, "de", "s", 1), (201, "", "en", "s", 1), (202, "1234 -- 5", "fr", "s", 1), (203, text("fr", 4000), None, "s", 1), (None, text("en", 5), "de", "s", 1), (3, text("de", 5), "fr", "s", 1)]
    rows += [rows[4], rows[4], (204, "été 東京 \U0001f600 İ", "fr", "s", 1)]
    return rows


def close(got, want):
    key = lambda r: tuple((x is not None, x) for x in r[:3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-6)


@pytest.mark.parametrize("at_once", [32, 2, 1])
def test_languages_are_brute_force(spark, at_once):
    """The same by blocks of languages as at once."""
    rows = language_rows()
    close(language_id.predicted_languages(frame(spark, rows), at_once).collect(), plain_languages(rows))


def test_languages_of_odd_tables(spark):
    rows = [r[:2] + (None,) + r[3:] for r in language_rows()]
    close(language_id.predicted_languages(frame(spark, rows)).collect(), plain_languages(rows))
    assert language_id.predicted_languages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_languages_of_what_was_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.predicted_languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and lang is not null").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 30 and sum(right) / len(right) >= 0.95
    assert all(r.lang == r.lang_pred for r in got if r.n_chars > 200)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_path(digests, i):
    """(root, [(siblings before, siblings after)]) of a leaf."""
    steps = []
    while len(digests) > 1:
        run = digests[i // 8 * 8 : i // 8 * 8 + 8]
        steps.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        digests, i = [H(*digests[k : k + 8]) for k in range(0, len(digests), 8)], i // 8
    return digests[0], steps


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    trees = defaultdict(list)
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low) if tampered else leaf(r, r[1])))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort()
    tops, out = [plain_path([x[2] for x in trees[k]], 0)[0] for k in langs], []
    for t, lang in enumerate(langs):
        digests = [x[2] for x in trees[lang]]
        for i, (some, doc, own, claimed) in enumerate(trees[lang]):
            subroot, below = plain_path(digests, i)
            root, above = plain_path(tops, t)
            folded = claimed
            for before, after in below + above:
                folded = H(before, folded, after)
            out.append((doc if some else None, own, subroot, root, H(*(a + b for a, b in below + above)), folded, folded == root))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def manifest_rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(3 * n) - n, rng.choice(["Some Text", "lower", "", None, "É ẞ"]), rng.choice(langs), rng.choice(["s", None]), rng.choice([0, 5, None])) for _ in range(n)]


@pytest.mark.parametrize("rows", [documents(), manifest_rows(1, ["en"]), manifest_rows(8, [None]), manifest_rows(9, ["b", "B"]), manifest_rows(300, [None, "de", "en", "fr", "é", "z", "a", "b", "c", "d"]), manifest_rows(700, ["en"] * 20 + ["de"])])
def test_manifest_is_plain(spark, rows):
    same(merkle.audited(frame(spark, rows)).collect(), plain_manifest(rows))


def test_manifest_over_several_rounds(spark, monkeypatch):
    """Two levels a round and partitions of 64 leaves: nodes are fetched from other partitions at several levels."""
    monkeypatch.setattr(merkle, "ROUND", 2)
    rows = manifest_rows(1500, ["en"] * 30 + ["de", None])
    same(merkle.audited(frame(spark, rows)).collect(), plain_manifest(rows))


def test_proofs_of_some_leaves(spark):
    """Leaves here and there: the nodes their proofs need are those that a plain walk finds, each once."""
    for n, known in [(1, [0]), (9, [8]), (70, [0, 1, 69]), (600, [5, 7, 64, 65, 599]), (64, list(range(64)))]:
        want, have, size = [], set(known), n
        while size > 1:
            near = {c for i in have for c in range(i // 8 * 8, min(i // 8 * 8 + 8, size))}
            want.append(sorted(near - have))
            have, size = {i // 8 for i in have}, -(-size // 8)
        assert [x.tolist() for x in merkle.missing(np.array(known), n)] == want
    rows = manifest_rows(500, ["en", "de", "fr"])
    text = F.col("text")
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA).select("lang", "doc_id", merkle.leaf_hash(text).alias("leaf"), F.col("n_chars")))
    some = made.leaves.where("i % 37 = 5 or i in (0, 1, 2)")
    got = merkle.proofs(made, some).collect()
    want = Counter(r[:5] for r in plain_manifest(rows))
    assert len(got) == some.count() > 10 and all(want[tuple(r)[:5]] and r.verified and r.folded_root == r.root for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).collect() == []


# Phrase collocations


def plain_collocations(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        dropped = set()
        for p, a in cands.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= 100 * own[p[i:j]]:
                        dropped.add(p[i:j])
        found = []
        for p, a in cands.items():
            if p in dropped:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for k, (score, a, p, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, k + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(8)
    common = [words(rng, 1) for _ in range(14)]
    stock = [" ".join(rng.choice(common) for _ in range(k)) for k in (2, 3, 4, 5, 6, 7)]
    rows = []
    for i in range(160):
        parts = [rng.choice([rng.choice(common), words(rng, 1), rng.choice(stock), "a a a a", "Of The"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "; "]) for _ in range(rng.randint(1, 40))]
        rows.append((i, "".join(parts), rng.choice(["en", "en", "de", None]), "s", 1))
    return rows + [rows[3]] * 20 + [(500, None, "en", "s", 1), (501, "", "fr", "s", 1), (502, "Ünï ñ \x0b x" * 30, "en", "s", 1), (None, "a a a a a", None, None, None)]


@pytest.mark.parametrize("least,top", [(20, 2000), (5, 7), (10**9, 10)])
def test_collocations_are_brute_force(spark, least, top):
    rows = phrase_rows()
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least, top=top).collect())) == plain_collocations(rows, least, top)


def test_phrases_that_come_late_are_counted_for_a_whole_cycle(spark):
    """Whatever shard a phrase becomes active at, its count is that of all shards; every phrase is found with its parts."""
    rows = phrase_rows()
    want = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").lower()):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                want[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    docs = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(23)
    for least in (12, 60):
        shards = collocations._shards(docs)
        frequent = collocations.frequent_phrases(shards, least).cache()
        some = frequent.withColumn("head", F.when(F.col("key") % 3 != 0, F.col("head")))  # as if these stood in no last shard
        salts = {r.salt: r.lang for r in shards.select("salt", "lang").distinct().collect()}
        all_ = [(lang, p.count(" ") + 1, n) for lang, own in want.items() for p, n in own.items() if n >= least]
        assert Counter((r.k, r.n) for r in frequent.collect()) == Counter(x[1:] for x in all_)
        for known in (frequent, some):
            full = collocations._described(shards, known, 5).cache()
            assert full.where("head is null").count() == 0
            got = collocations._with_parts(full, 5).collect()
            assert Counter((salts[r.salt], r.k, r.n) for r in got) == Counter(x for x in all_ if x[1] > 1)
            assert all(len(r.words) == len(r.fronts) == len(r.backs) == r.k and r.fronts[-1] == r.backs[-1] == r.n for r in got)


def test_a_field_of_few_cells_gives_the_same(spark, monkeypatch):
    rows = phrase_rows()
    want = plain_collocations(rows, 20, 2000)
    monkeypatch.setattr(collocations, "FIELD_BITS", 7)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 20).collect())) == want


def test_exact_arithmetic(spark):
    """Products beyond 64 bits."""
    row = spark.createDataFrame([(3, 10**15 + 7, 9 * 10**17 + 3, [10**15 + 9, 10**15 + 8, 1], [10**16, 10**15 + 10**9, 1])], "k int, a long, n long, fronts array<long>, backs array<long>")
    got = row.select(collocations._worst_cut("n").alias("c")).first().c
    each = [(1000 * (10**15 + 7) * (9 * 10**17 + 3) // (x * y), j, x, y) for j, x, y in [(1, 10**15 + 9, 10**15 + 10**9), (2, 10**15 + 8, 10**16)]]
    assert (got.score, got.j, got.l, got.r) == min(each)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name,operator", [("op12_merkle_manifest", merkle.audited), ("op13_collocations", collocations.collocations)])
def test_sql_gives_the_same(spark, name, operator):
    from driftline.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    got = operator(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(names) == sorted(got.columns)
    same([tuple(r[c] for c in names) for r in got.collect()], cur.fetchall())
