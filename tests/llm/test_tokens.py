import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm.packing import pack
from driftline.llm.token_counts import at_limit, length_histogram, lengths
from driftline.llm.token_files import packed, read_tokens, unpacked, write_tokens
from driftline.llm.tokenizing import WordEncoder, default_path, encoded

from .common import SCHEMA, documents, frame


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(default_path())


def library(encoder, texts, end):
    return [x.ids + end for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.lists(st.lists(st.sampled_from([*"abZé'#1٣ \n\t.,́İſK①Σ가\x1c", "<|endoftext|>", "'s "]), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    enc = _shared
    ids, sizes = encode(enc, texts)
    want = library(enc, texts, [])
    assert [len(x) for x in want] == list(sizes) and [i for x in want for i in x] == list(ids)


_shared = WordEncoder(default_path())


def encode(encoder, texts):
    data = [(t or "").encode() for t in texts]
    return encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_encoder_parts_a_long_text(monkeypatch, encoder):
    monkeypatch.setattr("driftline.llm.tokenizing.TEXT_BYTES", 100)
    text = " ".join(f"Wört{i}'s {i}" for i in range(500)) + "x" * 500
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([None, text, "a b"])], ["doc_id", "text"])
    got = [ids.tolist() for _, ids, _ in encoded([batch], default_path(), None)]
    assert [i for x in got for i in x] == [i for x in library(encoder, [text, "a b"], []) for i in x]


def test_encoder_forgets(monkeypatch, encoder):
    monkeypatch.setattr("driftline.llm.tokenizing.CACHE_UNITS", 6000)
    monkeypatch.setattr("driftline.llm.tokenizing.TEXT_BYTES", 1000)
    own = WordEncoder(default_path())
    for rows in (documents(1), documents(2), documents(3)):
        texts = [r[1] for r in rows if not r[1] or len(r[1]) < 9000]
        ids, sizes = encode(own, texts)
        want = library(encoder, texts, [])
        assert [i for x in want for i in x] == list(ids)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_code_round_trip(values):
    codes = np.array(values, np.uint32)
    control, payload = packed(codes)
    assert len(control) == -(-len(values) // 4) and list(unpacked(control, payload, len(values))) == values


def test_token_files(spark, encoder, monkeypatch):
    monkeypatch.setattr("driftline.llm.token_files.BLOCK_IDS", 700)
    monkeypatch.setattr("driftline.llm.token_files.SHARD_IDS", 3000)
    rows = documents()
    files = write_tokens(frame(spark), end_id=2)
    got = read_tokens(spark, files).orderBy("start").collect()
    order = lambda x: (x[0] is not None, x[0] or 0)
    want = sorted(((r[0], tuple(x)) for r, x in zip(rows, library(encoder, [r[1] for r in rows], [2]), strict=True)), key=order)
    at = 0
    for g in got:
        assert g.start == at and g.n_tokens == len(g.ids) // 4
        at += g.n_tokens
    read = [(g.doc_id, tuple(np.frombuffer(g.ids, "<u4").tolist())) for g in got]
    assert sorted(read, key=order) == read and Counter(read) == Counter(want)
    blocks = spark.read.parquet(files.blocks)
    assert blocks.select("shard").distinct().count() > 1 and blocks.count() > 3
    ranks = {r.rank: r.token_id for r in spark.read.parquet(files.ranks).collect()}
    counts = np.bincount([i for _, x in want for i in x], minlength=len(ranks))
    assert all(counts[ranks[k]] >= counts[ranks[k + 1]] for k in range(len(ranks) - 1))


def test_token_files_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_tokens(spark, write_tokens(empty)).count() == 0
    assert pack(empty).count() == 0 and length_histogram(lengths(empty)).count() == 0


@pytest.mark.parametrize("size,windows", [(64, 3), (2048, 32)])
def test_packing(spark, encoder, size, windows, monkeypatch):
    if size == 64:  # several tasks in the later rounds
        monkeypatch.setattr("driftline.llm.packing.LEFTOVER_TOKENS", 500)
    rows = documents()
    out = pack(frame(spark), sequence=size, open_windows=windows).withColumn("crc", F.crc32("ids")).collect()
    want = defaultdict(list)
    for r, ids in zip(rows, library(encoder, [r[1] for r in rows], [1]), strict=True):
        want[r[0]].append(ids)
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in out:
        by_row[p.row_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_row) == len(rows)
    for pieces in by_row.values():
        pieces.sort(key=lambda p: p.start)
        ids = [i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids in want[pieces[0].doc_id] and all(p.doc_tokens == len(ids) for p in pieces)
        want[pieces[0].doc_id].remove(ids)
        at = 0
        for p in pieces:
            assert p.start == at and p.length == len(p.ids) // 4 and p.crc == crc(np.frombuffer(p.ids, "<u4"))
            at += p.length
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fills.append(at)
    assert max(fills) <= size and sum(fills) / size / len(fills) > 0.95


def test_token_counts(spark, encoder):
    sizes = np.array([len(x) for x in library(encoder, [r[1] for r in documents()], [])])
    rows = length_histogram(lengths(frame(spark))).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(sizes.tolist()))
    for r in rows:
        cut = np.minimum(sizes, r.n_tokens)
        assert (r.n_docs, r.n_tokens_at) == ((sizes == r.n_tokens).sum(), sizes[sizes == r.n_tokens].sum())
        assert (r.docs_longer, r.docs_up_to) == ((sizes > r.n_tokens).sum(), (sizes <= r.n_tokens).sum())
        assert (r.tokens_up_to, r.truncated_total, r.tokens_lost) == (sizes[sizes <= r.n_tokens].sum(), cut.sum(), (sizes - cut).sum())
        assert r.quantile == pytest.approx((sizes <= r.n_tokens).mean())
    limits = [0, 1, 7, int(sizes.max()) - 1, int(sizes.max()) + 5]
    for r in at_limit(length_histogram(lengths(frame(spark))), *limits).collect():
        cut = np.minimum(sizes, r.limit)
        assert (r.docs_up_to, r.docs_longer, r.truncated_total, r.tokens_lost) == ((sizes <= r.limit).sum(), (sizes > r.limit).sum(), cut.sum(), (sizes - cut).sum())
