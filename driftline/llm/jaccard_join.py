"""Jaccard self-join of word 5-shingle sets by chosen paths.

Documents of equal sets are one node. In every run, sets are split on sampled minima of their tokens: coordinates are drawn
with a probability that gives a set 1 / SPLIT children, and sets that share the minimum of a drawn coordinate meet in
a bucket. Buckets of at most BRUTE sets are compared all against all by short sketches; larger ones are split again and
again until none is left. A large bucket that holds sets which are, on average, near the bar to the whole bucket would not
get smaller: it goes to brute force as a group. Runs are repeated until a pair at the bar is found with the target recall.

What meets is only proposed: proposals are joined to groups, and within each group every pair is held against the
bar on whole sets, in pairs of blocks of bounded size. So copies are compared once and no pair is written as a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACES, mixed, pieces, runs, span_hashes, utf8, windows
from .grouping import components, local_roots, sorted_groups
from .shared import settled, written

SHINGLE, SIMILARITY = 5, 0.8
#: A set has 1 / SPLIT children on average; a pair at the bar is found with RECALL, however often its buckets are split.
SPLIT, RECALL, BRUTE = 0.6, 0.998, 256
#: Coordinates of a sketch, one byte each, and the equal ones from which a pair is proposed (0.8 has 51 on average).
SKETCH, SKETCH_EQUAL = 64, 37
#: Sets of a large bucket (those of least hash in PROBES parts) by which its density is judged, and the mean share of equal
#: coordinates from which one of them counts as near the whole bucket.
PROBES, DENSE = 16, 0.7
#: Sets, and tokens of sets, of one block of a group.
BLOCK_SETS, BLOCK_TOKENS = 1024, 2_000_000


def _survives() -> float:
    """The probability that a pair at the bar, which shares SIMILARITY / SPLIT children on average, meets at all levels of one
    run: what a branching process of that mean does for ever."""
    alive = 1.0
    for _ in range(200):
        alive = 1 - math.exp(-alive * SIMILARITY / SPLIT)
    return alive


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - _survives()))
#: First-level coordinates, by run: as many as the runs draw, none of them twice.
FIRST = max(RUNS, round(RUNS / SPLIT))
_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 31, FIRST + SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = _rng.integers(0, 1 << 32, FIRST + SKETCH).astype(np.uint32)


def _shingles(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document), by document; a text of one to four words is one shingle."""
    starts, ends, of = pieces(text, offsets, SPACES)
    words = span_hashes(text, starts, ends)
    out, docs = [], []
    counts = np.bincount(of, minlength=len(offsets) - 1)
    for width in range(1, SHINGLE + 1):
        found, at = windows(words, of, width)
        d = of[at]
        if width < SHINGLE:
            use = counts[d] == width
            found, d = found[use] + np.uint64(width), d[use]
        out.append(found), docs.append(d)
    found, d = np.concatenate(out), np.concatenate(docs)
    if (np.diff(d) < 0).any():
        order = np.argsort(d, kind="stable")
        found, d = found[order], d[order]
    return found, d


def _sets(text: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each document."""
    found, of = _shingles(text, offsets)
    at = np.searchsorted(of, np.arange(len(offsets)))
    return [np.unique(found[at[k] : at[k + 1]]) for k in range(len(offsets) - 1)]


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    return int(mixed(tokens).sum(dtype=np.uint64).view(np.int64)), int(mixed(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum of each coordinate over each (non-empty) set: coordinates by sets."""
    tokens = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((FIRST + SKETCH, len(sets)), np.uint32)
    for k, (f, s) in enumerate(zip(_FACTORS, _SALTS, strict=True)):
        out[k] = np.minimum.reduceat((tokens ^ s) * f, at)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, row, h1, h2, n, keys, sketch): a number for each row, hash and size of the set, its first buckets and
    its sketch. No words, n = 0."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                sets = _sets(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                some = [k for k, x in enumerate(sets) if len(x)]
                keys: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if some:
                    low = _minima([sets[k] for k in some])
                    path = mixed(low[:FIRST].astype(np.uint64) + (np.arange(1, FIRST + 1, dtype=np.uint64) << np.uint64(33))[:, None])
                    short = np.ascontiguousarray(((low[FIRST:] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T)
                    for k, p, s in zip(some, path.T.view(np.int64).tolist(), short, strict=True):
                        keys[k], sketch[k] = p, s.tobytes()
                hashes = [_set_hash(x) for x in sets]
                numbers = pa.array(np.arange(row, row + len(sets)))
                row += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), numbers, pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "text_hash", "row", "h1", "h2", "n", "keys", "sketch"],
                )

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, row long, h1 long, h2 long, n long, keys array<long>, sketch binary")


def _dense(large: DataFrame) -> DataFrame:
    """(key, leader) of the buckets of rows (key, node, n, sketch) in which a set is, on average, near all others. Sets at the bar
    stay together in every split, so such a bucket would never get small. Judged by PROBES sets of each bucket."""

    def run(batches):
        for batch in batches:
            keys, leaders = [], []
            for key, probes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b"".join(x["sketch"] for x in probes), np.uint8).reshape(-1, SKETCH)
                equal = (own[:, None, :] == own[None, :, :]).mean(axis=2)
                others = (equal.sum(axis=1) - 1) / max(len(own) - 1, 1)
                if others.max() >= DENSE:
                    keys.append(key), leaders.append(min(x["node"] for x in probes))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(leaders, pa.int64())], ["key", "leader"])

    part = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(PROBES))
    least = large.groupBy("key", part.alias("part")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "sketch")).alias("p"))
    probes = least.groupBy("key").agg(F.collect_list(F.struct("p.node", "p.sketch")).alias("probes"))  # PROBES at most
    return probes.mapInArrow(run, "key long, leader long")


def _split(rows: DataFrame) -> DataFrame:
    """The children of rows (key, node, n, sketch): a row per coordinate that their bucket draws, with the bucket of the set's byte
    there."""
    bar = np.uint64(int(2**64 / (SPLIT * SKETCH)))

    def run(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            keys = batch.column(0).to_numpy().view(np.uint64)
            row, at = np.nonzero(mixed(keys[:, None] + np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) < bar)
            child = mixed(keys[row] * np.uint64(31) + (at.astype(np.uint64) << np.uint64(8)) + own[row, at] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(k).take(pa.array(row)) for k in (1, 2, 3))], ["key", "node", "n", "sketch"])

    return rows.select("key", "node", "n", "sketch").mapInArrow(run, "key long, node long, n long, sketch binary")


def _brute(rows: DataFrame) -> DataFrame:
    """(a, b): within each bucket, ties of every set to the least one that it is proposed with, directly or not."""

    def run(batches):
        a, b = [], []
        for group in sorted_groups(batches, ["key"]):
            node, n = group.column(1).to_numpy(), group.column(2).to_numpy()
            sketch = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            close = (sketch[:, None, :] == sketch[None, :, :]).sum(axis=2) >= SKETCH_EQUAL
            close &= np.minimum(n[:, None], n) >= SIMILARITY * np.maximum(n[:, None], n)
            root = local_roots(close)
            tied = root != np.arange(len(root))
            a += node[tied].tolist()
            b += node[root[tied]].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def proposals(nodes: DataFrame) -> DataFrame:
    """(a, b): ties between nodes (node, n, keys, sketch) that may be linked; connected where a link is, with the recall. All sets of
    a dense bucket are tied to one, so that each pair of them is verified."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n", "sketch")
    out = None
    while True:
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
        met = written(rows.join(sizes.hint("shuffle_hash"), "key"), "met")
        small = _brute(met.where(F.col("size") <= BRUTE).select("key", "node", "n", "sketch"))
        out = small if out is None else out.unionByName(small)
        large = met.where(F.col("size") > BRUTE).select("key", "node", "n", "sketch")
        if large.isEmpty():
            return out
        dense = written(_dense(large), "dense")
        tied = large.join(dense.hint("shuffle_hash"), "key").where("node <> leader")
        out = out.unionByName(tied.select(F.col("node").alias("a"), F.col("leader").alias("b")))
        rows = written(_split(large.join(dense, "key", "left_anti")), "split")


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs have at least the similarity, from exact counts of common tokens."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    common = np.zeros((n, n), np.float32)
    if n == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(n), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(first, len(tokens)))
        column = np.repeat(np.cumsum(count > 1) - 1, count)
        keep = np.repeat(count > 1, count)
        of, column = of[keep], column[keep]
        step = max(256, 4_000_000 // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, z = np.searchsorted(column, [lo, lo + step])
            dense = np.zeros((n, step), np.float32)
            dense[of[a:z], column[a:z] - lo] = 1
            common += dense @ dense.T
    either = sizes[:, None] + sizes - common
    return common >= SIMILARITY * either - 1e-9


def _verify(members: DataFrame) -> DataFrame:
    """(a, b, links): for every set its links within a pair of blocks (b null), and ties that connect linked sets."""

    def run(batches):
        rows: list[tuple] = []
        for group in sorted_groups(batches, ["root", "i", "j"]):
            node = group.column(3).to_numpy()
            _, one = np.unique(node, return_index=True)  # rows of a document that is listed twice
            group, node = group.take(pa.array(one)), node[one]
            block, copies = group.column(4).to_numpy(), group.column(5).to_numpy()
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            linked = _linked([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(6)])
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block  # pairs within a block are that block's own
            links = linked @ copies.astype(np.float64)
            root = local_roots(linked)
            rows += [(int(a), None, int(k)) for a, k in zip(node, links, strict=True) if k]
            rows += [(int(a), int(node[r]), 0) for a, r in zip(node, root, strict=True) if node[r] != a]
            if len(rows) > 50_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["a", "b", "links"])

    spread = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return spread.mapInArrow(run, "a long, b long, links long")


def _with_sets(rows: DataFrame) -> DataFrame:
    """Members with the tokens of their sets; of rows that repeat one document the first of a task is taken."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for k, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node), fresh.append(k)
            batch = batch.take(pa.array(fresh, pa.int64()))
            text, offsets = utf8(batch.column(5))
            for first, last in runs(offsets):
                sets = _sets(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([x.tobytes() for x in sets], pa.binary()), part.columns[4]], ["node", "root", "copies", "blocks", "tokens", "block"])

    picked = rows.select("node", "root", "copies", "blocks", "block", "text")
    return picked.mapInArrow(run, "node long, root long, copies long, blocks long, tokens binary, block long")


def _told_apart(docs: DataFrame) -> DataFrame:
    """Documents are told apart by id and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, n_links) of each row of docs (doc_id, text, text_hash). Rows without words have no class."""
    rows = written(signatures(docs), "signatures")
    some = rows.where("n > 0").withColumn("document", F.xxhash64("doc_id", "text_hash"))
    nodes = some.groupBy("h1", "h2").agg(F.min(F.struct("row", "doc_id", "text_hash")).alias("own"), F.count_distinct("document").alias("copies"), F.first(F.struct("n", "keys", "sketch")).alias("s"))
    nodes = written(nodes.select("h1", "h2", F.col("own.row").alias("node"), F.col("own.doc_id").alias("own_id"), F.col("own.text_hash").alias("own_text"), "copies", "s.*"), "nodes")
    groups = written(components(proposals(nodes)), "groups")

    size = nodes.join(groups, "node").groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    members = nodes.select("node", "own_id", "own_text", "copies").join(groups, "node").join(written(size, "sizes"), "root")
    members = written(members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))), "members")
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_text"))
    sets = _with_sets(docs.join(members.hint("shuffle_hash"), same)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "tokens")
    judged = written(_verify(sets), "judged")

    links = judged.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(judged.where("b is not null").select("a", "b"))
    known = nodes.join(links, "node", "left").join(linked, "node", "left")
    known = written(known.select("h1", "h2", F.coalesce("root", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return rows.select("doc_id", "text_hash", "h1", "h2", "n").join(known, ["h1", "h2"], "left").select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links), a row per row of docs.

    n_links counts the other documents of similarity 0.8 or more, equal ones included; class_id is the least doc_id that
    links lead to. Documents are told apart by doc_id and text: rows of one doc_id with other texts are documents of their own,
    rows repeated whole are one. Null and empty texts have no set: their class is their own id, without links. A null doc_id
    is judged by its text like others; a class of null ids alone has a null class_id. Other columns are ignored; no rows give
    no rows.
    """
    found = settled(lambda: _classes(_told_apart(docs)), "class-rows")
    names = written(found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id")), "class-ids")
    return found.join(names, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each class: that of its least doc_id (null ids last), of several texts of this id the one of the least
    hash; of rows that repeat it whole the one whose columns hash least. A text without words is only a copy of rows of its own
    doc_id without words and with the same text. Columns are kept, whatever their names; no rows give no rows."""
    found = settled(lambda: _classes(_told_apart(docs)), "class-rows")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    kept = found.where("class is not null").groupBy("class").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    kept = written(kept.unionByName(found.where("class is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()), "kept-documents")
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    slim = docs.select(own.alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = slim.join(kept, F.col("own.id").eqNullSafe(F.col("_id")) & (F.col("own.hash") == F.col("_hash")), "left_semi")
    return held.groupBy("own").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
