"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code.

Format (a Parquet table of blocks, written by Spark's committer, so a retried task leaves nothing behind):
one row per block of whole documents, blocks and the documents in them in ascending doc_id order (rows of one doc_id by a
hash of their ids).

  shard, block      position of the block; shards are ascending ranges of doc_id
  start             ids of the shard that stand before the block
  doc_ids, lengths  one entry per document
  control           two bits per id, four ids to a byte, lowest bits first: bytes of its code less one
  payload           the codes, little-endian, end to end

A code is the id's rank by frequency in the whole corpus (0 = most frequent, ties by id), so that most ids
take one byte. `ranks` holds the id of every rank; it has at most as many rows as the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import utf8
from .shared import new_path, written
from .tokenizing import default_path, encoded, encoder

#: Ids in a block (a longer document is a block of its own), and in a shard.
BLOCK_IDS, SHARD_IDS = 1 << 18, 8_000_000
#: Shards whose totals are summed as one group: running totals go within groups and over the groups' sums.
GROUP = 1024

#: Bytes of the four codes that a control byte tells of.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


@dataclass
class TokenFiles:
    blocks: str
    ranks: str


def packed(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control, payload) of non-negative codes under 2**32."""
    sizes = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    as_bytes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), as_bytes[np.arange(4) < sizes[:, None]].tobytes()


def unpacked(control: bytes, payload: bytes, n: int) -> np.ndarray:
    """The n codes; each control byte's four sizes come from a table."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(3, np.uint8)])
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokens(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian integers of the encoder's width. Null text counts as empty."""

    def run(batches):
        for rest, ids, at in encoded(batches, tokenizer, end_id):
            keys = rest.column(0)
            rows = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at), pa.int64()), rows], ["doc_id", "n_tokens", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(rows: DataFrame, vocabulary: int, width: int) -> DataFrame:
    """(token_id, n) over all rows: each task counts into one array, then one row per id and task is summed."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(utf8(batch.column(0))[0].view(f"<u{width}"), minlength=vocabulary)  # all rows' ids end to end
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token_id", "n"])

    return rows.select("ids").mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes the whole text of every document and writes the files.

    Null and empty texts hold end_id alone; rows whose doc_id is null come first; repeated doc_ids keep all their
    rows, in the order of a hash of their ids, by which shards can part them; other columns are ignored; an empty table gives files without blocks.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    width, vocabulary = enc.dtype.itemsize, max(enc.vocabulary, (end_id or 0) + 1)
    rows = written(tokens(docs, tokenizer, end_id, id_col, text_col), "token-rows")

    counts = id_counts(rows, vocabulary, width).toPandas()  # at most one row per id of the vocabulary
    order = counts.sort_values(["n", "token_id"], ascending=[False, True])["token_id"].to_numpy(np.int64)
    order = np.concatenate([order, np.setdiff1d(np.arange(vocabulary), order)])
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[order] = np.arange(vocabulary, dtype=np.uint32)
    total = int(counts["n"].sum())
    shards = max(1, -(-total // SHARD_IDS))

    def code(batches):
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        keys, parts, sizes = [], [], []

        def flush():
            nonlocal block, start
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            control, payload = packed(rank_of[ids])
            out = pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "start": start, "doc_ids": list(keys), "lengths": list(sizes), "control": control, "payload": payload}], schema)
            block, start = block + 1, start + len(ids)
            keys.clear(), parts.clear(), sizes.clear()
            return out

        held = 0
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), f"<u{width}")
                if keys and held + len(ids) > BLOCK_IDS:
                    yield flush()
                    held = 0
                keys.append(key), parts.append(ids), sizes.append(len(ids))
                held += len(ids)
        if keys:
            yield flush()

    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("payload", pa.binary())])
    ordered = rows.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ranged = ordered.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ranged.drop("tie").mapInArrow(code, "shard long, block long, start long, doc_ids array<long>, lengths array<long>, control binary, payload binary")
    files = TokenFiles(new_path(spark, "token-blocks"), new_path(spark, "token-ranks"))
    blocks.write.option("compression", "zstd").parquet(files.blocks)
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(order)], "rank long, token_id long").coalesce(1).write.parquet(files.ranks)
    return files


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone: start counts the ids of all documents before it, ids
    are little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(files.blocks)
    id_of = np.array([x[1] for x in sorted(map(tuple, spark.read.parquet(files.ranks).collect()))], "<u4")  # one per id of the vocabulary

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ids = id_of[unpacked(row["control"], row["payload"], int(sizes.sum()))]
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(sizes), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + at[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.tobytes())]),
                    ],
                    ["shard", "doc_id", "in_shard", "n_tokens", "ids"],
                )

    read = blocks.mapInArrow(decode, "shard long, doc_id long, in_shard long, n_tokens long, ids binary")
    starts = written(_shard_starts(blocks), "shard-starts")  # a table whose size is known before the ids are read
    return read.join(starts, "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before each. Only the groups' sums, a row per GROUP shards, meet in one task."""
    per = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).withColumn("g", F.expr(f"shard div {GROUP}"))
    earlier = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = per.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(earlier("g")), F.lit(0)).alias("group_before"))
    within = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per.join(groups, "g").select("shard", (F.col("group_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
