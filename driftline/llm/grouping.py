"""Groups of rows across record batches, and connected components by joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, one batch a key, from batches whose rows come ordered by `keys` (integer columns)."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def close():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield close()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield close()


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row it is connected with."""
    n = len(linked)
    root = np.arange(n)
    adjacent = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(adjacent, root[None, :], n).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the least node of the connected component of every node that has an edge (a, b).

    Each round ties all neighbours of a node to the least one (first those above the node, then all), which shortens
    paths by about half; edges stay as many or fewer. Rounds are written to the shared folder. Nothing is collected but
    a count and a checksum. Paths of any length end after a few rounds more than the logarithm of their length; what isn't at
    its end after most_rounds is an error.
    """
    state, now = None, written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join has plain exchanges on both sides, whose hot nodes the engine can split
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        # large star: neighbours above a node go to its least neighbour
        up = written(now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # small star: a node and its lower neighbours go to the least of them
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        tied = up.join(low, "a")
        now = written(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
