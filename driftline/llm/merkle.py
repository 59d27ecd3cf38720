"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf; leaves of a language form a tree of eight children a node, and the trees' roots form one above them. A leaf's
place is found without a sort in one task: rows are range-partitioned, and a partition's rows are numbered on from what the
partitions before it hold. Trees are built in rounds of four levels: a task takes the nodes below one node four levels up.

Proofs are made by leaf partition: it works out which nodes its leaves' proofs need that don't follow from the leaves
themselves, the union of them is fetched by one join, the nodes between are derived again in the task, and each leaf's
own proof is written out from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouping import sorted_groups
from .shared import settled, written

#: Children of a node; levels that one round builds, and whose leaves are one leaf partition.
ARITY, ROUND = 8, 4
#: The tree whose leaves are the roots of the others.
TOP = -1
_SHIFT = ARITY.bit_length() - 1
_HEX = 64


def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def _field(column) -> F.Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text) -> F.Column:
    """Digest of a row of documents with this text."""
    return F.unhex(F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)).cast("binary"), 256))


def _nodes(digests: list[bytes]) -> list[bytes]:
    """The nodes above a row of nodes whose first stands at a multiple of ARITY."""
    return [_hash(b"".join(digests[k : k + ARITY])) for k in range(0, len(digests), ARITY)]


def numbered(rows: DataFrame) -> DataFrame:
    """rows (lang, doc_id, leaf, ...) with tree (place of lang among all), i (place of the row in its tree) and n (its tree's rows)."""
    order = ["lang", "doc_id", "leaf"]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered-leaves")
    # A row per partition and language: as many as partitions and languages together.
    shares = placed.groupBy("part", F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("part", "of", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    trees = placed.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", "n", (F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("tree"))
    shares = written(shares.join(trees, F.col("of").eqNullSafe(F.col("name"))).select(F.col("part").alias("own"), "of", "first", "before", "n", "tree"), "shares")
    both = placed.join(shares, (F.col("part") == F.col("own")) & F.col("lang").eqNullSafe(F.col("of")))
    return both.withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "own", "of", "first", "before")


def _climbed(nodes: DataFrame) -> DataFrame:
    """(tree, level, i, digest, n): the nodes of the ROUND levels above nodes (tree, level, i, digest, n), all of one level; n is the number of
    nodes of their level. A tree that comes to its root ends there."""
    block = F.shiftright("i", ROUND * _SHIFT)

    def run(batches):
        for group in sorted_groups(batches, ["tree", "block"]):
            tree, level, first, n = (group.column(k)[0].as_py() for k in (0, 2, 3, 5))
            digests, out = [x.hex().encode() for x in group.column(4).to_pylist()], []
            for _ in range(ROUND):
                if n == 1:
                    break
                digests, level, first, n = _nodes(digests), level + 1, first >> _SHIFT, (n + ARITY - 1) >> _SHIFT
                out += [(level, first + k, bytes.fromhex(x.decode()), n) for k, x in enumerate(digests)]
            if out:
                levels, places, values, sizes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(out), pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(values, pa.binary()), pa.array(sizes, pa.int64())], ["tree", "level", "i", "digest", "n"])

    dealt = nodes.select("tree", block.alias("block"), "level", "i", "digest", "n").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return dealt.mapInArrow(run, "tree long, level int, i long, digest binary, n long")


def _all_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (level 0) and all above them; a round for every ROUND levels of the largest tree."""
    out, level = nodes, 0
    while nodes.where("n > 1").limit(1).count():
        new = written(_climbed(nodes), "nodes")
        level += ROUND
        out, nodes = out.unionByName(new), new.where(F.col("level") == level)
    return out


@dataclass
class Manifest:
    """leaves (lang, doc_id, leaf, ..., tree, i, n), nodes (tree, level, i, digest, n) of all trees with the leaves at level 0, the number of
    trees, and the root as hex text (None without leaves)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """The trees over rows (lang, doc_id, leaf, and columns to keep). Rows of a tree go by doc_id, null first; equal ones by digest."""
    leaves = settled(lambda: numbered(rows), "leaves")
    nodes = _all_nodes(leaves.select("tree", F.lit(0).alias("level"), "i", F.col("leaf").alias("digest"), "n"))
    # a root per language
    tops = written(nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("i"), "digest"), "tops")
    trees = tops.count()
    above = _all_nodes(tops.withColumn("n", F.lit(trees).cast("long")))
    root = above.where("n = 1").select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, nodes.unionByName(above), trees, root[0] if root else None)


def missing(known: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of n leaves, the places of the nodes that the proofs of the leaves `known` (sorted) need and that don't follow
    from these leaves and the missing nodes below."""
    out = []
    while n > 1:
        above = np.unique(known >> _SHIFT)
        children = (above[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(children[children < n], known))
        known, n = above, (n + ARITY - 1) >> _SHIFT
    return out


class _Derived:
    """The part of a tree above some leaves, from their digests and the fetched nodes: the children of each node, as one text."""

    def __init__(self, known: dict[int, bytes], fetched: dict[int, dict[int, bytes]], n: int):
        self.runs: list[dict[int, bytes]] = []
        level = 0
        while n > 1:
            nodes = fetched.get(level, {}) | known
            above = sorted({i >> _SHIFT for i in known})
            runs = {r: b"".join(nodes[c] for c in range(r * ARITY, min(r * ARITY + ARITY, n))) for r in above}
            self.runs.append(runs)
            known, n, level = {r: _hash(x) for r, x in runs.items()}, (n + ARITY - 1) >> _SHIFT, level + 1
        (self.root,) = known.values()
        self._above: dict[tuple[int, int], bytes] = {}

    def siblings(self, level: int, i: int) -> bytes:
        at, run = (i % ARITY) * _HEX, self.runs[level][i >> _SHIFT]
        return run[:at] + run[at + _HEX :]

    def proof(self, i: int, level: int = 0) -> bytes:
        """Siblings of node i and of all nodes above it; what lies above a node is put together once."""
        if level == len(self.runs):
            return b""
        key = (level + 1, i >> _SHIFT)
        if key not in self._above:
            self._above[key] = self.proof(i >> _SHIFT, level + 1)
        return self.siblings(level, i) + self._above[key]

    def folded(self, i: int, digest: bytes) -> bytes:
        """The root that follows from this digest as leaf i."""
        for runs in self.runs:
            at, run = (i % ARITY) * _HEX, runs[i >> _SHIFT]
            digest, i = _hash(run[:at] + digest + run[at + _HEX :]), i >> _SHIFT
        return digest


def _wanted(leaves: DataFrame, trees: int) -> DataFrame:
    """(own_tree, block, tree, level, i): the nodes that each leaf partition has to fetch."""

    def run(batches):
        for group in sorted_groups(batches, ["tree", "block"]):
            tree, block, n = (group.column(k)[0].as_py() for k in (0, 1, 3))
            both = [(tree, missing(group.column(2).to_numpy(), n)), (TOP, missing(np.array([tree]), trees))]
            out = [(of, level, int(i)) for of, levels in both for level, places in enumerate(levels) for i in places]
            if out:
                of, levels, places = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(out), pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array(of, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64())], ["own_tree", "block", "tree", "level", "i"])

    dealt = leaves.select("tree", "block", "i", "n").repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
    return dealt.mapInArrow(run, "own_tree long, block long, tree long, level int, i long")


def proofs(made: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of these leaves (rows of made.leaves; all by default), which may carry
    a binary column `claimed`: the digest to be checked in place of the leaf, null for the leaf itself."""
    leaves = made.leaves if leaves is None else leaves
    if "claimed" not in leaves.columns:
        leaves = leaves.withColumn("claimed", F.lit(None).cast("binary"))
    leaves = leaves.withColumn("block", F.shiftright("i", ROUND * _SHIFT))
    fetched = _wanted(leaves, made.trees).join(made.nodes, ["tree", "level", "i"]).select(F.col("own_tree"), "block", F.lit(0).alias("kind"), "tree", "level", "i", "digest", "n", F.lit(None).cast("binary").alias("claimed"), F.lit(None).cast("long").alias("doc_id"))
    own = leaves.select(F.col("tree").alias("own_tree"), "block", F.lit(1).alias("kind"), "tree", F.lit(0).alias("level"), "i", F.col("leaf").alias("digest"), "n", "claimed", "doc_id")
    root, trees = made.root, made.trees

    def run(batches):
        for group in sorted_groups(batches, ["own_tree", "block"]):
            c = {name: group.column(k).to_pylist() for k, name in enumerate(group.schema.names)}
            first = c["kind"].index(1)  # fetched nodes come before the leaves
            tree, n = c["own_tree"][0], c["n"][first]
            fetched: dict = {tree: {}, TOP: {}}
            for k in range(first):
                fetched[c["tree"][k]].setdefault(c["level"][k], {})[c["i"][k]] = c["digest"][k].hex().encode()
            digests = {i: x.hex().encode() for i, x in zip(c["i"][first:], c["digest"][first:], strict=True)}
            below = _Derived(digests, fetched[tree], n)
            above = _Derived({tree: below.root}, fetched[TOP], trees)
            to_root, out = above.proof(tree), []
            for k in range(first, len(c["i"])):
                i = c["i"][k]
                folded = above.root if c["claimed"][k] is None else above.folded(tree, below.folded(i, c["claimed"][k].hex().encode()))
                folded = folded.decode()
                out.append((c["doc_id"][k], digests[i].decode(), below.root.decode(), root, sha256(below.proof(i) + to_root).hexdigest(), folded, folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    dealt = fetched.unionByName(own).repartition("own_tree", "block").sortWithinPartitions("own_tree", "block", "kind", "tree", "level", "i")
    return dealt.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row per row of documents.

    Where 3 divides the crc32 of the decimal doc_id, the leaf that is checked is that of the row with A-Z of its text in lower case.
    Nulls have a sign of their own in a leaf; a null lang is a tree of its own, before the others; null ids come first and
    are never tampered with; repeated rows are leaves each; rows of one doc_id go by their digests; extra columns aren't part of a leaf; an
    empty table gives no rows. A text is hashed by the engine; past that a row takes about a hundred bytes.
    """
    text = F.col("text").cast("string")
    tampered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")), F.col("n_chars").cast("long").alias("n_chars"))
    # written, so that texts are hashed once and not again when ranges are sampled
    hashed = settled(lambda: rows.select("lang", "doc_id", leaf_hash(text).alias("leaf"), F.when(chosen, leaf_hash(tampered)).alias("claimed")), "row-digests")
    return proofs(manifest(hashed))


_LEAF = "sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen({0}) || ':' || {0}, '-'))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of the decimal id, bit by bit: the engine that runs this has no such function.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT)))"


def _levels_sql(name: str, base: str, tree: str) -> str:
    """A leaf goes up one level a step: `run` is the text of its node's siblings with itself."""
    over = f"OVER (PARTITION BY {tree}, pos // 8 ORDER BY pos, leaf_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""{name} AS (SELECT * FROM {base} UNION ALL
SELECT id, lang, lang_no, leaf_no, pos // 8, first AND pos % 8 = 0, sha256(run), proof || substr(run, 1, 64 * (pos % 8)) || substr(run, 64 * (pos % 8) + 65), sha256(substr(run, 1, 64 * (pos % 8)) || folded || substr(run, 64 * (pos % 8) + 65)), level + 1
FROM (SELECT *, string_agg(digest, '') FILTER (first) {over} AS run, count(*) FILTER (first) OVER (PARTITION BY {tree}) AS nodes FROM {name}) WHERE nodes > 1)"""


ORACLE_SQL = f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_LEAF.format('text')} AS leaf, CASE WHEN (xor({_CRC}, 4294967295)) % 3 = 0 THEN {_LEAF.format(_LOWER)} END AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS leaf_no, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_no FROM leaves),
start AS (SELECT id, lang, lang_no, leaf_no, leaf_no AS pos, true AS first, leaf AS digest, '' AS proof, coalesce(claimed, leaf) AS folded, 0 AS level FROM placed),
{_levels_sql('below', 'start', 'lang_no')},
tops AS (SELECT id, lang, lang_no, leaf_no, lang_no AS pos, leaf_no = 0 AS first, digest, proof, folded, 0 AS level FROM below QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
{_levels_sql('above', 'tops', '1')},
ends AS (SELECT * FROM above QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT doc_id, leaf, tops.digest AS subroot, ends.digest AS root, sha256(ends.proof) AS proof_sha256, ends.folded AS folded_root, ends.folded = ends.digest AS verified FROM placed JOIN tops USING (id) JOIN ends USING (id)"""
