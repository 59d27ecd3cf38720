"""Removal of repeated passages, byte for byte, from a sampled suffix array.

A passage of WIDTH bytes picks one of its own bytes as anchor: the one where the hash of the GRAM bytes that follow is least.
Equal passages pick the same anchor, so only suffixes that start at anchors (one byte in about eighty) are sorted, and
passages can only be equal if their anchors' grams are. What lies around an anchor, as far as its passages reach, is its context.

Equal contexts are one entry of the array that stands for all its places; such an entry is a repeat by itself. The entries of
a gram are sorted; a stack scan over the common prefixes of neighbours gives the tree of right-maximal intervals. The members
of each interval are sorted by what precedes them, and a second scan gives the intervals whose left extensions differ: a maximal
repeat with all its occurrences for each pair of the two.

A gram with too many entries for one task is parted: its passages by how far before the anchor they start, in ranges. Passages
of one range have a longer core around the anchor in common, so a part holds the entries of one core, and is sorted and scanned like
any other. A part that is still too large goes down to one start each, where the core is the whole passage and a part one group of
equal passages. Parts give the same repeats as the gram as a whole.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _power_tables, mixed, runs, utf8
from .grouping import sorted_groups
from .shared import settled, written

WIDTH, GRAM = 200, 40
#: Entries of a group that one task sorts; a larger one is parted into ranges of RANGE starts, then into single ones.
SORTED, RANGE = 8192, 13


def anchors(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, document, anchor, first passage, last passage) of every anchor, places in `text`.

    A context reaches from the first passage's start to the last one's end. Memory: about a hundred times the text.
    """
    n, reach = len(text), WIDTH - GRAM + 1
    if n < WIDTH:
        return tuple(np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = np.uint64(n.bit_length())
    m = len(gram)
    padded = np.full(-(-m // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = (gram >> bits << bits) | np.arange(m, dtype=np.uint64)
    rows = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - reach + 1], ahead[reach - 1 : m])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts, last = offsets[:-1], offsets[1:] - WIDTH
    some = last >= starts
    change = np.zeros(n + 1, np.int8)
    change[starts[some]] += 1
    change[last[some] + 1] -= 1
    place = np.flatnonzero(np.cumsum(change[: n - WIDTH + 1]) > 0)
    if not len(place):
        return tuple(np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    at = chosen[place]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1))
    lo, hi = place[np.append(0, cut + 1)], place[np.append(cut, len(place) - 1)]
    at = at[np.append(0, cut + 1)]
    end = hi + WIDTH
    spans = mixed((total[end] - total[lo]) * inverse[lo] + (end - lo).astype(np.uint64))
    context = mixed(spans ^ mixed((at - lo).astype(np.uint64)))
    return gram[at], context, np.searchsorted(offsets, lo, "right") - 1, at, lo, hi


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _placed(docs: DataFrame) -> DataFrame:
    """(key, ctx, doc_id, text_hash, at, lo, hi) of every anchor, places in the document."""

    def run(batches):
        for batch in batches:
            text, offsets = utf8(batch.column(2))
            for first, last in runs(offsets):
                own = offsets[first : last + 1] - offsets[first]
                key, ctx, of, at, lo, hi = anchors(text[offsets[first] : offsets[last]], own)
                pick = pa.array(of + first)
                start = own[of]
                yield pa.RecordBatch.from_arrays(
                    [_long(key), _long(ctx), batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array((x - start).astype(np.int32)) for x in (at, lo, hi))],
                    ["key", "ctx", "doc_id", "text_hash", "at", "lo", "hi"],
                )

    return docs.mapInArrow(run, "key long, ctx long, doc_id long, text_hash long, at int, lo int, hi int")


def _squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, z): texts compressed for the way to other tasks."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([squeeze(x.as_buffer()) for x in batch.column(2).cast(pa.binary())], pa.binary())], ["doc_id", "text_hash", "z"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, z binary")


def _same(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash"))


_CONTEXT = "key long, ctx long, n long, doc_id long, text_hash long, at int, shift int, before binary, after binary"


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted anchor: `before` backwards from it, `after` onwards; shift: from the last passage to it."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        names = [x.split()[0] for x in _CONTEXT.split(", ")]
        for batch in batches:
            rows = []
            for doc, text_hash, z, each in zip(*(batch.column(k) for k in range(4)), strict=True):
                text, doc, text_hash = unpack(z.as_buffer()), doc.as_py(), text_hash.as_py()
                for w in each.as_py():
                    at, lo, hi = w["at"], w["lo"], w["hi"]
                    rows.append((w["key"], w["ctx"], w["n"], doc, text_hash, at, at - hi, text[lo:at][::-1], text[at : hi + WIDTH]))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    by_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "ctx", "n", "at", "lo", "hi")).alias("each"))
    joined = docs.alias("d").join(by_doc.alias("w").hint("shuffle_hash"), _same("d", "w")).select("d.doc_id", "d.text_hash", "d.z", "w.each")
    return joined.mapInArrow(run, _CONTEXT)


_TYPES = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # x[:lo] == y[:lo], x[:hi] != y[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(prefixes: list[int]):
    """(common prefix, first, last, parent's common prefix) of the interval tree of a sorted list of suffixes, from the common
    prefixes of neighbours, by one scan with a stack."""
    stack: list[tuple[int, int]] = []  # (common prefix, first)
    for k, h in enumerate([*prefixes, 0]):
        first = k
        while stack and stack[-1][0] > h:
            top, first = stack.pop()
            yield top, first, k, max(h, stack[-1][0] if stack else 0)
        if h and (not stack or stack[-1][0] < h):
            stack.append((h, first))


def maximal_repeats(before: list[bytes], after: list[bytes], width: int = WIDTH):
    """(bytes before, bytes after, members) of every maximal repeat of at least `width` bytes around the anchors of several contexts:
    `before` runs backwards from the anchor, `after` onwards.

    The members are an interval of the suffixes and, among these, one in order of what precedes them. Left- and right-maximal: their
    extensions differ on both sides (a smaller left interval may have more in common on the right: a deeper interval has that one).
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    farthest = max(map(len, before))
    rank = [0] * len(before)
    for place, x in enumerate(sorted(range(len(before)), key=before.__getitem__)):
        rank[x] = place
    for h, first, last, _ in intervals([common(after[x], after[y]) for x, y in zip(order, order[1:], strict=False)]):
        if h + farthest < width:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [common(before[x], before[y]) for x, y in zip(members, members[1:], strict=False)]
        whole = [(0, 0, len(members) - 1, 0)] if 0 in shared else []  # the root, which the scan doesn't give
        for left, low, high, _ in chain(whole, intervals(shared)):
            own = members[low : high + 1]
            if left + h >= width and _extensions_differ(before, own, left) and _extensions_differ(after, own, h):
                yield left, h, own


def _extensions_differ(contexts: list[bytes], members: list[int], size: int) -> bool:
    """Whether the bytes that follow the common ones aren't all the same; a context's end is like no other."""
    seen = {contexts[x][size : size + 1] for x in members}
    return len(seen) > 1 or seen == {b""}


def _rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(named), named, strict=True)], [n for n, _ in named])


_GROUP = "group long, key long, ctx long, doc_id long, text_hash long, at int, left int, right int"


def _grouped(contexts: DataFrame, by: str, widest: bool = False) -> DataFrame:
    """Members of the maximal repeats of each group of entries. `group` numbers a repeat: by its bytes, so that parts of one gram
    that find the same repeat agree. Repeats can lie in each other, each with all its members; if only the `widest` reach of an entry to
    either side is wanted, an entry is one row at most, without a number."""

    def run(batches):
        rows: list[tuple] = []
        for group in sorted_groups(batches, [by]):
            keys, ctx, doc, text_hash, at = (group.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            before, after = ([x.as_py() for x in group.column(k)] for k in (7, 8))
            reach: dict[int, tuple[int, int]] = {}
            for left, right, members in maximal_repeats(before, after):
                if widest:
                    for x in members:
                        far = reach.get(x, (0, 0))
                        reach[x] = max(far[0], left), max(far[1], right)
                    continue
                x = members[0]
                number = int.from_bytes(hashlib.blake2b(before[x][:left][::-1] + after[x][:right], digest_size=8).digest(), "little", signed=True)
                rows += [(number, keys[x], ctx[x], doc[x], text_hash[x], at[x], left, right) for x in members]
                if len(rows) > 20_000:
                    yield _rows_of(rows, _GROUP)
                    rows = []
            rows += [(None, keys[x], ctx[x], doc[x], text_hash[x], at[x], *far) for x, far in reach.items()]
            if len(rows) > 20_000:
                yield _rows_of(rows, _GROUP)
                rows = []
        yield _rows_of(rows, _GROUP)

    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    dealt = contexts.select(*dict.fromkeys([*names, by])).repartition(by).sortWithinPartitions(by)
    return dealt.mapInArrow(run, _GROUP)


def _parted(contexts: DataFrame, width: int) -> DataFrame:
    """The entries of large groups, once for each range of `width` starts: their columns, `near` (the range's first start, counted back
    from the anchor) and `core`, a hash of the bytes that all passages of the range share. Without bytes where a start is alone."""
    schema = f"{_CONTEXT}, near long, core long"
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(k).to_pylist() for k in range(len(names))), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                own, (low, high) = values[:-2], values[-2:]
                before, after = own[-2], own[-1]
                for near in range(low, high, width):
                    far = min(near + width, high) - 1
                    if len(before) >= near and len(after) >= WIDTH - far:
                        core = hashlib.blake2b(b"%d,%d,%d:" % (own[0], near, far) + before[:near][::-1] + after[: WIDTH - far], digest_size=8).digest()
                        rows.append((*(own if width > 1 else (*own[:-2], None, None)), near, int.from_bytes(core, "little", signed=True)))
                if len(rows) > 5000:
                    yield _rows_of(rows, schema)
                    rows = []
            yield _rows_of(rows, schema)

    return contexts.select(*names, "low", "high").mapInArrow(run, schema)


def repeat_groups(docs: DataFrame, sorted_most: int = SORTED, widest: bool = False) -> DataFrame:
    """(group, key, ctx, doc_id, text_hash, at, left, right): the members of every maximal repeat around an anchor, each an entry
    that stands for all places of its context; the repeat's bytes are [at - left, at + right). Documents are (doc_id, text_hash, text).
    With `widest` a group of entries tells of each only how far its repeats reach to either side."""
    places = _placed(docs)
    keys = written(places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "gram-keys")
    met = written(places.join(keys.hint("shuffle_hash"), "key"), "anchors")
    place = F.struct("doc_id", "text_hash", "at", "lo", "hi")
    each = written(met.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")).select("key", "ctx", "n", "p.*"), "contexts")
    whole = written(each.where("n > 1").select("key", "ctx"), "repeated-contexts")
    # an entry of several places is a repeat from end to end: its passages' context
    out = met.join(whole.hint("shuffle_hash"), ["key", "ctx"]).select(F.col("ctx").alias("group"), "key", "ctx", "doc_id", "text_hash", "at", (F.col("at") - F.col("lo")).alias("left"), (F.col("hi") + WIDTH - F.col("at")).alias("right"))

    sizes = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "grams")
    wanted = each.join(sizes.select("key").hint("shuffle_hash"), "key")
    contexts = written(_contexts(_squeezed(docs), wanted), "context-bytes").join(sizes.hint("shuffle_hash"), "key")
    out = out.unionByName(_grouped(contexts.where(F.col("size") <= sorted_most), "key", widest))
    large = written(contexts.where(F.col("size") > sorted_most).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(WIDTH - GRAM + 1).cast("long")}), "large-grams")
    if large.isEmpty():
        return out
    parts = written(_parted(large, RANGE), "parts")
    sizes = written(parts.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "part-sizes")
    parts = parts.join(sizes.hint("shuffle_hash"), "core")
    out = out.unionByName(_grouped(parts.where(F.col("size") <= sorted_most), "core", widest))
    large = written(parts.where(F.col("size") > sorted_most).drop("core", "size").withColumns({"low": F.col("near"), "high": F.least(F.col("near") + RANGE, F.lit(WIDTH - GRAM + 1))}).drop("near"), "large-parts")
    if large.isEmpty():
        return out
    single = written(_parted(large, 1), "single-starts")
    twice = written(single.groupBy("core").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "equal-passages")
    equal = single.join(twice.hint("shuffle_hash"), "core")
    return out.unionByName(equal.select(F.col("core").alias("group"), "key", "ctx", "doc_id", "text_hash", "at", F.col("near").cast("int").alias("left"), (WIDTH - F.col("near")).cast("int").alias("right")))


def repeats_with_places(docs: DataFrame) -> DataFrame:
    """(group, length, doc_id, text_hash, start): every place of every maximal repeat that lies around an anchor, start in bytes.
    Documents are (doc_id, text_hash, text)."""
    groups = settled(lambda: repeat_groups(docs), "repeat-groups").select("group", "key", "ctx", "left", "right").distinct()
    met = _placed(docs).join(groups.hint("shuffle_hash"), ["key", "ctx"])
    return met.select("group", (F.col("left") + F.col("right")).alias("length"), "doc_id", "text_hash", (F.col("at") - F.col("left")).alias("start")).distinct()


def repeat_spans(docs: DataFrame, sorted_most: int = SORTED) -> DataFrame:
    """(doc_id, text_hash, from, to): stretches of repeated passages of documents (doc_id, text_hash, text); they can overlap. All repeats
    around one anchor overlap at it, so they make one stretch. (Entries of several places are repeats as a whole, at all of them.)"""
    by_anchor = repeat_groups(docs, sorted_most, widest=True).groupBy("doc_id", "text_hash", "at").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return by_anchor.select("doc_id", "text_hash", (F.col("at") - F.col("left")).alias("from"), (F.col("at") + F.col("right")).alias("to"))


def suffix_dedup(docs: DataFrame, sorted_most: int = SORTED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row per row of docs.

    Each byte of a passage of WIDTH bytes that starts anywhere else too, in the same or another document, is removed;
    n_spans counts the maximal removed stretches, kept is what remains, as bytes. Null text counts as empty; texts shorter than
    WIDTH lose nothing; repeated rows are copies of each other and lose all passages; a null doc_id is carried; other columns
    are ignored; an empty table gives no rows.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = settled(lambda: repeat_spans(docs, sorted_most), "repeat-spans")
    by_doc = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for z, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = unpack(z.as_buffer())
                kept, end, removed, n = [], 0, 0, 0
                for x in spans.as_py() or ():
                    lo, hi = x["from"], x["to"]
                    if lo > end or not n:
                        kept.append(text[end:lo])
                        n += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                kept.append(text[end:])
                rest = b"".join(kept)
                rows.append((len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = _squeezed(docs).alias("d").join(by_doc.alias("s").hint("shuffle_hash"), _same("d", "s"), "left").select("d.doc_id", "d.z", "s.spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
