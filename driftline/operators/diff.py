"""Differences between two versions of line tables, and of whole texts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.urls import once

#: Changed lines shown; steps (places on diagonals) of a diff, beyond which only counts of lines are compared.
HUNK_LINES, DIFF_BUDGET = 30, 20_000_000
#: Equal pairs for each line up to which chains of pairs are built: a part's memory stays linear in its lines.
CHAINED = 32
#: Characters of a line that hunks show; of both versions that a task compares before it hands on what it has.
LINE_CHARS, PART_CHARS = 180, 1 << 20


def line_array(text: Column) -> Column:
    """The lines of a text: any line end parts lines, a last one starts no line, an empty text has none."""
    kept = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return once(F.split(text, r"\r\n|\r|\n"), kept)


def lines_of(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line), line_no from 0, of the lines of each text."""
    return df.select(*keys, F.posexplode(line_array(F.col(text))).alias("line_no", "line"))


def version_pairs(snapshots: DataFrame, keys: list[str], at: str = "at", hash_: str = "hash") -> DataFrame:
    """Each snapshot whose hash differs from the one before it of the same key, with that one's hash and time as prev_*."""
    w = Window.partitionBy(*keys).orderBy(at)
    both = snapshots.withColumn("prev_hash", F.lag(hash_).over(w)).withColumn("prev_at", F.lag(at).over(w))
    return both.where(F.col("prev_hash").isNotNull() & (F.col("prev_hash") != F.col(hash_)))


def ticking_lines(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, masked_line): lines of tables (key, line_no, line) that differ only in numbers, where both have as many lines."""
    sizes = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    same = sizes(old, "a").join(sizes(new, "b"), key).where("a = b").select(key)
    pairs = old.join(new.withColumnRenamed("line", "new_line"), [key, "line_no"]).where("line <> new_line")
    pairs = pairs.select(key, F.struct("line", "new_line").alias("p"))
    # both masks in one expression over an array: a condition on columns of masks would work them out once more
    masks = F.transform(F.array("p"), lambda p: F.struct(t.mask_numbers(p["line"]).alias("masked_line"), t.mask_numbers(p["new_line"]).alias("new_mask")))
    equal = pairs.select(key, F.inline(F.filter(masks, lambda m: m["masked_line"] == m["new_mask"]))).select(key, "masked_line").distinct()
    return equal.join(same, key, "left_semi")


def numeric_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, numeric_only): whether all lines that differ, one at least, differ only in numbers."""
    both = old.join(new.withColumnRenamed("line", "new_line"), [key, "line_no"], "full")
    differs = ~F.col("line").eqNullSafe(F.col("new_line"))
    masked = F.coalesce(t.mask_numbers(F.col("line")) == t.mask_numbers(F.col("new_line")), F.lit(False))
    return both.groupBy(key).agg((F.bool_and(~differs | masked) & F.bool_or(differs)).alias("numeric_only"))


def paired(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, line_nos, old, new): tables (key, line_no, line) as one row a key, with the lines of both in order. They meet in one shuffle."""
    side = lambda df, is_new: df.select(key, F.lit(is_new).alias("is_new"), F.col("line_no").cast("long").alias("line_no"), "line")
    lines = lambda is_new: F.array_sort(F.collect_list(F.when(F.col("is_new") == is_new, F.struct("line_no", "line"))))
    both = side(old, False).unionByName(side(new, True)).groupBy(key).agg(lines(False).alias("a"), lines(True).alias("b"))
    return both.select(key, F.col("a.line_no").alias("line_nos"), F.col("a.line").alias("old"), F.col("b.line").alias("new"))


def _with_masks(pairs: DataFrame, *kept: str) -> DataFrame:
    """pairs(kept, old, new) of arrays of lines with gone and fresh: a digest of the mask of each different line that the other version lacks,
    in order; null for a line without numbers. Lines are bytes: to align them only their equality counts."""
    digest = lambda x: once(t.mask_numbers(x), lambda m: F.when(m != x, F.unhex(F.md5(m))))
    masks = lambda lines, other: F.transform(F.array_except(lines, other), digest)
    lines = [F.col(c).cast("array<binary>").alias(c) for c in ("old", "new")]
    return pairs.select(*kept, *lines, masks("old", "new").alias("gone"), masks("new", "old").alias("fresh"))


def _aligned(old: list | None, new: list | None, gone: list | None, fresh: list | None) -> list:
    """The lines of old, each one that new lacks replaced by its next line of new of the same mask that old lacks, if any."""
    if not gone or not fresh:
        return old or []
    lacking = lambda lines, other, masks: dict(zip(dict.fromkeys(x for x in lines if x not in other), masks, strict=True))
    gone_masks, fresh_masks = lacking(old, set(new), gone), lacking(new, set(old), fresh)
    waiting: dict = {}
    for line in reversed(new):
        if (mask := fresh_masks.get(line)) is not None:
            waiting.setdefault(mask, []).append(line)
    same = lambda line: waiting.get(gone_masks.get(line))
    return [found.pop() if (found := same(line)) else line for line in old]


def _aligned_batches(batches):
    """Batches (kept, old) of rows (kept, old, new, gone, fresh). Rows go out once they make up PART_CHARS."""
    import pyarrow as pa

    for batch in batches:
        rows, size, first = [], 0, 0
        for k, row in enumerate(zip(*batch.columns[-4:], strict=True)):
            rows.append(_aligned(*(x.as_py() for x in row)))
            size += sum(len(line or b"") for line in rows[-1])
            if size > PART_CHARS or k == batch.num_rows - 1:
                own = [c.slice(first, len(rows)) for c in batch.columns[:-4]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.binary()))], [*batch.schema.names[:-4], "old"])
                rows, size, first = [], 0, k + 1


def align_pairs(pairs: DataFrame, *kept: str) -> DataFrame:
    """pairs(kept, old, new) of arrays of lines -> (kept, old): old lines, each one that the new version lacks replaced by its next new line of
    the same mask, if any. Both versions of a page stand in one row: nothing is shuffled."""
    masked = _with_masks(pairs, *kept)
    aligned = masked.mapInArrow(_aligned_batches, masked.select(*kept, "old").schema)
    return aligned.select(*kept, F.col("old").cast("array<string>").alias("old"))


def align_numbers(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Lines of the old table, each one that the new version lacks replaced by its next new line of the same mask, if any."""
    rows = align_pairs(paired(old, new, key), key, "line_nos").select(key, F.explode(F.arrays_zip("line_nos", "old")).alias("l"))
    return rows.select(key, F.col("l.line_nos").cast(old.schema["line_no"].dataType).alias("line_no"), F.col("l.old").alias("line"))


def line_diff_multiset(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, line, n): how many more times a line stands in one version than in the other."""
    count = lambda df, n: df.groupBy(key, "line").agg(F.count(F.lit(1)).alias(n))
    both = count(old, "a").join(count(new, "b"), [key, "line"], "full").withColumn("d", F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0)))
    return both.where("d <> 0").select(key, F.when(F.col("d") > 0, "+").otherwise("-").alias("op"), "line", F.abs("d").alias("n"))


def split_lines(text: str | None) -> list[str]:
    """Lines of a text: any line end parts them, a last one starts no line, an empty text has none."""
    lines = re.split(r"\r\n|\r|\n", text or "")
    return lines[:-1] if lines[-1] == "" else lines


def _chained(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of short runs of equal pairs. Each line of x is put, at all its places in y from the last
    on, behind the longest chain that ends before them; only the ends of the best chains are looked at."""
    at: dict[int, list[int]] = {}
    for j, line in enumerate(y.tolist()):
        at.setdefault(line, []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []  # of each length the chain whose end is least: (i, j, chain before)
    for i, line in enumerate(x.tolist()):
        for j in reversed(at.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _reach(far: np.ndarray, ks: np.ndarray, at: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The furthest lines of x on the diagonals ks with one change more: from a neighbouring diagonal, then along equal lines. x and y end
    in a line that nothing equals; what would leave the table is far below zero."""
    n, m = len(x) - 1, len(y) - 1
    right, down = far[at + ks - 1] + 1, far[at + ks + 1]
    out = np.maximum(np.where(right <= n, right, _NOWHERE), np.where(down - ks <= m, down, _NOWHERE))
    on = np.flatnonzero(out >= 0)
    while len(on):
        i = out[on]
        on = on[x[i] == y[i - ks[on]]]
        out[on] += 1
    return out


_NOWHERE = -(1 << 40)


def _middle(x: np.ndarray, y: np.ndarray, budget: int) -> tuple[tuple[int, int] | None, int]:
    """(a place on a shortest script from x to y with changes on both sides of it, or None if that takes more than `budget` steps; steps).

    Scripts grow from both ends, all diagonals at once, until one from the front meets one from the back; no more is held than the
    furthest place on each diagonal. x and y share neither their first nor their last line, and neither is empty."""
    n, m = len(x), len(y)
    at, delta, steps = n + m + 1, n - m, 0
    ends = (np.append(x, -1), np.append(y, -2)), (np.append(x[::-1], -1), np.append(y[::-1], -2))
    far = [np.full(2 * (n + m) + 3, _NOWHERE, np.int64) for _ in range(2)]
    far[0][at + 1] = far[1][at + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        low = -d if d <= m else -m + (d - m) % 2
        high = d if d <= n else n - (d - n) % 2
        ks = np.arange(low, high + 1, 2)
        for side in range(2):
            steps += len(ks)
            if steps > budget:
                return None, steps
            got = _reach(far[side], ks, at, *ends[side])
            far[side][at + ks] = got
            if (delta - side) % 2:  # with an odd number of changes the front one is longer
                meets = np.flatnonzero((got >= 0) & (got + far[1 - side][at + delta - ks] >= n))
                if len(meets):
                    i, j = int(got[meets[0]]), int(got[meets[0]] - ks[meets[0]])
                    return ((i, j) if side == 0 else (n - i, m - j)), steps
    raise AssertionError("scripts from both ends meet at half of the lines")


def _common(x: np.ndarray, y: np.ndarray, budget: int) -> list[tuple[int, int] | None]:
    """Places of the lines that a shortest script keeps, in order; None stands for a part that takes more steps than are left of
    `budget`. Memory is linear in the number of lines."""
    out: list = []
    todo: list = [(0, len(x), 0, len(y))]
    while todo:
        part = todo.pop()
        if len(part) == 2:  # equal lines after a part
            out += zip(range(*part[0]), range(*part[1]), strict=True)
            continue
        i, i_end, j, j_end = part
        while i < i_end and j < j_end and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        tail = 0
        while i < i_end - tail and j < j_end - tail and x[i_end - 1 - tail] == y[j_end - 1 - tail]:
            tail += 1
        todo.append(((i_end - tail, i_end), (j_end - tail, j_end)))
        i_end, j_end = i_end - tail, j_end - tail
        if i == i_end or j == j_end:
            continue
        a, b = x[i:i_end], y[j:j_end]
        values = int(max(a.max(), b.max())) + 1
        if int(np.bincount(a, minlength=values) @ np.bincount(b, minlength=values)) <= CHAINED * (len(a) + len(b)):
            out += [(i + p, j + q) for p, q in _chained(a, b)]
            continue
        place, steps = _middle(a, b, budget)
        budget -= steps
        if place is None:
            out.append(None)
        else:
            todo += [(i + place[0], i_end, j + place[1], j_end), (i, i + place[0], j, j + place[1])]
    return out


def _counted(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """What x has more often than y, then what y has more often: the last places of each line."""
    more = lambda a, b: (Counter(a) - Counter(b), a)
    out = []
    for sign, (left, lines) in (("-", more(x, y)), ("+", more(y, x))):
        found = []
        for line in reversed(lines):
            if left[line] > 0:
                left[line] -= 1
                found.append((sign, line))
        out += reversed(found)
    return out


def edit_script(a: list[str], b: list[str], budget: int = DIFF_BUDGET) -> list[tuple[str, str]]:
    """A shortest script of ('=', '-', '+') lines from a to b, removed lines before added ones. Lines of one side only are put aside first.
    Of parts that take more than the budget, lines are counted, and only what one side has more often is told."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = {line: k for k, line in enumerate(set(x) & set(y))}
    at_x, at_y = ([k for k, line in enumerate(side) if line in both] for side in (x, y))
    pairs = _common(np.array([both[x[k]] for k in at_x], np.int64), np.array([both[y[k]] for k in at_y], np.int64), budget) if both else []
    out, i, j, over = [("=", v) for v in a[:head]], 0, 0, False
    for pair in [*pairs, (len(at_x), len(at_y))]:
        if pair is None:
            over = True
            continue
        p, q = (at[k] if k < len(at) else len(side) for at, k, side in ((at_x, pair[0], x), (at_y, pair[1], y)))
        out += _counted(x[i:p], y[j:q]) if over else [("-", v) for v in x[i:p]] + [("+", v) for v in y[j:q]]
        out += [("=", x[p])] if p < len(x) else []
        i, j, over = p + 1, q + 1, False
    return out + [("=", v) for v in a[len(a) - tail :]]


def unified(ops: list[tuple[str, str]], context: int = 1, most: int = HUNK_LINES) -> str:
    """Changed lines with `context` lines around them, '…' between hunks, and how many changed lines more there are than are shown.
    Runs of changes put removed lines first; over-long lines are cut."""
    changed = [k for k, (o, _) in enumerate(ops) if o != "="]
    out: list[str] = []
    shown = end = 0
    cut = lambda v: v if len(v) <= LINE_CHARS else v[:LINE_CHARS] + "…"
    for k in changed:
        for near in range(max(end, k - context), min(len(ops), k + context + 1)):
            if out and near > end:
                out.append("…")
            end = near + 1
            if len(out) >= most:
                break
            o, v = ops[near]
            out.append(f"{' ' if o == '=' else o} {cut(v)}")
            shown += o != "="
        if len(out) >= most:
            break
    out = out[:most]
    left = len(changed) - shown
    return "\n".join(out + ([f"… (+{left} more changed lines)"] if left else []))


def pair_window(old: Column, new: Column, most: int = 180, before: int = 40) -> Column:
    """Both lines cut to the stretch around their first difference."""
    first = F.size(F.split(old, "")) * 0
    i = F.coalesce(F.array_position(F.zip_with(F.split(old, ""), F.split(new, ""), lambda x, y: x.eqNullSafe(y)), False).cast("int"), first)
    start = F.greatest(i - before, F.lit(1))
    cut = lambda c: F.concat(F.when(start > 1, "…").otherwise(""), c.substr(start, F.lit(most)), F.when(F.length(c) >= start + most, "…").otherwise(""))
    return F.struct(cut(old).alias("old"), cut(new).alias("new"))


_TOLD = "key long, added array<string>, removed array<string>, unified string, diff_hash string"


def _told(batches, lines):
    """Batches of _TOLD for rows that lines() makes (key, old lines, new lines); rows of equal lines it leaves out as None. Rows go out once they
    make up PART_CHARS: a task holds the batch that it reads and no more than that of lines and results."""
    import hashlib
    import json

    import pyarrow as pa

    kinds = {"key": pa.int64(), "added": pa.list_(pa.string()), "removed": pa.list_(pa.string()), "unified": pa.string(), "diff_hash": pa.string()}
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
    for batch in batches:
        rows, size = [], 0
        for row in zip(*batch.columns, strict=True):
            if (found := lines(*(x.as_py() for x in row))) is None:
                continue
            key, old, new = found
            ops = edit_script(old, new)
            added, removed = [v for o, v in ops if o == "+"], [v for o, v in ops if o == "-"]
            told = json.dumps([removed, added], ensure_ascii=False, separators=(",", ":"))
            rows.append((key, added, removed, unified(ops), hashlib.sha1(told.encode()).hexdigest()))
            size += sum(map(len, old)) + sum(map(len, new))
            if size > PART_CHARS:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def line_diff(pairs: DataFrame) -> DataFrame:
    """pairs(key, old, new) of texts that differ -> (key, added, removed, unified, diff_hash)."""

    def run(batches):
        yield from _told(batches, lambda key, old, new: (key, split_lines(old), split_lines(new)))

    differing = pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("key").cast("long").alias("key"), "old", "new")
    return differing.mapInArrow(run, _TOLD)


def diff_hash(removed: Column, added: Column) -> Column:
    return F.sha1(F.to_json(F.array(removed, added)))


def group_identical_edits(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, diff_hash, n, first, members): equal edits as one group, largest first by rank, then first seen."""
    groups = changes.groupBy(*keys, "diff_hash").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")))


def set_diff(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) members of two arrays, sorted."""
    return F.array_sort(F.array_except(new, old)), F.array_sort(F.array_except(old, new))


def joined(lines: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the lines of each key as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def diff_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, old, new) of arrays of lines -> (key, added, removed, unified, diff_hash): the ordered diff after the old numbers were aligned to
    the new ones, so that only real edits show. Nothing is shuffled."""

    def run(batches):
        def lines(own, old, new, gone, fresh):
            texts = [[x.decode() for x in side if x is not None] for side in (_aligned(old, new, gone, fresh), new or [])]
            return (own, *texts) if texts[0] != texts[1] else None

        yield from _told(batches, lines)

    return _with_masks(pairs.select(F.col(key).cast("long").alias("key"), "old", "new"), "key").mapInArrow(run, _TOLD).withColumnRenamed("key", key)


def page_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The ordered diff of two line tables after the old numbers were aligned to the new ones, so that only real edits show."""
    return diff_pairs(paired(old, new, key), key)


def newest_masks(learned: DataFrame, key: str, most: int = 200) -> DataFrame:
    """(key, masked_line, last_at): of learned(key, masked_line, at) the `most` lines of each key that were learned last."""
    per = learned.groupBy(key, "masked_line").agg(F.max("at").alias("last_at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last_at"), "masked_line"))
    return per.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def compare_hashes(lines: DataFrame, learned: DataFrame, key: str, mask_all: Column | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(key, cmp_hash) of texts as tables (key, line_no, line): what is deleted by the patterns doesn't count; a line whose masked form is among
    learned(key, masked_line) counts without its numbers, as all lines do where mask_all is true; of others only relative times
    are put aside."""
    own = lines.withColumn("mask_all", F.lit(False) if mask_all is None else mask_all)
    if patterns:
        own = own.withColumn("line", t.apply_patterns(F.col("line"), patterns)).where("line <> ''")
    own = own.withColumn("mask", t.mask_numbers(F.col("line")))
    known = learned.select(key, F.col("masked_line").alias("mask")).distinct().withColumn("known", F.lit(True))
    own = own.join(known, [key, "mask"], "left")
    plain = t.normalize_relative_times(F.col("line"))
    out = own.select(key, "line_no", F.when(F.col("mask_all") | F.coalesce("known", F.lit(False)), F.col("mask")).otherwise(plain).alias("line"))
    return joined(out, key, "text").select(key, F.sha1("text").alias("cmp_hash"))


def rehash(lines: DataFrame, key: str, masked: Column) -> DataFrame:
    """(key, cmp_hash, rebased): hashes of stored texts under new rules; rebased where numbers are masked now."""
    flag = lines.select(key, masked.alias("rebased"), "line_no", F.when(masked, t.mask_numbers(F.col("line"))).otherwise(F.col("line")).alias("line"))
    return joined(flag, key, "text").join(flag.select(key, "rebased").distinct(), key).select(key, F.sha1("text").alias("cmp_hash"), "rebased")
