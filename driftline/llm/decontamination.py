"""Benchmark decontamination: shared rare word n-grams propose (document, item) places, Smith-Waterman scores them.

Every n-gram of an item is a seed, so any SEED words in a row that a document has in common with an item propose it, whatever else the
corpus or the document holds. Of n-grams that more than STOCK items share, only distinct passages propose, each for the shortest
item that has it: a seed's rows are bounded by the passages it stands in, not by documents times items. A document that has nothing else in common
with an item than several such passages, none of which counts by itself, isn't compared with it. Seeds of documents and items
meet in a join; a bit field of fixed size, made of the items' n-grams, keeps other n-grams of the corpus out of it.

The words around the seeds that a document shares with an item are aligned with the item, word by word; the
alignment stands edits, insertions and left-out words. Places where common words met by chance are put aside first, by
the best score of their alignment, many at a time. An alignment keeps some rows of its table and works out the others again,
so its memory grows with the root of the table's size.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import flagged, runs, span_hashes, utf8, windows
from .shared import settled, written

#: Words of a seed; an n-gram of more items than this is wording that items share.
SEED, STOCK = 3, 16
#: Alignment: score of equal words, of a replaced word and of a word on one side only.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A place counts from MIN_WORDS equal words in its alignment, and from this share of the best score that its own length on the
#: item allows, and if they cover this share of the item or LONG_WORDS words. An item of fewer than MIN_WORDS words has to stand
#: there whole and unchanged; one of fewer than SEED words counts only in a document that holds nothing else.
MIN_WORDS, IDENTITY, COVERAGE, LONG_WORDS = 8, 0.5, 0.3, 24
#: Bits of the field for each n-gram of the items, and of the whole field at least and at most, as powers of two.
FIELD_BITS, LEAST_FIELD, MOST_FIELD = 16, 20, 27
#: Seeds of one item further apart than this many words more than the item has are other places.
SLACK = 20
#: Words of documents that a task aligns at once.
HELD = 200_000
#: Cells of a row of the alignments scored at once; cells of an alignment's table that is kept whole.
ROW_CELLS, WHOLE_TABLE = 50_000, 1_000_000


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """A flag for each code point: letters, digits and the marks on them."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)])


def _lower(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col(key).cast("long").alias(key), F.lower(text).alias("text"), F.xxhash64(text).alias("text_hash"))


def _words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word: letters and digits of lower-case text."""
    known = _word_characters()
    inside = known[:128][np.minimum(text, 127)]
    for lead, size in ((0xC2, 2), (0xE0, 3), (0xF0, 4)):  # the first bytes of characters of so many bytes start there
        at = np.flatnonzero((text >= lead) & (text < (0xE0, 0xF0, 0xF8)[size - 2]))
        if len(at):
            code = (text[at] & (0xFF >> (size + 1))).astype(np.int64)
            for k in range(1, size):
                code = code << 6 | (text[at + k] & 0x3F)
            flag = known[code]
            for k in range(size):
                inside[at + k] = flag
    starts, ends, of = flagged(inside, offsets)
    return span_hashes(text, starts, ends), of


def _grams(words: np.ndarray, of: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the n-grams of SEED words of each document; a document of fewer words is one of its own length."""
    sizes = np.bincount(of, minlength=documents)
    keys, first = [], []
    for width in range(1, SEED + 1):
        found, at = windows(words, of, width)
        if width < SEED:
            use = sizes[of[at]] == width
            found, at = found[use], at[use]
        keys.append(found + np.uint64(width)), first.append(at)
    return np.concatenate(keys), np.concatenate(first)


def _next_row(row: np.ndarray, equal: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """The next row of the table: with a gap score per word, the best way along a row is a running maximum."""
    out = np.empty_like(row)
    out[0] = 0
    np.maximum(row[:-1] + np.where(equal, np.int32(MATCH), np.int32(MISMATCH)), row[1:] + np.int32(GAP), out=out[1:])
    np.maximum(out, 0, out=out)
    return np.maximum(np.maximum.accumulate(out + ramp) - ramp, out)


class _Pair:
    """Two word sequences, and the pairs of equal words that don't count as equal any more."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.given_up = a, b, {}
        self.ramp = np.arange(len(b) + 1, dtype=np.int32) * np.int32(-GAP)

    def equal(self, i: int) -> np.ndarray:
        out = self.b == self.a[i]
        if i in self.given_up:
            out[self.given_up[i]] = False
        return out

    def give_up(self, rows: np.ndarray, columns: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
            self.given_up.setdefault(i, []).append(j)

    def path(self, low: int, high: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(score, rows, columns, equal) of a best local alignment of a[low:high] with b.

        rows and columns are the words before each step of the path and after its last; equal has a flag per step. Of equally good
        ones the first is taken. Every `step`th row of the table is kept; on the way back the rows between are worked out again.
        """
        n, m = high - low, len(self.b)
        step = 1 if n * m <= WHOLE_TABLE else int(n**0.5) + 1
        row, kept, best, i, j = np.zeros(m + 1, np.int32), [], 0, 0, 0
        for k in range(n):
            if k % step == 0:
                kept.append(row)
            row = _next_row(row, self.equal(low + k), self.ramp)
            if (top := int(row.max())) > best:
                best, i, j = top, k + 1, int(row.argmax())
        at, equal, first, rows = [(low + i, j)], [], i + 1, []
        while best and i:
            if i - 1 < first:  # the rows from a kept one on
                first = (i - 1) // step * step
                rows = [kept[first // step]]
                for k in range(first, i):
                    rows.append(_next_row(rows[-1], self.equal(low + k), self.ramp))
            here, above = rows[i - first], rows[i - 1 - first]
            if here[j] <= 0:
                break
            same = bool(self.equal(low + i - 1)[j - 1])
            if here[j] == above[j - 1] + (MATCH if same else MISMATCH):
                i, j = i - 1, j - 1
            else:
                same = False
                i, j = (i - 1, j) if here[j] == above[j] + GAP else (i, j - 1)
            equal.append(same)
            at.append((low + i, j))
        rows, columns = np.array(at[::-1]).T
        return best, rows, columns, np.array(equal[::-1], bool)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """(score, equal words, a_from, a_to, b_from, b_to) of a best local alignment of two word sequences."""
    score, rows, columns, equal = _Pair(a, b).path(0, len(a))
    return score, int(equal.sum()), int(rows[0]), int(rows[-1]), int(columns[0]), int(columns[-1])


def _leak(score: int, equal: int, from_b: int, to_b: int, item_words: int) -> bool:
    if item_words < MIN_WORDS:
        return score == MATCH * item_words
    span = to_b - from_b
    return equal >= MIN_WORDS and score >= IDENTITY * MATCH * span and (span >= COVERAGE * item_words or equal >= LONG_WORDS)


def _part(rows: np.ndarray, columns: np.ndarray, equal: np.ndarray, item_words: int) -> tuple | None:
    """(score, equal words, a_from, a_to, b_from, b_to) of the part of a path, between two of its equal words, that counts
    as a leak and has most equal words; None if no part does.

    Of the parts that end at a step, the longest that keeps the share of the best score holds all others, so one start
    per end is tried: the first from which the score less its bar doesn't fall.
    """
    both = (np.diff(rows) > 0) & (np.diff(columns) > 0)
    score = np.append(0, np.cumsum(np.where(equal, MATCH, np.where(both, MISMATCH, GAP))))
    count = np.append(0, np.cumsum(equal))
    over = score - IDENTITY * MATCH * (columns - columns[0])
    least = np.minimum.accumulate(np.where(np.append(equal, False), over, np.inf))
    best = None
    for to in np.flatnonzero(np.append(False, equal)):
        at = int(np.searchsorted(-least, -over[to]))
        if at < to and (best is None or count[to] - count[at] > best[1]):
            got = tuple(int(x) for x in (score[to] - score[at], count[to] - count[at], rows[at], rows[to], columns[at], columns[to]))
            best = got if _leak(got[0], got[1], got[4], got[5], item_words) else best
    return best


def _least(item_words: int) -> float:
    """A passage that counts scores no less: each of its item words brings IDENTITY of MATCH, and it has so many of them."""
    if item_words < MIN_WORDS:
        return MATCH * item_words
    return IDENTITY * MATCH * max(MIN_WORDS, min(COVERAGE * item_words, LONG_WORDS))


def _passages(pair: _Pair, low: int, high: int) -> list[tuple]:
    """All parts of alignments of a[low:high] that count as leaks, by place. What lies before and after an accepted one is aligned
    again; a path without such a part gives up its equal words, and its stretch is aligned without them."""
    out, todo, item_words = [], [(low, high)], len(pair.b)
    while todo:
        low, high = todo.pop()
        score, rows, columns, equal = pair.path(low, high)
        if score < _least(item_words) or not equal.any():
            continue
        got = _part(rows, columns, equal, item_words)
        if got:
            out.append(got)
            todo += [(low, got[2]), (got[3], high)]
        else:
            pair.give_up(rows[:-1][equal], columns[:-1][equal])
            todo.append((low, high))
    return sorted(out, key=lambda x: x[2])


def _best_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The score of a best local alignment of each row of a with the same row of b."""
    ramp = np.arange(a.shape[1] + 1, dtype=np.int32) * -GAP
    h, best = np.zeros((len(a), a.shape[1] + 1), np.int32), np.zeros(len(a), np.int32)
    for j in range(b.shape[1]):
        row = h + GAP
        np.maximum(row[:, 1:], h[:, :-1] + np.where(a == b[:, j : j + 1], np.int32(MATCH), np.int32(MISMATCH)), out=row[:, 1:])
        np.maximum(row, 0, out=row)
        h = np.maximum.accumulate(row + ramp, axis=1) - ramp
        np.maximum(best, h.max(axis=1), out=best)
    return best


def _side_by_side(sequences: list[np.ndarray], other: int) -> np.ndarray:
    """Each sequence as a row, filled up with a word that nothing else is."""
    out = np.full((len(sequences), max(map(len, sequences))), other, np.uint64)
    for row, x in zip(out, sequences, strict=True):
        row[: len(x)] = x
    return out


def _likely(stretches: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """False for stretches whose best score is below that of any passage that counts. Very long ones aren't judged."""
    size, m = np.array([len(x) for x in stretches]), np.array([len(x) for x in items])
    out = np.ones(len(size), bool)
    order = np.lexsort((size, m))
    order = order[size[order] <= ROW_CELLS]
    done = 0
    while done < len(order):
        part = order[done : done + max(1, ROW_CELLS // max(1, int(size[order[done]])))]
        part = part[: max(1, ROW_CELLS // max(1, int(size[part].max())))]
        done += len(part)
        got = _best_scores(_side_by_side([stretches[k] for k in part], 0), _side_by_side([items[k] for k in part], 1))
        out[part] = got >= [_least(int(x)) for x in m[part]]
    return out


def _places(words: np.ndarray, item: np.ndarray):
    """The passages of one stretch, in windows of a few times the item's length, each whole for what starts in its first part."""
    at, m = 0, len(item)
    while at < len(words):
        to = min(len(words), at + 4 * m + 2 * SLACK)
        step = to if to == len(words) else to - 2 * m
        past = step
        for got in _passages(_Pair(words[at:to], item), 0, to - at):
            if at + got[2] < step:
                past = max(past, at + got[3])
                yield got[0], got[1], at + got[2], at + got[3], got[4], got[5]
        at = past


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, m, words): a number for each distinct item, its words' hashes. Items without words are left out."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            text, offsets = utf8(batch.column(1))
            words, of = _words(text, offsets)
            at = np.searchsorted(of, np.arange(batch.num_rows + 1))
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(some))), batch.column(0).take(pa.array(some)), pa.array(np.diff(at)[some]), pa.array([words[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())],
                ["item", "item_id", "m", "words"],
            )
            number += len(some)

    low = _lower(benchmark, "item_id").select("item_id", "text").distinct()
    return written(low.mapInArrow(run, "item long, item_id long, m long, words binary"), "items")


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram, item, m, place) of the n-grams of every item."""

    def run(batches):
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            of = np.repeat(np.arange(len(each)), [len(x) for x in each])
            if not len(of):
                continue
            key, first = _grams(np.concatenate(each), of, len(each))
            own, place = pa.array(of[first]), first - np.searchsorted(of, of[first])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(place)], ["gram", "item", "m", "place"])

    return items.select("item", "m", "words").mapInArrow(run, "gram long, item long, m long, place long")


def _field(grams: DataFrame) -> tuple[np.ndarray, int]:
    """(words of a bit field with a bit for each gram, bits of a gram that number it). Its size has a fixed bound."""
    bits = min(max((FIELD_BITS * grams.count()).bit_length(), LEAST_FIELD), MOST_FIELD)
    number = f"shiftrightunsigned(gram, {64 - bits})"
    marked = grams.selectExpr(f"shiftrightunsigned({number}, 6) AS at", f"shiftleft(1L, cast({number} & 63 AS int)) AS bit")
    got = marked.groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def _hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, doc_id, text_hash, place) of the documents' n-grams that the items may have."""
    field, bits = _field(grams)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2**MOST_FIELD bits at most

    def run(batches):
        own, shift = shared.value, np.uint64(64 - bits)
        for batch in batches:
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                words, of = _words(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                key, at = _grams(words, of, last - first)
                number = key >> shift
                hit = np.flatnonzero(own[number >> np.uint64(6)] >> (number & np.uint64(63)) & np.uint64(1))
                key, at = key[hit], at[hit]
                pick, place = pa.array(of[at] + first), at - np.searchsorted(of, of[at])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pick), batch.column(2).take(pick), pa.array(place)], ["gram", "doc_id", "text_hash", "place"])

    return docs.mapInArrow(run, "gram long, doc_id long, text_hash long, place long")


def _seeds(grams: DataFrame) -> DataFrame:
    """(gram, item, m, item_place): the places at which an n-gram proposes an item.

    An n-gram of at most STOCK items proposes each of them. One of more items belongs to wording that items share (a question's opening), and proposes
    every distinct wording once: n-grams of this kind that follow one another in an item are a passage, and of the items with the same
    passage the shortest stands for all. Nothing here depends on the documents."""
    shared = grams.groupBy("gram").agg((F.count_distinct("item") > STOCK).alias("stock"))
    rows = grams.join(shared, "gram").withColumnRenamed("place", "item_place")
    own = rows.where("not stock").select("gram", "item", "m", "item_place")
    order = Window.partitionBy("item").orderBy("item_place")
    runs_ = rows.where("stock").withColumn("run", F.col("item_place") - F.row_number().over(order))
    passages = runs_.groupBy("item", "m", "run").agg(F.array_sort(F.collect_list(F.struct("item_place", "gram"))).alias("grams"))  # within an item
    passages = passages.withColumn("passage", F.transform("grams", lambda x: x["gram"]))
    each = passages.groupBy("passage").agg(F.min(F.struct("m", "item", "grams")).alias("one"))
    spread = each.select("one.item", "one.m", F.inline("one.grams")).select("gram", "item", "m", "item_place")
    return own.unionByName(spread).distinct()


SCHEMA = "doc_id long, text_hash long, item_id long, score long, item_words long, equal_words long, doc_from long, doc_to long, item_from long, item_to long"


def _by_document(met: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _hash, met): the items that a document shares seeds with, each with its words and where in the document it would start."""
    by_item = met.groupBy("doc_id", "text_hash", "item").agg(F.array_sort(F.collect_set(F.col("place") - F.col("item_place"))).alias("starts"))
    own = by_item.join(items, "item").select("doc_id", "text_hash", F.struct("item_id", "starts", "words").alias("one"))
    return own.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list("one").alias("met"))  # of one document


def _stretches(words: np.ndarray, starts: np.ndarray, m: int) -> list[tuple[int, int]]:
    """The parts of a document around the seeds that it shares with an item of m words. A passage that counts has no more put-in words than
    equal ones, so it takes 2 * m words of the document at most."""
    cut = np.flatnonzero(np.diff(starts) > 3 * m + 2 * SLACK)
    ends = zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)
    return [(max(0, int(head) - m - SLACK), min(len(words), int(tail) + 2 * m + SLACK)) for head, tail in ends]


def _aligned(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """The passages of documents (doc_id, text, text_hash) and what they met."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def passages(held: list[tuple]):
        out = []
        for k in np.flatnonzero(_likely([x[4] for x in held], [x[5] for x in held])).tolist():
            keys, item_id, doc_words, at, stretch, item = held[k]
            m = len(item)
            if m >= SEED or m == doc_words:
                out += [(*keys, item_id, s, m, e, at + a0, at + a1, b0, b1) for s, e, a0, a1, b0, b1 in _places(stretch, item)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text, offsets = utf8(batch.column(1).slice(k, 1))
                words, _ = _words(text, offsets)
                for x in batch.column(3)[k].as_py():
                    item = np.frombuffer(x["words"], np.uint64)
                    for low, high in _stretches(words, np.array(x["starts"]), len(item)):
                        held.append(((batch.column(0)[k].as_py(), batch.column(2)[k].as_py()), x["item_id"], len(words), low, words[low:high], item))
                        size += high - low
                    if size > HELD:
                        yield passages(held)
                        held, size = [], 0
        if held:
            yield passages(held)

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return docs.join(by_doc.hint("shuffle_hash"), same).select("doc_id", "text", "text_hash", "met").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document, item and place of a leaked passage: the alignment's score, equal words and word ranges; text_hash tells
    documents of one doc_id apart.

    Null and empty texts and items match nothing; a null doc_id or item_id is carried as null; repeated rows are reported
    each, repeated items once; empty tables give no rows; other columns are ignored. Words are letters, digits and marks on
    them, of any script, in lower case; all else parts them. Places of an item in a document don't overlap; of equally good
    alignments the first is taken.
    """
    low, items = _lower(docs, "doc_id"), _items(benchmark)
    grams = written(_item_grams(items), "item-grams")
    seeds = written(_seeds(grams), "seeds")
    hits = written(_hits(low, seeds), "gram-hits")
    return _aligned(low, written(_by_document(hits.join(seeds, "gram"), items), "met"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose own text no passage of an item was found: rows of one doc_id, or of none, are judged each by its
    text. Columns are kept, whatever their names; no rows give no rows."""
    bad = settled(lambda: leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaked")
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    slim = docs.select(own.alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return slim.join(bad, F.col("own.id").eqNullSafe(F.col("_id")) & (F.col("own.hash") == F.col("_hash")), "left_anti").select("row.*")
