"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, whatever stands between words becomes one blank, and all n-grams of one to four characters of a text are
hashed to buckets. Counts by language and bucket come from one aggregation over all documents to learn from; the matrix of log
probabilities, of a size that doesn't depend on the corpus, goes to all tasks, where a run of texts is scored at once: the
buckets that its n-grams touch are looked up and summed by document.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, runs, utf8
from .shared import written

#: Lengths of n-grams, and buckets they are hashed to.
ORDERS, BUCKET_BITS = (1, 2, 3, 4), 16
#: Added to each count.
SMOOTHING = 0.5
#: Languages whose log probabilities are with a task at once: 16 MB. Of more, one block after the other is scored.
AT_ONCE = 32
UNKNOWN = "und"


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case character, 0 for what is no part of a word; whether it is a letter."""
    lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        if kind in "LM":
            small = chr(k).lower()
            lower[k], letter[k] = ord(small) if len(small) == 1 else k, kind == "L"
    return lower, letter


def _code_points(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets between documents) of UTF-8 bytes; what isn't UTF-8 is replaced."""
    whole = text.tobytes()
    try:
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        each = [whole[a:b].decode(errors="replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def text_grams(text: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((bucket, document) of all n-grams for each length; whether each document has a letter)."""
    n = len(offsets) - 1
    lower, letter = _characters()
    points, at = _code_points(text, offsets)
    of = np.repeat(np.arange(n), np.diff(at))
    has_letter = np.bincount(of[letter[points]], minlength=n) > 0
    # a blank before and after each document, and one for all that stands between two words
    chars, own = np.zeros(len(points) + 2 * n, np.uint64), np.repeat(np.arange(n), np.diff(at) + 2)
    chars[np.arange(len(points)) + 2 * of + 1] = lower[points]
    keep = chars != 0
    keep[1:] |= chars[:-1] != 0
    keep[at[:-1] + 2 * np.arange(n)] = True
    chars, own = chars[keep], own[keep]
    out, rolled = [], np.zeros(len(chars), np.uint64)
    for k in range(1, max(ORDERS) + 1):
        m = max(len(chars) - k + 1, 0)
        rolled = rolled[:m] * np.uint64(0xD6E8FEB86659FD93) + chars[k - 1 : m + k - 1]
        if k in ORDERS:
            inside = chars > 0 if k == 1 else own[:m] == own[k - 1 : m + k - 1]
            out.append(((mixed(rolled[inside] + np.uint64(k)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), own[:m][inside]))
    return out, has_letter


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text) of docs; null texts have no n-grams. A task holds one array of counts for each of
    at most AT_ONCE languages before it passes them on."""
    size = 1 << BUCKET_BITS

    def rows(held: dict):
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])
        held.clear()

    def run(batches):
        held: dict = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                grams, _ = text_grams(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                own = codes[first:last]
                for code in np.unique(own):
                    if names[code] not in held and len(held) >= AT_ONCE:
                        yield from rows(held)
                    total = held.setdefault(names[code], np.zeros(size, np.int64))
                    for bucket, of in grams:
                        total += np.bincount(bucket[own[of] == code], minlength=size)
        yield from rows(held)

    counted = docs.mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _log_probabilities(counts, langs: list[str]) -> np.ndarray:
    """A row per language, from its counts by bucket."""
    out = np.zeros((len(langs), 1 << BUCKET_BITS))
    out[counts["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)] = counts["n"]
    out += SMOOTHING
    return np.log(out / out.sum(axis=1, keepdims=True))


def _scored(docs: DataFrame, langs: list[str], prior: np.ndarray, table: np.ndarray, last: bool) -> DataFrame:
    """docs (doc_id, held_out, text, lang_pred, best, total) with a block of languages taken into account: the best one so far, its log
    probability, and the sum of all probabilities as multiples of the best one's. After the last block the text isn't kept."""
    model = docs.sparkSession.sparkContext.broadcast((np.array(langs, object), prior, table))  # at most AT_ONCE languages

    def run(batches):
        names, prior, table = model.value
        for batch in batches:
            text, offsets = utf8(batch.column(2))
            for first, until in runs(offsets):
                n = until - first
                grams, has_letter = text_grams(text[offsets[first] : offsets[until]], offsets[first : until + 1] - offsets[first])
                score = np.zeros((len(names), n))
                for bucket, of in grams:
                    for k, row in enumerate(table):
                        score[k] += np.bincount(of, row[bucket], n)
                # a character stands in an n-gram of every length, so its evidence is counted once for each
                score = score / len(ORDERS) + prior[:, None]
                part = batch.slice(first, n)
                had, was = (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5))
                had, was = np.where(np.isnan(had), -np.inf, had), np.where(np.isnan(was), 0, was)
                pick = score.argmax(axis=0)
                best = np.maximum(had, score[pick, np.arange(n)])
                total = was * np.exp(had - best) + np.exp(score - best).sum(axis=0)
                pred = np.where(had >= best, np.array(part.column(3).to_pylist(), object), names[pick])
                pred[~has_letter] = UNKNOWN
                kept = [part.column(0), part.column(1)] + ([] if last else [part.column(2)])
                columns = ["doc_id", "held_out"] + ([] if last else ["text"]) + ["lang_pred", "best", "total"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(best), pa.array(np.where(has_letter, total, np.inf))], columns)

    return docs.mapInArrow(run, f"doc_id long, held_out boolean, {'' if last else 'text string, '}lang_pred string, best double, total double")


def predicted_languages(docs: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of docs (doc_id, text, lang).

    Held-out rows are those whose crc32 of the decimal doc_id leaves 2 when divided by 4; all others that have a lang are learned
    from. Only the text decides a prediction. score is the share of lang_pred among the probabilities of all languages, each
    character counted once. A null text, or one without a letter, is `und` with score 0, and so is every text if there
    is nothing to learn from. A null doc_id is neither held out nor learned from; repeated rows are counted and predicted each;
    of languages with the same probability the first by name is taken; extra columns are ignored; an empty table gives no rows. A text's
    memory is about three hundred times its bytes while it is worked on.
    """
    at = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(at == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learned = rows.where("not held_out and doc_id is not null and lang is not null").select("lang", "text")
    known = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("lang")  # a row per language
    rows = rows.select("doc_id", "held_out", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("total"))
    if not len(known):
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    counts = written(gram_counts(learned), "language-counts")
    prior = np.log(known["n"].to_numpy(float) / known["n"].sum())
    langs = known["lang"].tolist()
    for k in range(0, len(langs), at_once):
        block = langs[k : k + at_once]
        table = _log_probabilities(counts.where(F.col("lang").isin(block)).toPandas(), block)  # at most at_once * 2**BUCKET_BITS rows
        last = k + at_once >= len(langs)
        rows = _scored(rows, block, prior[k : k + at_once], table, last)
        rows = rows if last else written(rows, "language-scores")
    return rows.select("doc_id", "held_out", "lang_pred", (1 / F.col("total")).alias("score"))
