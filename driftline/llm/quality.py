"""Quality rules: plain text rules, then a hashed n-gram log-likelihood ratio against the corpus itself.

Words and word pairs of every document are hashed to buckets. Two multinomials over the buckets are counted: one
from trusted documents, one from the whole corpus. A document's score is the mean over its n-grams of
log p_trusted - log p_corpus, so that its length doesn't matter. One threshold holds for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACES, count_by, later, mixed, pieces, repeated, runs, span_hashes, utf8, windows
from .shared import settled, written

#: Buckets of the multinomials; words and pairs share them.
BUCKET_BITS = 16
#: Labelled rows of each class that are used at most (those with the least hash of their id): three of four are
#: counted as trusted text, the others only set the threshold.
SAMPLE = 20_000
#: A held-out trusted document that is rejected costs as much as so many bad ones that are kept (as shares of their class).
TRUSTED_COST = 10
#: n_words under MIN_WORDS, or more than REPEAT_PERCENT words of a hundred in repeated windows, fail.
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _buckets(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all words and word pairs."""
    pairs, at = windows(hashes, of, 2)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64), np.concatenate([of, of[at]])


def text_stats(text: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts per document, and the hash and document of every word. Words and lines are compared by 64-bit
    hashes that are keyed by document."""
    n = len(offsets) - 1
    starts, ends, of = pieces(text, offsets, SPACES)
    hashes = span_hashes(text, starts, ends)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    found, at = windows(hashes, of, WINDOW)
    twice = at[repeated(found ^ mixed(of[at].astype(np.uint64)))]
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[twice] += 1  # window starts are distinct
    cover[twice + WINDOW] -= 1
    line_s, line_e, line_of = pieces(text, offsets, _NEWLINE)
    wordy = np.searchsorted(starts, line_e) > np.searchsorted(starts, line_s)
    line_s, line_e, line_of = line_s[wordy], line_e[wordy], line_of[wordy]
    lines = span_hashes(text, line_s, line_e) ^ mixed(line_of.astype(np.uint64))
    stats = {
        "n_words": count_by(of, n),
        "word_chars": per_doc(~SPACES[text] & ((text & 0xC0) != 0x80)),
        "n_symbols": per_doc(_SYMBOLS[text]),
        "n_dup_lines": count_by(line_of[later(lines)], n),
        "n_repeat_words": count_by(of[np.cumsum(cover)[:-1] > 0], n) if len(of) else np.zeros(n, np.int64),
    }
    return stats, hashes, of


def count_ngrams(docs: DataFrame, trusted_ids: np.ndarray) -> DataFrame:
    """(bucket, n_corpus, n_trusted) over all documents; a task adds up one array, then a row per bucket is summed."""

    known = pa.array(trusted_ids, pa.int64())

    def run(batches):
        size = 1 << BUCKET_BITS
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            trusted = pc.is_in(batch.column(0), value_set=known).to_numpy(zero_copy_only=False)  # a null id is none of them
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                at = offsets[first : last + 1] - offsets[first]
                part = text[offsets[first] : offsets[last]]
                starts, ends, of = pieces(part, at, SPACES)
                bucket, of = _buckets(span_hashes(part, starts, ends), of)
                total[0] += np.bincount(bucket, minlength=size)
                total[1] += np.bincount(bucket[trusted[first:last][of]], minlength=size)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "n_corpus", "n_trusted"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "bucket long, n_corpus long, n_trusted long")
    return counted.groupBy("bucket").agg(F.sum("n_corpus").alias("n_corpus"), F.sum("n_trusted").alias("n_trusted"))


def weights(counts) -> np.ndarray:
    """log p_trusted - log p_corpus by bucket. The trusted counts are smoothed towards the corpus, so that what
    trusted text is too small to tell of weighs nothing."""
    size = 1 << BUCKET_BITS
    corpus, trusted = np.zeros(size), np.zeros(size)
    corpus[counts["bucket"]], trusted[counts["bucket"]] = counts["n_corpus"], counts["n_trusted"]
    if not trusted.sum():
        return np.zeros(size)
    p_corpus = (corpus + 1) / (corpus.sum() + size)
    p_trusted = (trusted + size * p_corpus) / (trusted.sum() + size)
    return np.log(p_trusted) - np.log(p_corpus)


def text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def scored(docs: DataFrame, model_weights: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, the counts, base_failed, score): score is null for a text without words."""

    def run(batches):
        for batch in batches:
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                at = offsets[first : last + 1] - offsets[first]
                stats, hashes, of = text_stats(text[offsets[first] : offsets[last]], at)
                bucket, of = _buckets(hashes, of)
                n = np.bincount(of, minlength=last - first)
                score = np.bincount(of, model_weights[bucket], last - first) / np.maximum(n, 1)
                failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, last - first) for k in (0, 2)), *(pa.array(stats[k], pa.int64()) for k in _STATS), pa.array(failed), pa.array(score, mask=n == 0)],
                    ["doc_id", "text_hash", *_STATS, "base_failed", "score"],
                )

    hashed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    return hashed.mapInArrow(run, f"doc_id long, text_hash long, {', '.join(f'{k} long' for k in _STATS)}, base_failed boolean, score double")


def labelled_sample(labels: DataFrame, quality: int, sample: int = SAMPLE) -> np.ndarray:
    """At most `sample` ids of labelled documents of one class, those with the least hash. Toxic documents, where `toxic` is given, are
    not trusted, good as their prose may be."""
    if quality == 1 and "toxic" in labels.columns:
        labels = labels.where(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    ids = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return np.array([r[0] for r in rows], np.int64)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of least cost; of equal ones the middle of the widest gap between neighbouring scores."""
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(good.min())
    both = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[both[0] - 1], both])  # kept: above the cut
    lost = np.searchsorted(np.sort(good), cuts, "right") / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts, "right") / len(bad)
    cost = TRUSTED_COST * lost + passed
    upper = np.append(both, both[-1] + 1)
    best = np.flatnonzero(cost == cost.min())
    k = best[np.argmax((upper - cuts)[best])]
    return float((cuts[k] + upper[k]) / 2)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, text_hash: a row per row.

    Null text has no words and fails the base rules; a null doc_id stays null and is never trusted; repeated rows are
    judged each; ties at the threshold are kept; other columns are ignored. Without trusted labels every n-gram weighs
    nothing, and what passes the base rules is kept. An empty table gives no rows. A text's memory is about forty
    times its bytes while it is worked on.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labelled_sample(labels, 1, sample)
    held_out, trusted = good[3::4], np.delete(good, np.s_[3::4])
    counts = count_ngrams(docs, trusted).toPandas()  # at most one row per bucket
    rows = written(scored(docs, weights(counts)), "quality")
    bad = labelled_sample(labels, 0, sample)
    known = [(int(x), True) for x in held_out] + [(int(x), False) for x in bad]
    ids = docs.sparkSession.createDataFrame(known, "doc_id long, good boolean")  # bounded by the sample
    own = rows.where(~F.col("base_failed")).join(F.broadcast(ids), "doc_id").select("score", "good").toPandas()
    flag = own["good"].to_numpy(bool)
    threshold = best_threshold(own["score"].to_numpy(float)[flag], own["score"].to_numpy(float)[~flag])
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold))
    return rows.select("doc_id", *_STATS, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "score", "text_hash")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text are kept."""
    good = settled(lambda: quality(docs, labels).where("kept").select(F.col("doc_id").alias("good_id"), F.col("text_hash").alias("good_text")).distinct(), "kept-by-rules")
    same = docs["doc_id"].cast("long").eqNullSafe(good["good_id"]) & (text_hash(docs["text"]) == good["good_text"])
    return docs.join(good, same, "left_semi")
