"""Phrase collocations by dynamic itemset counting.

The words of all documents are written once, hashed, as shards of about equal size. Steps go round the shards: each counts, in one
shard, the phrases of all lengths that are active. Words are active from the first step on; a longer phrase becomes active at the
step after both of its subphrases, the one without its last word and the one without its first, have come to the threshold by the shards
read so far. Every phrase is counted for one full cycle, whichever shard it begins with, so its count is exact; what can't come
to the threshold is never counted.

Tasks know by a field of fixed size when phrases have come to the threshold: a cell for each range of keys, with the step in
which the first of its phrases had. So a phrase may become active early or without need, but once its cycle has begun it stands fixed, every task
knows it, and the counts of a cycle are those of all shards: phrases below the threshold are dropped with exact counts. Phrases go by 64-bit
hashes of their words and language.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import mixed, pieces, runs, span_hashes, utf8
from .shared import deleted, new_path, settled, written, written_at

#: Occurrences of a phrase, words of the longest, rows per language, and the percentage of a phrase's occurrences in a longer one that drops it.
LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Shards of a cycle.
SHARDS = 3
#: Cells of the field as a power of two (a byte each), and what stands in a cell that no phrase has marked.
FIELD_BITS, NEVER = 24, 255
#: Windows that a task holds before it counts them and passes the counts on.
HELD = 1 << 21
#: Parts of a language that are ranked before the language as a whole is.
PARTS = 64
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_CUT = _BREAK.copy()
_CUT[[0x20, 0x09]] = True
_FACTOR = np.uint64(0x9E6C63D0876A9A47)


def _words(text: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
    """(hash, piece, document, start, end) of every word; salts has the hash of each document's language. No hash is 0."""
    text = _LOWER[text]
    starts, ends, of = pieces(text, offsets, _CUT)
    hashes = mixed(span_hashes(text, starts, ends) ^ salts[of])
    hashes[hashes == 0] = 1
    breaks = np.concatenate([[0], np.cumsum(_BREAK[text])])
    return text, hashes, breaks[starts] + of, of, starts, ends


def _salts(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names of the languages, code and salt of each row)."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return names, codes, own[codes] if len(names) else np.zeros(0, np.uint64)


def _shards(docs: DataFrame) -> DataFrame:
    """(lang, salt, n, words, shard): hashes of the n words of a run of documents of one language, with a 0 after each piece."""

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            names, codes, salts = _salts(batch.column(0))
            text, offsets = utf8(batch.column(1))
            out = []
            for first, last in runs(offsets):
                _, hashes, piece, of, _, _ = _words(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], salts[first:last])
                code, salt = codes[first:last][of], salts[first:last][of]
                for k in np.unique(code):
                    own, at = hashes[code == k], piece[code == k]
                    ends = np.append(np.diff(at) > 0, True)
                    cells = np.zeros(len(own) + int(ends.sum()), np.uint64)
                    cells[np.arange(len(own)) + np.cumsum(ends) - ends] = own
                    out.append((names[k], int(salt[code == k][0].view(np.int64)), len(own), cells.tobytes(), turn % SHARDS))
                turn += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["lang", "salt", "n", "words", "shard"])

    spark = docs.sparkSession
    made, path = docs.mapInArrow(run, "lang string, salt long, n long, words binary, shard int"), new_path(spark, "word-shards")
    made.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _marked(keys: DataFrame) -> np.ndarray:
    """A flag for each cell of the field that some key of keys (key, ...) falls in."""
    cell = f"shiftrightunsigned(key, {64 - FIELD_BITS})"
    marked = keys.selectExpr(f"shiftrightunsigned({cell}, 6) AS at", f"shiftleft(1L, cast({cell} & 63 AS int)) AS bit")
    got = marked.groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()  # at most 2**(FIELD_BITS - 6) rows
    words = np.zeros(1 << (FIELD_BITS - 6), np.uint64)
    words[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
    return (words[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool).ravel()


def _shared(spark: SparkSession, field: np.ndarray) -> Broadcast:
    """A field for all tasks; most of its cells are alike, so it goes packed."""
    return spark.sparkContext.broadcast((zlib.compress(field.tobytes(), 1), field.dtype.str))


def _unpacked(shared: Broadcast) -> np.ndarray:
    data, kind = shared.value
    return np.frombuffer(zlib.decompress(data), kind)


def _looked_up(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What the field holds in the cell of each key."""
    return field[(keys >> np.uint64(65 - len(field).bit_length())).astype(np.int64)]


def _windows(words: np.ndarray, longest: int):
    """For k = 1, 2, ...: (key of the k words from each place on, whether they stand in one piece). 0 parts pieces."""
    rolled, valid = words, words != 0
    for k in range(1, longest + 1):
        if k > 1:
            rolled = rolled[:-1] * _FACTOR + words[k - 1 :]
            valid = valid[:-1] & (words[k - 1 :] != 0)
        yield k, mixed(rolled + np.uint64(k)), valid


def _counted(shard: DataFrame, step: int, shared: Broadcast, longest: int, n_shards: int) -> DataFrame:
    """(key, k, since, head, tail, n) of the words of a shard in the first cycle, and of its longer phrases whose cycle, which begins with
    step `since`, goes on. In the last step of a cycle head and tail tell what a phrase is made of: the keys of it without its last and
    without its first word; of a word, head is the salt of its language."""

    def counts(held: dict):
        for k, parts in held.items():
            key, since, head, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n, own = np.diff(np.append(at, len(key))), order[at]
            goes_on = since[own].astype(np.int64) + n_shards - 1 != step
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(np.full(len(at), k, np.int8)), pa.array(since[own].astype(np.int8)), *(pa.array(x[own].view(np.int64), mask=goes_on) for x in (head, tail)), pa.array(n)], ["key", "k", "since", "head", "tail", "n"])
        held.clear()

    def run(batches):
        ready, held, size = _unpacked(shared) if step > 1 else None, {}, 0
        for batch in batches:
            for salt, cells in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1), strict=True):
                words, below, before = np.frombuffer(cells.as_buffer(), np.uint64), None, None
                for k, key, valid in _windows(words, longest if step > 1 else 1):
                    if k == 1:
                        pick = np.flatnonzero(valid) if step <= n_shards else np.zeros(0, np.int64)
                        found = key[pick], np.ones(len(pick), np.uint8), np.full(len(pick), salt), np.zeros(len(pick), np.uint64)
                    else:
                        latest = np.maximum(below[:-1], below[1:])  # NEVER is greater than all steps
                        pick = np.flatnonzero(valid & (latest < step) & (latest >= step - n_shards))
                        found = key[pick], latest[pick] + np.uint8(1), before[pick], before[pick + 1]
                    if len(pick):
                        held.setdefault(k, []).append(found)
                        size += len(pick)
                    if step > 1:
                        below, before = np.where(valid, _looked_up(ready, key), NEVER), key
                if size >= HELD:
                    yield from counts(held)
                    size = 0
        yield from counts(held)

    return shard.select("salt", "words").mapInArrow(run, "key long, k tinyint, since tinyint, head long, tail long, n long")


def frequent_phrases(shards: DataFrame, least: int = LEAST, longest: int = LONGEST, n_shards: int = SHARDS) -> DataFrame:
    """(key, k, head, tail, n): all phrases of up to `longest` words that stand `least` times or more, each counted in every shard once.
    head and tail are null for a phrase that doesn't stand in the last shard of its cycle.

    At most longest * n_shards steps, usually half of that; each passes once over one shard and over the counts so far, and the table of the
    step before is deleted."""
    spark, times, path, state = shards.sparkSession, np.full(1 << FIELD_BITS, NEVER, np.uint8), None, None
    for step in range(1, longest * n_shards + 1):
        if step > n_shards and not ((times >= step - n_shards) & (times < step)).any():
            break
        shared = _shared(spark, times)
        counted = _counted(shards.where(F.col("shard") == (step - 1) % n_shards), step, shared, longest, n_shards)
        both = counted if state is None else counted.unionByName(state)
        merged = both.groupBy("key").agg(*(F.min(c).alias(c) for c in ("k", "since", "head", "tail")), F.sum("n").alias("n"))
        # what has been through its cycle and stayed below the threshold is done with
        merged = merged.where((F.col("n") >= least) | (F.col("since") + (n_shards - 1) > step))
        before, path = path, new_path(spark, "phrase-counts")
        state = written_at(merged, path)
        shared.destroy()
        if before:
            deleted(spark, before)
        times[_marked(state.where((F.col("n") >= least) & (F.col("k") < longest))) & (times == NEVER)] = step
    return state.select("key", F.col("k").cast("int").alias("k"), "head", "tail", "n")


def _described(shards: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """phrases with head and tail where these are null: one more scan for what stands in no shard that told them. Keys that only fall
    into the field with such a phrase are taken out by the join."""
    unknown = phrases.where("head is null").select("key")
    if not unknown.limit(1).count():
        return phrases
    shared = _shared(shards.sparkSession, _marked(unknown))

    def run(batches):
        known = _unpacked(shared)
        for batch in batches:
            for salt, cells in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1), strict=True):
                before = None
                for _, key, valid in _windows(np.frombuffer(cells.as_buffer(), np.uint64), longest):
                    own, at = np.unique(key[valid & _looked_up(known, key)], return_index=True)
                    if len(own):
                        at = np.flatnonzero(valid & _looked_up(known, key))[at]
                        parts = (np.full(len(at), salt), np.zeros(len(at), np.uint64)) if before is None else (before[at], before[at + 1])
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, *parts)], ["key", "new_head", "new_tail"])
                    before = key

    found = shards.select("salt", "words").mapInArrow(run, "key long, new_head long, new_tail long").join(unknown, "key", "left_semi")
    found = found.groupBy("key").agg(F.min("new_head").alias("new_head"), F.min("new_tail").alias("new_tail"))
    return phrases.join(found, "key", "left").select("key", "k", F.coalesce("head", "new_head").alias("head"), F.coalesce("tail", "new_tail").alias("tail"), "n")


def _with_parts(phrases: DataFrame, longest: int) -> DataFrame:
    """Phrases of two words or more with `salt` (of their language), `words` (keys of their words), `fronts` and `backs`: counts of
    their first and of their last 1, 2, ... words."""
    words = phrases.where("k = 1")
    made = [words.select("key", F.col("head").alias("salt"), F.array("key").alias("words"), F.array("n").alias("fronts"), F.array("n").alias("backs"))]
    for k in range(2, longest + 1):
        own = phrases.where(F.col("k") == k)
        head = made[-1].select(F.col("key").alias("head"), "salt", F.col("words").alias("w"), "fronts")
        tail = made[-1].select(F.col("key").alias("tail"), F.element_at("words", -1).alias("last"), "backs")
        both = own.join(head, "head").join(tail, "tail")
        made.append(written(both.select(*phrases.columns, "salt", F.concat("w", F.array("last")).alias("words"), F.concat("fronts", F.array("n")).alias("fronts"), F.concat("backs", F.array("n")).alias("backs")), "phrases"))
    out = made[1]
    for more in made[2:]:
        out = out.unionByName(more)
    return out


def _worst_cut(n: str) -> F.Column:
    """(score, cut, l, r) of the cut of least score, the first of equal ones. The counts of a corpus stay below 10**19, so that
    products fit 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("k") - 1),
        lambda j: F.named_struct(F.lit("j"), j, F.lit("l"), F.element_at("fronts", j), F.lit("r"), F.element_at("backs", F.col("k") - j)),
    )
    scored = F.transform(cuts, lambda c: F.struct(F.call_function("div", wide(F.col("a")) * (wide(F.col(n)) * 1000), wide(c["l"]) * wide(c["r"])).alias("score"), c["j"].alias("j"), c["l"].alias("l"), c["r"].alias("r")))
    return F.array_min(scored)


def _spelled(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, word) of the words of docs (lang, text) that have these keys, by one more scan."""
    shared = _shared(docs.sparkSession, _marked(keys))

    def run(batches):
        seen, own = set(), _unpacked(shared)
        for batch in batches:
            _, _, salts = _salts(batch.column(0))
            text, offsets = utf8(batch.column(1))
            for first, last in runs(offsets):
                text_, hashes, _, _, starts, ends = _words(text[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], salts[first:last])
                keys_ = mixed(hashes + np.uint64(1))
                hit = np.flatnonzero(_looked_up(own, keys_))
                found, at = np.unique(keys_[hit], return_index=True)
                fresh = [k for k, x in enumerate(found.tolist()) if x not in seen]
                seen.update(found[fresh].tolist())
                if len(seen) > HELD:
                    seen.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(found[fresh].view(np.int64)), pa.array([text_[starts[i] : ends[i]].tobytes() for i in hit[at[fresh]]], pa.binary())], ["key", "word"])

    rows = docs.mapInArrow(run, "key long, word binary")
    return rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("word").cast("string").alias("word"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of docs (text, lang) by score.

    A null text has no words, a null lang is `und`; repeated rows count each; ties go by a and by the phrase's bytes; extra columns are
    ignored; an empty table gives no rows. A text's memory is about a hundred times its bytes while it is worked on. The table of
    frequent phrases is never held by one task or the driver.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    shards = _shards(docs)
    totals = shards.groupBy("lang", "salt").agg(F.sum("n").alias("n_all"))  # a row per language

    def found():
        frequent = settled(lambda: frequent_phrases(shards, least, longest), "frequent")
        return _with_parts(written(_described(shards, frequent, longest), "described"), longest)

    candidates = settled(found, "frequent-phrases")
    longer = candidates.where("k > 2").select(F.explode(F.array("head", "tail")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longest_n"))
    # a phrase that stands in a longer one with k + 2 words stands in one with k + 1 at least as often
    alone = candidates.join(longer, "key", "left").where(F.col("longest_n").isNull() | (100 * F.col("longest_n").cast("decimal(19,0)") < share * F.col("n").cast("decimal(19,0)")))
    scored = alone.withColumnRenamed("n", "a").join(totals, "salt").withColumn("cut", _worst_cut("n_all"))
    scored = scored.select("key", "lang", "k", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("n_all").alias("n"), F.col("cut.score").alias("score"))
    # ties at the end of a part are all kept, as their order needs the spelling
    part = Window.partitionBy("lang", F.pmod("key", F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"))
    first = written(scored.withColumn("place", F.rank().over(part)).where(F.col("place") <= top).drop("place"), "best-phrases")
    spelled = _spelled(docs, first.select(F.explode("words").alias("key")).distinct())
    words = first.select("key", F.posexplode("words").alias("at", "own")).join(spelled.withColumnRenamed("key", "own"), "own")
    texts = words.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(texts, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""WITH pieces AS (SELECT lang, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, row_number() OVER () AS doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
each AS (SELECT lang, unnest(list_concat({', '.join(f"list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])" for k in range(1, LONGEST + 1))})) AS p FROM words),
f AS MATERIALIZED (SELECT lang, p, count(*) AS n FROM each GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS (SELECT lang, p, n AS a FROM f WHERE n >= {LEAST} AND len(p) > 1),
starts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM c),
inner_ AS (SELECT lang, p[i:j] AS p, max(a) AS a FROM (SELECT *, unnest(range(i + 1, len(p) + 1)) AS j FROM starts) WHERE j - i + 1 < len(p) GROUP BY ALL),
held AS (SELECT DISTINCT c.lang, c.p FROM c JOIN inner_ i ON c.lang = i.lang AND c.p = i.p AND 100 * i.a >= {SHARE} * c.a),
cuts AS (SELECT c.lang, c.p, c.a, unnest(range(1, len(c.p))) AS k FROM c ANTI JOIN held USING (lang, p)),
s AS (SELECT cuts.lang, array_to_string(cuts.p, ' ') AS phrase, a, k, x.n AS l, y.n AS r, t.n::BIGINT AS n, ((1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:] JOIN total t ON t.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= {TOP}"""
