"""Removal of repeated multi-line chunks, whose borders follow the text and not its position.

A line is marked when a rolling hash over it and the two lines before falls under a bar; a border follows a marked line
whose line before isn't marked, so borders shift with inserted or deleted lines and no chunk has fewer than two lines. Chunks
that stand anywhere in the corpus twice are removed but for their first place; equal hashes only propose, equal bytes
decide. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: The rolling hash is taken modulo MODULUS; a line is marked where it is under BAR (half of all lines, so that chunks have four on
#: average).
MODULUS, BAR = 65521, 32760
#: No border leaves fewer lines than this at either end of a text; a text of fewer lines is no chunk.
MIN_LINES = 2


def _cut(docs: DataFrame) -> DataFrame:
    """Adds lines and spans, the (from, to) of each chunk of docs (text, ...); `from` counts the lines before it."""
    line_hash = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    back = lambda n, of: F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), n), F.col(of)), 1, F.size(of))
    marked = lambda x: ((x["h"] * 961 + x["one"] * 31 + x["two"]) % MODULUS < BAR).cast("long")
    inside = lambda i: (i + 1 >= MIN_LINES) & (i + 1 <= F.size("lines") - MIN_LINES)
    return (
        docs.withColumn("lines", F.split("text", "\n"))
        .withColumn("h", line_hash)
        .withColumn("m", F.transform(F.arrays_zip("h", back(1, "h").alias("one"), back(2, "h").alias("two")), marked))
        .withColumn("ends", F.transform(F.arrays_zip("m", back(1, "m").alias("before")), lambda x, i: F.when((x["m"] == 1) & (x["before"] == 0) & inside(i), i + 1)))
        .withColumn("ends", F.concat(F.array_compact("ends"), F.array(F.size("lines"))))
        .withColumn("spans", F.arrays_zip(F.slice(F.concat(F.array(F.lit(0)), F.col("ends")), 1, F.size("ends")).alias("from"), F.col("ends").alias("to")))
        .drop("h", "m", "ends")
    )


def _joined(start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.col("lines"), start + 1, end - start), "\n")


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, from, to, key, chunk) of the chunks that can be removed."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text"))
    # chunks are joined before the array is taken apart, so that conditions on them don't join them again
    whole = F.filter("spans", lambda s: s["to"] - s["from"] >= MIN_LINES)
    each = F.transform(whole, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), _joined(s["from"], s["to"]).alias("chunk")))
    flat = _cut(picked.withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "text_hash", F.explode(each).alias("c")).select("doc_id", "text_hash", "c.*")
    return flat.where(F.col("chunk").rlike("[^\\n ]")).withColumn("key", F.xxhash64("chunk"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with the kept text in `text`, and n_lines, n_removed_lines and n_removed_chunks.

    The first place is that of the least (doc_id, line), null ids first. Null text counts as empty and comes
    back empty; blank chunks and texts of a single line stay. Rows of one doc_id and the same text are one document that is
    listed twice: they keep the same lines. Rows of one doc_id with other text are other documents. Columns of docs that are
    named like the added ones are replaced. An empty table gives no rows.
    """
    added = ("n_lines", "n_removed_lines", "n_removed_chunks")
    docs = docs.drop(*added)
    chunks = written(_chunks(docs), "line-chunks")  # cut once; the keys are counted without reading the texts
    keys = written(chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key"), "line-keys")
    # By key alone both sides are plain exchanges, whose hot keys the engine can split.
    found = written(chunks.join(keys.hint("shuffle_hash"), "key"), "line-candidates")
    place = F.struct("doc_id", "text_hash", "from")
    firsts = written(found.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n"), "line-firsts")
    gone = found.join(firsts.hint("shuffle_hash"), ["key", "chunk"]).where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("gone")).toDF("gone_doc", "gone_hash", "gone")

    # what else a row holds travels in one struct, so that no name of it meets a name used here
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest")
    slim = docs.select(rest, F.col("doc_id").cast("long").alias("doc"), _text(docs).alias("text"), F.xxhash64(_text(docs)).alias("hash"))
    both = slim.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("hash") == F.col("gone_hash")), "left")
    both = both.withColumn("lines", F.split("text", "\n"))
    # what stays lies between what goes
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["to"])), F.concat(F.transform("gone", lambda g: g["from"]), F.array(F.size("lines")))
    stays = F.filter(F.arrays_zip(starts.alias("from"), ends.alias("to")), lambda s: s["to"] > s["from"])
    cut = both.select(
        "rest",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda s: _joined(s["from"], s["to"])), "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["to"] - g["from"]), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )
    return cut.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns), *added)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), marked AS (
  SELECT *, (h * 961 + coalesce(lag(h, 1) OVER w, 0) * 31 + coalesce(lag(h, 2) OVER w, 0)) % {MODULUS} < {BAR} AS m, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY i), false) AND i >= {MIN_LINES} AND i <= n - {MIN_LINES} AS ends FROM marked
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no
  FROM ended
), chunks AS (
  SELECT doc_id, chunk_no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY ALL
), judged AS (
  SELECT *, n >= {MIN_LINES} AND length(translate(chunk, chr(10) || ' ', '')) > 0
    AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_no) > 1 AS gone
  FROM chunks
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (gone) AS n_removed_chunks, coalesce(string_agg(chunk, chr(10) ORDER BY chunk_no) FILTER (NOT gone), '') AS text
FROM judged GROUP BY doc_id
"""
