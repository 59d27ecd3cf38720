"""Exact token counts for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .tokenizing import default_path, encoded

#: Lengths summed as one group: the suffix sums run within groups and over the groups' totals.
GROUP = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null counts as empty."""
    import numpy as np

    tokenizer = tokenizer or default_path()

    def run(batches):
        for rest, _, at in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(np.diff(at), pa.int64())], ["doc_id", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(counted: DataFrame) -> DataFrame:
    """One row per length that occurs, with what every limit L = n_tokens asks for.

    n_docs, n_tokens_at     documents of this length, their tokens
    docs_longer             documents of more than L tokens
    docs_up_to              documents of at most L tokens
    tokens_up_to            tokens of the documents of at most L tokens
    truncated_total         tokens when each document is cut to L
    tokens_lost             tokens that such a cut drops
    quantile                share of documents of at most L tokens; the q-quantile is the least L with quantile >= q
    at_limit tells of limits between two lengths or under the least. An empty table gives no rows; a null count counts as 0.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0).cast("long"))
    per = written(counted.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("g", F.expr(f"n_tokens div {GROUP}")), "lengths")
    # One row per group of lengths: longest document / GROUP, however many documents there are.
    groups = per.groupBy("g").agg(F.sum("n_docs").alias("gd"), F.sum("tokens").alias("gt"))
    after = Window.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    groups = groups.select("g", F.coalesce(F.sum("gd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("gt").over(after), F.lit(0)).alias("tokens_after"), F.sum("gd").over(whole).alias("all_docs"), F.sum("gt").over(whole).alias("all_tokens"))
    within = Window.partitionBy("g").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.col("docs_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))
    above = F.col("tokens_after") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return (
        per.join(groups, "g")
        .select("*", longer.alias("docs_longer"), above.alias("tokens_longer"))
        .select(
            "n_tokens", "n_docs", F.col("tokens").alias("n_tokens_at"), "docs_longer",
            (F.col("all_docs") - F.col("docs_longer")).alias("docs_up_to"),
            (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_up_to"),
            (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
            (F.col("tokens_longer") - F.col("n_tokens") * F.col("docs_longer")).alias("tokens_lost"),
            ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limit(histogram: DataFrame, *limits: int) -> DataFrame:
    """(limit, docs_up_to, docs_longer, truncated_total, tokens_lost) of length_histogram's rows for any limits, also ones under the
    shortest document or between two lengths. A negative limit counts as 0; an empty histogram gives no rows."""
    each = F.explode(F.array(*(F.lit(max(0, x)).cast("long") for x in limits))).alias("limit")
    rows = histogram.select(each, "n_tokens", "n_docs")
    longer = F.col("n_tokens") > F.col("limit")
    cut = F.least("n_tokens", "limit") * F.col("n_docs")
    return rows.groupBy("limit").agg(
        F.sum(F.when(~longer, F.col("n_docs")).otherwise(0)).alias("docs_up_to"),
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(cut).alias("truncated_total"),
        F.sum(F.col("n_tokens") * F.col("n_docs") - cut).alias("tokens_lost"),
    )
