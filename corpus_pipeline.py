"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns the columns of documents; the
last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.decontamination import decontaminated
from driftline.llm.jaccard_join import deduplicated
from driftline.llm.line_dedup import line_dedup
from driftline.llm.packing import pack
from driftline.llm.quality import kept_documents
from driftline.llm.shared import settled, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, each row judged by its own text."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks that repeat; one of which nothing is left goes. n_chars follows the text."""
    # written first: a condition on the kept text would else be worked out again below the join, with all that leads to it
    out = settled(lambda: line_dedup(docs), "kept-lines").where((F.col("n_removed_chunks") == 0) | F.col("text").rlike("[^ \n\t\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Null ids are judged by their texts like others; repeated rows leave one; texts without
    words stay; extra columns are kept."""
    return deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose own text no passage of the benchmark stands, whatever their id or null; extra columns are kept."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: every row is packed, null texts as the end id alone; extra columns are left out."""
    packed = pack(docs, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("packing", packing)]

#: A tokenizer, hashed statistics and alignments are beyond SQL; tests hold every stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
