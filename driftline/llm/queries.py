"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, line_dedup, merkle
from .shared import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    read = read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), end_id=2))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, lengths

    return length_histogram(lengths(table(spark, sf_dir, "documents")))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_format(chat.reply_pairs(table(spark, sf_dir, "conversations")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predicted_languages

    return predicted_languages(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_line_dedup, op3_suffix_dedup, op4_quality, op5_decontamination, op6_main_text, op7_jaccard_join, op8_packing, op9_token_counts, op10_preference_pairs, op11_language_id, op12_merkle_manifest, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op10_preference_pairs": chat.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
