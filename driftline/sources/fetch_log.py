"""Observation logs: one row per fetch of a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCH_LOG = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("probe", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_type", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("blocked", T.BooleanType()),
        T.StructField("retry_after_ms", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def with_outcome(df: DataFrame) -> DataFrame:
    """Adds ok (2xx), not_modified (304) and the lower-cased media type without parameters."""
    return df.withColumns(
        {
            "ok": F.col("status").between(200, 299),
            "not_modified": F.col("status") == 304,
            "content_type": F.lower(F.trim(F.regexp_extract("content_type", "^([^;]*)", 1))),
        }
    )


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """A log of FETCH_LOG's schema, as a table or as a stream, with its outcome columns."""
    reader = spark.readStream if streaming else spark.read
    return with_outcome(reader.schema(FETCH_LOG).format(fmt).load(path))


def decode_bodies(df: DataFrame) -> DataFrame:
    """body_text from body: byte order mark, then the header's charset, then one declared in the first 1024 bytes, then UTF-8."""
    head = F.decode(F.substring("body", 1, 1024), "ISO-8859-1")
    charset = r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:\-]+)"
    named = F.upper(F.coalesce(F.nullif(F.regexp_extract("content_type", "(?i)" + charset, 1), F.lit("")), F.nullif(F.regexp_extract(head, "(?i)" + charset, 1), F.lit("")), F.lit("UTF-8")))
    latin = named.isin("ISO-8859-1", "LATIN1", "US-ASCII", "ASCII")
    mark = F.hex(F.substring("body", 1, 3))
    text: Column = (
        F.when(mark == "EFBBBF", F.decode(F.expr("substring(body, 4)"), "UTF-8"))
        .when(mark.startswith("FFFE"), F.decode(F.expr("substring(body, 3)"), "UTF-16LE"))
        .when(mark.startswith("FEFF"), F.decode(F.expr("substring(body, 3)"), "UTF-16BE"))
        .when(latin, F.decode("body", "ISO-8859-1"))
        .when(named == "UTF-16LE", F.decode("body", "UTF-16LE"))
        .when(named == "UTF-16BE", F.decode("body", "UTF-16BE"))
        .otherwise(F.decode("body", "UTF-8"))
    )
    return df.withColumn("body_text", F.when(F.col("body").isNotNull(), text).otherwise(F.col("body_text")))


def from_events(events: DataFrame) -> DataFrame:
    """The supplied events table as an observation log: users are sites, kinds of event are outcomes."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when((F.col("event_type") == "error") & (k % 7 == 0), 0)
        .when(F.col("event_type") == "error", 503)
        .when(F.col("event_type") == "signup", 404)
        .when((F.col("event_type") == "purchase") & (k % 4 == 0), 403)
        .when(F.col("event_type") == "purchase", 429)
        .otherwise(200)
    )
    site = F.col("user_id").cast("string")
    return events.select(
        "event_id",
        F.col("user_id").alias("site_id"),
        F.concat(F.lit("https://s"), site, F.lit(".example.com/p"), (k % 5).cast("string")).alias("url"),
        F.concat(F.lit("s"), site, F.lit(".example.com")).alias("host"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        status.alias("status"),
        (status == 403).alias("blocked"),
        F.when((status == 429) & (k % 3 == 0), (k * 1000).cast("long")).alias("retry_after_ms"),
        F.when((status == 0) & (k % 2 == 0), F.lit("timeout after 20s")).alias("error"),
        F.when(status == 200, F.concat(F.lit("v"), F.floor(k / 5 % 4).cast("string"))).alias("hash"),
        F.col("value"),
        k.alias("k"),
    )


#: The same log for an SQL engine over the same table.
FETCH_SQL = """obs AS (
  SELECT event_id, user_id AS site_id, 'https://s' || user_id || '.example.com/p' || (k % 5) AS url, 's' || user_id || '.example.com' AS host,
    ts AS fetched_at, status, status = 403 AS blocked, CASE WHEN status = 429 AND k % 3 = 0 THEN (k * 1000)::BIGINT END AS retry_after_ms,
    CASE WHEN status = 0 AND k % 2 = 0 THEN 'timeout after 20s' END AS error,
    CASE WHEN status = 200 THEN 'v' || ((k // 5) % 4) END AS hash, value, k
  FROM (SELECT *, CASE WHEN event_type = 'error' AND k % 7 = 0 THEN 0 WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 404
      WHEN event_type = 'purchase' AND k % 4 = 0 THEN 403 WHEN event_type = 'purchase' THEN 429 ELSE 200 END AS status
    FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)))"""


def read_public_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """suffixes(suffix) from a public suffix list as published: one rule a line up to the first blank, // comments, '*.' and '!' rules kept
    as they are written."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("suffix")
    return spark.read.text(path).select(rule).where((F.col("suffix") != "") & ~F.col("suffix").startswith("//")).distinct()
