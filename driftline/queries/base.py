"""What query modules share: registration, tables, and URL parts as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fetch_log import FETCH_SQL, from_events

__all__ = ["FETCH_SQL", "Registry", "fetch", "host_sql", "path_sql", "query_sql", "rows", "table", "values_sql"]


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A small settings table."""
    return spark.createDataFrame(values, schema)


def values_sql(name: str, columns: str, values: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in values)})"


def host_sql(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':\\d*$', ''))"


def path_sql(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def query_sql(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
