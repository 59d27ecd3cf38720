"""Folds and windows over the observation log as a table; tests replay the same log as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..streaming import folds, windows
from .base import FETCH_SQL, Registry, fetch, table
from .status import _ISLANDS, ntz
from .text import _MASK, _REL

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def fold_log(log):
    """What folds read: the version as hash, and a mask that every second version shares."""
    mask = F.when(F.col("hash").isNotNull(), F.concat(F.lit("m"), (F.floor(F.col("k") / 5) % 4 / 2).cast("int").cast("string")))
    return log.select("event_id", "site_id", "url", F.unix_millis("fetched_at").alias("at"), "status", "blocked", "hash", mask.alias("mask"))


@query(f"""WITH {FETCH_SQL}, r AS (SELECT *, status <= 0 OR status >= 500 AS in_run FROM obs WHERE NOT blocked AND status <> 429), i AS ({_ISLANDS.format(keys='site_id')} FROM r),
n AS (SELECT *, row_number() OVER w AS nth, first_value(fetched_at) OVER w AS first_at FROM i WINDOW w AS (PARTITION BY site_id, island ORDER BY fetched_at, event_id)),
g AS (SELECT site_id, island, min(epoch_us(fetched_at) // 1000) FILTER (in_run) AS since, min(epoch_us(fetched_at) // 1000) FILTER (in_run AND nth >= 3 AND epoch_us(fetched_at) // 1000 - epoch_us(first_at) // 1000 >= 20000) AS down, min(epoch_us(fetched_at) // 1000) FILTER (NOT in_run) AS up FROM n GROUP BY ALL)
SELECT site_id, down AS at_ms, 'down' AS kind, since::VARCHAR AS detail FROM g WHERE down IS NOT NULL UNION ALL SELECT site_id, up, 'up', (up - since)::VARCHAR FROM g WHERE down IS NOT NULL AND up IS NOT NULL""")
def k1_fold_outages(spark, sf):
    return folds.fold(fold_log(fetch(spark, sf)).drop("url"), ["site_id"], folds.OUTAGES)


@query()
def k2_fold_page_changes(spark, sf):
    """The interplay of confirming (c5), holding (c6), learning (c7), unstable (c8), churn (c9), trust (c10), flip-flops and removal."""
    return folds.fold(fold_log(fetch(spark, sf)), ["site_id", "url"], folds.PAGES)


@query()
def k3_fold_deploys(spark, sf):
    return folds.fold(fold_log(fetch(spark, sf)).drop("url"), ["site_id"], folds.DEPLOYS)


@query(f"""WITH {FETCH_SQL}, w AS (SELECT site_id, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, fetched_at) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, fetched_at), INTERVAL 5 MINUTE)) AS start FROM obs WHERE status = 200) SELECT site_id, start, count(*) AS n FROM w GROUP BY ALL""")
def k4_change_rate_windows(spark, sf):
    changes = fetch(spark, sf).where("status = 200").withColumnRenamed("fetched_at", "at")
    return ntz(windows.change_rates(changes), "start")


@query(f"""WITH {FETCH_SQL}, b AS (SELECT *, coalesce((fetched_at - lag(fetched_at) OVER (PARTITION BY site_id ORDER BY fetched_at) > INTERVAL 6 HOUR)::INT, 1) AS fresh FROM obs WHERE status <= 0 OR status >= 500),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY fetched_at ROWS UNBOUNDED PRECEDING) AS session FROM b) SELECT site_id, min(fetched_at) AS start, max(fetched_at) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY site_id, session""")
def k5_outage_sessions(spark, sf):
    return ntz(windows.outage_sessions(fetch(spark, sf).withColumnRenamed("fetched_at", "at")), "start", "end")


@query(f"WITH {FETCH_SQL} SELECT site_id, url, day(fetched_at) AS day, count(*) AS n FROM (SELECT DISTINCT site_id, url, fetched_at FROM obs) GROUP BY ALL")
def k6_dedup_observations(spark, sf):
    log = fetch(spark, sf).withColumnRenamed("fetched_at", "at")
    seen = windows.dedup_observations(log.unionByName(log.where("k % 3 = 0")), ["site_id", "url", "at"])
    return seen.groupBy("site_id", "url", F.dayofmonth("at").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FETCH_SQL} SELECT CASE WHEN fetched_at < TIMESTAMP '2024-01-05' THEN 'late' WHEN fetched_at > TIMESTAMP '2024-01-25' THEN 'future' ELSE 'in_time' END AS part, count(*) AS n FROM obs GROUP BY 1""")
def k7_late_and_future_rows(spark, sf):
    parts = windows.split_by_time(fetch(spark, sf), F.lit("2024-01-25").cast("timestamp"), F.lit("2024-01-05").cast("timestamp"), "fetched_at")
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {FETCH_SQL}, b AS (SELECT event_id, event_id % 4 AS batch, epoch_us(fetched_at) // 1000 AS ms FROM obs), m AS (SELECT batch, max(ms) AS top FROM b GROUP BY batch)
SELECT event_id, coalesce(ms <= (SELECT max(top) FROM m WHERE m.batch < b.batch) - 864000000, false) AS late FROM b""")
def k7_late_side_table(spark, sf):
    """The log in four batches, one of them written twice: rows that are ten days behind what came before them are put aside."""
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/divided-{uuid.uuid4().hex}"
    log = fetch(spark, sf).select("event_id", F.unix_millis("fetched_at").alias("at"))
    write = windows.divide_late(path, "at", 864_000_000)
    for k in (0, 1, 2, 2, 3):
        write(log.where(F.col("event_id") % 4 == k), k)
    read = lambda part: spark.read.schema(log.schema).parquet(*(f"{path}/{part}/batch={k}" for k in range(4))).select("event_id", F.lit(part == "late").alias("late"))
    return read("late").unionByName(read("in_time"))


def _ticker_log(spark, sf):
    """The log as that of pages with one ticking number: two versions, one mask."""
    version = F.when(F.col("hash").isin("v0", "v1"), "v0").when(F.col("hash").isNotNull(), "v1")
    return fold_log(fetch(spark, sf)).drop("url").withColumn("hash", version).withColumn("mask", F.when(F.col("hash").isNotNull(), "m"))


@query()
def c6_held_numeric_changes(spark, sf):
    """Number-only changes that stood long enough: the fold's 'number' events."""
    return folds.fold(_ticker_log(spark, sf), ["site_id"], folds.PAGES).where("kind = 'number'")


def _loads(spark, sf):
    """Every document as a page that is loaded seven times, ten minutes apart: every seventh line ends in a counter that is moved on at every
    second load."""
    line = lambda x, i: F.when(i % 7 == 3, F.concat(x, F.lit(" #"), F.floor((F.col("load") + 1) / 2).cast("string"))).otherwise(x)
    mask = lambda x, i: t.mask_numbers(F.when(i % 7 == 3, F.concat(x, F.lit(" #0"))).otherwise(x))
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split(t.normalize_relative_times(F.col("text")), "\n").alias("x"))
    masked = docs.withColumn("mask_text", F.transform("x", mask)).withColumn("load", F.explode(F.sequence(F.lit(0), F.lit(6))))
    hashes = lambda of: F.transform(of, lambda x: F.xxhash64(x))
    one = F.lit(None).cast("string")
    return masked.select("doc_id", (F.col("load") * 600_000).cast("long").alias("at"), F.col("load").cast("long").alias("event_id"), F.lit(200).alias("status"), F.lit(False).alias("blocked"), one.alias("hash"), one.alias("mask"), hashes(F.transform("x", line)).alias("lines"), hashes("mask_text").alias("masks"), "mask_text")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_REL.format('text')}, chr(10))) AS line, generate_subscripts(string_split({_REL.format('text')}, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT DISTINCT doc_id, 3600000 AS at_ms, {_MASK.format("(line || ' #0')")} AS masked_line FROM l WHERE line_no % 7 = 3""")
def c7_learn_ticking_lines(spark, sf):
    """Lines that three numeric changes within six hours teach: the fold's 'learned' events, spelt out."""
    log = _loads(spark, sf)
    told = folds.fold(log.drop("mask_text"), ["doc_id"], folds.PAGES).where("kind = 'learned'").select("doc_id", "at_ms", F.col("detail").cast("long").alias("key"))
    lines = log.where("at = 0").select("doc_id", F.explode(F.array_distinct("mask_text")).alias("masked_line")).withColumn("key", F.xxhash64("masked_line"))
    return told.join(lines, ["doc_id", "key"]).select("doc_id", "at_ms", "masked_line")


@query(f"WITH {FETCH_SQL} SELECT event_id, site_id, status FROM obs WHERE status >= 500")
def k8_notify_sink(spark, sf):
    """The events of a batch that is written twice, read back from where deliveries take them."""
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    events = fetch(spark, sf).where("status >= 500").select("event_id", "site_id", "status")
    write = windows.notify_sink(path)
    for _ in range(2):
        write(events, 0)
    return spark.read.parquet(f"{path}/batch=0")
