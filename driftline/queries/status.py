"""Queries over the observation log that the events stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import status as ops
from .base import FETCH_SQL, Registry, fetch, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(f"WITH {FETCH_SQL} SELECT status, blocked, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 299) AS n_ok FROM obs GROUP BY ALL")
def s1_read_fetch_log(spark, sf):
    from ..sources.fetch_log import with_outcome

    log = with_outcome(fetch(spark, sf).withColumn("content_type", F.lit("Text/HTML; charset=x")))
    return log.groupBy("status", "blocked").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))


_ISLANDS = """SELECT *, coalesce(sum(CASE WHEN in_run THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY fetched_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island"""


@query(f"""WITH {FETCH_SQL}, r AS (SELECT *, status <= 0 OR status >= 500 AS in_run FROM obs WHERE NOT blocked AND status <> 429), i AS ({_ISLANDS.format(keys='site_id')} FROM r),
n AS (SELECT *, row_number() OVER w AS nth, first_value(fetched_at) OVER w AS first_at FROM i WINDOW w AS (PARTITION BY site_id, island ORDER BY fetched_at, event_id)),
g AS (SELECT site_id, island, min(fetched_at) FILTER (in_run) AS down_since, min(fetched_at) FILTER (in_run AND nth >= 3 AND (epoch_us(fetched_at) // 1000) - (epoch_us(first_at) // 1000) >= 20000) AS down_at,
  min(fetched_at) FILTER (NOT in_run) AS up_at, count(*) FILTER (in_run) AS n FROM n GROUP BY ALL)
SELECT site_id, down_since, down_at, up_at, (epoch_us(up_at) // 1000) - (epoch_us(down_since) // 1000) AS down_for_ms, n FROM g WHERE down_at IS NOT NULL""")
def c1_outages(spark, sf):
    return ntz(ops.outages(fetch(spark, sf)), "down_since", "down_at", "up_at")


@query(f"""WITH {FETCH_SQL}, r AS (SELECT *, 'blocked' AS kind, blocked AS in_run FROM obs UNION ALL SELECT *, 'rate_limited', status = 429 FROM obs WHERE NOT blocked), i AS ({_ISLANDS.format(keys='kind, site_id')} FROM r)
SELECT site_id, kind, min(fetched_at) AS start_at, max(fetched_at) AS end_at, count(*) AS n FROM i WHERE in_run GROUP BY site_id, kind, island HAVING count(*) >= 2""")
def c2_episodes(spark, sf):
    return ntz(ops.episodes(fetch(spark, sf), least=2), "start_at", "end_at")


@query(f"""WITH RECURSIVE {FETCH_SQL}, e AS (SELECT DISTINCT site_id, CASE WHEN blocked THEN 'blocked' WHEN status = 429 THEN 'rate_limited' ELSE 'failed' END AS kind, fetched_at AS start_at FROM obs WHERE blocked OR status = 429 OR status <= 0 OR status >= 500),
told AS (SELECT site_id, kind, min(start_at) AS start_at FROM e GROUP BY ALL UNION ALL SELECT t.site_id, t.kind, min(e.start_at) FROM told t JOIN e ON e.site_id = t.site_id AND e.kind = t.kind AND e.start_at >= t.start_at + INTERVAL 6 HOUR GROUP BY t.site_id, t.kind, t.start_at)
SELECT site_id, kind, start_at FROM told""")
def c2_throttled_notices(spark, sf):
    """Every refusal and failure of a site as a notice, of which one in six hours is told of each kind."""
    bad = fetch(spark, sf).where("blocked or status = 429 or status <= 0 or status >= 500")
    kind = F.when(F.col("blocked"), "blocked").when(F.col("status") == 429, "rate_limited").otherwise("failed")
    notices = bad.select("site_id", kind.alias("kind"), F.col("fetched_at").alias("start_at")).distinct()
    return ntz(ops.throttled(notices, ["site_id", "kind"]), "start_at")


@query(f"""WITH {FETCH_SQL}, r AS (SELECT *, status = 429 OR (status = 503 AND retry_after_ms IS NOT NULL) AS in_run FROM obs WHERE status IN (429, 200) OR (status = 503 AND retry_after_ms IS NOT NULL)),
i AS ({_ISLANDS.format(keys='host')} FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY host, island ORDER BY fetched_at, event_id) - 1 AS level FROM i WHERE in_run)
SELECT host, fetched_at AS at, level, (epoch_us(fetched_at) // 1000) + least(1800000, coalesce(retry_after_ms, 60000 * pow(2, level)))::BIGINT AS until_ms FROM l""")
def c3_host_backoff(spark, sf):
    return ntz(ops.host_backoff(fetch(spark, sf)), "at")


@query(f"""WITH {FETCH_SQL} SELECT CASE WHEN status <= 0 THEN coalesce(error, 'unreachable') WHEN blocked THEN 'bot challenge (HTTP ' || status || ')' ELSE 'HTTP ' || status END AS detail, count(*) AS n
FROM obs WHERE status <= 0 OR status >= 400 GROUP BY 1""")
def c4_failure_detail(spark, sf):
    bad = fetch(spark, sf).where("status <= 0 or status >= 400")
    return bad.groupBy(ops.failure_detail(F.col("status"), F.col("error"), F.col("blocked")).alias("detail")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FETCH_SQL} SELECT site_id, count(*) FILTER (NOT (status <= 0 OR status >= 500 OR status = 429 OR blocked)) AS usable, count(*) AS n FROM obs GROUP BY 1")
def c23_usable_observation(spark, sf):
    return fetch(spark, sf).groupBy("site_id").agg(F.count_if(ops.usable(F.col("status"), F.col("blocked"))).alias("usable"), F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, (page_id % 7 = 0) OR (page_id % 3 = 1 AND page_id % 5 IN (0, 1)) AS blocked FROM pages""")
def x12_detect_challenges(spark, sf):
    i = F.col("page_id")
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 403, 404))), (i % 3 + 1).cast("int"))
    script = F.concat(F.lit("<script src='/cdn-cgi/challenge-platform/scripts/jsd/main.js'></script>"), "html")
    body = F.when(i % 5 == 0, F.concat(F.lit("Just a moment..."), "html")).when(i % 5 == 1, F.concat("html", F.lit("<div id='px-captcha'>"))).when(i % 5 == 2, script).otherwise(F.col("html"))
    headers = F.create_map(F.lit("cf-mitigated"), F.when(i % 7 == 0, "challenge").otherwise(""))
    return table(spark, sf, "pages").select("page_id", ops.challenged(status, headers, body).alias("blocked"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN least(page_id * 1500, 86400000) WHEN 1 THEN ((page_id % 60) * 60000) WHEN 2 THEN NULL ELSE 86400000 END::BIGINT AS retry_after_ms FROM pages""")
def x13_parse_retry_after(spark, sf):
    i = F.col("page_id")
    minute = F.lpad((i % 60).cast("string"), 2, "0")
    value = F.when(i % 4 == 0, (i * 1.5).cast("decimal(20,1)").cast("string")).when(i % 4 == 1, F.concat(F.lit("Mon, 01 Jan 2024 00:"), minute, F.lit(":00 GMT"))).when(i % 4 == 2, "-5").otherwise("9999999")
    return table(spark, sf, "pages").select("page_id", ops.parse_retry_after(value, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("retry_after_ms"))
