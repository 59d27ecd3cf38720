"""Change detection on the observation log that the events stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as ops
from .base import FETCH_SQL, Registry, fetch
from .status import ntz

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_OUTCOMES = """o AS (SELECT *, CASE WHEN next_hash IS NULL THEN 'pending' WHEN next_hash = hash THEN 'confirmed' WHEN next_hash = prev_hash THEN 'transient' ELSE 'unstable' END AS outcome
  FROM (SELECT *, lag(hash) OVER w AS prev_hash, lead(hash) OVER w AS next_hash FROM obs WHERE hash IS NOT NULL WINDOW w AS (PARTITION BY site_id, url ORDER BY fetched_at, event_id)) WHERE prev_hash <> hash)"""


@query(f"WITH {FETCH_SQL}, {_OUTCOMES} SELECT site_id, url, event_id, fetched_at, hash, prev_hash, outcome FROM o")
def c5_confirmed_text_changes(spark, sf):
    return ntz(ops.confirmed_changes(fetch(spark, sf)), "fetched_at")


@query(f"""WITH {FETCH_SQL}, {_OUTCOMES} SELECT site_id, url, min(fetched_at) AS dynamic_at FROM (SELECT *, count(*) FILTER (outcome = 'unstable') OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM o)
WHERE run = 3 GROUP BY ALL""")
def c8_unstable_pages(spark, sf):
    return ntz(ops.unstable_pages(ops.confirmed_changes(fetch(spark, sf))), "dynamic_at")


@query(f"""WITH {FETCH_SQL} SELECT event_id, site_id, count(*) OVER w AS recent, count(*) OVER w > 3 AS muted FROM obs WHERE hash IS NOT NULL
WINDOW w AS (PARTITION BY site_id ORDER BY fetched_at RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW)""")
def c9_churn_mute(spark, sf):
    """Over a day, as the events are sparse."""
    changes = fetch(spark, sf).where("hash is not null").select("event_id", "site_id", "fetched_at")
    return ops.churn(changes, ["site_id"], hours=24).select("event_id", "site_id", "recent", "muted")


@query(f"""WITH {FETCH_SQL}, c AS (SELECT event_id, site_id, fetched_at, count(*) OVER w > 2 AS muted FROM obs WHERE hash IS NOT NULL
WINDOW w AS (PARTITION BY site_id ORDER BY fetched_at RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW)),
n AS (SELECT *, coalesce(sum(muted::INT) OVER (PARTITION BY site_id ORDER BY fetched_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT event_id, site_id, muted, before = 0 AS told FROM n""")
def c9_file_changes_told(spark, sf):
    """The rule of files over a day: the third change mutes and is told, none after it."""
    changes = fetch(spark, sf).where("hash is not null").select("event_id", "site_id", "fetched_at")
    return ops.told_changes(changes, ["site_id"], 2, 24, tell_last=True).select("event_id", "site_id", "muted", "told")


@query(f"""WITH {FETCH_SQL}, c AS (SELECT *, coalesce((lag(hash) OVER w <> hash)::INT, 1) AS changed FROM obs WHERE hash IS NOT NULL WINDOW w AS (PARTITION BY site_id, url ORDER BY fetched_at, event_id)),
s AS (SELECT *, sum(changed) OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM c), b AS (SELECT *, min(fetched_at) OVER (PARTITION BY site_id, url, stretch) AS start FROM s)
SELECT site_id, url, min(fetched_at) AS trusted_at FROM b WHERE epoch_us(fetched_at) // 1000 - epoch_us(start) // 1000 >= 86400000 GROUP BY site_id, url, stretch""")
def c10_trust_again(spark, sf):
    return ntz(ops.trust_again(fetch(spark, sf)), "trusted_at")


_SWITCHES = """sw AS (SELECT site_id, url, fetched_at AS t, hash FROM (SELECT *, lag(hash) OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id) AS p FROM obs WHERE hash IS NOT NULL) WHERE p IS NULL OR p <> hash)"""


@query(f"""WITH {FETCH_SQL}, {_SWITCHES}, l AS (SELECT *, lead(t) OVER (PARTITION BY site_id, url ORDER BY t) AS left_at FROM sw)
SELECT site_id, url, t AS "at", hash, coalesce(epoch_us(t) // 1000 - epoch_us(max(left_at) OVER w) // 1000 <= 900000, false) OR count(*) OVER w >= 2 AS flip_flop FROM l WINDOW w AS (PARTITION BY site_id, url, hash ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def c11_flip_flops(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("site_id", "url").orderBy("fetched_at", "event_id")
    rows = fetch(spark, sf).where("hash is not null").withColumn("p", F.lag("hash").over(w)).where("p is null or p <> hash")
    return ntz(ops.flip_flops(rows.select("site_id", "url", F.col("fetched_at").alias("at"), "hash"), ["site_id", "url"]), "at")


@query(f"""WITH {FETCH_SQL}, g AS (SELECT *, epoch_us(fetched_at) // 1000 - epoch_us(lag(fetched_at) OVER w) // 1000 AS gap, coalesce(max((status = 200)::INT) OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM obs WINDOW w AS (PARTITION BY site_id, url ORDER BY fetched_at, event_id)),
r AS (SELECT *, coalesce(sum((status = 200)::INT) OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g WHERE status IN (200, 404, 410)),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, url, run ORDER BY fetched_at, event_id) AS nth FROM r WHERE status <> 200 AND seen = 1 AND coalesce(gap, 60000) >= 60000)
SELECT site_id, url, fetched_at AS removed_at FROM n WHERE nth = 2""")
def c12_removed_pages(spark, sf):
    return ntz(ops.removed_pages(fetch(spark, sf)), "removed_at")


@query(f"""WITH {FETCH_SQL}, b AS (SELECT site_id, min(fetched_at) + INTERVAL 5 DAY AS baseline_at FROM obs GROUP BY 1),
r AS (SELECT *, lag(status) OVER (PARTITION BY site_id, url ORDER BY fetched_at, event_id) AS before, min(fetched_at) OVER (PARTITION BY site_id, url) AS first_check FROM obs JOIN b USING (site_id)),
c AS (SELECT site_id, url, min(fetched_at) AS new_at, false AS back FROM r WHERE status = 200 AND fetched_at > baseline_at AND first_check > baseline_at GROUP BY ALL
  UNION ALL SELECT site_id, url, min(fetched_at), true FROM r WHERE status = 200 AND fetched_at > baseline_at AND before IN (404, 410) GROUP BY ALL)
SELECT site_id, url, min(new_at) AS new_at, arg_min(back, (new_at, back)) AS back FROM c GROUP BY ALL""")
def c13_new_pages(spark, sf):
    log = fetch(spark, sf)
    baseline = log.groupBy("site_id").agg((F.min("fetched_at") + F.expr("interval 5 days")).alias("baseline_at"))
    return ntz(ops.new_pages(log, baseline), "new_at")


@query(f"""WITH {FETCH_SQL}, e AS (SELECT DISTINCT site_id % 10 AS site_id, day(fetched_at) % 4 AS read, url FROM obs), k AS (SELECT DISTINCT site_id % 10 AS site_id, url FROM obs WHERE k % 20 = 0), f AS (SELECT * FROM e ANTI JOIN k USING (site_id, url)),
n AS (SELECT site_id, read, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT site_id, min(read) AS first_read FROM e GROUP BY 1) SELECT site_id, read, url, n > 30 OR read = first_read AS silent FROM f JOIN n USING (site_id, read) JOIN m USING (site_id)""")
def c14_sitemap_backfill_guard(spark, sf):
    log = fetch(spark, sf).withColumn("site_id", F.col("site_id") % 10)
    entries = log.select("site_id", (F.dayofmonth("fetched_at") % 4).cast("long").alias("read"), "url").distinct()
    return ops.sitemap_backfill(entries, log.where("k % 20 = 0").select("site_id", "url").distinct(), 30)


@query(f"""WITH {FETCH_SQL}, p AS (SELECT *, lag(hash) OVER w AS prev, lag(true) OVER w AS had FROM obs WINDOW w AS (PARTITION BY site_id, url ORDER BY fetched_at, event_id)),
c AS (SELECT *, CASE WHEN hash IS NOT NULL AND prev IS NULL AND had THEN 'added' WHEN hash IS NULL AND prev IS NOT NULL THEN 'removed' WHEN prev <> hash THEN 'modified' END AS change FROM p)
SELECT site_id, url, fetched_at, change, CASE change WHEN 'added' THEN 0 WHEN 'modified' THEN 1 ELSE 2 END AS rank FROM c WHERE change IS NOT NULL""")
def c15_file_changes(spark, sf):
    return ntz(ops.file_changes(fetch(spark, sf)), "fetched_at")


#: Four assets per observation: two with the build, one of another host, one of the platform.
_ASSETS_SQL = """assets AS (SELECT event_id, site_id, fetched_at, host, unnest(['https://' || host || '/a/app-' || (k // 30) || '.js', 'https://' || host || '/a/main.css?v=17' || (10000000 + k), 'https://cdn.example.net/x' || k || '.js', 'https://' || host || '/cdn-cgi/x.js']) AS url FROM obs WHERE status = 200)"""


def _assets(spark, sf):
    own = lambda *x: F.concat(F.lit("https://"), "host", *x)
    s = lambda c: c.cast("string")
    urls = F.array(own(F.lit("/a/app-"), s(F.floor(F.col("k") / 30)), F.lit(".js")), own(F.lit("/a/main.css?v=17"), s(10_000_000 + F.col("k"))), F.concat(F.lit("https://cdn.example.net/x"), s(F.col("k")), F.lit(".js")), own(F.lit("/cdn-cgi/x.js")))
    return fetch(spark, sf).where("status = 200").select("event_id", "site_id", "fetched_at", "host", F.explode(urls).alias("url"), F.lit(None).cast("string").alias("build_id"))


_PRINTS = f"""{_ASSETS_SQL}, own AS (SELECT event_id, site_id, fetched_at, regexp_replace(url, '\\?v=[0-9]{{10,}}', '') AS url FROM assets WHERE starts_with(url, 'https://' || host || '/') AND url NOT LIKE '%/cdn-cgi/%'),
prints AS (SELECT event_id, site_id, fetched_at, list_sort(list(DISTINCT url)) AS assets FROM own GROUP BY ALL), signed AS (SELECT *, sha1(chr(10) || array_to_string(assets, chr(10))) AS sig FROM prints)"""


@query(f"WITH {FETCH_SQL}, {_PRINTS} SELECT event_id, array_to_string(assets, ' ') AS assets, sig FROM signed")
def c16_deploy_fingerprints(spark, sf):
    return ops.deploy_fingerprints(_assets(spark, sf), ["event_id"]).select("event_id", F.array_join("assets", " ").alias("assets"), "sig")


@query(f"""WITH {FETCH_SQL}, {_PRINTS}, d AS (SELECT *, lag(sig) OVER w AS old_sig, lag(assets) OVER w AS old FROM signed WINDOW w AS (PARTITION BY site_id ORDER BY fetched_at))
SELECT site_id, fetched_at AS seen_at, old_sig, sig, array_to_string(list_sort(list_filter(assets, lambda x: NOT list_contains(old, x))), ' ') AS added, array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(assets, x))), ' ') AS removed FROM d WHERE old_sig <> sig""")
def c17_deploy_changes(spark, sf):
    prints = ops.deploy_fingerprints(_assets(spark, sf), ["site_id", "fetched_at", "event_id"]).withColumnRenamed("fetched_at", "seen_at")
    return ntz(ops.deploy_changes(prints).withColumns({c: F.array_join(c, " ") for c in ("added", "removed")}), "seen_at")


@query(f"""WITH {FETCH_SQL} SELECT DISTINCT site_id, 'https://' || host || '/a' || (k % 5) || '.js' AS path FROM obs WHERE status = 200 AND k % 3 = 1""")
def c18_unstable_asset_queries(spark, sf):
    """Per observation: the confirming fetch has other queries where k leaves 1 by three."""
    log = fetch(spark, sf).where("status = 200")
    url = lambda q: F.concat(F.lit("https://"), "host", F.lit("/a"), (F.col("k") % 5).cast("string"), F.lit(".js?v="), q)
    checks = log.select("event_id", "site_id", url(F.lit("1")).alias("url"))
    confirms = log.select("event_id", "site_id", url(F.when(F.col("k") % 3 == 1, "2").otherwise("1")).alias("url"))
    return ops.unstable_asset_queries(checks, confirms, ["event_id", "site_id"]).select("site_id", "path").distinct()


@query(f"""WITH {FETCH_SQL}, a AS (SELECT event_id, site_id, fetched_at AS t, 'https://' || host || '/a' || (k % 5) || '.js' AS path, k % 13 = 1 AS moved FROM obs WHERE status = 200),
l AS (SELECT site_id, path, min(t) AS learned_at FROM a WHERE moved GROUP BY ALL)
SELECT event_id, site_id, CASE WHEN l.learned_at <= a.t THEN path ELSE path || '?v=1' END AS compared FROM a LEFT JOIN l USING (site_id, path)""")
def c18_compared_assets(spark, sf):
    """The asset of every observation as it is compared: without its query from the first time on that a confirming fetch had another one."""
    log = fetch(spark, sf).where("status = 200")
    url = lambda q: F.concat(F.lit("https://"), "host", F.lit("/a"), (F.col("k") % 5).cast("string"), F.lit(".js?v="), q)
    checks = log.select("event_id", "site_id", F.col("fetched_at").alias("at"), url(F.lit("1")).alias("url"))
    confirms = log.select("event_id", "site_id", F.col("fetched_at").alias("at"), url(F.when(F.col("k") % 13 == 1, "2").otherwise("1")).alias("url"))
    learned = ops.unstable_since(checks, confirms, ["site_id"])
    return ops.compared_assets(checks, learned, ["site_id"]).select("event_id", "site_id", "compared")


_SEEN = "seen AS (SELECT event_id, site_id, fetched_at AS t, 'app' || (k % 4) || '.js' AS url FROM obs WHERE status = 200)"


@query(f"""WITH {FETCH_SQL}, {_SEEN} SELECT c.event_id AS change_id, EXISTS (SELECT 1 FROM seen s WHERE s.site_id = c.site_id AND s.url = c.url AND s.t < c.t AND epoch_us(c.t) - epoch_us(s.t) < 86400000000) AS known FROM seen c""")
def c19_known_asset_variants(spark, sf):
    seen = fetch(spark, sf).where("status = 200").select("event_id", "site_id", F.col("fetched_at").alias("at"), F.concat(F.lit("app"), (F.col("k") % 4).cast("string"), F.lit(".js")).alias("url"))
    return ops.known_variants(seen.withColumnRenamed("event_id", "change_id"), seen.drop("event_id"))


@query(f"""WITH {FETCH_SQL} SELECT event_id, 'dpl' AS name, 'd' || k AS from_value, 'd' || (k + 1) AS to_value FROM obs WHERE status = 200 AND k % 2 = 0""")
def c20_deployment_param_change(spark, sf):
    s = lambda n: (F.col("k") + n).cast("string")
    url = lambda f, dpl, extra: F.concat(F.lit(f"/a/{f}.js?x="), s(0), F.lit("&dpl=d"), dpl, extra)
    odd = F.when(F.col("k") % 2 == 1, s(5)).otherwise(s(1))
    sides = F.array(F.struct(F.lit("-").alias("side"), url("a", s(0), F.lit("")).alias("url")), F.struct(F.lit("-").alias("side"), url("b", s(0), F.lit("")).alias("url")), F.struct(F.lit("+").alias("side"), url("a", s(1), F.lit("")).alias("url")), F.struct(F.lit("+").alias("side"), url("b", odd, F.lit("")).alias("url")))
    return ops.parameter_change(fetch(spark, sf).where("status = 200").select("event_id", F.explode(sides).alias("c")).select("event_id", "c.*"), "event_id")


@query(f"""WITH {FETCH_SQL}, h AS (SELECT DISTINCT site_id, 'path' AS kind, '/p' || k AS value FROM obs WHERE status = 404 AND site_id % 4 <> 0), r AS (SELECT DISTINCT site_id, 'path' AS kind, '/p' || k AS value FROM obs WHERE status = 200),
f AS (SELECT * FROM r ANTI JOIN h USING (site_id, kind, value) WHERE site_id IN (SELECT site_id FROM h)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY value) AS rank FROM f) WHERE rank <= 10""")
def c21_new_code_refs(spark, sf):
    refs = fetch(spark, sf).select("status", "site_id", F.lit("path").alias("kind"), F.concat(F.lit("/p"), F.col("k").cast("string")).alias("value"))
    history = refs.where("status = 404 and site_id % 4 <> 0").drop("status").distinct()
    return ops.new_code_refs(refs.where("status = 200").drop("status"), history, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FETCH_SQL}, r AS (SELECT DISTINCT site_id, CASE WHEN k % 2 = 0 THEN 'path' ELSE 'host' END AS kind, '/a b' || k AS value FROM obs WHERE status = 200),
h AS (SELECT DISTINCT site_id, CASE WHEN k % 2 = 0 THEN 'path' ELSE 'host' END AS kind, '/a b' || k AS value FROM obs WHERE status = 404 AND k % 2 = site_id % 2),
f AS (SELECT * FROM r ANTI JOIN h USING (site_id, kind, value) WHERE (site_id, kind) IN (SELECT site_id, kind FROM h) AND (site_id, value) NOT IN (SELECT site_id, '/a b' || k FROM obs WHERE k % 5 = 0))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, kind ORDER BY value) AS rank FROM f) WHERE rank <= 40""")
def c21_new_refs_by_kind(spark, sf):
    """References that are no known page's path, which is encoded there, of kinds that their site has been searched for before."""
    log, k = fetch(spark, sf), F.col("k").cast("string")
    refs = log.select("status", "site_id", "k", F.when(F.col("k") % 2 == 0, "path").otherwise("host").alias("kind"), F.concat(F.lit("/a b"), k).alias("value"))
    history = refs.where("status = 404 and k % 2 = site_id % 2").drop("status", "k").distinct()
    pages = log.where("k % 5 = 0").select("site_id", F.concat(F.lit("/a%20b"), k).alias("path")).distinct()
    out = ops.new_code_refs(refs.where("status = 200").drop("status", "k"), history, 40, pages, by_kind=True)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FETCH_SQL}, c AS (SELECT DISTINCT site_id, '/api/' || k AS url FROM obs WHERE status = 200 AND k % 3 = 0), t AS (SELECT DISTINCT site_id, '/api/' || k AS url FROM obs WHERE k % 12 = 0), n AS (SELECT site_id, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY url) AS rank FROM c ANTI JOIN t USING (site_id, url)) SELECT site_id, url, rank FROM r LEFT JOIN n USING (site_id) WHERE rank <= 15 - coalesce(n, 0)""")
def c22_api_endpoint_admission(spark, sf):
    log = fetch(spark, sf).select("site_id", F.concat(F.lit("/api/"), F.col("k").cast("string")).alias("url"), "status", (F.col("k") % 3 == 0).alias("is_json"), "k")
    return ops.admit_endpoints(log.drop("k"), log.where("k % 12 = 0").select("site_id", "url").distinct()).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FETCH_SQL}, e AS (SELECT site_id, fetched_at, 'text' AS kind, 1 AS rank, url AS summary FROM obs WHERE status = 200 UNION ALL SELECT site_id, fetched_at, 'removed', 3, url FROM obs WHERE status = 404 UNION ALL SELECT site_id, fetched_at, 'status', 5, 'HTTP ' || status FROM obs WHERE status = 503)
SELECT site_id, fetched_at AS "at", kind, rank, summary FROM e WHERE (site_id, fetched_at) NOT IN (SELECT (site_id, min(fetched_at)) FROM obs GROUP BY site_id)""")
def c25_assemble_events(spark, sf):
    log = fetch(spark, sf).withColumnRenamed("fetched_at", "at")
    rows = lambda status, text: log.where(F.col("status") == status).select("site_id", "at", text.alias("summary"))
    tables = {"text": rows(200, F.col("url")), "removed": rows(404, F.col("url")), "status": rows(503, F.concat(F.lit("HTTP "), F.col("status").cast("string")))}
    return ntz(ops.assemble_events(tables, log.groupBy("site_id").agg(F.min("at").alias("at"))), "at")


@query(f"""WITH {FETCH_SQL}, l AS (SELECT site_id, day(fetched_at) AS run, list_sort(list(DISTINCT url)) AS u FROM obs WHERE status = 404 GROUP BY ALL)
SELECT site_id, run, len(u) AS n, array_to_string(u[1:3], ', ') || CASE WHEN len(u) > 3 THEN ' (+' || (len(u) - 3) || ' more)' ELSE '' END AS summary FROM l""")
def c26_event_summaries(spark, sf):
    runs = fetch(spark, sf).where("status = 404").groupBy("site_id", F.dayofmonth("fetched_at").cast("long").alias("run")).agg(F.array_sort(F.collect_set("url")).alias("u"))
    return runs.select("site_id", "run", F.size("u").cast("long").alias("n"), ops.listed(F.col("u")).alias("summary"))


@query(f"""WITH {FETCH_SQL}, l AS (SELECT site_id % 9 AS site_id, day(fetched_at) AS run, 'page' AS kind, list_sort(list(DISTINCT url)) AS u FROM obs WHERE status = 200 GROUP BY ALL)
SELECT site_id, run, kind, len(u) AS n, array_to_string(u[1:10], ', ') || CASE WHEN len(u) > 10 THEN ' (+' || (len(u) - 10) || ' more)' ELSE '' END AS notice FROM l""")
def c27_noise_notices(spark, sf):
    noisy = fetch(spark, sf).where("status = 200").select((F.col("site_id") % 9).alias("site_id"), F.dayofmonth("fetched_at").cast("long").alias("run"), F.lit("page").alias("kind"), F.col("url").alias("label"))
    return ops.noise_notices(noisy)
