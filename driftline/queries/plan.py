"""Planning, hosts, tables and serving over page and host states that the supplied orders, customers and events stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hosts, plan, serve, tables
from .base import FETCH_SQL, Registry, fetch, rows, table
from .extract import _EDGES, _TITLE
from .status import ntz

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Orders as page states at NOW: every fourth is a file, the order's status says how the last fetch went.
NOW = "1998-12-01 00:00:00"
_PAGES = """pages_state AS (SELECT o_orderkey AS id, o_custkey % 50 AS site_id, 'https://s' || (o_custkey % 50) || '.example.com/o' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN '.pdf' ELSE '.txt' END ELSE '' END AS url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'file' ELSE 'page' END AS kind, (o_orderkey % 5)::INT AS depth, o_orderdate AS first_seen, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_hours((o_orderkey % 100)::INT) END AS last_checked,
  CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'F' THEN 404 ELSE CASE o_orderkey % 3 WHEN 0 THEN 503 WHEN 1 THEN 301 END END AS status, o_orderkey % 3 = 0 AS tracked, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS gone, o_orderkey % 7 <> 0 AS in_scope,
  CASE WHEN o_orderkey % 6 = 0 THEN 'sitemap' ELSE 'link' END AS source FROM orders)"""


def pages_state(spark, sf):
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    site = F.col("o_custkey") % 50
    tail = F.when(k % 8 == 0, ".pdf").when(k % 4 == 0, ".txt").otherwise("")
    status = F.when(F.col("o_orderstatus") == "O", 200).when(F.col("o_orderstatus") == "F", 404).when(k % 3 == 0, 503).when(k % 3 == 1, 301)
    date = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        k.alias("id"), site.alias("site_id"), F.concat(F.lit("https://s"), s(site), F.lit(".example.com/o"), s(k), tail).alias("url"), F.when(k % 4 == 0, "file").otherwise("page").alias("kind"),
        (k % 5).cast("int").alias("depth"), date.alias("first_seen"), F.when(k % 9 != 0, date + F.make_dt_interval(hours=(k % 100).cast("int"))).alias("last_checked"), status.alias("status"),
        (k % 3 == 0).alias("tracked"), ((F.col("o_orderstatus") == "F") & (k % 2 == 0)).alias("gone"), (k % 7 != 0).alias("in_scope"), F.when(k % 6 == 0, "sitemap").otherwise("link").alias("source"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def _ranked(df, *more):
    return df.select("id", "site_id", F.col("rank").cast("long").alias("rank"), *more)


_SECONDS = "(epoch_us(TIMESTAMP '" + NOW + "') // 1000000 - epoch_us({0}) // 1000000)"


@query(f"""WITH {_PAGES}, p AS (SELECT *, greatest(5, ceil(count(*) FILTER (NOT gone) OVER (PARTITION BY site_id) * 30 / 86400.0)) AS most FROM pages_state),
d AS (SELECT * FROM p WHERE last_checked IS NULL OR {_SECONDS.format('last_checked')} < 0 OR {_SECONDS.format('last_checked')} >= 86400)
SELECT id, site_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY last_checked NULLS FIRST, depth, url) AS rank FROM d) WHERE rank <= most""")
def g2_due_pages(spark, sf):
    sites = pages_state(spark, sf).select("site_id").distinct().select("site_id", F.lit(30).alias("interval_sec"), F.lit(86_400).alias("sweep_sec"))
    return _ranked(plan.due_pages(pages_state(spark, sf), sites, _now()))


@query(f"""WITH {_PAGES}, d AS (SELECT *, CASE WHEN last_checked IS NULL THEN 0 ELSE 1 END AS never, CASE WHEN id % 8 = 0 THEN 0 ELSE 1 END AS doc FROM pages_state WHERE kind = 'file' AND (last_checked IS NULL OR {_SECONDS.format('last_checked')} >= 120))
SELECT id, site_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY never, CASE WHEN never = 0 THEN doc END NULLS FIRST, last_checked NULLS FIRST, doc, first_seen, url) AS rank FROM d) WHERE rank <= 10""")
def g3_due_files(spark, sf):
    return _ranked(plan.due_files(pages_state(spark, sf).where("kind = 'file'"), _now(), 120))


@query(f"""WITH {_PAGES}, k AS (SELECT *, tracked AND in_scope AS t FROM pages_state), l AS (SELECT *, t AND NOT gone AS live FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, live ORDER BY depth, first_seen, url) AS place, count(*) FILTER (live) OVER (PARTITION BY site_id) AS n_live, coalesce(NOT t AND NOT gone AND in_scope AND status BETWEEN 200 AND 299, false) AS can FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY site_id, can ORDER BY depth, first_seen, url) AS turn FROM n)
SELECT site_id, url, (CASE WHEN live THEN place <= 70 ELSE t END) OR (can AND turn <= 70 - n_live) AS tracked FROM c""")
def g4_tracked_set(spark, sf):
    out = plan.tracked_set(pages_state(spark, sf), 70)
    return out.withColumn("tracked", F.coalesce("tracked", F.lit(False)))


@query(f"""WITH {_PAGES}, t AS (SELECT *, {_SECONDS.format('last_checked')} AS age FROM pages_state WHERE NOT tracked AND NOT gone AND kind = 'page'),
r AS (SELECT *, CASE WHEN status IS NULL THEN 0 WHEN status BETWEEN 200 AND 299 THEN NULL WHEN status >= 500 THEN CASE WHEN age >= 600 THEN 1 END WHEN status IN (404, 410) THEN CASE WHEN age >= 900 THEN 2 END ELSE CASE WHEN age >= 21600 THEN 3 END END AS tier FROM t),
l AS (SELECT *, tier = 2 OR first_seen > TIMESTAMP '1995-01-01' AS loud FROM r WHERE tier IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, loud ORDER BY tier, depth, last_checked NULLS FIRST, url) AS nth FROM l)
SELECT site_id, url, tier, loud, row_number() OVER (PARTITION BY site_id ORDER BY tier, depth, last_checked NULLS FIRST, url) AS rank FROM n WHERE loud OR nth <= 10""")
def g5_reprobe_queue(spark, sf):
    pages = pages_state(spark, sf).where("not tracked and not gone and kind = 'page'").withColumn("baseline_at", F.lit("1995-01-01").cast("timestamp"))
    return plan.reprobe_queue(pages, _now()).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_PAGES}, k AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS known, status IS NULL AND source = 'sitemap' AS never, coalesce(gone OR status IN (404, 410, 301), false) AS dead FROM pages_state),
e AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN never THEN 0 ELSE 1 END, CASE WHEN never THEN depth END DESC NULLS LAST, CASE WHEN never THEN first_seen END DESC NULLS LAST, last_checked NULLS FIRST, url) AS r FROM k WHERE NOT tracked AND (never OR dead))
SELECT site_id, url FROM e WHERE r <= known - 250""")
def g6_evict_known_urls(spark, sf):
    return plan.evict(pages_state(spark, sf), 250)


@query(f"""WITH {_PAGES}, c AS (SELECT site_id, url, min(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS k, min(id) AS seen FROM pages_state WHERE kind = 'page' GROUP BY ALL)
SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY k, seen, url) <= 40 AS admitted FROM c""")
def g7_admit_candidates(spark, sf):
    kind = F.when(F.col("id") % 3 == 0, "code").when(F.col("id") % 3 == 1, "fresh").otherwise("stale")
    return plan.admit(pages_state(spark, sf).where("kind = 'page'").select("site_id", "url", kind.alias("kind"), F.col("id").alias("seen")), 40)


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT regexp_replace(src, '^.*/', '/') AS src, regexp_extract(dst, '^[a-z]+://[^/]+(/.*)$', 1) AS dst FROM edges), hops AS (SELECT '/' || (page_id % 40) AS src, '/' || ((page_id * 7 + 3) % 97) AS dst FROM pages),
d AS (SELECT '/0' AS url, 0 AS depth UNION SELECT hops.dst, d.depth + 1 FROM d JOIN hops ON hops.src = d.url WHERE d.depth < 4) SELECT url, min(depth) AS depth FROM d GROUP BY 1""")
def g1_crawl_depths(spark, sf):
    i = F.col("page_id")
    slash = lambda c: F.concat(F.lit("/"), c.cast("string"))
    hops = table(spark, sf, "pages").select(slash(i % 40).alias("src"), slash((i * 7 + 3) % 97).alias("dst"))
    return plan.crawl_depths(hops, rows(spark, "url string", [("/0",)]))


@query("""SELECT url, count(*) AS n FROM (SELECT 'https://' || ['a.example.com', 'b.example.com', 'c.other.org'][page_id % 3 + 1] || '/d' || (page_id % 50) || ['.pdf', '.html', '.csv'][page_id % 7 % 3 + 1] AS url FROM pages)
WHERE contains(url, 'example.com') AND NOT contains(url, '.html') AND url <> 'https://a.example.com/d0.pdf' GROUP BY 1""")
def g9_discover_files(spark, sf):
    i = F.col("page_id")
    pick = lambda names, n: F.get(F.array(*(F.lit(x) for x in names)), n.cast("int"))
    dst = F.concat(F.lit("https://"), pick(["a.example.com", "b.example.com", "c.other.org"], i % 3), F.lit("/d"), (i % 50).cast("string"), pick([".pdf", ".html", ".csv"], i % 7 % 3))
    return plan.discover_files(table(spark, sf, "pages").select("page_id", dst.alias("dst")), rows(spark, "url string", [("https://a.example.com/d0.pdf",)]), rows(spark, "root string", [("example.com",)]))


#: Customers as hosts of ten roots.
_HOSTS = """hosts_state AS (SELECT c_custkey AS id, 'r' || (c_custkey % 10) || '.com' AS root, 'h' || (c_custkey // 2) || '.r' || (c_custkey % 10) || '.com' AS host, c_acctbal > 4000 AS alive, TIMESTAMP '1998-10-01' + to_days((c_custkey % 60)::INT) AS first_seen,
  CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '1998-11-30 20:00:00' + to_minutes((c_custkey % 240)::INT) END AS last_probe, '10.' || (c_custkey % 3) || '.' || (c_nationkey) || '.' || (c_custkey % 7) AS ip FROM customer)"""


def hosts_state(spark, sf):
    k, s = F.col("c_custkey"), lambda c: c.cast("string")
    root = F.concat(F.lit("r"), s(k % 10), F.lit(".com"))
    t = lambda x: F.lit(x).cast("timestamp")
    return table(spark, sf, "customer").select(
        k.alias("id"), root.alias("root"), F.concat(F.lit("h"), s(F.floor(k / 2)), F.lit("."), root).alias("host"), (F.col("c_acctbal") > 4000).alias("alive"), (t("1998-10-01") + F.make_dt_interval(days=(k % 60).cast("int"))).alias("first_seen"),
        F.when(k % 5 != 0, t("1998-11-30 20:00:00") + F.make_dt_interval(mins=(k % 240).cast("int"))).alias("last_probe"), F.concat(F.lit("10."), s(k % 3), F.lit("."), s(F.col("c_nationkey")), F.lit("."), s(k % 7)).alias("ip"),
    )


@query("""SELECT DISTINCT 'r' || (c_custkey % 10) || '.com' AS root, 'h' || c_custkey || '.r' || (c_custkey % 10) || '.com' AS host FROM customer WHERE c_custkey % 6 < 3""")
def n1_normalize_names(spark, sf):
    k = F.col("c_custkey")
    s, root = k.cast("string"), F.concat(F.lit("r"), (k % 10).cast("string"), F.lit(".com"))
    name = F.when(k % 6 == 0, F.concat(F.lit("*.H"), s, F.lit("."), root)).when(k % 6 == 1, F.concat(F.lit(" h"), s, F.lit("."), root, F.lit(". "))).when(k % 6 == 2, F.concat(F.lit("h"), s, F.lit("."), root)).when(k % 6 == 3, root).when(k % 6 == 4, F.concat(F.lit("-bad."), root)).otherwise(F.concat(F.lit("h."), F.lit("other.com")))
    return hosts.normalize_names(table(spark, sf, "customer").select(root.alias("root"), name.alias("name")))


@query(f"""WITH {_HOSTS}, f AS (SELECT root, host, ['ct', 'dns', 'link', 'code'][id % 4 + 1] AS source, id % 3 = 0 AS loud FROM hosts_state)
SELECT root, host, array_to_string(list_filter(['ct', 'crtsh', 'dns', 'link', 'code'], lambda x: list_contains(list(source), x)), ' ') AS sources, bool_or(loud) AS loud FROM f GROUP BY root, host""")
def n2_candidate_hosts(spark, sf):
    source = F.get(F.array(*(F.lit(x) for x in ("ct", "dns", "link", "code"))), (F.col("id") % 4).cast("int"))
    found = hosts_state(spark, sf).select("root", "host", source.alias("source"), (F.col("id") % 3 == 0).alias("loud"))
    return hosts.candidate_hosts(found).withColumn("sources", F.array_join("sources", " "))


_ANSWERS = "answers AS (SELECT root, host, 'A' AS kind, ip AS value FROM hosts_state UNION ALL SELECT root, host, 'CNAME', 'c' || (id % 4) || '.net' FROM hosts_state WHERE id % 2 = 0)"


def _answers(spark, sf):
    h = hosts_state(spark, sf)
    a = h.select("root", "host", F.lit("A").alias("kind"), F.col("ip").alias("value"))
    return a.unionByName(h.where("id % 2 = 0").select("root", "host", F.lit("CNAME").alias("kind"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string"), F.lit(".net")).alias("value")))


@query(f"""WITH {_HOSTS}, {_ANSWERS}, w AS (SELECT DISTINCT root, kind, value FROM answers WHERE value = 'c0.net' OR value LIKE '10.1.%'), r AS (SELECT a.root, host, a.kind, w.value IS NOT NULL AS hit FROM answers a LEFT JOIN w USING (root, kind, value))
SELECT root, host FROM r GROUP BY ALL HAVING NOT bool_and(hit) AND NOT coalesce(bool_and(hit) FILTER (kind = 'CNAME'), false)""")
def n3_drop_wildcard_answers(spark, sf):
    answers = _answers(spark, sf)
    return hosts.drop_wildcard_answers(answers, answers.where("value = 'c0.net' or value like '10.1.%'").select("root", "kind", "value").distinct())


@query(f"""WITH {_HOSTS}, k AS (SELECT DISTINCT root, ip FROM hosts_state WHERE id % 2 = 0) SELECT h.root, count(*) FILTER (k.ip IS NULL) > 0 AS rotating, count(DISTINCT regexp_extract(h.ip, '^(\\d+\\.\\d+\\.\\d+)\\.', 1)) > 4 AS spread FROM hosts_state h LEFT JOIN k ON h.root = k.root AND h.ip = k.ip GROUP BY h.root""")
def n4_rotating_wildcards(spark, sf):
    h = hosts_state(spark, sf).select("id", "root", F.col("ip").alias("value"))
    return hosts.rotating_wildcards(h.drop("id"), h.where("id % 2 = 0").select("root", "value").distinct())


#: Hosts of rotating pools: IPv4 in a few networks for some roots (and a few hosts elsewhere) and in many for others, IPv6 for every fourth
#: host, aliases for some.
_POOL = f"""pool AS (SELECT id, root, host, CASE WHEN id % 4 = 3 THEN 'AAAA' WHEN id % 9 = 5 THEN 'CNAME' ELSE 'A' END AS kind, id % 10 < 6 AS narrow FROM hosts_state),
pv AS (SELECT *, CASE kind WHEN 'AAAA' THEN '2001:db8:' || (CASE WHEN narrow AND id % 11 = 0 AND id % 7 >= 3 AND id % 3 <> 0 THEN 77 WHEN narrow THEN id % 2 ELSE id % 40 END) || '::' || (id % 900 + 1) WHEN 'CNAME' THEN 'c' || (id % 3) || '.net' ELSE '203.0.' || (CASE WHEN narrow AND id % 11 = 0 AND id % 7 >= 3 AND id % 3 <> 0 THEN 77 WHEN narrow THEN id % 2 ELSE id % 60 END) || '.' || (id % 200) END AS value,
  CASE kind WHEN 'AAAA' THEN '2001:db8:' || (CASE WHEN narrow AND id % 11 = 0 AND id % 7 >= 3 AND id % 3 <> 0 THEN 77 WHEN narrow THEN id % 2 ELSE id % 40 END) WHEN 'A' THEN '203.0.' || (CASE WHEN narrow AND id % 11 = 0 AND id % 7 >= 3 AND id % 3 <> 0 THEN 77 WHEN narrow THEN id % 2 ELSE id % 60 END) END AS prefix FROM pool)"""


@query(f"""WITH {_HOSTS}, {_POOL}, known AS (SELECT DISTINCT root, kind, value, prefix FROM pv WHERE id % 3 = 0),
probes AS (SELECT p.root, host, p.kind, p.prefix, k.value IS NOT NULL AS old FROM pv p LEFT JOIN known k ON k.root = p.root AND k.value = p.value WHERE id % 7 < 3),
moved AS (SELECT root, bool_or(fresh AND NOT coalesce(explained, false)) AS rotating FROM (SELECT root, host, bool_or(NOT old) AS fresh, bool_and(old) FILTER (kind = 'CNAME') AS explained FROM probes GROUP BY ALL) GROUP BY root),
spreads AS (SELECT root, count(DISTINCT prefix) > 4 AS spread FROM probes GROUP BY root),
hit AS (SELECT p.root, p.host, p.kind, p.prefix, k.value IS NOT NULL AS hit FROM pv p LEFT JOIN known k ON k.root = p.root AND k.kind = p.kind AND k.value = p.value),
kept AS (SELECT root, host FROM hit GROUP BY ALL HAVING NOT bool_and(hit) AND NOT coalesce(bool_and(hit) FILTER (kind = 'CNAME'), false)),
near AS (SELECT root, host, bool_and(prefix IN (SELECT prefix FROM known k WHERE k.root = hit.root)) AS all_near FROM hit WHERE kind <> 'CNAME' GROUP BY ALL),
sizes AS (SELECT root, count(DISTINCT prefix) AS n FROM known WHERE kind <> 'CNAME' GROUP BY root)
SELECT root, host FROM kept JOIN moved USING (root) JOIN spreads USING (root) LEFT JOIN near USING (root, host) LEFT JOIN sizes USING (root)
WHERE NOT rotating OR (NOT (spread OR n IS NULL OR n > 4) AND NOT coalesce(all_near, false))""")
def n4_rotating_pools(spark, sf):
    """What is left of hosts under rotating wildcards of both families, by the state that probes give."""
    i, s = F.col("id"), lambda c: c.cast("string")
    kind = F.when(i % 4 == 3, "AAAA").when(i % 9 == 5, "CNAME").otherwise("A")
    outside = (i % 11 == 0) & (i % 7 >= 3) & (i % 3 != 0)  # neither probed nor known
    net = lambda n: s(F.when((i % 10 < 6) & outside, 77).when(i % 10 < 6, i % 2).otherwise(i % n))
    value = F.when(kind == "AAAA", F.concat(F.lit("2001:db8:"), net(40), F.lit("::"), s(i % 900 + 1))).when(kind == "CNAME", F.concat(F.lit("c"), s(i % 3), F.lit(".net"))).otherwise(F.concat(F.lit("203.0."), net(60), F.lit("."), s(i % 200)))
    pool = hosts_state(spark, sf).select("id", "root", "host", kind.alias("kind"), value.alias("value"))
    known = pool.where("id % 3 = 0").select("root", "kind", "value").distinct()
    state = hosts.rotating_wildcards(pool.where("id % 7 < 3").withColumnRenamed("host", "name"), known)
    return hosts.drop_rotating_answers(pool.drop("id"), known, state)


@query(f"""WITH {_HOSTS}, p AS (SELECT root, host, array_to_string(list_sort(list(DISTINCT '10.0.' || (id % 4 // 2))), ' ') AS answer FROM hosts_state GROUP BY ALL) SELECT root, answer, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5""")
def n5_shared_answer_groups(spark, sf):
    value = F.concat(F.lit("10.0."), F.floor(F.col("id") % 4 / 2).cast("string"))
    return hosts.shared_answer_groups(hosts_state(spark, sf).select("root", "host", value.alias("value")), 5)


@query(f"""WITH {_HOSTS}, r AS (SELECT root, ip AS value, max(last_probe) AS last_seen FROM hosts_state WHERE {_SECONDS.format('last_probe')} BETWEEN 0 AND 10800 GROUP BY ALL) SELECT root, value, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY last_seen DESC, value) AS n FROM r) WHERE n <= 20""")
def n6_remember_wildcards(spark, sf):
    answers = hosts_state(spark, sf).select("root", F.col("ip").alias("value"), F.col("last_probe").alias("at"))
    return ntz(hosts.remember_wildcards(answers, _now(), 3, 20), "last_seen")


@query(f"""WITH {_HOSTS}, c AS (SELECT root, host, bool_or(alive) AS alive FROM hosts_state GROUP BY ALL), k AS (SELECT DISTINCT root, host FROM hosts_state WHERE id % 3 = 0)
SELECT * FROM (SELECT root, host, alive, row_number() OVER (PARTITION BY root ORDER BY alive DESC, host) AS rank FROM c ANTI JOIN k USING (root, host)) WHERE rank <= 50""")
def n7_new_subdomains(spark, sf):
    h = hosts_state(spark, sf)
    out = hosts.new_subdomains(h.groupBy("root", "host").agg(F.bool_or("alive").alias("alive")), h.where("id % 3 = 0").select("root", "host").distinct())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FETCH_SQL}, p AS (SELECT host AS root, url AS host, fetched_at AS t, status = 200 AS alive FROM obs), d AS (SELECT *, bool_and(NOT alive) OVER (PARTITION BY root, host ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dead FROM p)
SELECT root, host, min(t) AS live_at FROM d WHERE alive AND dead GROUP BY ALL""")
def n8_went_live(spark, sf):
    probes = fetch(spark, sf).select(F.col("host").alias("root"), F.col("url").alias("host"), F.col("fetched_at").alias("at"), (F.col("status") == 200).alias("alive"))
    return ntz(hosts.went_live(probes), "live_at")


@query(f"""WITH {_HOSTS}, d AS (SELECT *, CASE WHEN {_SECONDS.format('first_seen')} >= 2592000 THEN 10800 WHEN {_SECONDS.format('first_seen')} >= 604800 THEN 1800 ELSE 600 END AS every FROM hosts_state WHERE NOT alive)
SELECT id, root, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY last_probe NULLS FIRST, host) AS rank FROM d WHERE last_probe IS NULL OR {_SECONDS.format('last_probe')} >= every * 0.85) WHERE rank <= 200""")
def n9_reprobe_due(spark, sf):
    one = hosts_state(spark, sf)
    return hosts.reprobe_due(one, _now(), 600).select("id", "root", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FETCH_SQL} SELECT DISTINCT host AS root, day(fetched_at) AS run FROM obs WHERE status = 200")
def n10_resolver_health(spark, sf):
    log = fetch(spark, sf).select(F.col("host").alias("root"), F.dayofmonth("fetched_at").cast("long").alias("run"), "host", (F.col("status") == 200).alias("ok"))
    return hosts.resolver_health(log)


_LABELS = ["www", "app", "api", "docs", "blog", "status", "cdn", "staging", "dev", "test"]


@query(f"WITH {_HOSTS} SELECT root, unnest({_LABELS}) || '.' || root AS host FROM (SELECT DISTINCT root FROM hosts_state)")
def n11_expand_wordlist(spark, sf):
    return hosts.expand_wordlist(hosts_state(spark, sf).select("root").distinct(), _LABELS)


@query(f"WITH {_HOSTS}, h AS (SELECT root, host, bool_or(alive) AS alive FROM hosts_state GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY alive DESC, host) AS rank FROM h) WHERE rank <= 30")
def n12_scan_subdomain_list(spark, sf):
    h = hosts_state(spark, sf).groupBy("root", "host").agg(F.bool_or("alive").alias("alive"))
    return hosts.scan_list(h, 30).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {FETCH_SQL}, u AS (SELECT *, 0 AS is_new FROM obs WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM obs WHERE event_id % 2 = 1 AND site_id % 5 <> 0)
SELECT site_id, url, arg_max(status, (is_new, fetched_at)) AS status, max(fetched_at) FILTER (is_new = m) AS fetched_at FROM (SELECT *, max(is_new) OVER (PARTITION BY site_id, url) AS m FROM u) GROUP BY ALL""")
def s3_upsert_pages(spark, sf):
    log = fetch(spark, sf).select("event_id", "site_id", "url", "status", "fetched_at")
    halves = [log.where(f"event_id % 2 = {k}").drop("event_id") for k in (0, 1)]
    return ntz(tables.upsert(halves[0], halves[1], log.where("site_id % 5 <> 0").select("site_id").distinct(), ["site_id", "url"], "fetched_at"), "fetched_at")


@query(f"""WITH {FETCH_SQL} SELECT site_id, url, arg_max(event_id, (fetched_at, event_id % 3, event_id)) AS event_id, max(fetched_at) AS fetched_at FROM obs WHERE event_id % 3 = 0 OR site_id % 5 <> 0 GROUP BY ALL""")
def s3_merge_pages(spark, sf):
    """A table by site into which two batches are merged, the later one first and one of them twice, read back."""
    import uuid

    from ..sources.shared import shared_dir

    log = fetch(spark, sf).select("event_id", "site_id", "url", "fetched_at")
    parts = [log.where(f"event_id % 3 = {k}") for k in range(3)]
    path = f"{shared_dir(spark).rstrip('/')}/pages-by-site-{uuid.uuid4().hex}"
    sites = log.where("site_id % 5 <> 0").select("site_id").distinct()
    tables.write_by_site(tables.upsert(parts[0].limit(0), parts[0], log, ["site_id", "url"], "fetched_at"), path)
    for k in (2, 1, 2):
        tables.merge_by_site(path, parts[k], sites, ["site_id", "url"], "fetched_at")
    return ntz(spark.read.parquet(path).drop("site_bucket"), "fetched_at")


@query(f"""WITH {_HOSTS} SELECT root, host, arg_max(id, (id % 2, id)) AS id FROM hosts_state GROUP BY ALL""")
def s4_upsert_subdomains(spark, sf):
    h = hosts_state(spark, sf).select(F.col("id"), F.col("root"), F.col("host"), F.col("id").alias("site_id"))
    out = tables.upsert(h.where("id % 2 = 0"), h.where("id % 2 = 1"), h.select("site_id"), ["root", "host"], "id")
    return out.drop("site_id")


@query(f"WITH {FETCH_SQL} SELECT event_id, left(repeat(url, 200), 4000) AS summary FROM obs WHERE site_id % 3 <> 0")
def s5_append_events(spark, sf):
    events = fetch(spark, sf).select("event_id", "site_id", F.repeat("url", F.lit(200)).alias("summary"))
    return tables.append_events(events, events.where("site_id % 3 <> 0").select("site_id").distinct()).select("event_id", "summary")


@query(f"WITH {FETCH_SQL} SELECT event_id FROM obs WHERE fetched_at >= TIMESTAMP '2024-01-15'")
def s6_prune_events(spark, sf):
    return tables.prune_events(fetch(spark, sf), F.lit("2024-01-15").cast("timestamp"), "fetched_at").select("event_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5000")
def s6_keep_newest_code_refs(spark, sf):
    return tables.keep_newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 5000, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey")


@query(f"WITH {FETCH_SQL} SELECT 'pages' AS tbl, count(DISTINCT url) AS n FROM obs WHERE site_id % 4 <> 0 UNION ALL SELECT 'events', count(*) FROM obs WHERE site_id % 4 <> 0")
def s7_delete_sites(spark, sf):
    log = fetch(spark, sf)
    left = tables.delete_sites({"pages": log.select("site_id", "url").distinct(), "events": log.select("site_id", "event_id")}, log.where("site_id % 4 = 0").select("site_id").distinct())
    return left["pages"].agg(F.lit("pages").alias("tbl"), F.count(F.lit(1)).alias("n")).unionByName(left["events"].agg(F.lit("events").alias("tbl"), F.count(F.lit(1)).alias("n")))


@query("""SELECT event_id, (props->>'$.k')::INT % 2 = 0 AS deploy, true AS text, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::BIGINT ELSE 30 END AS interval_sec, event_id % 5 = 0 AS paused, CASE WHEN event_id % 2 = 0 THEN '/a*,/b' ELSE '' END AS exclude FROM events""")
def s8_normalize_state(spark, sf):
    k, i, s = F.get_json_object("props", "$.k"), F.col("event_id"), F.lit
    raw = F.concat(s('{"features":{"deploy":'), (k.cast("int") % 2 == 0).cast("string"), s(',"text":7,"other":true},"interval_sec":'), F.when(i % 3 == 0, k).otherwise('"x"'), s(',"paused":'), (i % 5 == 0).cast("string"), F.when(i % 2 == 0, ',"exclude":["/a*",null,"/b"]}').otherwise("}"))
    state = table(spark, sf, "events").select("event_id", tables.normalize_state(raw).alias("s"))
    return state.select("event_id", "s.features.deploy", "s.features.text", "s.interval_sec", "s.paused", F.array_join("s.exclude", ",").alias("exclude"))


@query("""SELECT c_custkey AS site_id, '{"v":1,"name":"' || c_name || '","url":"https://c' || c_custkey || '.example.com/"}' AS line FROM customer""")
def s9_export_site_list(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("name"), F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com/")).alias("url"))
    return tables.export_sites(sites)


@query("""SELECT c_name AS name, 'https://c' || c_custkey || '.example.com/' AS url FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""")
def s9_import_site_list(spark, sf):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example.com/"))
    c = table(spark, sf, "customer")
    line = F.when(k % 3 == 0, F.lit('{"v":2,"url":"x"}')).otherwise(F.to_json(F.struct(F.lit(1).alias("v"), F.col("c_name").alias("name"), url.alias("url"))))
    return tables.import_sites(c.select(line.alias("line")), c.where("c_custkey % 5 = 0").select(url.alias("url")))


@query("""SELECT page_id AS site_id, pos, [split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/sm.xml', 'https://x.example.com/s' || page_id || '.xml'][n] AS sitemap_url FROM pages, (VALUES (1, 1), (2, 2)) v(n, pos)""")
def s10_ingest_robots(spark, sf):
    body = F.concat(F.lit("User-agent: *\nSitemap: /sm.xml\r\n  SITEMAP : https://x.example.com/s"), F.col("page_id").cast("string"), F.lit(".xml#top\nsitemap: /sm.xml\nDisallow: /"))
    return tables.ingest_robots(table(spark, sf, "pages").select(F.col("page_id").alias("site_id"), "url", body.alias("body"))).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT page_id AS doc, kind, pos, loc FROM (SELECT page_id, 'page' AS kind, unnest([0, 1]) AS pos, unnest(['https://a.example.com/' || page_id || '?a=1&b=2', 'https://a.example.com/x']) AS loc FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'sitemap', 0, 'https://a.example.com/s' || page_id || '.xml' FROM pages WHERE page_id % 3 = 1)""")
def s11_ingest_sitemaps(spark, sf):
    s, i = F.col("page_id").cast("string"), F.col("page_id") % 3
    pages = F.concat(F.lit("<urlset><url><loc> https://a.example.com/"), s, F.lit("?a=1&amp;b=2 </loc><lastmod>x</lastmod></url><url><loc><![CDATA[https://a.example.com/x]]></loc><image><loc>no</loc></image></url></urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>https://a.example.com/s"), s, F.lit(".xml</loc></sitemap></sitemapindex>"))
    return tables.ingest_sitemaps(table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.when(i == 0, pages).when(i == 1, index).otherwise(F.lit("<html>https://a.example.com</html>")).alias("body")))


@query("""WITH RECURSIVE refs AS (SELECT page_id AS doc, page_id * 2 + 1 AS child FROM pages UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages), t AS (SELECT page_id AS site_id, page_id AS doc, 0 AS lvl FROM pages UNION SELECT site_id, child, lvl + 1 FROM t JOIN refs USING (doc) WHERE lvl < 3)
SELECT site_id, count(DISTINCT doc) AS n_docs, bool_and(doc IN (SELECT page_id FROM pages) AND doc % 11 <> 10) AS complete, false AS cut FROM t GROUP BY 1""")
def s12_resolve_sitemap_tree(spark, sf):
    p, i = table(spark, sf, "pages"), F.col("page_id")
    refs = p.select(i.alias("doc"), F.explode(F.array(i * 2 + 1, i * 2 + 2)).alias("child"))
    return tables.sitemap_tree(p.select(i.alias("doc"), (i % 11 != 10).alias("ok")), refs, p.select(i.alias("site_id"), i.alias("doc")), max_level=3)


@query("""WITH RECURSIVE refs AS (SELECT page_id AS doc, page_id * 2 + 1 AS child FROM pages UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages), t AS (SELECT page_id AS site_id, page_id AS doc, 0 AS level FROM pages UNION SELECT site_id, child, level + 1 FROM t JOIN refs USING (doc)),
l AS (SELECT site_id, doc, min(level) AS level FROM t GROUP BY ALL), p AS (SELECT page_id AS doc, unnest(range(4)) AS pos FROM pages),
o AS (SELECT site_id, 'https://s.example.com/p' || ((doc * 3 + pos) // 2) AS url, min({'lvl': level, 'doc': doc, 'pos': pos}) AS place FROM l JOIN p USING (doc) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY place, url) AS nth, count(*) OVER (PARTITION BY site_id) AS n FROM o)
SELECT site_id, url, place.lvl AS level, place.doc AS doc, place.pos AS pos, n > 25 AS cut FROM r WHERE nth <= 25""")
def s12_sitemap_urls(spark, sf):
    """The first 25 pages of every site, whose sitemaps share some, in breadth-first order over all levels."""
    p, i = table(spark, sf, "pages"), F.col("page_id")
    refs = p.select(i.alias("doc"), F.explode(F.array(i * 2 + 1, i * 2 + 2)).alias("child"))
    levels = tables.sitemap_levels(refs, p.select(i.alias("site_id"), i.alias("doc")))
    pages = p.select(i.alias("doc"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit("https://s.example.com/p"), F.floor((i * 3 + k) / 2).cast("string")))).alias("pos", "url"))
    out = tables.sitemap_urls(levels, pages, 25)
    return out.select("site_id", "url", F.col("level").cast("long").alias("level"), "doc", F.col("pos").cast("long").alias("pos"), "cut")


@query("""SELECT DISTINCT 'r' || (c_custkey % 10) || '.com' AS root, c_custkey AS id, unnest(['a' || c_custkey || '.com', '*.b.com', 'n' || c_custkey || '.com']) AS name FROM customer WHERE c_custkey > 100""")
def s13_ingest_ct(spark, sf):
    s = F.col("c_custkey").cast("string")
    made = table(spark, sf, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 10).cast("string"), F.lit(".com")).alias("root"), F.col("c_custkey").alias("id"), F.array(F.concat(F.lit("A"), s, F.lit(".com")), F.lit("*.b.com")).alias("dns_names"), F.concat(F.lit("*.b.com\n*.B.com")).alias("name_value"), F.concat(F.lit("n"), s, F.lit(".com")).alias("common_name"))
    return tables.ingest_ct(made, 100)


@query("""WITH c AS (SELECT c_custkey AS k, 'r' || (c_custkey % 10) || '.com' AS root FROM customer)
SELECT root, k * 3 AS id, 'a' || k || '.com' AS name FROM c UNION ALL SELECT root, k * 3, '*.b.com' FROM c UNION ALL SELECT root, k * 3 + 1, unnest(['n' || k || '.com', 'm.com', 'cn' || k || '.com']) FROM c UNION ALL SELECT root, k * 3 + 2, 'last' || k || '.com' FROM c WHERE k % 2 = 0""")
def s13_salvaged_ct(spark, sf):
    """Answers of certificate logs, every second one cut in the middle of its last entry."""
    k = F.col("c_custkey")
    s, n = k.cast("string"), lambda by: (k * 3 + by).cast("string")
    last = F.concat(F.lit(',{"id":'), n(2), F.lit(',"dns_names":["last'), s, F.lit('.com"]}]'))
    body = F.concat(F.lit('[{"id":'), n(0), F.lit(',"issuer":{"name":"x","id":7},"dns_names":["A'), s, F.lit('.com","*.b.com"]},{"id":'), n(1), F.lit(',"name_value":"n'), s, F.lit('.com\\nm.com","common_name":"cn'), s, F.lit('.com"}'), F.when(k % 2 == 0, last).otherwise(F.substring(last, 1, 22)))
    made = table(spark, sf, "customer").select(F.concat(F.lit("r"), (k % 10).cast("string"), F.lit(".com")).alias("root"), body.alias("body"))
    return tables.ingest_ct(tables.ct_issuances(made), -1)


@query("""SELECT c_custkey AS id, '1.1.1.' || (c_custkey % 4) || ' 9.9.9.9' AS a, CASE WHEN c_custkey % 2 = 0 THEN '2001:db8::a' END AS aaaa, NULL AS cname FROM customer""")
def s14_ingest_dns(spark, sf):
    k = F.col("c_custkey")
    a = F.array(F.lit("9.9.9.9"), F.concat(F.lit(" 1.1.1."), (k % 4).cast("string")), F.lit("9.9.9.9"))
    none = F.array().cast("array<string>")
    out = tables.ingest_dns(table(spark, sf, "customer").select(k.alias("id"), a.alias("a"), F.when(k % 2 == 0, F.array(F.lit("2001:DB8::A"))).otherwise(none).alias("aaaa"), F.array(F.lit("")).alias("cname")))
    return out.select("id", *(F.array_join(c, " ").alias(c) for c in ("a", "aaaa", "cname")))


@query("""WITH p AS (SELECT 'h' || (c_custkey // 2) AS host, CASE WHEN c_custkey % 2 = 0 THEN 'https' ELSE 'http' END AS scheme, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 200 END AS status, repeat(c_name, 30) AS title FROM customer)
SELECT host, arg_min(scheme, o) AS scheme, arg_min(status, o) AS status, left(arg_min(title, o), 300) AS title FROM (SELECT *, (CASE WHEN status = 0 THEN 2 WHEN scheme = 'https' THEN 0 ELSE 1 END) * 2 + CASE WHEN scheme = 'https' THEN 0 ELSE 1 END AS o FROM p) GROUP BY host""")
def s15_ingest_http_probes(spark, sf):
    k = F.col("c_custkey")
    probes = table(spark, sf, "customer").select(F.concat(F.lit("h"), F.floor(k / 2).cast("string")).alias("host"), F.when(k % 2 == 0, "https").otherwise("http").alias("scheme"), F.when(k % 3 == 0, 0).otherwise(200).alias("status"), F.repeat("c_name", F.lit(30)).alias("title"), F.lit("nginx").alias("server"))
    return tables.ingest_http_probes(probes).drop("server")


@query("""SELECT c_custkey AS input_id, CASE c_custkey % 6 WHEN 0 THEN 'https://c' || c_custkey || '.com:8080/x' WHEN 1 THEN 'http://C' || c_custkey || '.com' END AS url, CASE c_custkey % 6 WHEN 0 THEN 'c' || c_custkey || '.com' WHEN 1 THEN 'c' || c_custkey || '.com' END AS host,
  CASE c_custkey % 6 WHEN 2 THEN 'scheme' WHEN 3 THEN 'no dot' WHEN 4 THEN 'blank inside' WHEN 5 THEN 'label' END AS reason FROM customer""")
def s16_seed_sites(spark, sf):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit(" c"), s, F.lit(".com:8080/x"))).when(k % 6 == 1, F.concat(F.lit("<http://C"), s, F.lit(".com>"))).when(k % 6 == 2, F.concat(F.lit("ftp://c"), s, F.lit(".com"))).when(k % 6 == 3, "localhost").when(k % 6 == 4, "two words.com").otherwise("-x-.com")
    return tables.seed_sites(table(spark, sf, "customer").select(k.alias("input_id"), text.alias("text")))


@query(f"WITH {_PAGES} SELECT site_id, count(*) FILTER (kind = 'page' AND tracked AND NOT gone) AS tracked, count(*) FILTER (kind = 'page') AS known, count(*) FILTER (kind = 'file' AND tracked) AS files, count(*) FILTER (gone) AS gone FROM pages_state GROUP BY 1")
def a1_page_stats(spark, sf):
    return serve.page_stats(pages_state(spark, sf))


@query(f"WITH {_HOSTS} SELECT root, count(*) AS known, count(*) FILTER (alive) AS live FROM hosts_state GROUP BY 1")
def a2_subdomain_stats(spark, sf):
    return serve.subdomain_stats(hosts_state(spark, sf))


@query(f"WITH {_PAGES} SELECT id, url FROM pages_state WHERE site_id = 7 AND kind = 'page' AND tracked ORDER BY depth, first_seen, url LIMIT 50 OFFSET 10")
def a3_list_pages(spark, sf):
    return serve.list_pages(pages_state(spark, sf), 7, "page", True, 50, 10).select("id", "url")


@query(f"""WITH {_HOSTS}, s AS (SELECT id AS site_id, host, CASE WHEN id % 2 = 0 THEN 'https' ELSE 'http' END AS scheme FROM hosts_state WHERE id % 4 < 2), w AS (SELECT host, arg_min(site_id, (scheme <> 'https', site_id)) AS watched_as FROM s GROUP BY 1)
SELECT id, h.host, watched_as FROM hosts_state h LEFT JOIN w USING (host)""")
def a4_list_subdomains(spark, sf):
    h = hosts_state(spark, sf)
    sites = h.where("id % 4 < 2").select(F.col("id").alias("site_id"), "host", F.when(F.col("id") % 2 == 0, "https").otherwise("http").alias("scheme"))
    return serve.list_subdomains(h, sites).select("id", "host", "watched_as")


_SITES = "st AS (SELECT DISTINCT site_id, site_id % 4 AS tenant_id, 'Site ' || site_id AS name FROM obs)"


def _sites(spark, sf):
    s = F.col("site_id")
    return fetch(spark, sf).select("site_id").distinct().select(s, (s % 4).alias("tenant_id"), F.concat(F.lit("Site "), s.cast("string")).alias("name"))


@query(f"WITH {FETCH_SQL}, {_SITES} SELECT event_id, site_id, name FROM obs JOIN st USING (site_id) WHERE tenant_id = 2 AND event_id > 300 ORDER BY event_id LIMIT 200")
def a5_event_feed(spark, sf):
    return serve.event_feed(fetch(spark, sf), _sites(spark, sf), 2, 300, 200).select("event_id", "site_id", "name")


@query(f"WITH {FETCH_SQL}, p AS (SELECT event_id, url FROM obs WHERE site_id = 8 AND event_id < 9000 ORDER BY event_id DESC LIMIT 20) SELECT *, (SELECT min(event_id) FROM p) AS next_cursor FROM p")
def a6_history(spark, sf):
    return serve.history(fetch(spark, sf), 8, 9000, 20).select("event_id", "url", "next_cursor")


_STATUS = "stt AS (SELECT site_id, site_id % 4 AS tenant_id, CASE WHEN site_id % 9 = 0 THEN 'paused' WHEN site_id % 13 = 1 THEN 'scanning' WHEN bool_or(status = 503) FILTER (k > 90) THEN 'down' WHEN bool_or(blocked) FILTER (k > 80) THEN 'blocked' ELSE 'up' END AS status FROM obs GROUP BY site_id)"


def _status(spark, sf):
    s = F.col("site_id")
    facts = fetch(spark, sf).groupBy("site_id").agg(F.coalesce(F.bool_or(F.when(F.col("k") > 90, F.col("status") == 503)), F.lit(False)).alias("down"), F.coalesce(F.bool_or(F.when(F.col("k") > 80, F.col("blocked"))), F.lit(False)).alias("blocked"))
    return facts.select("site_id", (s % 4).alias("tenant_id"), serve.site_status(s % 9 == 0, s % 13 != 1, F.col("down"), F.col("blocked")).alias("status"))


@query(f"WITH {FETCH_SQL}, {_STATUS} SELECT site_id, status FROM stt")
def a7_site_status(spark, sf):
    return _status(spark, sf).select("site_id", "status")


@query(f"""WITH {FETCH_SQL}, {_STATUS}, c AS (SELECT tenant_id, count(*) FILTER (status = 'up') AS up, count(*) FILTER (status = 'down') AS down, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'paused') AS paused, count(*) FILTER (status = 'scanning') AS scanning, count(*) AS n FROM stt GROUP BY 1)
SELECT tenant_id, up, down, blocked, paused, scanning, CASE WHEN down > 0 THEN down || ' of ' || n || ' down' ELSE n || ' sites, none down' END AS headline FROM c""")
def a8_tenant_summary(spark, sf):
    return serve.tenant_summary(_status(spark, sf))


@query(f"""WITH {FETCH_SQL}, {_SITES}, {_PAGES}, p AS (SELECT site_id, count(*) FILTER (kind = 'page' AND tracked AND NOT gone) AS tracked, count(*) FILTER (kind = 'page') AS known, count(*) FILTER (kind = 'file' AND tracked) AS files, count(*) FILTER (gone) AS gone FROM pages_state GROUP BY 1),
e AS (SELECT site_id, count(*) AS n_events, max(event_id) AS last_event FROM obs GROUP BY 1) SELECT site_id, tenant_id, name, coalesce(tracked, 0) AS tracked, coalesce(known, 0) AS known, coalesce(files, 0) AS files, coalesce(gone, 0) AS gone, coalesce(n_events, 0) AS n_events, last_event FROM st LEFT JOIN p USING (site_id) LEFT JOIN e USING (site_id)""")
def a9_site_card(spark, sf):
    return serve.site_card(_sites(spark, sf), pages_state(spark, sf), fetch(spark, sf))


@query("""SELECT page_id FROM pages WHERE split_part(regexp_replace(url, '[?#].*$', ''), '/', 3) = 'm.ththth.example.net'""")
def a11_sites_by_url(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", F.split(F.regexp_replace("url", "[?#].*$", ""), "/")[2].alias("host"))
    return serve.sites_by_url(p, "https://m.ththth.example.net/").select("page_id")


@query(f"""WITH {FETCH_SQL}, {_PAGES}, {_HOSTS}, p AS (SELECT site_id, count(*) FILTER (kind = 'page' AND tracked AND NOT gone) AS tracked, count(*) FILTER (kind = 'page') AS known, count(*) FILTER (kind = 'file' AND tracked) AS files, count(*) FILTER (gone) AS gone FROM pages_state GROUP BY 1),
h AS (SELECT id % 30 AS site_id, count(*) AS n_hosts FROM hosts_state GROUP BY 1), d AS (SELECT site_id, arg_max(hash, fetched_at) AS sig FROM obs WHERE hash IS NOT NULL GROUP BY 1) SELECT p.*, coalesce(n_hosts, 0) AS n_hosts, sig FROM p LEFT JOIN h USING (site_id) LEFT JOIN d USING (site_id)""")
def a12_run_summary(spark, sf):
    deploys = fetch(spark, sf).where("hash is not null").select("site_id", F.col("hash").alias("sig"), F.col("fetched_at").alias("seen_at"))
    return serve.run_summary(pages_state(spark, sf), hosts_state(spark, sf).select((F.col("id") % 30).alias("site_id"), "host"), deploys)


@query(f"""WITH {_EDGES}, n AS (SELECT page_id, count(*) AS internal FROM edges GROUP BY 1),
m AS (SELECT page_id AS site_id, split_part(url, '/', 3) AS host, {_TITLE} AS title, CASE WHEN contains(html, 'track(') THEN 'Tracker' ELSE 'None' END AS technologies FROM pages)
SELECT site_id, host, title, technologies, internal, CASE WHEN internal IS NULL THEN NULL ELSE 0::BIGINT END AS external, host IN (SELECT host FROM m WHERE site_id % 5 = 0) AS watched FROM m LEFT JOIN n ON site_id = page_id""")
def a10_site_report(spark, sf):
    from ..operators import extract as x

    pages = table(spark, sf, "pages")
    meta = pages.select(F.col("page_id").alias("site_id"), F.split("url", "/")[2].alias("host"), x.page_meta(F.col("html"))["title"].alias("title"))
    techs = pages.select(F.col("page_id").alias("site_id"), F.when(F.col("html").contains("track("), "Tracker").otherwise("None").alias("name"))
    links = x.link_counts(x.link_edges(pages)).withColumnRenamed("page_id", "site_id")
    return serve.site_report(meta, techs, links, meta.where("site_id % 5 = 0"))


_ORIGIN, _SITE_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)", "split_part(split_part(url, '/', 3), '?', 1)"


@query(f"""WITH {_EDGES}, m AS (SELECT page_id AS k, url, {_ORIGIN} AS origin, {_SITE_HOST} AS host, {_TITLE} AS title, page_id % 7 <> 5 AND page_id % 11 <> 4 AS had FROM pages),
r AS (SELECT *, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS root FROM m), e AS (SELECT page_id AS k, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT host, string_agg(ip, ' ' ORDER BY ip) AS ips FROM (SELECT DISTINCT host, '192.0.2.' || k % 200 AS ip FROM m) GROUP BY 1),
t AS (SELECT k, list_sort(list_filter([struct_pack(o := 1, name := CASE WHEN had THEN 'React' END), struct_pack(o := 2, name := 'Vercel'), struct_pack(o := 15, name := CASE WHEN k % 3 = 0 THEN 'Nginx' END), struct_pack(o := 16, name := CASE WHEN had THEN 'Node' END)], lambda x: x.name IS NOT NULL)) AS l FROM r),
w AS (SELECT r.k, coalesce(min(o.k) FILTER (o.url = r.url), min(o.k)) AS w FROM r LEFT JOIN (SELECT * FROM r WHERE k % 5 = 0) o ON regexp_replace(o.host, '^www[.]', '') = regexp_replace(r.host, '^www[.]', '') GROUP BY 1)
SELECT k AS site_id, r.host, root AS root_domain, CASE WHEN k % 7 = 5 THEN 0 WHEN k % 11 = 4 THEN 403 ELSE 200 END AS status, CASE WHEN k % 7 = 5 THEN 'timeout' WHEN k % 11 = 4 THEN 'The site answered with a bot-protection challenge, so only headers, DNS and subdomains were checked.' END AS error,
  CASE WHEN had AND title <> '' THEN title END AS title, CASE WHEN had THEN origin || '/og/' || k || '.png' END AS image, CASE WHEN had THEN 'build-' || k + 1000 END AS build_id, CASE WHEN had THEN 2 + k % 2 ELSE 0 END AS n_assets, CASE WHEN k % 3 = 0 THEN 'nginx/1.' || k % 5 END AS server, ips,
  CASE WHEN had THEN '/api/p' || k || ' ' ELSE '' END || '/v1/x' || k AS api_endpoints, CASE WHEN had THEN 'api.' || root || ' cdn' || k % 4 || '.tools.io js.tools.io' ELSE 'js.tools.io' END AS code_hosts,
  CASE WHEN had THEN 'x https://x.com/u' || k || ' docs ' || origin || '/docs' ELSE '' END AS socials, list_aggregate(list_filter(['app.' || root || ' dns+ct true', CASE WHEN had THEN 'api.' || root || ' code false' END, CASE WHEN k % 2 = 0 AND had THEN 'old.' || root || ' ct+link false' ELSE 'old.' || root || ' ct false' END], lambda x: x IS NOT NULL), 'string_agg', ', ') AS subdomains,
  CASE WHEN had THEN coalesce(n, 0) + 1 + (k % 2 = 0)::INT ELSE 0 END AS internal, CASE WHEN had THEN 1 ELSE 0 END AS external, array_to_string([x.name FOR x IN l], ', ') AS technologies, w AS watched
FROM r LEFT JOIN e USING (k) JOIN t USING (k) JOIN w USING (k) JOIN i USING (host)""")
def a10_whole_report(spark, sf):
    """A report of every page as a site: markup, headers, scripts, answers and certificates made of its own URL and id; some blocked or down."""
    from ..operators import report
    from ..operators import urls as ur
    from ..operators.extract import noise_domains

    pages = table(spark, sf, "pages")
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    root = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    add = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    head = add('<meta property="og:image" content="/og/', s, '.png"><script src="/a/', s, '.js"></script><link rel=stylesheet href="/a/s.css?t=17000000001"><script>var x={"buildId":"build-', (k + 1000).cast("string"), '"};fetch("/api/p', s, '");y="https://cdn', (k % 4).cast("string"), '.tools.io/z";w="wss://api.', root, '"</script>', F.when(k % 2 == 1, '<link rel=modulepreload href="/a/m.js">').otherwise(""))
    body = add('<div data-reactroot>', '<a href="https://twitter.com/u', s, '">x</a><a href="/docs">d</a>', F.when(k % 2 == 0, add('<a href="https://old.', root, '/">old</a>')).otherwise(""), F.col("html"))
    down, blocked = k % 7 == 5, (k % 11 == 4) & (k % 7 != 5)
    headers = F.when(k % 3 == 0, F.create_map(F.lit("server"), add("nginx/1.", (k % 5).cast("string")), F.lit("x-vercel-id"), F.lit("f"))).otherwise(F.create_map(F.lit("x-vercel-id"), F.lit("f")))
    scans = pages.select(k.alias("site_id"), "url", F.lit(None).cast("string").alias("final_url"), F.when(down, 0).when(blocked, 403).otherwise(200).alias("status"), blocked.alias("blocked"), F.when(down, "timeout").alias("error"), F.lit("text/html").alias("content_type"), headers.alias("headers"), add(head, body).alias("html"))
    bundles = pages.select(k.alias("site_id"), add('a("/v1/x', s, '");b="https://js.tools.io/x"').alias("text"))
    found = pages.select(root.alias("root"), F.explode(F.array(add("app.", root, " dns"), add("app.", root, " ct"), add("old.", root, " ct"))).alias("h")).select("root", F.split("h", " ")[0].alias("host"), F.split("h", " ")[1].alias("source"))
    addresses = pages.select(host.alias("host"), add("192.0.2.", (k % 200).cast("string")).alias("ip")).unionByName(pages.select(add("app.", root).alias("host"), F.lit("192.0.2.1").alias("ip")))
    watches = pages.where("page_id % 5 = 0").select(k.alias("id"), add("Site ", s).alias("name"), "url", host.alias("host"))
    rules = [("Nginx", "server", "header", r"^server:\s*nginx"), ("Vercel", "hosting", "header", "^x-vercel-id:"), ("React", "framework", "html", r"\bdata-reactroot\b")]
    suffixes = rows(spark, "suffix string", [(v,) for v in ur.PUBLIC_SUFFIXES])
    noise = {mode: noise_domains(spark, mode).where("domain not in ('example.com', 'example.org', 'example.net')") for mode in ("markup", "script")}
    out = report.site_reports(scans, bundles, found, addresses, watches, suffixes, noise, rows(spark, "name string, implies string", [("React", "Node")]), rules, {"Node": "language"})
    joined = lambda c, f, sep=" ": F.array_join(F.transform(c, f), sep)
    return out.select(
        "site_id", "host", "root_domain", "status", "error", "title", "image", F.col("build.id").alias("build_id"), F.col("build.assets").alias("n_assets"), F.col("server.server").alias("server"), F.array_join("server.ips", " ").alias("ips"), F.array_join("api_endpoints", " ").alias("api_endpoints"), F.array_join("code_hosts", " ").alias("code_hosts"),
        joined("socials", lambda v: F.concat_ws(" ", v["kind"], v["url"])).alias("socials"), joined("subdomains", lambda v: F.concat_ws(" ", v["host"], F.array_join(v["sources"], "+"), v["alive"].cast("string")), ", ").alias("subdomains"),
        F.col("links.internal").alias("internal"), F.col("links.external").alias("external"), F.array_join(F.transform("technologies", lambda v: v["name"]), ", ").alias("technologies"), F.col("watched.id").alias("watched"),
    )
