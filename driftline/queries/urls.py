"""Queries over URLs: supplied pages, and links and hosts derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import urls as ops
from .base import FETCH_SQL, Registry, fetch, host_sql, path_sql, query_sql, rows, table, values_sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_TRACKING = ", ".join(f"'{x}'" for x in u.TRACKING)
_CLEAN_PATH = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace({path_sql(c)}, '/{{2,}}', '/', 'g'), '(?:/index\\.html?|/)+$', '', 'i'), ''), '/')"
_KEPT = lambda c: f"list_filter(string_split({query_sql(c)}, '&'), lambda x: x <> '' AND NOT starts_with(lower(url_decode(regexp_extract(x, '^([^=]*)', 1))), 'utm_') AND lower(url_decode(regexp_extract(x, '^([^=]*)', 1))) NOT IN ({_TRACKING}))"
_CLEAN_QUERY = lambda c: f"CASE WHEN len({_KEPT(c)}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({_KEPT(c)}), '&') END"


def canon_sql(c: str) -> str:
    return f"(lower(regexp_extract({c}, '^([A-Za-z]+)://', 1)) || '://' || {host_sql(c)} || {_CLEAN_PATH(c)} || {_CLEAN_QUERY(c)})"


@query(f"SELECT page_id, {canon_sql('url')} AS canon_url FROM pages")
def u1_canonicalize(spark, sf):
    return ops.canonicalize_urls(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "canon_url")


@query(f"SELECT canon_url, count(*) AS n, min(page_id) AS page_id FROM (SELECT page_id, {canon_sql('url')} AS canon_url FROM pages) GROUP BY 1")
def u1_dedup_by_canonical(spark, sf):
    return ops.dedup_by_canonical(table(spark, sf, "pages").select("page_id", "url"), "page_id").select("canon_url", "n", "page_id")


_ROOT = lambda h: f"CASE WHEN {h} LIKE '%.%' THEN regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) ELSE {h} END"


@query(f"SELECT host, root_domain, count(*) AS n FROM (SELECT {host_sql('url')} AS host, {_ROOT(host_sql('url'))} AS root_domain FROM pages) GROUP BY ALL")
def u2_root_domain(spark, sf):
    hosts = table(spark, sf, "pages").select(u.host(F.col("url")).alias("host"))
    suffixes = rows(spark, "suffix string", [(x,) for x in ops.PUBLIC_SUFFIXES])
    return ops.root_domain(hosts, suffixes).groupBy("host", "root_domain").agg(F.count(F.lit(1)).alias("n"))


_ROOTS = [("example.com",), ("ththth.example.net",), ("example",)]


@query(f"WITH {values_sql('roots', 'root', _ROOTS)} SELECT page_id, host FROM (SELECT page_id, {host_sql('url')} AS host FROM pages) p WHERE EXISTS (SELECT 1 FROM roots WHERE host = root OR host LIKE '%.' || root)")
def u3_within_domain(spark, sf):
    hosts = table(spark, sf, "pages").select("page_id", u.host(F.col("url")).alias("host"))
    return ops.within_domain(hosts, rows(spark, "root string", _ROOTS)).select("page_id", "host")


#: Extensions put in place of .html, by page_id, so that all classes occur.
_EXTENSIONS = ["", ".html", ".pdf", ".js", ".zip", ".json", ".PHP", "/"]
_VARIED_SQL = f"regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)?$', '') || [{', '.join(repr(x) for x in _EXTENSIONS)}][(page_id % 8) + 1]"


def _varied(df):
    stem = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"(\.html|/)?$", "")
    return F.concat(stem, F.element_at(F.array(*(F.lit(x) for x in _EXTENSIONS)), (df["page_id"] % 8 + 1).cast("int")))


@query(f"""WITH v AS (SELECT page_id, {_VARIED_SQL} AS url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '\\.json$') THEN 'file' WHEN regexp_matches(url, '\\.pdf$') THEN 'file' WHEN regexp_matches(url, '\\.js$') THEN 'asset'
  WHEN regexp_matches(url, '\\.zip$') THEN 'skip' ELSE 'page' END AS url_class FROM v""")
def u4_classify_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", u.url_class(_varied(pages)).alias("url_class"))


_SITES_SQL = f"""sites AS (SELECT min(page_id) AS site_id, 'https://' || host || '/' AS start_url, host, '/' || min(lang) AS scope_path
  FROM (SELECT page_id, {host_sql('url')} AS host, split_part({path_sql('url')}, '/', 2) AS lang FROM pages) GROUP BY host)"""


def sites_of_pages(spark, sf):
    """A site per host of the pages: its start page and, as scope, its first language folder."""
    pages = table(spark, sf, "pages").select("page_id", u.host(F.col("url")).alias("host"), F.split(u.path(F.col("url")), "/")[1].alias("lang"))
    sites = pages.groupBy("host").agg(F.min("page_id").alias("site_id"), F.min("lang").alias("lang"))
    return sites.select("site_id", F.concat(F.lit("https://"), "host", F.lit("/")).alias("start_url"), "host", F.concat(F.lit("/"), "lang").alias("scope_path"))


@query(f"""WITH {_SITES_SQL} SELECT site_id, page_id FROM pages p JOIN sites s ON {host_sql('p.url')} = s.host
WHERE ({path_sql('p.url')} = scope_path OR starts_with({path_sql('p.url')}, scope_path || '/')) AND {query_sql('p.url')} = '' AND length(url) <= 2048""")
def u5_scope_filter(spark, sf):
    return ops.scope_filter(table(spark, sf, "pages").select("page_id", "url"), sites_of_pages(spark, sf)).select("site_id", "page_id")


_RULES = [(0, "/en/*"), (1, "/fr/**"), (1, "/*/1*"), (2, r"\.html$"), (2, "(broken"), (0, "/de/7*")]


@query(f"""SELECT page_id, site_id FROM (SELECT page_id, page_id % 3 AS site_id, url FROM pages) WHERE NOT (
  (site_id = 0 AND regexp_matches(url, '^[a-z]+://[^/?#]+/en/.+', 'i')) OR (site_id = 1 AND regexp_matches(url, '^[a-z]+://[^/?#]+/fr/.*/?([?#].*)?$', 'i'))
  OR (site_id = 1 AND regexp_matches(url, '^[a-z]+://[^/?#]+/[^/]*/1[^/]*/?([?#].*)?$', 'i')) OR (site_id = 2 AND regexp_matches(url, '\\.html$', 'i'))
  OR (site_id = 0 AND regexp_matches(url, '^[a-z]+://[^/?#]+/de/7[^/]*/?([?#].*)?$', 'i')))""")
def u6_exclude_by_rules(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).alias("site_id"), "url")
    return ops.exclude_by_rules(urls, _RULES).select("page_id", "site_id")


@query("""SELECT page_id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN md5(url) WHEN 1 THEN substr(md5(url), 1, 8) || '-post' WHEN 2 THEN left(md5(url), 20) ELSE 'Z' || md5(url) END AS seg FROM pages)
WHERE NOT (regexp_matches(seg, '^(0x)?[0-9a-fA-F]{24,}$') OR (regexp_matches(seg, '^[A-Za-z0-9]{32,}$') AND regexp_matches(seg, '[0-9]') AND regexp_matches(seg, '[A-Za-z]')))""")
def u7_drop_opaque_id_urls(spark, sf):
    m = F.md5("url")
    segment = F.when(F.col("page_id") % 4 == 0, m).when(F.col("page_id") % 4 == 1, F.concat(F.substring(m, 1, 8), F.lit("-post"))).when(F.col("page_id") % 4 == 2, F.substring(m, 1, 20)).otherwise(F.concat(F.lit("Z"), m))
    made = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://a.example.com/tx/"), segment).alias("url"))
    return ops.drop_opaque_id_urls(made).select("page_id")


@query(f"""WITH {_SITES_SQL} SELECT p.page_id, CASE WHEN regexp_matches(split_part({path_sql('p.url')}, '/', 2), '^[a-z]{{2}}([-_][a-z]{{2,4}})?$', 'i') THEN 1 ELSE 0 END AS locale_rank
FROM pages p JOIN sites s ON {host_sql('p.url')} = s.host""")
def u8_rank_locale_copies(spark, sf):
    sites = sites_of_pages(spark, sf)
    urls = table(spark, sf, "pages").select("page_id", "url", u.host(F.col("url")).alias("host")).join(sites.select("site_id", "host"), "host")
    return ops.rank_locale_copies(urls, sites).select("page_id", "locale_rank")


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.html|/)$', '') AS url FROM pages),
f AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.md' WHEN 1 THEN url || 'x.md' ELSE url || '/llms.txt' END AS url FROM p)
SELECT page_id FROM f WHERE page_id % 3 = 1 AND regexp_replace(url, '\\.md$', '') NOT IN (SELECT url FROM p)""")
def u9_drop_page_twins(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"(\.html|/)$", "").alias("url"))
    tail = F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, "x.md").otherwise("/llms.txt")
    return ops.drop_page_twins(pages.select("page_id", F.concat("url", tail).alias("url")), pages).select("page_id")


@query(f"""SELECT page_id, {host_sql('url')} || regexp_replace({path_sql('url')}, '(.)/+$', '\\1') || CASE WHEN {query_sql('url')} = '' THEN '' ELSE '?' || {query_sql('url')} END AS display,
  {path_sql('url')} || CASE WHEN {query_sql('url')} = '' THEN '' ELSE '?' || {query_sql('url')} END AS path_query,
  coalesce(list_filter(string_split({path_sql('url')}, '/'), lambda x: x <> '')[-1], {host_sql('url')}) AS filename FROM pages""")
def u10_url_labels(spark, sf):
    c = F.col("url")
    return table(spark, sf, "pages").select("page_id", u.display(c).alias("display"), u.path_query(c).alias("path_query"), u.filename(c).alias("filename"))


_REDIRECT_SQL = "redirects AS (SELECT *, CASE WHEN status = 200 AND k % 6 = 0 THEN url || '/new' || (k % 3) WHEN status = 200 AND k % 11 = 0 THEN 'https://www.' || host || '/home' ELSE url END AS final_url FROM obs)"


def _redirects(spark, sf):
    k, good = F.col("k"), F.col("status") == 200
    final = F.when(good & (k % 6 == 0), F.concat("url", F.lit("/new"), (k % 3).cast("string"))).when(good & (k % 11 == 0), F.concat(F.lit("https://www."), "host", F.lit("/home"))).otherwise(F.col("url"))
    return fetch(spark, sf).withColumn("final_url", final)


@query(f"""WITH {FETCH_SQL}, {_REDIRECT_SQL} SELECT url, arg_max(final_url, fetched_at) AS final_url, max(fetched_at) AS at, max(fetched_at) + INTERVAL 1 HOUR AS valid_until
FROM redirects WHERE final_url <> url AND starts_with(final_url, 'https://' || host || '/') GROUP BY url""")
def u11_redirect_map(spark, sf):
    out = ops.redirect_map(_redirects(spark, sf))
    return out.select("url", "final_url", F.col("at").cast("timestamp_ntz").alias("at"), F.col("valid_until").cast("timestamp_ntz").alias("valid_until"))


@query(f"""WITH {FETCH_SQL}, {_REDIRECT_SQL}, first AS (SELECT site_id, host, arg_min(final_url, (fetched_at, event_id)) AS final_url FROM redirects WHERE status = 200 GROUP BY ALL)
SELECT site_id, host AS from_host, {host_sql('final_url')} AS to_host FROM first WHERE {host_sql('final_url')} <> host""")
def u12_adopt_redirected_hosts(spark, sf):
    from ..operators.plan import adopt_redirected_hosts

    log = _redirects(spark, sf)
    sites = log.select("site_id", "host").distinct()
    return adopt_redirected_hosts(log, sites, rows(spark, "suffix string", [(x,) for x in ops.PUBLIC_SUFFIXES])).select("site_id", "from_host", "to_host")


@query(f"""WITH links AS (SELECT page_id % 5 AS site_id, {path_sql('url')} AS p FROM pages), g AS (SELECT site_id, '/' || split_part(p, '/', 2) || '/*' AS "glob", count(*) AS n FROM links
  WHERE len(list_filter(string_split(p, '/'), lambda x: x <> '')) >= 2 GROUP BY ALL)
SELECT site_id, "glob", n FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, "glob") AS r FROM g WHERE NOT (site_id = 0 AND "glob" = '/en/*')) WHERE r <= 3""")
def u13_suggest_exclude_globs(spark, sf):
    urls = table(spark, sf, "pages").select((F.col("page_id") % 5).alias("site_id"), "url")
    return ops.suggest_exclude_globs(urls, rows(spark, "site_id long, glob string", [(0, "/en/*")]))


@query("""WITH h AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '10.1.2.' || (page_id % 256) WHEN 1 THEN '172.' || (page_id % 64) || '.0.1' WHEN 2 THEN '8.8.' || (page_id % 256) || '.8'
  WHEN 3 THEN 'host' || page_id || '.local' WHEN 4 THEN '192.168.' || (page_id % 256) || '.1' ELSE 'www.example.com' END AS host FROM pages)
SELECT page_id, host, page_id % 6 IN (0, 3, 4) OR (page_id % 6 = 1 AND try_cast(split_part(host, '.', 2) AS INT) BETWEEN 16 AND 31) AS private FROM h""")
def u14_flag_private_targets(spark, sf):
    i = F.col("page_id")
    part = lambda n: (i % n).cast("string")
    host = F.when(i % 6 == 0, F.concat(F.lit("10.1.2."), part(256))).when(i % 6 == 1, F.concat(F.lit("172."), part(64), F.lit(".0.1"))).when(i % 6 == 2, F.concat(F.lit("8.8."), part(256), F.lit(".8")))
    host = host.when(i % 6 == 3, F.concat(F.lit("host"), i.cast("string"), F.lit(".local"))).when(i % 6 == 4, F.concat(F.lit("192.168."), part(256), F.lit(".1"))).otherwise("www.example.com")
    return ops.flag_private_targets(table(spark, sf, "pages").select("page_id", host.alias("host"))).select("page_id", "host", "private")


#: An address inside and one outside of every range, in every form that holds one, and names.
_TARGETS = [
    ("0.1.2.3", True), ("1.0.0.1", False), ("10.255.0.1", True), ("11.0.0.0", False), ("100.63.255.255", False), ("100.64.0.1", True), ("100.128.0.0", False), ("127.8.8.8", True), ("169.254.9.9", True), ("169.255.0.1", False),
    ("172.15.255.255", False), ("172.31.0.1", True), ("172.32.0.0", False), ("192.0.0.8", True), ("192.0.1.0", False), ("192.168.77.1", True), ("198.19.255.255", True), ("198.20.0.0", False), ("223.255.255.255", False), ("224.0.0.1", True), ("255.255.255.255", True),
    ("::", True), ("::1", True), ("0:0:0:0:0:0:0:1", True), ("[::1]", True), ("::2", True), ("::ffff:172.16.0.1", True), ("::ffff:100.64.0.1", True), ("::FFFF:8.8.8.8", False), ("::ffff:a00:1", True), ("::ffff:0:10.0.0.1", True), ("::ffff:0:8.8.8.8", False), ("::10.0.0.1", True), ("::9.9.9.9", False),
    ("64:ff9b::10.0.0.1", True), ("64:ff9b::8.8.4.4", False), ("64:ff9b:1::10.0.0.1", False), ("2002:a00:1::", True), ("2002:808:808::1", False), ("fc00::1", True), ("fdff:1::", True), ("fe00::1", False), ("fe80::1%eth0", True), ("febf::", True), ("fec0::1", True), ("ff02::1", True), ("2001:db8::1", False), ("2606:4700:4700::1111", False),
    ("1:2:3:4:5:6:7::", False), ("localhost", True), ("a.localhost", True), ("printer.local", True), ("db.internal", True), ("host", True), ("host.", True), ("www.example.com", False), ("256.1.1.1", False), ("10.0.0", False), ("1.2.3.4.5", False), ("local.example.com", False), ("mylocal.net", False),
]


@query(f"WITH {values_sql('t', 'i, host, private', [(i, h, str(p).lower()) for i, (h, p) in enumerate(_TARGETS)])} SELECT page_id, host, private::BOOLEAN AS private FROM pages JOIN t ON t.i = page_id % {len(_TARGETS)}")
def u14_target_forms(spark, sf):
    """Addresses of both families in every form, and names, against the fixed ranges."""
    host = F.element_at(F.array(*(F.lit(h) for h, _ in _TARGETS)), (F.col("page_id") % len(_TARGETS) + 1).cast("int"))
    return ops.flag_private_targets(table(spark, sf, "pages").select("page_id", host.alias("host"))).select("page_id", "host", "private")


#: Networks of four lengths, nested in part, for every supplier; an address for every customer, every third one in a form of IPv6.
_RANGES_SQL = """r AS (SELECT DISTINCT n, bits FROM (SELECT s_suppkey * 2654435761 % 4294967296 AS a FROM supplier) CROSS JOIN (VALUES (3), (9), (14), (17)) b(bits), LATERAL (SELECT (a >> (32 - bits)) << (32 - bits) AS n))"""
_DOTTED = "(({0} >> 24) & 255) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"


def _spread(key, factor: int):
    """key * factor modulo 2^32, for keys from 0 on. The factor's remainder nearest to 0 and the key's one make a product below 2^63,
    whatever the key."""
    whole = 1 << 32
    return F.pmod(F.pmod(key.cast("long"), F.lit(whole)) * F.lit((factor + whole // 2) % whole - whole // 2).cast("long"), F.lit(whole))


@query(f"""WITH {_RANGES_SQL}, c AS (SELECT c_custkey, c_custkey * 40503 * 2654435761 % 4294967296 AS n FROM customer),
m AS (SELECT c_custkey, max_by({_DOTTED.format('r.n')} || '/' || bits, bits) AS range FROM c JOIN r ON (c.n >> (32 - bits)) << (32 - bits) = r.n GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '::ffff:' ELSE '' END || {_DOTTED.format('n')} AS address, range FROM c LEFT JOIN m USING (c_custkey)""")
def u14_longest_prefix(spark, sf):
    dotted = lambda n: F.concat_ws(".", *(F.shiftright(n, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)))
    a = _spread(F.col("s_suppkey"), 2654435761)
    lengths = F.explode(F.array(*(F.lit(x) for x in (3, 9, 14, 17))))
    first = F.expr("a - a % shiftleft(1L, 32 - bits)")
    ranges = table(spark, sf, "supplier").select(a.alias("a"), lengths.alias("bits")).select(F.concat(dotted(first), F.lit("/"), F.col("bits").cast("string")).alias("cidr")).distinct()
    n = _spread(F.col("c_custkey"), 40503 * 2654435761)
    address = F.concat(F.when(F.col("c_custkey") % 3 == 0, "::ffff:").otherwise(""), dotted(n))
    return ops.longest_prefix(table(spark, sf, "customer").select("c_custkey", address.alias("address")), ranges)


@query("""WITH s AS (SELECT s_suppkey AS site_id, lower('Site ' || (s_suppkey % 50)) AS name, 'h' || s_suppkey || '.example.com' AS host FROM supplier),
q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'site ' || (c_custkey % 60) WHEN 2 THEN 'https://h' || c_custkey || '.example.com' ELSE 'h' || c_custkey || '.example.com' END AS t FROM customer),
names AS (SELECT name, min(site_id) AS site_id FROM s GROUP BY name HAVING count(*) = 1)
SELECT query_id, coalesce(a.site_id, b.site_id, c.site_id) AS site_id FROM q LEFT JOIN s a ON t = a.site_id::VARCHAR LEFT JOIN names b ON t = b.name
  LEFT JOIN s c ON regexp_replace(t, '^https?://', '') = c.host WHERE coalesce(a.site_id, b.site_id, c.site_id) IS NOT NULL""")
def u15_resolve_site_reference(spark, sf):
    n = F.col("s_suppkey").cast("string")
    sites = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("site_id"), F.concat(F.lit("Site "), (F.col("s_suppkey") % 50).cast("string")).alias("name"), F.concat(F.lit("https://h"), n, F.lit(".example.com/")).alias("start_url"))
    c, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    text = F.when(c % 4 == 0, s).when(c % 4 == 1, F.concat(F.lit("site "), (c % 60).cast("string"))).when(c % 4 == 2, F.concat(F.lit("https://h"), s, F.lit(".example.com"))).otherwise(F.concat(F.lit("h"), s, F.lit(".example.com")))
    return ops.resolve_site_reference(table(spark, sf, "customer").select(c.alias("query_id"), text.alias("text")), sites)
