"""Reports of scanned sites: what one look at each start page, its scripts and the host inventory tell, for all sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..sources.shared import new_table
from . import extract as x
from .detect import deploy_fingerprints
from .hosts import normalize_names
from .socials import site_socials, twitter_handle
from .urls import root_domain

#: Order of categories and of sources in a report, and what is told of a page that wasn't had.
CATEGORIES = ("framework", "hosting", "cdn", "cms", "docs", "ui", "analytics", "monitoring", "auth", "payments", "support", "web3", "fonts", "security", "other")
SOURCES = ("dns", "ct", "code", "link")
CHALLENGED = "The site answered with a bot-protection challenge, so only headers, DNS and subdomains were checked."
#: The most that a report lists of each, and the characters of its texts.
MOST_ENDPOINTS, MOST_CODE_HOSTS, MOST_SUBDOMAINS, MOST_BUNDLES = 200, 300, 200, 25
TITLE_CHARS, DESCRIPTION_CHARS, URL_CHARS, HEADER_CHARS = 300, 500, 2048, 200


def _below(host: Column, root: Column) -> Column:
    return (host == root) | host.endswith(F.concat(F.lit("."), root))


def _capped(text: Column, most: int) -> Column:
    """A text in one line of so many characters; null for an empty one."""
    t = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "))
    return F.when(t != "", F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t))


def _header(name: str) -> Column:
    """A header's value; names of the map are in lower case."""
    return F.nullif(F.substring(F.trim(F.try_element_at("headers", F.lit(name))), 1, HEADER_CHARS), F.lit(""))


def _parsed(scans: DataFrame) -> DataFrame:
    """scans with host, final_url and final_host, and html only where the page itself was had."""
    final = F.when((F.coalesce("status", F.lit(0)) != 0) & (u.host(F.col("final_url")) != ""), F.col("final_url")).otherwise(F.col("url"))
    had = ~F.coalesce("blocked", F.lit(False)) & (F.coalesce("status", F.lit(0)) != 0) & (x.body_kind(F.col("content_type"), F.col("html")) == "html")
    return scans.select("site_id", "url", final.alias("final_url"), "status", "blocked", "error", "headers", F.when(had, F.col("html")).alias("html"), u.host(F.col("url")).alias("host"), u.host(final).alias("final_host"))


def _places(parsed: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(site_id, url, final_url, host, final_host, root_domain): bodies don't go along, they aren't shuffled by host."""
    narrow = root_domain(parsed.select("site_id", "url", "final_url", "host", "final_host"), suffixes, "final_host")
    return narrow.withColumn("root_domain", F.coalesce("root_domain", "final_host"))


def scan_bundles(scans: DataFrame, suffixes: DataFrame, most: int = MOST_BUNDLES) -> DataFrame:
    """(site_id, url): the scripts of a site's own that a report wants to be read, scripts before preloads, the first `most` by URL."""
    parsed = _parsed(scans)
    pages = parsed.select(F.col("site_id").alias("page_id"), F.col("final_url").alias("url"), "html").where("html is not null")
    found = x.page_assets(pages).select(F.col("page_id").alias("site_id"), "role", F.regexp_replace("url", "#.*$", "").alias("url")).join(_places(parsed, suffixes).select("site_id", "root_domain"), "site_id")
    path = F.lower(u.path(F.col("url")))
    wanted = _below(u.host(F.col("url")), F.col("root_domain")) & ~path.contains("/cdn-cgi/") & ((F.col("role") == "script") | ((F.col("role") == "preload") & path.rlike(r"\.m?js$")))
    first = found.where(wanted).groupBy("site_id", "url").agg(F.max("role").alias("role"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("role").desc(), "url"))).where(F.col("nth") <= most).select("site_id", "url")


def _listed(rows: DataFrame, value: str, most: int, name: str) -> DataFrame:
    """(site_id, name): the first `most` values of a site as a sorted array."""
    few = rows.select("site_id", value).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy(value))).where(F.col("nth") <= most)
    return few.groupBy("site_id").agg(F.array_sort(F.collect_list(value)).alias(name))


def _subdomains(places: DataFrame, mentioned: DataFrame, found: DataFrame, alive: DataFrame, most: int) -> DataFrame:
    """(site_id, subdomains): hosts below a site's root, live first, with who tells of them. Of the inventory's hosts a root's first
    most + 1 are enough: one of them may be the site's own."""
    own = places.select("site_id", "host", F.col("root_domain").alias("root"))
    said = mentioned.withColumnRenamed("host", "name").join(own.select("site_id", "root"), "site_id")
    said = normalize_names(said, "site_id", "source").select("site_id", "host", "source")
    listed = normalize_names(found.withColumnRenamed("host", "name"), "source")
    live = alive.select("host").distinct().withColumn("alive", F.lit(True))
    with_life = lambda df: df.join(live, "host", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    per_root = new_table(with_life(listed.groupBy("root", "host").agg(F.collect_set("source").alias("sources"))), "report-inventory")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("alive").desc(), "host"))
    top = per_root.withColumn("nth", rank).where(F.col("nth") <= most + 1).drop("nth")
    of_site = top.join(own.select("site_id", "root"), "root").select("site_id", "host", "alive", F.explode("sources").alias("source"))
    each = of_site.unionByName(with_life(said).select("site_id", "host", "alive", "source")).join(own.select("site_id", "host"), ["site_id", "host"], "left_anti")
    each = each.groupBy("site_id", "host", "alive").agg(F.collect_set("source").alias("s"))
    # a host that the inventory has beyond its first ones may still be told of by the page: its sources come from the inventory
    more = each.join(own.select("site_id", "root"), "site_id").join(per_root.select("root", "host", "sources"), ["root", "host"], "left").select("site_id", "host", "alive", F.array_union("s", F.coalesce("sources", F.array().cast("array<string>"))).alias("s"))
    few = more.withColumn("nth", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("alive").desc(), "host"))).where(F.col("nth") <= most)
    order = F.array(*(F.lit(s) for s in SOURCES))
    one = F.struct((~F.col("alive")).alias("dead"), "host", F.filter(order, lambda v: F.array_contains("s", v)).alias("sources"), "alive")
    return few.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: F.struct(r["host"].alias("host"), r["sources"].alias("sources"), r["alive"].alias("alive"))).alias("subdomains"))


def _watched(places: DataFrame, watches: DataFrame) -> DataFrame:
    """(site_id, watched): the site that is watched at this URL, at the final one, or else at one of both hosts; of several the first by id."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    watch = F.struct("id", "name", "url")
    by_url = watches.groupBy(F.col("url").alias("at")).agg(F.min(watch).alias("w"))
    by_host = watches.groupBy(bare(F.col("host")).alias("at")).agg(F.min(watch).alias("w"))
    look = lambda table, key, name: table.select(F.col("at").alias(key), F.col("w").alias(name))
    rows = places.select("site_id", F.col("url").alias("u1"), F.col("final_url").alias("u2"), bare(F.col("host")).alias("h1"), bare(F.col("final_host")).alias("h2"))
    for table, key, name in ((by_url, "u1", "w1"), (by_url, "u2", "w2"), (by_host, "h1", "w3"), (by_host, "h2", "w4")):
        rows = rows.join(look(table, key, name), key, "left")
    return rows.select("site_id", F.coalesce("w1", "w2", F.least("w3", "w4")).alias("watched"))


def site_reports(
    scans: DataFrame,
    bundles: DataFrame,
    found: DataFrame,
    addresses: DataFrame,
    watches: DataFrame,
    suffixes: DataFrame,
    noise: dict[str, DataFrame],
    closure: DataFrame | None = None,
    rules: list[tuple] | None = None,
    categories: dict[str, str] | None = None,
) -> DataFrame:
    """A row per scanned site, whatever was had of it.

    scans(site_id, url, final_url, status, blocked, error, content_type, headers, html): one look at each start page, URLs canonical, names
    of headers in lower case; bundles(site_id, text): its scripts, see scan_bundles; found(root, host, source): the inventory ('dns', 'ct');
    addresses(host, ip): answers, a host with one is alive; watches(id, name, url, host) of who asks; noise by mode as noise_domains gives it;
    closure(name, implies) and the categories of what is implied, rules as for detect_technologies.

    Columns: site_id, url, final_url, host, root_domain, status, blocked, error, title, description, image, technologies, build(id, assets,
    generator), server(server, powered_by, ips), api_endpoints, code_hosts, subdomains, socials, links(internal, external), watched. Lists
    are empty, texts null, where nothing is known; a blocked or failed page has neither facts nor links. Null rows of the other tables tell
    nothing; repeated ones tell it once. Extra columns are left out.

    Links, assets, hosts, places and the inventory, which several parts want, are written to the shared folder once; every part is counted
    by site and joined by site, so bodies are never shuffled, and lists are cut to what a report shows before they are gathered, in each
    task first. Html is read by each of five parts: scans should be a stored table.
    """
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    parsed = _parsed(scans)
    pages = parsed.where("html is not null").select(F.col("site_id").alias("page_id"), F.col("final_url").alias("url"), "html")
    places = new_table(_places(parsed, suffixes), "report-places")
    code = bundles.where("text is not null").select("site_id", "text")
    markup = pages.select(F.col("page_id").alias("site_id"), F.col("html").alias("text"))

    edges = x.link_edges(pages, places=True).select(F.col("page_id").alias("site_id"), F.col("dst").alias("url"), "pos").withColumn("to", u.host(F.col("url"))).join(places.drop("url", "final_url"), "site_id")
    edges = new_table(edges, "report-links")
    inside = _below(F.col("to"), F.col("root_domain"))
    links = edges.groupBy("site_id").agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"))
    link_hosts = edges.select("site_id", F.col("to").alias("host")).distinct()
    handles = pages.select(F.col("page_id").alias("site_id"), twitter_handle(F.col("html")).alias("handle"))
    profiles = site_socials(edges.select("site_id", "url", "pos", F.col("root_domain").alias("root")), handles=handles)
    profile = F.transform(F.array_sort(F.collect_list(F.struct("rank", "kind", "url"))), lambda r: F.struct(r["kind"].alias("kind"), r["url"].alias("url")))
    socials = profiles.groupBy("site_id").agg(profile.alias("socials"))

    script_hosts = x.host_mentions(code, suffixes, noise["script"], "site_id")
    page_hosts = x.host_mentions(markup, suffixes, noise["markup"], "site_id").join(link_hosts, ["site_id", "host"], "left_anti")
    hosts = new_table(script_hosts.unionByName(page_hosts).distinct(), "report-hosts")
    own = places.select("site_id", F.explode(F.array_distinct(F.array("host", "final_host"))).alias("host"))
    code_hosts = _listed(hosts.join(own, ["site_id", "host"], "left_anti"), "host", MOST_CODE_HOSTS, "code_hosts")
    paths = x.code_paths(code.unionByName(markup), "site_id").where(x.is_api_listed(F.col("path")))
    endpoints = _listed(paths, "path", MOST_ENDPOINTS, "api_endpoints")

    assets = new_table(x.page_assets(pages).withColumnRenamed("page_id", "site_id"), "report-assets")
    kept = assets.join(places.select("site_id", "root_domain"), "site_id").where(_below(u.host(F.col("url")), F.col("root_domain"))).select("site_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", F.lit(None).cast("string").alias("build_id"))
    builds = deploy_fingerprints(kept, ["site_id"]).select("site_id", F.size("assets").cast("long").alias("n_assets"))

    signal = lambda df, kind, value: df.select("site_id", F.lit(kind).alias("kind"), value.alias("value"))
    facts = x.page_meta(F.col("html"))
    by_header = parsed.select("site_id", F.explode("headers").alias("name", "value"))
    signals = [
        signal(by_header, "header", F.concat("name", F.lit(": "), "value")), signal(parsed.select("site_id", F.explode(x.cookie_names(F.try_element_at("headers", F.lit("set-cookie")))).alias("name")), "cookie", F.col("name")),
        signal(parsed.where("html is not null").select("site_id", F.explode(F.array(facts["generator"])).alias("g")).where("g <> ''"), "generator", F.col("g")), signal(parsed, "site", F.col("final_host")), signal(assets.where("role <> 'style'"), "script", F.col("url")),
        signal(assets.where("role = 'style'"), "style", F.col("url")), signal(hosts, "host", F.col("host")), signal(link_hosts, "link", F.col("host")), signal(code, "js", F.col("text")), signal(markup, "html", x.strip_code_samples(F.col("text"))),
    ]
    every = signals[0]
    for one in signals[1:]:
        every = every.unionByName(one)
    technologies = reported_technologies(x.detect_technologies(every, rules), closure, categories)

    mentioned = hosts.withColumn("source", F.lit("code")).unionByName(link_hosts.withColumn("source", F.lit("link")))
    subdomains = _subdomains(places, mentioned, found, addresses.where("ip is not null"), MOST_SUBDOMAINS)
    ips = addresses.where("ip is not null").groupBy("host").agg(F.array_sort(F.collect_set("ip")).alias("ips"))

    image = x.page_image(F.col("html"), F.col("final_url"))
    status = F.coalesce("status", F.lit(0))
    error = F.when(status == 0, F.coalesce("error", F.lit("unreachable"))).when(F.col("blocked"), CHALLENGED).when(status == 429, F.coalesce("error", F.lit("HTTP 429 (rate limited)"))).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    base = parsed.select(
        "site_id", "url", "final_url", "host", "final_host", status.alias("status"), F.coalesce("blocked", F.lit(False)).alias("blocked"), error.alias("error"),
        _capped(facts["title"], TITLE_CHARS).alias("title"), _capped(facts["description"], DESCRIPTION_CHARS).alias("description"), F.when(u.scheme(image).isin("http", "https") & (F.length(image) <= URL_CHARS), image).alias("image"),
        x.build_id(F.col("html")).alias("build_id"), F.nullif(facts["generator"], F.lit("")).alias("generator"), _header("server").alias("server_name"), _header("x-powered-by").alias("powered_by"),
    )
    out = base.join(ips.select(F.col("host").alias("final_host"), F.col("ips").alias("final_ips")), "final_host", "left").join(ips, "host", "left")
    for part in (places.select("site_id", "root_domain"), links, socials, code_hosts, endpoints, builds, technologies, subdomains, _watched(places, watches)):
        out = out.join(part, "site_id", "left")
    return out.select(
        "site_id", "url", "final_url", "host", "root_domain", "status", "blocked", "error", "title", "description", "image",
        F.coalesce("technologies", empty("struct<name:string,category:string,version:string,evidence:string>")).alias("technologies"),
        F.struct(F.col("build_id").alias("id"), F.coalesce("n_assets", F.lit(0)).alias("assets"), "generator").alias("build"),
        F.struct(F.col("server_name").alias("server"), "powered_by", F.coalesce("final_ips", "ips", empty("string")).alias("ips")).alias("server"),
        F.coalesce("api_endpoints", empty("string")).alias("api_endpoints"), F.coalesce("code_hosts", empty("string")).alias("code_hosts"),
        F.coalesce("subdomains", empty("struct<host:string,sources:array<string>,alive:boolean>")).alias("subdomains"), F.coalesce("socials", empty("struct<kind:string,url:string>")).alias("socials"),
        F.struct(F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external")).alias("links"), "watched",
    )


def reported_technologies(hits: DataFrame, closure: DataFrame | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """hits(site_id, name, category, version, evidence) -> (site_id, technologies): with what they imply by closure(name, implies), by category
    in the order of a report and name. A site has at most as many as there are rules."""
    own = F.struct(F.lit(False).alias("derived"), F.lit(None).cast("string").alias("via"), "name", "category", "version", "evidence")
    each = F.array(own)
    if closure is not None:
        hits = hits.join(closure.where("name <> implies").groupBy("name").agg(F.collect_set("implies").alias("implies")), "name", "left")
        category = lambda name: F.coalesce(u._looked_up(name, categories), F.lit("other")) if categories else F.lit("other")
        text = lambda v: v.cast("string")
        more = F.transform(F.coalesce("implies", F.array().cast("array<string>")), lambda n: F.struct(F.lit(True).alias("derived"), F.col("name").alias("via"), n.alias("name"), category(n).alias("category"), text(F.lit(None)).alias("version"), F.concat(F.lit("implied by "), "name").alias("evidence")))
        each = F.concat(each, more)
    # what was seen itself goes before what another implies, of these the first by name
    rows = hits.select("site_id", F.explode(each).alias("h")).groupBy("site_id", "h.name").agg(F.min("h").alias("h")).select("site_id", "h.name", "h.category", "h.version", "h.evidence")
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category")), F.lit(0)), F.lit(len(CATEGORIES)))
    one = F.struct(place.alias("place"), F.lower("name").alias("key"), "name", "category", "version", "evidence")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda r: F.struct(r["name"].alias("name"), r["category"].alias("category"), r["version"].alias("version"), r["evidence"].alias("evidence")))
    return rows.groupBy("site_id").agg(listed.alias("technologies"))
