"""Table maintenance: upserts, appends, retention, cascades, settings and inputs in text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u


def upsert(current: DataFrame, updates: DataFrame, sites: DataFrame, keys: list[str], at: str, by_time: bool = False) -> DataFrame:
    """One row per key: the order of arrival decides, so updates go before current rows, and among either the latest by `at` counts. With
    by_time the latest of all counts, an update only where it is as late, so that a batch may come late or again. Updates of sites that
    are gone are dropped. An aggregate with map-side combine, no window."""
    fresh = updates.join(sites.select("site_id"), "site_id", "left_semi").withColumn("_new", F.lit(1))
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh)
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*current.columns), F.struct(at, "_new") if by_time else F.struct("_new", at)).alias("r"))
    return last.select("r.*")


#: Parts of a table that is kept by site.
SITE_BUCKETS = 64


def with_bucket(df: DataFrame, buckets: int = SITE_BUCKETS) -> DataFrame:
    return df.withColumn("site_bucket", F.pmod(F.xxhash64("site_id"), F.lit(buckets)).cast("int"))


def write_by_site(df: DataFrame, path: str, buckets: int = SITE_BUCKETS) -> None:
    """A table in folders by site bucket, a few files each."""
    with_bucket(df, buckets).repartition("site_bucket").write.mode("overwrite").partitionBy("site_bucket").parquet(path)


def merge_by_site(path: str, updates: DataFrame, sites: DataFrame, keys: list[str], at: str, buckets: int = SITE_BUCKETS) -> None:
    """Puts updates into the table at `path` (one row per key, the latest by `at`): only the buckets of their sites are read and written, the
    files of others stay. The same updates again change nothing, and a batch that comes late doesn't put older rows over newer ones."""
    from ..sources.shared import new_table

    spark = updates.sparkSession
    fresh = new_table(with_bucket(updates, buckets), "updates")
    touched = sorted(r[0] for r in fresh.select("site_bucket").distinct().collect())  # `buckets` at most
    if not touched:
        return
    current = spark.read.schema(fresh.schema).parquet(path).where(F.col("site_bucket").isin(touched))
    # written first, so that a bucket is replaced by a copy of rows that no longer depend on it
    merged = new_table(upsert(current, fresh, sites, keys, at, by_time=True), "merged")
    merged.repartition("site_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_bucket").parquet(path)


def merge_sink(path: str, sites: DataFrame, keys: list[str], at: str, buckets: int = SITE_BUCKETS):
    """For foreachBatch: every batch of a stream of updates is merged, any number of times."""
    return lambda batch, _: merge_by_site(path, batch, sites, keys, at, buckets)


def append_events(events: DataFrame, sites: DataFrame, most: int = 4000) -> DataFrame:
    """Events of sites that exist, summaries cut; to be written in append mode by date."""
    return events.join(sites.select("site_id"), "site_id", "left_semi").withColumn("summary", F.substring("summary", 1, most))


def prune_events(events: DataFrame, before: Column, at: str = "at") -> DataFrame:
    return events.where(F.col(at) >= before)


def keep_newest(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows in order: each task keeps n, then one merges them."""
    return df.orderBy(*order).limit(n)


def delete_sites(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    return {name: df.join(ids.select("site_id"), "site_id", "left_anti") for name, df in tables.items()}


FEATURES = ("deploy", "text", "pages", "subdomains", "files", "status", "code_intel")


def normalize_state(raw: Column) -> Column:
    """Stored settings as a typed struct: what is missing or of another type has its default, unknown keys are dropped."""
    parsed = F.from_json(raw, "features map<string,string>, interval_sec string, paused string, exclude array<string>")
    flag = lambda name: F.coalesce(F.when(F.try_element_at(parsed["features"], F.lit(name)).isin("true", "false"), F.try_element_at(parsed["features"], F.lit(name)) == "true"), F.lit(True)).alias(name)
    number = F.when(parsed["interval_sec"].rlike(r"^\d{1,9}$"), parsed["interval_sec"].cast("long"))
    return F.struct(F.struct(*(flag(f) for f in FEATURES)).alias("features"), F.coalesce(number, F.lit(30).cast("long")).alias("interval_sec"), F.coalesce(parsed["paused"] == "true", F.lit(False)).alias("paused"), F.coalesce(F.filter(parsed["exclude"], lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("exclude"))


def export_sites(sites: DataFrame) -> DataFrame:
    """(site_id, line): a versioned JSON line per site."""
    return sites.select("site_id", F.to_json(F.struct(F.lit(1).alias("v"), "name", "url")).alias("line"))


def import_sites(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """lines(line) -> (name, url): valid entries of version 1 whose URL isn't there yet."""
    parsed = lines.select(F.from_json("line", "v int, name string, url string").alias("s")).select("s.*")
    good = parsed.where((F.col("v") == 1) & F.col("url").rlike("^https?://[^/]+")).groupBy("url").agg(F.min("name").alias("name"))
    return good.join(existing.select("url"), "url", "left_anti").select("name", "url")


def ingest_robots(docs: DataFrame, most: int = 50) -> DataFrame:
    """docs(site_id, url, body) -> (site_id, pos, sitemap_url): Sitemap lines in order, each once, the first `most`."""
    rows = docs.select("site_id", F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("origin"), F.posexplode(F.split("body", "\r\n|\r|\n")).alias("pos", "line"))
    href = F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)
    full = F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat("origin", href))
    found = rows.select("site_id", "pos", F.regexp_replace(full, "#.*$", "").alias("sitemap_url")).where("sitemap_url is not null").groupBy("site_id", "sitemap_url").agg(F.min("pos").alias("pos"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("pos"))).where(F.col("rank") <= most).select("site_id", "pos", "sitemap_url")


def ingest_sitemaps(docs: DataFrame) -> DataFrame:
    """docs(doc, body) -> (doc, kind, pos, loc): the first loc of each entry, kind 'page' or 'sitemap'; plain lists of URLs too; nothing for
    HTML."""
    entity = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    entries = lambda tag, kind: F.transform(F.regexp_extract_all("body", F.lit(rf"(?is)<{tag}\b[^>]*>.*?<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda x: F.struct(F.lit(kind).alias("kind"), entity(x).alias("loc")))
    lines = F.filter(F.transform(F.split("body", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.when(F.size(lines) > 0, F.when(F.forall(lines, lambda x: x.rlike(r"^https?://\S+$")), F.transform(lines, lambda x: F.struct(F.lit("page").alias("kind"), x.alias("loc")))))
    every = F.coalesce(text, F.concat(entries("sitemap", "sitemap"), entries("url", "page")))
    return docs.select("doc", F.posexplode(every).alias("pos", "e")).select("doc", "e.kind", F.col("pos").cast("long").alias("pos"), "e.loc")


def sitemap_levels(refs: DataFrame, roots: DataFrame, max_level: int | None = None) -> DataFrame:
    """(site_id, doc, level): the sitemaps that roots(site_id, doc) lead to by refs(doc, child), each with the least number of steps; to the
    end if max_level is None."""
    from ..sources.shared import new_table

    reached = roots.select("site_id", "doc").distinct().withColumn("level", F.lit(0))
    frontier, level = reached, 0
    while max_level is None or level < max_level:
        level += 1
        frontier = frontier.join(refs, "doc").select("site_id", F.col("child").alias("doc")).distinct().join(reached, ["site_id", "doc"], "left_anti").withColumn("level", F.lit(level))
        if max_level is None:
            frontier = new_table(frontier, "sitemap-level")
            if frontier.isEmpty():
                break
        reached = reached.unionByName(frontier)
    return reached


def _first_documents(levels: DataFrame, pages: DataFrame, max_urls: int) -> DataFrame:
    """levels without the documents that are behind a site's first max_urls pages. Documents that come after twice as many entries are left
    out where those before hold more than max_urls different pages; a site whose documents share so many that they don't keeps all."""
    from ..sources.shared import new_table

    counted = levels.join(pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc")
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("site_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counted.groupBy("site_id", "level").agg(F.sum("n").alias("n")).select("site_id", "level", before("level").alias("levels_before"))
    placed = counted.withColumn("docs_before", before("level", "doc")).join(total, ["site_id", "level"])
    near = F.col("levels_before") + F.col("docs_before") < 2 * max_urls
    placed = new_table(placed.select("site_id", "doc", "level", near.alias("near")), "sitemap-documents")
    urls = placed.where("near").join(placed.where("not near").select("site_id").distinct(), "site_id", "left_semi").join(pages, "doc").select("site_id", "url").distinct()
    enough = urls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_urls).select("site_id")
    far = placed.where("not near").join(enough, "site_id", "left_anti")
    return placed.where("near").unionByName(far).drop("near")


def sitemap_urls(levels: DataFrame, pages: DataFrame, max_urls: int | None = 5000) -> DataFrame:
    """(site_id, url, level, doc, pos, cut): the first max_urls pages of each site, by levels(site_id, doc, level) and pages(doc, pos, url), in
    breadth-first order (level, doc, place), each canonical URL once, where it stands first; cut tells that a site has more.

    Places are running totals: of the levels before, of the documents before in the level, and within the document. No task sorts more than a
    level's documents or a document's pages. URLs are made canonical once a document, whatever the sites that it belongs to, and of a site
    whose first documents hold more than max_urls pages the others aren't read."""
    from ..sources.shared import new_table

    named = pages.select("doc", "pos", u.canonical(F.col("url")).alias("url")).where("url is not null")
    listed = new_table(named.groupBy("doc", "url").agg(F.min("pos").alias("pos")), "sitemap-pages")
    own = (levels if max_urls is None else _first_documents(levels, listed, max_urls)).join(listed, "doc")
    once = own.groupBy("site_id", "url").agg(F.min(F.struct("level", "doc", "pos")).alias("at")).select("site_id", "url", "at.*")
    docs = once.groupBy("site_id", "level", "doc").agg(F.count(F.lit(1)).alias("n"))
    before = lambda *by: Window.partitionBy("site_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = docs.groupBy("site_id", "level").agg(F.sum("n").alias("n_level"))
    total = total.withColumn("levels_before", F.coalesce(F.sum("n_level").over(before("level")), F.lit(0))).withColumn("n_site", F.sum("n_level").over(Window.partitionBy("site_id")))
    docs = docs.withColumn("docs_before", F.coalesce(F.sum("n").over(before("level", "doc")), F.lit(0))).join(total, ["site_id", "level"])
    within = F.row_number().over(Window.partitionBy("site_id", "doc").orderBy("pos", "url"))
    placed = once.withColumn("nth", within).join(docs.select("site_id", "doc", "docs_before", "levels_before", "n_site"), ["site_id", "doc"])
    kept = placed if max_urls is None else placed.where(F.col("levels_before") + F.col("docs_before") + F.col("nth") <= max_urls)
    return kept.select("site_id", "url", "level", "doc", "pos", (F.lit(False) if max_urls is None else F.col("n_site") > max_urls).alias("cut"))


def sitemap_tree(docs: DataFrame, refs: DataFrame, roots: DataFrame, max_level: int | None = None, max_docs: int | None = None) -> DataFrame:
    """docs(doc, ok), refs(doc, child), roots(site_id, doc) -> (site_id, n_docs, complete, cut): sitemaps reached level by level, and whether
    all of them could be read. Levels go on to the end if max_level is None; with max_docs a site keeps the first so many (by level, then
    doc), and cut tells that there are more."""
    reached = sitemap_levels(refs, roots, max_level)
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("level", "doc"))
    kept = reached if max_docs is None else reached.withColumn("rank", rank).where(F.col("rank") <= max_docs + 1)
    over = F.lit(False) if max_docs is None else F.max("rank") > max_docs
    within = kept if max_docs is None else kept.withColumn("doc", F.when(F.col("rank") <= max_docs, F.col("doc")))
    rows = within.join(docs, "doc", "left").groupBy("site_id").agg(F.count("doc").alias("n_docs"), F.bool_and(F.col("doc").isNull() | F.coalesce("ok", F.lit(False))).alias("read"), over.alias("cut"))
    return rows.select("site_id", "n_docs", (F.col("read") & ~F.col("cut")).alias("complete"), "cut")


def ct_issuances(bodies: DataFrame) -> DataFrame:
    """bodies(root, body) of certificate logs -> (root, id, dns_names, name_value, common_name): every whole entry of a JSON array, also of one
    that was cut short; what is no entry is passed over. Entries may hold objects one level deep."""
    entries = F.regexp_extract_all("body", F.lit(r"\{(?:[^{}]++|\{[^{}]*+\})*+\}"), 0)
    rows = bodies.select("root", F.explode(entries).alias("entry"))
    parsed = rows.select("root", F.from_json("entry", "id long, dns_names array<string>, name_value string, common_name string").alias("e"))
    return parsed.where("e.id is not null").select("root", "e.*")


def ingest_ct(issuances: DataFrame, cursor: int) -> DataFrame:
    """issuances(root, id, dns_names, name_value, common_name) after the cursor -> (root, id, name), lower-cased, each once.

    Entries seldom come twice: they are dealt by id before their names are told apart, so that no task that reads answers holds all of theirs."""
    empty = F.array().cast("array<string>")
    names = F.concat(F.coalesce("dns_names", empty), F.coalesce(F.split("name_value", r"\s+"), empty), F.coalesce(F.array("common_name"), empty))
    dealt = issuances.where(F.col("id") > cursor).select("root", "id", "dns_names", "name_value", "common_name").repartition("root", "id")
    return dealt.select("root", "id", F.explode(F.array_distinct(names)).alias("name")).where("name <> ''").select("root", "id", F.lower("name").alias("name")).distinct()


def ingest_dns(answers: DataFrame) -> DataFrame:
    """Arrays a, aaaa and cname sorted, distinct and lower-cased; null where empty."""
    clean = lambda c: F.nullif(F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.lower(F.trim(x))))), F.array().cast("array<string>"))
    return answers.withColumns({c: clean(F.col(c)) for c in ("a", "aaaa", "cname")})


def ingest_http_probes(probes: DataFrame) -> DataFrame:
    """probes(host, scheme, status, title, server) -> one per host: the first that answered of https, then http; else status 0. Texts are
    cut and rows dealt by host before one is chosen: a host has few, so a task that reads probes would hold nearly all of its own."""
    rank = F.when(F.col("status") == 0, 2).when(F.col("scheme") == "https", 0).otherwise(1)
    dealt = probes.select("host", "scheme", "status", F.substring("title", 1, 300).alias("title"), F.substring("server", 1, 120).alias("server")).repartition("host")
    best = dealt.groupBy("host").agg(F.min_by(F.struct("scheme", "status", "title", "server"), F.struct(rank, F.when(F.col("scheme") == "https", 0).otherwise(1))).alias("p"))
    return best.select("host", "p.*")


def seed_sites(inputs: DataFrame) -> DataFrame:
    """inputs(input_id, text) -> (input_id, url, host, reason): reason is null for accepted ones. Adds https, takes '<...>' and host:port."""
    t = F.trim(F.regexp_replace(F.trim("text"), "^<|>$", ""))
    scheme = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    full = F.when(scheme == "", F.concat(F.lit("https://"), t)).otherwise(t)
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    label = r"[a-z0-9_](?:[a-z0-9_\-]{0,61}[a-z0-9_])?"
    reason = F.when(t == "", "empty").when(t.rlike(r"\s"), "blank inside").when((scheme != "") & ~F.lower(scheme).isin("http", "https"), "scheme").when(~host.contains("."), "no dot").when(~host.rlike(rf"^(?:{label}\.)+{label}$"), "label")
    return inputs.select("input_id", F.when(reason.isNull(), full).alias("url"), F.when(reason.isNull(), host).alias("host"), reason.alias("reason"))
