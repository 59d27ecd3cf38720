"""Crawl planning: tables of pages and links in, plans out; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..sources.shared import shared_dir
from .urls import root_domain


def top_per(df: DataFrame, keys: list[str], order: list, limit: int, rank: str = "rank") -> DataFrame:
    """The first rows of each key, with their rank: Spark keeps only so many per key and task before the shuffle, up to the limit of
    spark.sql.optimizer.windowGroupLimitThreshold."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= limit)


def ranked(df: DataFrame, keys: list[str], order: list, steps: list[Column], rank: str = "rank") -> DataFrame:
    """Row numbers of each key by `order` without sorting a whole key in one task. `steps` are the first parts of the order in coarse form
    (ascending, nulls first): rows of an earlier step come earlier. A row's rank is the number of its key's rows in earlier steps, from a
    count per step, and its place within its own step."""
    at = F.struct(*keys, *(s.alias(f"step{k}") for k, s in enumerate(steps)))
    marked = df.withColumn("_step", at)
    before = F.sum("n").over(Window.partitionBy(*(F.col("_step")[k] for k in keys)).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    counts = marked.groupBy("_step").agg(F.count(F.lit(1)).alias("n")).select("_step", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = marked.withColumn("_place", F.row_number().over(Window.partitionBy("_step").orderBy(*order)))
    return placed.join(counts, "_step").withColumn(rank, F.col("_before") + F.col("_place")).drop("_step", "_before", "_place")


def _hour(at: Column | str) -> Column:
    return F.floor(F.unix_timestamp(at) / 3600)


def adopt_redirected_hosts(log: DataFrame, sites: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(site_id, from_host, to_host, adopted): sites whose first good observation led to another host of the same root, which
    isn't a site's yet."""
    first = log.where("status = 200").groupBy("site_id", "host").agg(F.min_by("final_url", F.struct("fetched_at", "event_id")).alias("adopted"))
    first = first.select("site_id", F.col("host").alias("from_host"), "adopted", u.host(F.col("adopted")).alias("to_host")).where("to_host <> from_host")
    roots = root_domain(first.select(F.col("from_host").alias("host")).unionByName(first.select(F.col("to_host").alias("host"))).distinct(), suffixes)
    same = first.join(roots.toDF("from_host", "from_root"), "from_host").join(roots.toDF("to_host", "to_root"), "to_host").where("from_root = to_root")
    return same.join(sites.select(F.col("host").alias("to_host")), "to_host", "left_anti").select("site_id", "from_host", "to_host", "adopted")


def discover_candidates(edges: DataFrame, known: DataFrame, max_depth: int = 4) -> DataFrame:
    """edges(page_id, dst, depth) -> (url, n, first_page, depth): linked pages that known(url) lacks, in classes and shapes that can be
    pages, at most max_depth deep. URLs are reduced to one row each before the anti-join."""
    # The URL is taken as an aggregate, so that conditions on it stay above and aren't worked out again in every link's parsing.
    per = edges.groupBy("dst").agg(F.max("dst").alias("url"), F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"), (F.min("depth") + 1).alias("depth"))
    url = F.col("url")
    fine = (F.length(url) <= u.MAX_SCOPED_CHARS) & (u.query(url) == "") & (u.url_class(url) == "page") & ~u.has_opaque_id(url) & (F.col("depth") <= max_depth)
    seen = known.groupBy("url").agg(F.max("url").alias("seen"))  # likewise: the conditions are inferred for this side too
    return per.where(fine).drop("dst").join(seen.select("seen"), F.col("url") == F.col("seen"), "left_anti")


def crawl_depths(links: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """links(src, dst), seeds(url) -> (url, depth): least number of links from a seed, up to max_depth. Each round joins the frontier alone
    and drops what was reached before; a checkpoint in the shared folder keeps plans short."""
    reached = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    links.sparkSession.sparkContext.setCheckpointDir(shared_dir(links.sparkSession))
    for depth in range(1, max_depth + 1):
        fresh = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = fresh.join(reached, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        reached = reached.unionByName(frontier)
    return reached


def due_pages(pages: DataFrame, sites: DataFrame, now: Column) -> DataFrame:
    """Pages of sites(site_id, interval_sec, sweep_sec) to check at `now`, longest waiting first: what the time since the last check
    allows (an hour for pages that are gone), at most max(5, live pages * interval / sweep) a site."""
    live = pages.groupBy("site_id").agg(F.count_if(~F.col("gone")).alias("_live"))
    joined = pages.join(sites.join(live, "site_id"), "site_id")
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_checked")
    every = F.when(F.col("gone"), F.greatest("sweep_sec", F.lit(3600))).otherwise(F.col("sweep_sec"))
    due = joined.withColumn("most", F.greatest(F.lit(5), F.ceil(F.col("_live") * F.col("interval_sec") / F.col("sweep_sec")))).where(F.col("last_checked").isNull() | (waited < 0) | (waited >= every))
    steps = [_hour("last_checked"), F.when(F.col("last_checked").isNull(), F.col("depth"))]
    return ranked(due.drop("_live"), ["site_id"], [F.col("last_checked").asc_nulls_first(), "depth", "url"], steps).where("rank <= most")


def due_files(files: DataFrame, now: Column, sweep_sec: int, most: int = 10) -> DataFrame:
    """Files to check: never checked first, documents first among them, then the longest waiting."""
    never = F.when(F.col("last_checked").isNull(), 0).otherwise(1)
    document = F.when(u.path(F.col("url")).rlike(r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|epub|rtf|csv|key|pages|numbers)$"), 0).otherwise(1)
    due = files.where(F.col("last_checked").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_checked") >= sweep_sec))
    return top_per(due, ["site_id"], [never, F.when(never == 0, document), F.col("last_checked").asc_nulls_first(), document, "first_seen", "url"], most)


def tracked_set(pages: DataFrame, most: int) -> DataFrame:
    """pages(site_id, url, tracked, in_scope, gone, status, depth, first_seen) -> (site_id, url, tracked) after demoting pages out of scope and,
    over budget, the deepest and newest, and promoting live ones, shallowest and oldest, into what room is left."""
    kept = pages.withColumn("tracked", F.col("tracked") & F.col("in_scope"))
    live = F.col("tracked") & ~F.col("gone")
    can = ~F.col("tracked") & ~F.col("gone") & F.col("in_scope") & F.col("status").between(200, 299)
    # no page is both live and promotable, so one numbering serves both
    kept = kept.withColumn("role", F.when(live, "live").when(can, "can").otherwise("rest"))
    lives = kept.groupBy(F.col("site_id").alias("of_site")).agg(F.count_if(live).alias("n_live"))
    placed = ranked(kept, ["site_id", "role"], ["depth", "first_seen", "url"], [F.col("depth"), _hour("first_seen")], "place")
    placed = placed.join(lives, F.col("site_id").eqNullSafe(F.col("of_site")))
    stays = F.when(F.col("role") == "live", F.col("place") <= most).otherwise(F.col("tracked"))
    return placed.select("site_id", "url", (stays | ((F.col("role") == "can") & (F.col("place") <= most - F.col("n_live")))).alias("tracked"))


def reprobe_queue(pages: DataFrame, now: Column, silent_most: int = 10) -> DataFrame:
    """Untracked pages to try again, by tier: never fetched, failed for a while (10 minutes), missing (15), others (6 hours). Of those that
    are only backfill, known since the baseline, at most ten a site."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_checked")
    s = F.col("status")
    tier = (
        F.when(s.isNull(), 0)
        .when(s.between(200, 299), None)
        .when((s <= 0) | (s == 429) | (s >= 500), F.when(age >= 600, 1))
        .when(s.isin(404, 410), F.when(age >= 900, 2))
        .otherwise(F.when(age >= 21_600, 3))
    )
    rows = pages.withColumn("tier", tier).where("tier is not null").withColumn("loud", (F.col("tier") == 2) | (F.col("first_seen") > F.col("baseline_at")))
    order = ["tier", "depth", F.col("last_checked").asc_nulls_first(), "url"]
    silent = top_per(rows.where("loud is null or not loud"), ["site_id", "loud"], order, silent_most).drop("rank")
    steps = [F.col("tier"), F.col("depth"), _hour("last_checked")]
    return ranked(rows.where("loud").unionByName(silent), ["site_id"], order, steps).select("site_id", "url", "tier", "loud", "rank")


def evict(pages: DataFrame, cap: int) -> DataFrame:
    """(site_id, url): untracked pages over the cap, worth least first: never fetched ones of sitemaps, deepest and newest, then dead or
    redirecting ones, longest unchecked."""
    never = F.col("status").isNull() & (F.col("source") == "sitemap")
    dead = F.col("gone") | F.col("status").isin(404, 410, 301)
    known = pages.groupBy(F.col("site_id").alias("of_site")).agg(F.count(F.lit(1)).alias("known")).where(F.col("known") > cap)
    rows = pages.where(~F.col("tracked") & (never | F.coalesce(dead, F.lit(False)))).join(known, F.col("site_id").eqNullSafe(F.col("of_site")))
    order = [F.when(never, 0).otherwise(1), F.when(never, F.col("depth")).desc(), F.when(never, F.col("first_seen")).desc(), "last_checked", "url"]
    late = F.when(never, F.coalesce(-_hour("first_seen"), F.lit(2**62))).otherwise(_hour("last_checked"))
    steps = [order[0], F.when(never, F.coalesce(-F.col("depth"), F.lit(2**62))), late]
    return ranked(rows, ["site_id"], order, steps).where(F.col("rank") <= F.col("known") - cap).select("site_id", "url")


def admit(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates(site_id, url, kind, seen) with admitted: code before fresh before stale, then first seen, `budget` a site; the others stay
    pending."""
    kind = F.when(F.col("kind") == "code", 0).when(F.col("kind") == "fresh", 1).otherwise(2)
    best = candidates.groupBy("site_id", "url").agg(F.min(F.struct(kind.alias("k"), "seen")).alias("b"))
    order = F.struct("b.k", "b.seen", "url")
    last = top_per(best, ["site_id"], [order], budget).groupBy(F.col("site_id").alias("of_site")).agg(F.max(order).alias("last"))
    best = best.join(last, F.col("site_id").eqNullSafe(F.col("of_site")), "left")
    return best.select("site_id", "url", F.coalesce(order <= F.col("last"), F.lit(False)).alias("admitted"))


def discover_files(edges: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """edges(page_id, dst) -> (url, n): documents linked from pages, on hosts within roots(root), that known(url) lacks."""
    from .urls import within_domain

    files = edges.groupBy("dst").agg(F.max("dst").alias("url"), F.count(F.lit(1)).alias("n")).where(u.url_class(F.col("url")) == "file").withColumn("host", u.host(F.col("url")))
    return within_domain(files, roots).join(known, "url", "left_anti").select("url", "n")
