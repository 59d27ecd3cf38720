"""Change detection over observations by windows: each rule on its own. Their interplay is the fold in streaming.changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u

from .status import millis, usable

MINUTE, HOUR = 60_000, 3_600_000


def since(hours: float, key: list[str], at: str = "fetched_at"):
    """The window of rows of a key less than so many hours before a row (open: exactly so many don't count), it included."""
    return Window.partitionBy(*key).orderBy(F.unix_micros(at)).rangeBetween(-(int(hours * 3600 * 1_000_000) - 1), 0)


def confirmed_changes(log: DataFrame, key: list[str] = ["site_id", "url"]) -> DataFrame:  # noqa: B006
    """(key, fetched_at, hash, prev_hash, outcome) of usable observations with content that differ from the one before: 'confirmed' if
    the next one agrees, 'transient' if it is back at the old, 'unstable' if it is another one, 'pending' if there is none yet."""
    w = Window.partitionBy(*key).orderBy("fetched_at", "event_id")
    rows = log.where(usable(F.col("status"), F.col("blocked")) & F.col("hash").isNotNull())
    rows = rows.withColumn("prev_hash", F.lag("hash").over(w)).withColumn("next_hash", F.lead("hash").over(w)).where("prev_hash <> hash")
    outcome = F.when(F.col("next_hash").isNull(), "pending").when(F.col("next_hash") == F.col("hash"), "confirmed").when(F.col("next_hash") == F.col("prev_hash"), "transient").otherwise("unstable")
    return rows.select(*key, "event_id", "fetched_at", "hash", "prev_hash", outcome.alias("outcome"))


def unstable_pages(outcomes: DataFrame, key: list[str] = ["site_id", "url"], least: int = 3) -> DataFrame:  # noqa: B006
    """Keys with `least` unstable outcomes in a row, and when first."""
    w = Window.partitionBy(*key).orderBy("fetched_at", "event_id").rowsBetween(-(least - 1), 0)
    run = (F.count_if(F.col("outcome") == "unstable").over(w) == least)
    return outcomes.withColumn("run", run).where("run").groupBy(*key).agg(F.min("fetched_at").alias("dynamic_at"))


def churn(changes: DataFrame, key: list[str], most: int = 3, hours: float = 1) -> DataFrame:
    """Adds recent, the changes of the key within the hours before (it included), and muted: more than `most` of them."""
    recent = F.count(F.lit(1)).over(since(hours, key))
    return changes.withColumn("recent", recent).withColumn("muted", F.col("recent") > most)


def told_changes(changes: DataFrame, key: list[str], most: int = 3, hours: float = 1, tell_last: bool = False) -> DataFrame:
    """churn with told: changes before the first that mutes its key, and with tell_last that one too. Pages: the fourth change of an hour mutes
    and isn't told; files (most=2, tell_last): the third one mutes and is."""
    rows = churn(changes, key, most, hours)
    first = rows.where("muted").groupBy(*key).agg(F.min(F.struct("fetched_at", "event_id")).alias("first"))
    own = F.struct("fetched_at", "event_id")
    before = own <= F.col("first") if tell_last else own < F.col("first")
    return rows.join(first, key, "left").withColumn("told", F.col("first").isNull() | before).drop("first")


def trust_again(log: DataFrame, key: list[str] = ["site_id", "url"], hours: int = 24) -> DataFrame:  # noqa: B006
    """(key, trusted_at): when content has stood unchanged for so long, once per stretch of equal content."""
    w = Window.partitionBy(*key).orderBy("fetched_at", "event_id")
    rows = log.where("hash is not null").withColumn("changed", F.coalesce((F.lag("hash").over(w) != F.col("hash")).cast("long"), F.lit(1)))
    rows = rows.withColumn("stretch", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.min("fetched_at").over(Window.partitionBy(*key, "stretch")))
    old = millis(F.col("fetched_at")) - millis(F.col("start")) >= hours * HOUR
    return rows.where(old).groupBy(*key, "stretch").agg(F.min("fetched_at").alias("trusted_at")).drop("stretch")


def flip_flops(versions: DataFrame, key: list[str], minutes: int = 15, times: int = 2) -> DataFrame:
    """versions(key, at, hash), one row per switch; adds flip_flop: the version was left at most 15 minutes ago or was current twice before."""
    rows = versions.withColumn("left_at", F.lead("at").over(Window.partitionBy(*key).orderBy("at")))
    same = Window.partitionBy(*key, "hash").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before, last = F.count(F.lit(1)).over(same), F.max("left_at").over(same)
    recent = millis(F.col("at")) - millis(last) <= minutes * MINUTE
    return rows.withColumn("flip_flop", F.coalesce(recent, F.lit(False)) | (before >= times)).drop("left_at")


def removed_pages(log: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """(site_id, url, removed_at): the second 404 or 410 in a row of a page that was live before; a miss less than a minute after the check
    before it, of any outcome, doesn't count."""
    w = Window.partitionBy("site_id", "url").orderBy("fetched_at", "event_id")
    gone = F.col("status").isin(404, 410)
    rows = log.withColumn("gap", millis(F.col("fetched_at")) - millis(F.lag("fetched_at").over(w)))
    rows = rows.withColumn("seen", F.coalesce(F.max((F.col("status") == 200).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(gone | (F.col("status") == 200)).withColumn("miss", gone)
    rows = rows.withColumn("run", F.coalesce(F.sum((~F.col("miss")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = rows.where(F.col("miss") & (F.col("seen") == 1) & (F.coalesce("gap", F.lit(gap_seconds * 1000)) >= gap_seconds * 1000))
    nth = F.row_number().over(Window.partitionBy("site_id", "url", "run").orderBy("fetched_at", "event_id"))
    return counted.withColumn("nth", nth).where("nth = 2").select("site_id", "url", F.col("fetched_at").alias("removed_at"))


def new_pages(log: DataFrame, baseline: DataFrame) -> DataFrame:
    """(site_id, url, new_at, back): pages first live after their site's baseline_at that weren't checked before it, or live again after
    a 404."""
    w = Window.partitionBy("site_id", "url").orderBy("fetched_at", "event_id")
    rows = log.join(baseline, "site_id").withColumn("before", F.lag("status").over(w)).withColumn("first_check", F.min("fetched_at").over(Window.partitionBy("site_id", "url")))
    live = rows.where((F.col("status") == 200) & (F.col("fetched_at") > F.col("baseline_at")))
    fresh = live.where(F.col("first_check") > F.col("baseline_at")).groupBy("site_id", "url").agg(F.min("fetched_at").alias("new_at")).withColumn("back", F.lit(False))
    back = live.where(F.col("before").isin(404, 410)).groupBy("site_id", "url").agg(F.min("fetched_at").alias("new_at")).withColumn("back", F.lit(True))
    both = fresh.unionByName(back).groupBy("site_id", "url")
    return both.agg(F.min("new_at").alias("new_at"), F.min_by("back", F.struct("new_at", "back")).alias("back"))


def sitemap_backfill(entries: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """entries(site_id, read, url) with silent: the read brought over `most` unknown pages, or was the site's first."""
    fresh = entries.join(known, ["site_id", "url"], "left_anti")
    per = fresh.groupBy("site_id", "read").agg(F.count(F.lit(1)).alias("n"))
    first = entries.groupBy("site_id").agg(F.min("read").alias("first_read"))
    return fresh.join(per, ["site_id", "read"]).join(first, "site_id").select("site_id", "read", "url", ((F.col("n") > most) | (F.col("read") == F.col("first_read"))).alias("silent"))


def file_changes(fetches: DataFrame) -> DataFrame:
    """fetches(site_id, url, fetched_at, event_id, status, hash) -> (site_id, url, fetched_at, change, rank): added, modified or removed
    against the observation before; hash null stands for missing."""
    w = Window.partitionBy("site_id", "url").orderBy("fetched_at", "event_id")
    rows = fetches.withColumn("prev", F.lag("hash").over(w)).withColumn("had", F.lag(F.lit(True)).over(w))
    change = F.when(F.col("hash").isNotNull() & F.col("prev").isNull() & F.col("had"), "added").when(F.col("hash").isNull() & F.col("prev").isNotNull(), "removed").when(F.col("prev") != F.col("hash"), "modified")
    rank = F.when(change == "added", 0).when(change == "modified", 1).otherwise(2)
    return rows.withColumn("change", change).where("change is not null").select("site_id", "url", "fetched_at", "change", rank.alias("rank"))


def deploy_fingerprints(assets: DataFrame, keys: list[str]) -> DataFrame:
    """assets(keys, host, url, build_id) -> (keys, assets, build_id, sig): own assets without platform paths and cache busters, as a sorted
    set; sig is empty if there are none and no build."""
    own = assets.where((F.regexp_extract("url", "^https?://([^/]+)", 1) == F.col("host")) & ~F.col("url").contains("/cdn-cgi/"))
    clean = F.regexp_replace(F.regexp_replace("url", r"([?&])(?:_|t|ts|v|cb|cache|nocache|rnd|time)=\d{10,}", "$1"), r"[?&]+$", "")
    sets = own.withColumn("url", clean).groupBy(*keys).agg(F.array_sort(F.collect_set("url")).alias("assets"), F.max("build_id").alias("build_id"))
    text = F.concat_ws("\n", F.coalesce("build_id", F.lit("")), F.array_join("assets", "\n"))
    return sets.withColumn("sig", F.when((F.size("assets") == 0) & F.col("build_id").isNull(), "").otherwise(F.sha1(text)))


def deploy_changes(deploys: DataFrame, key: str = "site_id", at: str = "seen_at") -> DataFrame:
    """deploys(key, at, assets, sig) -> changes of the signature, with added and removed assets; an empty one replaces nothing."""
    w = Window.partitionBy(key).orderBy(at)
    rows = deploys.where("sig <> ''").withColumn("old_sig", F.lag("sig").over(w)).withColumn("old", F.lag("assets").over(w)).where("old_sig <> sig")
    return rows.select(key, at, "old_sig", "sig", F.array_sort(F.array_except("assets", "old")).alias("added"), F.array_sort(F.array_except("old", "assets")).alias("removed"))


def unstable_asset_queries(checks: DataFrame, confirms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): paths of tables (keys, url) whose queries differ between two fetches back to back."""
    split = lambda df, n: df.groupBy(*keys, F.regexp_extract("url", r"^([^?]*)", 1).alias("path")).agg(F.array_sort(F.collect_set(F.regexp_extract("url", r"\?(.*)$", 1))).alias(n))
    return split(checks, "a").join(split(confirms, "b"), [*keys, "path"]).where("a <> b").select(*keys, "path")


def unstable_since(checks: DataFrame, confirms: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """(keys, path, learned_at): from when on a path is known to change its query between two fetches back to back, by tables (keys, at, url)
    whose rows of one time are a pair. A row per path, whatever the number of its fetches."""
    return unstable_asset_queries(checks, confirms, [*keys, at]).groupBy(*keys, "path").agg(F.min(at).alias("learned_at"))


def compared_assets(assets: DataFrame, learned: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """assets(keys, at, url) with `compared`: the URL without its query once its path is known to be unstable; checks before that
    moment stay as they are."""
    path = F.regexp_extract("url", r"^([^?]*)", 1)
    rows = assets.withColumn("path", path).join(learned, [*keys, "path"], "left")
    return rows.withColumn("compared", F.when(F.col("learned_at") <= F.col(at), F.col("path")).otherwise(F.col("url"))).drop("path", "learned_at")


def known_variants(changes: DataFrame, seen: DataFrame, hours: int = 24) -> DataFrame:
    """changes(change_id, site_id, at, url) -> (change_id, known): all its assets were seen on the site within the day before. By the hour
    bucket and equality, so that the range is only compared within two days' rows of one asset."""
    micros = hours * 3_600_000_000
    bucket = lambda c, by=0: F.floor(F.unix_micros(c) / micros) + by
    probes = changes.withColumn("b", F.explode(F.array(bucket("at"), bucket("at", -1))))
    log = seen.select("site_id", "url", F.col("at").alias("seen_at"), bucket("at").alias("b"))
    hit = probes.join(log, ["site_id", "url", "b"]).where((F.col("seen_at") < F.col("at")) & (F.unix_micros("at") - F.unix_micros("seen_at") < micros)).select("change_id", "url").distinct().withColumn("hit", F.lit(1))
    return changes.select("change_id", "url").distinct().join(hit, ["change_id", "url"], "left").groupBy("change_id").agg((F.count("hit") == F.count(F.lit(1))).alias("known"))


def parameter_change(changed: DataFrame, key: str) -> DataFrame:
    """changed(key, side, url), side '+' or '-' -> (key, name, from_value, to_value): a parameter that has one value on all added and another
    one on all removed assets."""
    params = F.regexp_extract_all(F.regexp_extract("url", r"\?(.*)$", 1), F.lit(r"([^&=]+)=([^&]*)"), 0)
    rows = changed.select(key, "side", "url", F.explode(params).alias("p")).select(key, "side", "url", F.split("p", "=", 2)[0].alias("name"), F.split("p", "=", 2)[1].alias("value"))
    sizes = changed.groupBy(key, "side").agg(F.count_distinct("url").alias("all"))
    sides = rows.groupBy(key, "side", "name").agg(F.count_distinct("url").alias("n"), F.count_distinct("value").alias("values"), F.min("value").alias("value")).join(sizes, [key, "side"]).where("n = all and values = 1")
    plus, minus = sides.where("side = '+'"), sides.where("side = '-'")
    return minus.select(key, "name", F.col("value").alias("from_value")).join(plus.select(key, "name", F.col("value").alias("to_value")), [key, "name"]).where("from_value <> to_value")


def new_code_refs(refs: DataFrame, history: DataFrame, most: int = 40, pages: DataFrame | None = None, by_kind: bool = False) -> DataFrame:
    """refs(site_id, kind, value) that history(site_id, kind, value) lacks, `most` per kind by value; nothing for sites without history, or, by
    kind, for kinds that a site has none of: the first time they are only taken down. Paths of known pages(site_id, path), as they stand
    or decoded, are no news."""
    scope = ["site_id", "kind"] if by_kind else ["site_id"]
    fresh = refs.distinct().join(history, ["site_id", "kind", "value"], "left_anti").join(history.select(*scope).distinct(), scope, "left_semi")
    if pages is not None:
        known = pages.select("site_id", F.explode(F.array("path", u.decoded(F.col("path")))).alias("value")).distinct()
        fresh = fresh.join(known, ["site_id", "value"], "left_anti").select(refs.columns)
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("site_id", "kind").orderBy("value"))).where(F.col("rank") <= most)


def admit_endpoints(candidates: DataFrame, tracked: DataFrame, most: int = 15) -> DataFrame:
    """candidates(site_id, url, status, is_json) that answered 2xx JSON and aren't tracked yet, up to what their site has room for."""
    good = candidates.where(F.col("status").between(200, 299) & F.col("is_json")).join(tracked, ["site_id", "url"], "left_anti").select("site_id", "url").distinct()
    room = tracked.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("url"))
    return good.join(room, "site_id", "left").withColumn("rank", rank).where(F.col("rank") <= most - F.coalesce("n", F.lit(0))).select("site_id", "url", "rank")


#: The order in which the events of one run are told.
KINDS = ("deploy", "text", "new", "removed", "file", "status", "info", "subdomain", "live")


def assemble_events(tables: dict[str, DataFrame], baseline_runs: DataFrame | None = None) -> DataFrame:
    """Tables (site_id, at, summary) by kind as one table with kind and rank; rows of baseline_runs(site_id, at) are left out."""
    out = None
    for kind, df in tables.items():
        rows = df.select("site_id", "at", F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), F.substring("summary", 1, 4000).alias("summary"))
        out = rows if out is None else out.unionByName(rows)
    return out if baseline_runs is None else out.join(baseline_runs, ["site_id", "at"], "left_anti")


def listed(items: Column, most: int = 3) -> Column:
    """'a, b, c (+2 more)'."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def noise_notices(noisy: DataFrame) -> DataFrame:
    """noisy(site_id, run, kind, label) -> one notice per site, run and kind: how many labels, and the first ten."""
    per = noisy.distinct().groupBy("site_id", "run", "kind").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return per.select("site_id", "run", "kind", F.size("labels").cast("long").alias("n"), listed(F.col("labels"), 10).alias("notice"))
