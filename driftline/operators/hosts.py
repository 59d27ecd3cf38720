"""Host inventory from certificate logs, name service answers and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import network_prefix

_LABEL = r"[a-z0-9_](?:[a-z0-9_\-]{0,61}[a-z0-9_])?"
SOURCES = ("ct", "crtsh", "dns", "link", "code")


def normalize_names(names: DataFrame, *also: str) -> DataFrame:
    """names(root, name) -> (root, host): lower-case, without dots at the ends and '*.', valid and strictly below the root; columns named
    in `also` go along."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"^(?:\*\.)+", ""), r"^\.+|\.+$", "")
    rows = names.select("root", host.alias("host"), *also)
    return rows.where(F.col("host").rlike(rf"^(?:{_LABEL}\.)+{_LABEL}$") & (F.length("host") <= 253) & F.col("host").endswith(F.concat(F.lit("."), "root"))).distinct()


def candidate_hosts(found: DataFrame) -> DataFrame:
    """found(root, host, source, loud) -> (root, host, sources, loud): sources in fixed order, loud if any is."""
    order = F.array(*(F.lit(s) for s in SOURCES))
    per = found.groupBy("root", "host").agg(F.collect_set("source").alias("s"), F.bool_or("loud").alias("loud"))
    return per.select("root", "host", F.filter(order, lambda x: F.array_contains("s", x)).alias("sources"), "loud")


def drop_wildcard_answers(answers: DataFrame, wildcard: DataFrame) -> DataFrame:
    """answers(root, host, kind, value) -> (root, host) whose answers, or CNAMEs if there are any, aren't all in wildcard(root, kind, value)."""
    rows = answers.join(wildcard.withColumn("hit", F.lit(True)), ["root", "kind", "value"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    per = rows.groupBy("root", "host").agg(F.bool_and("hit").alias("all"), F.bool_and(F.when(F.col("kind") == "CNAME", F.col("hit"))).alias("names"))
    return per.where(~F.col("all") & ~F.coalesce("names", F.lit(False))).select("root", "host")


def rotating_wildcards(probes: DataFrame, known: DataFrame, most_prefixes: int = 4) -> DataFrame:
    """(root, rotating, spread) of probes(root, value) of random names, with name and kind where they are known, against
    known(root, value): rotating if a probe has an answer outside the known set that its CNAMEs, all of them known, don't explain; spread if the
    answers lie in more networks than that (/24 of IPv4, /48 of IPv6)."""
    for c in ("name", "kind"):
        probes = probes if c in probes.columns else probes.withColumn(c, F.lit(None).cast("string"))
    rows = probes.join(known.select("root", "value").distinct().withColumn("old", F.lit(1)), ["root", "value"], "left")
    alias = F.col("kind").eqNullSafe("CNAME")
    per = rows.groupBy("root", "name").agg(F.bool_or(F.col("old").isNull()).alias("new"), F.bool_and(F.when(alias, F.col("old").isNotNull())).alias("explained"))
    moved = per.groupBy("root").agg(F.bool_or(F.col("new") & ~F.coalesce("explained", F.lit(False))).alias("rotating"))
    prefixes = probes.where(~alias).groupBy("root").agg(F.count_distinct(network_prefix(F.col("value"))).alias("n"))
    return moved.join(prefixes, "root", "left").select("root", "rotating", (F.coalesce("n", F.lit(0)) > most_prefixes).alias("spread"))


def drop_rotating_answers(answers: DataFrame, known: DataFrame, state: DataFrame, most_prefixes: int = 4) -> DataFrame:
    """(root, host) of answers(root, host, kind, value) that tell more than that the wildcard known(root, kind, value) answers: as
    drop_wildcard_answers, and under a root that state(root, rotating, spread) says rotates, not all addresses in networks of the known
    ones. Where the pool is spread, or its networks are none or too many, answers tell nothing."""
    left = answers.join(drop_wildcard_answers(answers, known), ["root", "host"], "left_semi")
    own = lambda df: df.where("kind <> 'CNAME'").withColumn("prefix", network_prefix(F.col("value")))
    pool = own(known).where("prefix is not null").select("root", "prefix").distinct()
    size = pool.groupBy("root").agg(F.count(F.lit(1)).alias("n_prefixes"))
    near = own(left).join(pool.withColumn("near", F.lit(True)), ["root", "prefix"], "left").groupBy("root", "host").agg(F.bool_and(F.coalesce("near", F.lit(False))).alias("all_near"))
    rows = left.select("root", "host").distinct().join(near, ["root", "host"], "left").join(state.where("rotating").select("root", "rotating", "spread"), "root", "left").join(size, "root", "left")
    nothing = F.col("spread") | F.col("n_prefixes").isNull() | (F.col("n_prefixes") > most_prefixes)
    told = ~F.coalesce("rotating", F.lit(False)) | (~nothing & ~F.coalesce("all_near", F.lit(False)))
    return rows.where(told).select("root", "host")


def shared_answer_groups(answers: DataFrame, least: int = 25) -> DataFrame:
    """(root, answer, n): answers(root, host, value) that so many hosts of a root have as a whole."""
    per = answers.groupBy("root", "host").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("answer"))
    return per.groupBy("root", "answer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def remember_wildcards(answers: DataFrame, now: Column, hours: int = 24, most: int = 64) -> DataFrame:
    """(root, value, last_seen): answers(root, value, at) of the last day, the newest `most` a root."""
    recent = answers.where((F.unix_timestamp(now) - F.unix_timestamp("at")).between(0, hours * 3600)).groupBy("root", "value").agg(F.max("at").alias("last_seen"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("last_seen").desc(), "value"))
    return recent.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def new_subdomains(candidates: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """candidates(root, host, alive) that known(root, host) lacks: live ones first, `most` a root, with their rank."""
    fresh = candidates.join(known, ["root", "host"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("alive").desc(), "host"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= most)


def went_live(probes: DataFrame) -> DataFrame:
    """probes(root, host, at, alive) -> (root, host, live_at): first answer of a host that was probed without one before."""
    w = Window.partitionBy("root", "host").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = probes.withColumn("dead", F.bool_and(~F.col("alive")).over(w))
    return rows.where(F.col("alive") & F.col("dead")).groupBy("root", "host").agg(F.min("at").alias("live_at"))


def reprobe_due(subdomains: DataFrame, now: Column, interval_sec: int, most: int = 200, slack: float = 0.15) -> DataFrame:
    """Dead hosts to probe again: each interval while young, half-hourly from 7 days, three-hourly from 30, longest waiting first."""
    age = F.unix_timestamp(now) - F.unix_timestamp("first_seen")
    every = F.when(age >= 30 * 86_400, F.greatest(F.lit(interval_sec), F.lit(10_800))).when(age >= 7 * 86_400, F.greatest(F.lit(interval_sec), F.lit(1_800))).otherwise(F.lit(interval_sec))
    due = subdomains.where(~F.col("alive") & (F.col("last_probe").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_probe") >= every * (1 - slack))))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("last_probe").asc_nulls_first(), "host"))
    return due.withColumn("rank", rank).where(F.col("rank") <= most)


def resolver_health(answers: DataFrame) -> DataFrame:
    """(root, run): runs of answers(root, run, host, ok) in which the root or a watched host resolved."""
    return answers.where("ok").select("root", "run").distinct()


def expand_wordlist(roots: DataFrame, labels: list[str]) -> DataFrame:
    """(root, host): every label below every root. Labels are a setting of a few hundred words, held in the expression: no join."""
    return roots.select("root", F.explode(F.array(*(F.lit(x) for x in labels))).alias("label")).select("root", F.concat("label", F.lit("."), "root").alias("host"))


def scan_list(subdomains: DataFrame, most: int = 200) -> DataFrame:
    """Hosts of each root as a report lists them: live first, then by name."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("alive").desc(), "host"))
    return subdomains.withColumn("rank", rank).where(F.col("rank") <= most)
