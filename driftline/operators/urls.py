"""Jobs over tables of URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses as ad
from ..functions import urls as u

#: A small extract of the public suffix list; pass a larger table where more is needed.
PUBLIC_SUFFIXES = ("com", "net", "org", "io", "dev", "app", "co", "de", "fr", "es", "uk", "co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "com.br", "github.io", "vercel.app", "netlify.app", "pages.dev", "herokuapp.com")
_IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def canonicalize_urls(df: DataFrame, url: str = "url", base: str | None = None) -> DataFrame:
    """Adds canon_url, relative to the column `base` if given; null where the URL has no identity."""
    return df.withColumn("canon_url", u.canonical(F.col(url), F.col(base) if base else None))


def dedup_by_canonical(df: DataFrame, order: str, url: str = "url") -> DataFrame:
    """The first row by `order` of each canonical URL: one aggregate with map-side combine, no window."""
    rows = canonicalize_urls(df, url).where("canon_url is not null")
    return rows.groupBy("canon_url").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("first"), F.count(F.lit(1)).alias("n")).select("canon_url", "n", "first.*")


def _suffixes(host: Column) -> Column:
    """(suffix, labels before it) of each suffix of a host."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix"), (i - 1).alias("before")))


def root_domain(df: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Adds root_domain: one label more than the longest suffix in suffixes(suffix) that the host ends with, or than its last label.
    A suffix '*.x' stands for any label before x; '!y.x' takes y.x out of it again. IP addresses and single labels are their own; a
    suffix itself has none.

    Distinct hosts are split into suffixes and joined by equality; each host then takes its longest."""
    hosts = df.select(host).where(F.col(host).isNotNull()).distinct()
    split = hosts.select(host, F.explode(_suffixes(F.col(host))).alias("s")).select(host, "s.*")
    wild = F.concat(F.lit("*."), F.regexp_replace("suffix", r"^[^.]*\.", ""))
    form = lambda suffix, before: F.struct(suffix.alias("suffix"), before.alias("before"))
    forms = F.array(form(F.col("suffix"), F.col("before")), form(wild, F.col("before")), form(F.concat(F.lit("!"), "suffix"), F.col("before") + 1))
    split = split.select(host, F.explode(forms).alias("s")).select(host, "s.*")
    except_ = F.max(F.when(F.col("suffix").startswith("!"), F.col("before")))
    longest = split.join(suffixes.select("suffix").distinct(), "suffix").groupBy(host).agg(F.coalesce(except_, F.min("before")).alias("before"))
    labels = F.split(F.col(host), r"\.")
    before = F.coalesce(F.col("before"), F.size(labels) - 1)
    root = F.when(F.col(host).rlike(_IPV4) | (F.size(labels) == 1), F.col(host)).when(before > 0, F.array_join(F.slice(labels, before, F.size(labels)), "."))
    return df.join(hosts.join(longest, host, "left").select(host, root.alias("root_domain")), host, "left")


def within_domain(df: DataFrame, roots: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is one of roots(root) or below one: by suffixes and equality, never by pattern."""
    hosts = df.select(host).distinct()
    hit = hosts.select(host, F.explode(_suffixes(F.col(host))).alias("s")).join(roots, F.col("s.suffix") == F.col("root"), "left_semi").select(host).distinct()
    return df.join(hit, host, "left_semi")


def scope_filter(urls: DataFrame, sites: DataFrame, allow_query: bool = False) -> DataFrame:
    """(site_id, url) of urls(url) in the scope of sites(site_id, start_url, scope_path): same host and port, below the path."""
    rows = urls.select("*", u.host(F.col("url")).alias("_h"), u.port(F.col("url")).alias("_p"), u.path(F.col("url")).alias("_path"))
    scope = F.regexp_replace(F.regexp_replace(F.coalesce("scope_path", F.lit("")), "/{2,}", "/"), "/+$", "")
    places = sites.select("site_id", u.host(F.col("start_url")).alias("_h"), u.port(F.col("start_url")).alias("_p"), scope.alias("_scope"))
    joined = rows.join(places, ["_h", "_p"])
    below = (F.col("_scope") == "") | (F.col("_path") == F.col("_scope")) | F.col("_path").startswith(F.concat("_scope", F.lit("/")))
    fine = below & (F.length("url") <= u.MAX_SCOPED_CHARS) & u.scheme(F.col("url")).isin("http", "https")
    return joined.where(fine if allow_query else fine & (u.query(F.col("url")) == "")).drop("_h", "_p", "_path", "_scope")


def exclude_by_rules(urls: DataFrame, rules: list[tuple[int, str]]) -> DataFrame:
    """Rows of urls(site_id, url) that no rule of their site matches. Rules are a few lines of settings: they become one expression
    per site. Ones that can't be used exclude nothing; rule_problems tells them."""
    out = F.lit(False)
    for site, rule in rules:
        if (pattern := u.glob_regex(rule)) is not None:
            out = out | ((F.col("site_id") == site) & F.col("url").rlike(pattern))
    return urls.where(~out)


def rule_problems(rules: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(site_id, rule, why) of the rules that exclude nothing because they can't be used."""
    return [(site, rule, why) for site, rule in rules if (why := u.rule_problem(rule))]


def drop_opaque_id_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~u.has_opaque_id(F.col(url)))


def rank_locale_copies(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds locale_rank: 1 for a URL whose first segment is a locale, unless its site starts in one itself."""
    local = sites.select("site_id", u.has_locale(F.col("start_url")).alias("_local"))
    return urls.join(local, "site_id", "left").withColumn("locale_rank", (u.has_locale(F.col("url")) & ~F.coalesce("_local", F.lit(False))).cast("int")).drop("_local")


def drop_page_twins(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files that aren't the text form of a known page (x.md of x or x/index) nor a dump of the whole site."""
    base = F.regexp_replace(F.regexp_replace("url", r"(?i)\.(?:md|markdown)$", ""), r"(?i)/index$", "")
    rows = files.withColumn("_base", F.when(F.col("url").rlike(r"(?i)\.(?:md|markdown)$"), base))
    known = pages.select(F.regexp_replace("url", "/$", "").alias("_base")).distinct()
    return rows.join(known, "_base", "left_anti").where(~u.path(F.col("url")).rlike(r"(?i)/llms(?:-full)?\.txt$")).drop("_base")


def redirect_map(log: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(url, final_url, at, valid_until): the last redirect of each URL that stays on its host, and how long it holds."""
    rows = log.where((F.col("final_url") != F.col("url")) & (u.host(F.col("final_url")) == u.host(F.col("url"))))
    last = rows.groupBy("url").agg(F.max_by("final_url", "fetched_at").alias("final_url"), F.max("fetched_at").alias("at"))
    return last.withColumn("valid_until", F.col("at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))


def suggest_exclude_globs(urls: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """(site_id, glob, n): a site's k commonest '/folder/*' over URLs at least two segments deep, that known(site_id, glob) lacks."""
    segments = F.filter(F.split(u.path(F.col("url")), "/"), lambda x: x != "")
    globs = urls.where(F.size(segments) >= 2).groupBy("site_id", F.concat(F.lit("/"), F.element_at(segments, 1), F.lit("/*")).alias("glob")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("n").desc(), "glob"))
    return globs.join(known, ["site_id", "glob"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


#: Ranges that aren't publicly routed. The loopback address ::1 is in the first one, as an IPv6 address that holds 0.0.0.1.
PRIVATE_RANGES = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")


def range_digits(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """ranges with `bits`, and `lead`: the leading digits of its addresses; what is no range of addresses is left out."""
    address, bits = F.split_part(cidr, F.lit("/"), F.lit(1)), F.expr(f"try_cast(split_part({cidr}, '/', 2) AS int)")
    v4 = ~address.contains(":")
    made = ranges.withColumn("_digits", ad.address_digits(address)).withColumn("bits", F.when(v4, bits + 96).otherwise(bits))
    made = made.where(F.col("_digits").isNotNull() & F.col("bits").between(0, 128))
    return made.withColumn("lead", ad.leading(F.col("_digits"), F.col("bits"))).drop("_digits")


def longest_prefix(df: DataFrame, ranges: DataFrame, address: str = "address", cidr: str = "cidr") -> DataFrame:
    """df with `range`: of ranges(cidr) the longest that holds the address, null if none does or it is no address.

    An address is looked up by the prefix lengths that occur in the ranges only (129 at most), each by an equality join; the
    greatest length wins. An address that holds an IPv4 one is looked up as that. Every distinct address is looked up once, and no row
    meets a range that doesn't hold it, so the join grows with neither table's square."""
    known = range_digits(ranges, cidr).select("bits", "lead", F.col(cidr).alias("range")).groupBy("bits", "lead").agg(F.min("range").alias("range"))
    lengths = [r[0] for r in known.select("bits").distinct().orderBy("bits").collect()]  # 129 at most
    # the distinct rows are worked out before prefixes are cut from them
    each = df.select(F.col(address).alias("_address"), ad.routed_digits(ad.address_digits(F.col(address))).alias("_digits")).distinct()
    keys = F.transform(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: F.struct(n.alias("bits"), ad.leading(F.col("_digits"), n).alias("lead")))
    found = each.where("_digits is not null").select("_address", F.inline(keys)).join(known, ["bits", "lead"])
    best = found.groupBy("_address").agg(F.max_by("range", "bits").alias("range"))
    return df.join(best, F.col(address) == F.col("_address"), "left").drop("_address")


def flag_private_targets(df: DataFrame, host: str = "host") -> DataFrame:
    """Adds private: an address, of either family and any form, that isn't publicly routed or holds one that isn't, or an internal name."""
    digits = ad.address_digits(F.col(host))
    bare = F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")
    name = digits.isNull() & ((bare == "") | bare.rlike(r"(^|\.)localhost$|\.(local|internal)$") | ~bare.contains("."))
    return df.withColumn("private", F.coalesce(ad.in_ranges(ad.routed_digits(digits), PRIVATE_RANGES), F.lit(False)) | F.coalesce(name, F.lit(True)))


def resolve_site_reference(queries: DataFrame, sites: DataFrame) -> DataFrame:
    """(query_id, site_id) for queries(query_id, text): by id, then by the only site of that name, by URL with or without scheme (https
    first), by the only site of that host. A step with several sites is no match; the first step that matches decides.

    Sites that share a key are one row before queries meet them: least and greatest id, which are equal if there is one site only. A
    query meets four rows at most, however many sites have its name."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^https?://", ""), "/$", "")
    steps = lambda *keys: F.explode(F.array(*(F.struct(F.lit(rank).alias("rank"), key.alias("key")) for rank, key in enumerate(keys, 1)))).alias("k")
    t, url = F.lower(F.trim("text")), F.col("start_url")
    q = queries.select("query_id", steps(t, t, bare(t), t)).select("query_id", "k.*").where("key is not null")
    s = sites.select("site_id", (F.coalesce(u.scheme(url), F.lit("")) == "https").alias("secure"), steps(F.col("site_id").cast("string"), F.lower("name"), bare(F.lower(url)), u.host(url))).select("site_id", "secure", "k.*")
    s = s.where("key is not null").withColumn("secure", F.col("secure") & (F.col("rank") == 3))
    own = F.when(F.col("secure"), F.col("site_id"))
    known = s.groupBy("rank", "key").agg(F.min("site_id").alias("least"), F.max("site_id").alias("greatest"), F.bool_or("secure").alias("secure"), F.min(own).alias("least_secure"), F.max(own).alias("greatest_secure"))
    met = q.join(known, ["rank", "key"]).groupBy("query_id", "rank").agg(*(f(c).alias(c) for f, c in ((F.min, "least"), (F.max, "greatest"), (F.bool_or, "secure"), (F.min, "least_secure"), (F.max, "greatest_secure"))))
    choice = lambda end: F.when(F.col("secure"), F.col(f"{end}_secure")).otherwise(F.col(end))
    one = met.where(choice("least") == choice("greatest")).select("query_id", "rank", choice("least").alias("site_id"))
    return one.groupBy("query_id").agg(F.min_by("site_id", "rank").alias("site_id"))
