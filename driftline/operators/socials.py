"""Profiles, chats and documentation that pages link to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from .extract import attribute, tags


class Rule(NamedTuple):
    """Links to `hosts` ('*.x' for those below x, of two labels) are of a kind: what `pattern` takes from the path follows `target`, unless the
    first segment is one of `reserved`. {host} and {origin} in a target are the link's own."""

    hosts: str
    kind: str
    target: str
    pattern: str = "^/([^/]+)"
    reserved: str = ""


_X = "intent share home i search hashtag explore settings login signup tos privacy messages notifications compose about"
_GITHUB = "features pricing login join about marketplace topics explore site security enterprise contact collections trending sponsors settings notifications"
_AT, _TWO = "^/(@[^/]*)", "^/([^/]+/[^/]+)"
_AFTER = "^/((?:[^/]+/)*?{}/[^/]+)"
_LEDGER = "^/((?i:token|address|account)/[^/]+)"

#: Hosts, kinds and paths of profiles.
RULES = (
    Rule("x.com twitter.com", "x", "https://x.com/", "^/([A-Za-z0-9_]{1,15})(?:/|$)", _X),
    Rule("t.me telegram.me telegram.dog", "telegram", "https://t.me/", "^/((?i:joinchat|s|c)(?=/|$)(?:/[^/]+)?|[^/]+)", "share iv"),
    Rule("discord.gg", "discord", "https://discord.gg/"),
    Rule("discord.com discordapp.com", "discord", "https://discord.gg/", "^/(?i:invite)/([^/]+)"),
    Rule("github.com", "github", "https://github.com/", "^/([^/]+(?:/[^/]+)?)", _GITHUB),
    Rule("medium.com", "medium", "https://medium.com/", "^/(@[^/]*|[^/]+$)"),
    Rule("mirror.xyz", "mirror", "https://mirror.xyz/"),
    Rule("youtube.com", "youtube", "https://www.youtube.com/", "^/(@[^/]*|(?i:channel|c|user)/[^/]+)"),
    Rule("instagram.com", "instagram", "https://instagram.com/", reserved="p reel explore accounts"),
    Rule("tiktok.com", "tiktok", "https://www.tiktok.com/", _AT),
    Rule("linktr.ee", "linktree", "https://linktr.ee/"),
    Rule("reddit.com", "reddit", "https://www.reddit.com/", "^/((?i:r|user|u)/[^/]+)"),
    Rule("linkedin.com", "linkedin", "https://www.linkedin.com/", "^/((?i:company|in)/[^/]+)"),
    Rule("facebook.com", "facebook", "https://www.facebook.com/", reserved="sharer sharer.php share dialog plugins"),
    Rule("warpcast.com farcaster.xyz", "farcaster", "https://{host}/"),
    Rule("dexscreener.com", "dexscreener", "https://dexscreener.com/", _TWO),
    Rule("birdeye.so", "birdeye", "https://birdeye.so/", _AFTER.format("token")),
    Rule("pump.fun", "pumpfun", "https://pump.fun/", "^/((?i:coin)/[^/]+)"),
    Rule("pump.fun", "pumpfun", "https://pump.fun/coin/", "^/([1-9A-HJ-NP-Za-km-z]{32,44})(?=/|$)"),
    Rule("gmgn.ai", "gmgn", "https://gmgn.ai/", _AFTER.format("token")),
    Rule("coingecko.com", "coingecko", "https://www.coingecko.com/", _AFTER.format("coins")),
    Rule("coinmarketcap.com", "coinmarketcap", "https://coinmarketcap.com/", "^/((?i:currencies)/[^/]+)"),
    Rule("etherscan.io", "etherscan", "https://{host}/", _LEDGER),
    Rule("basescan.org", "basescan", "https://{host}/", _LEDGER),
    Rule("bscscan.com", "bscscan", "https://{host}/", _LEDGER),
    Rule("arbiscan.io", "arbiscan", "https://{host}/", _LEDGER),
    Rule("polygonscan.com", "polygonscan", "https://{host}/", _LEDGER),
    Rule("solscan.io", "solscan", "https://{host}/", _LEDGER),
    Rule("*.medium.com", "medium", "https://{host}/", "^/()"),
    Rule("*.mirror.xyz", "mirror", "https://{host}/", "^/()"),
    Rule("*.substack.com", "substack", "https://{host}/", "^/()"),
)
#: Platforms that host documentation, and hosts that look like one and aren't.
DOCS_PLATFORMS = ("gitbook.io", "mintlify.app", "readme.io", "readthedocs.io", "gitbook.com")
NO_DOCS = ("docs.google.com", "app.gitbook.com")


def _by_host(rules) -> Column:
    """The rules as one literal map, host -> its rules in order: settings of a few dozen rows, held in the expression."""
    found: dict[str, list[Rule]] = {}
    for rule in rules:
        for host in rule.hosts.split():
            found.setdefault(host, []).append(rule)
    one = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.target).alias("target"), F.lit(r.pattern).alias("pattern"), F.split(F.lit(r.reserved), " ").alias("reserved"))
    return F.create_map(*(x for host, own in found.items() for x in (F.lit(host), F.array(*map(one, own)))))


def _with_profile(links: DataFrame, rules) -> DataFrame:
    """links(url, root) with p: struct(kind, url), null if a link is no profile. Parts of the URL are columns of their own, worked out once."""
    url, col = F.col("url"), F.col
    segments = F.filter(F.split(u.path(url), "/"), lambda x: x != "")
    place = F.concat(u.host(url), F.regexp_replace(F.concat(F.lit(":"), u.port(url)), r"\A:\z", ""))
    parts = links.select("*", u.scheme(url).alias("_scheme"), u.host(url).alias("_whole"), u.path(url).alias("_path"), segments.alias("_segments"), F.concat(u.scheme(url), F.lit("://"), place, F.lit("/")).alias("_origin"))
    parts = parts.where(col("_scheme").isin("http", "https")).withColumn("_host", F.regexp_replace("_whole", r"^(?:www|mobile|m)\.", ""))
    parent = F.when(col("_host").rlike(r"\..*\."), F.regexp_extract("_host", r"([^.]+\.[^.]+)$", 1))
    parts = parts.select("*", parent.alias("_parent"), F.concat(F.lit("/"), F.array_join("_segments", "/")).alias("_clean"), F.coalesce(F.get("_segments", F.lit(0)), F.lit("")).alias("_first"))
    known = _by_host(rules)
    parts = parts.withColumn("_own", F.coalesce(F.try_element_at(known, col("_host")), F.try_element_at(known, F.concat(F.lit("*."), "_parent"))))
    target = lambda r: F.replace(F.replace(r["target"], F.lit("{host}"), col("_host")), F.lit("{origin}"), col("_origin"))
    fits = lambda r: F.call_function("regexp_like", col("_clean"), r["pattern"]) & ~((col("_first") != "") & F.array_contains(r["reserved"], F.lower(col("_first"))))
    made = F.transform(F.filter("_own", fits), lambda r: F.struct(r["kind"].alias("kind"), F.concat(target(r), F.call_function("regexp_extract", col("_clean"), r["pattern"], F.lit(1))).alias("url")))
    told = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.alias("url"))
    named = F.when(col("_host").rlike(r"^(?:docs?|developers?|wiki)\.") & ~col("_host").isin(*NO_DOCS), told("docs", col("_origin")))
    hosted = F.when(col("_parent").isin(*DOCS_PLATFORMS) & ~col("_host").isin(*NO_DOCS), told("docs", F.concat("_origin", "_first")))
    inside = (col("_whole") == col("root")) | col("_whole").endswith(F.concat(F.lit("."), "root"))
    folder = F.when(inside & (F.size("_segments") == 1) & F.lower("_first").isin("docs", "documentation"), told("docs", F.concat("_origin", "_first")))
    paper = F.when(col("_path").rlike("(?i)(?:white|lite)paper"), told("whitepaper", F.concat("_origin", F.substr("_path", F.lit(2)))))
    p = F.when(col("_own").isNotNull(), F.get(made, F.lit(0))).otherwise(F.coalesce(named, hosted, folder, paper))
    return parts.select("*", F.explode(F.array(p)).alias("p"))  # a row of its own, so that filters on p don't work it out again


def twitter_handle(html: Column) -> Column:
    """The account that a page's cards name (twitter:site, twitter:creator), null if none."""
    named = F.filter(tags(html, "meta"), lambda x: F.lower(F.coalesce(attribute(x, "name"), F.lit(""))).isin("twitter:site", "twitter:creator"))
    handles = F.transform(named, lambda x: F.regexp_extract(F.trim(F.coalesce(attribute(x, "content"), F.lit(""))), "^@?([A-Za-z0-9_]{1,15})$", 1))
    return F.when(html.contains("twitter:"), F.get(F.filter(handles, lambda x: (x != "") & ~F.lower(x).isin(*_X.split())), 0))


def site_socials(links: DataFrame, rules=RULES, handles: DataFrame | None = None, per_kind: int = 3, per_site: int = 40, most_chars: int = 300) -> DataFrame:
    """links(site_id, url, pos[, root]) -> (site_id, kind, url, rank): profiles that a site links to, each once (whatever its case or slash at
    the end), the first `per_kind` of a kind and `per_site` of all in order of links. handles(site_id, handle) tell the account of sites
    that link to none. Root, if given, is the site's domain: its own /docs counts too. Null and unusable URLs are no profiles.

    Rules are looked up in the row, so nothing is joined. Of a hot site, the links that are no profiles are gone before the shuffle, equal
    profiles are combined before it, and what a kind doesn't need is cut off by each task before it sorts a site."""
    rows = links if "root" in links.columns else links.withColumn("root", F.lit(None).cast("string"))
    found = _with_profile(rows, rules).where("p is not null").select("site_id", "pos", "p.kind", "p.url").where(F.length("url") <= most_chars)
    key = F.regexp_replace(F.lower("url"), "/+$", "")
    each = found.groupBy("site_id", key.alias("key")).agg(F.min(F.struct("pos", "url", "kind")).alias("f")).select("site_id", F.col("f.pos").cast("long").alias("pos"), "f.kind", "f.url")
    few = each.withColumn("nth", F.row_number().over(Window.partitionBy("site_id", "kind").orderBy("pos", "url"))).where(F.col("nth") <= per_kind).drop("nth")
    if handles is not None:
        last = F.lit(2**63 - 1).alias("pos")
        named = handles.where("handle is not null").groupBy("site_id").agg(F.min("handle").alias("handle")).join(few.where("kind = 'x'").select("site_id").distinct(), "site_id", "left_anti")
        few = few.unionByName(named.select("site_id", last, F.lit("x").alias("kind"), F.concat(F.lit("https://x.com/"), "handle").alias("url")))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("pos", "url")))
    return ranked.where(F.col("rank") <= per_site).select("site_id", "kind", "url", "rank")
