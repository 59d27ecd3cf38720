"""Profiles and reports of scanned sites: known answers, and a plain walk over links in order."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import report, socials
from driftline.operators.extract import noise_domains
from driftline.operators.urls import PUBLIC_SUFFIXES

ADDRESS = "7GCihgDB8fe6KNjn2MYtkzZcRjQy3t9GHdC8uHYmW2hr"

LINKS = [
    ("https://twitter.com/Drift?s=20", "x https://x.com/Drift"), ("https://mobile.twitter.com/a_b/status/1", "x https://x.com/a_b"), ("https://x.com/intent/post", None), ("https://x.com/name_of_16_chars", None),
    ("https://t.me/joinchat/AbC", "telegram https://t.me/joinchat/AbC"), ("https://telegram.me/s/news/12", "telegram https://t.me/s/news"), ("https://t.me/sandbox/5", "telegram https://t.me/sandbox"), ("https://t.me/share/url?u=1", None),
    ("https://discord.com/invite/abc", "discord https://discord.gg/abc"), ("https://discord.gg/abc/", "discord https://discord.gg/abc"), ("https://discord.com/channels/1", None), ("https://discord.com/invite", None),
    ("https://github.com/org/repo/issues", "github https://github.com/org/repo"), ("https://www.github.com/org", "github https://github.com/org"), ("https://github.com/features/actions", None),
    ("https://medium.com/@me/post-1", "medium https://medium.com/@me"), ("https://medium.com/pub", "medium https://medium.com/pub"), ("https://medium.com/pub/post", None), ("https://us.medium.com/x", "medium https://us.medium.com/"),
    ("https://m.youtube.com/@me/videos", "youtube https://www.youtube.com/@me"), ("https://youtube.com/channel/UC1/about", "youtube https://www.youtube.com/channel/UC1"), ("https://youtube.com/watch?v=1", None),
    ("https://instagram.com/p/1", None), ("https://www.tiktok.com/@me", "tiktok https://www.tiktok.com/@me"), ("https://tiktok.com/me", None), ("https://reddit.com/r/spark/top", "reddit https://www.reddit.com/r/spark"), ("https://reddit.com/r", None),
    ("https://linkedin.com/company/x/jobs", "linkedin https://www.linkedin.com/company/x"), ("https://facebook.com/sharer.php?u=1", None), ("https://farcaster.xyz/me/0x", "farcaster https://farcaster.xyz/me"),
    ("https://birdeye.so/solana/token/abc/x", "birdeye https://birdeye.so/solana/token/abc"), ("https://birdeye.so/token", None), ("https://pump.fun/coin/abc", "pumpfun https://pump.fun/coin/abc"), (f"https://pump.fun/{ADDRESS}", f"pumpfun https://pump.fun/coin/{ADDRESS}"), ("https://pump.fun/board", None),
    ("https://coingecko.com/en/coins/btc", "coingecko https://www.coingecko.com/en/coins/btc"), ("https://etherscan.io/token/0x1/more", "etherscan https://etherscan.io/token/0x1"), ("https://etherscan.io/tx/0x1", None),
    ("https://news.substack.com/p/1", "substack https://news.substack.com/"), ("https://docs.other.org:8443/a/b", "docs https://docs.other.org:8443/"), ("https://docs.google.com/d/1", None), ("https://me.gitbook.io/book/ch", "docs https://me.gitbook.io/book"), ("https://app.gitbook.com/x", None),
    ("https://own.com/docs", "docs https://own.com/docs"), ("https://app.own.com/Documentation/", "docs https://app.own.com/Documentation"), ("https://own.com/docs/a", None), ("https://notown.com/docs", None),
    ("https://own.com/files/WhitePaper-v2.pdf?x=1", "whitepaper https://own.com/files/WhitePaper-v2.pdf"), ("mailto:me@x.com", None), ("ftp://github.com/a", None), ("https://x.com", None), ("", None), (None, None),
]


def test_each_link_has_its_profile(spark):
    links = spark.createDataFrame([(i, u, 0, "own.com") for i, (u, _) in enumerate(LINKS)], "site_id long, url string, pos int, root string")
    got = {r.site_id: f"{r.kind} {r.url}" for r in socials.site_socials(links).collect()}
    assert [(u, got.get(i)) for i, (u, _) in enumerate(LINKS)] == LINKS


def test_profiles_are_taken_in_order_of_links(spark):
    """Against a plain walk: each once, three of a kind, 40 of all, the cards' account last; no rows of sites without any."""
    rng, rows, kinds = random.Random(4), [], [h.split()[0] for h in (r.hosts for r in socials.RULES) if not h.startswith("*")]
    paths = {"youtube.com": "@p{}", "tiktok.com": "@p{}", "reddit.com": "r/p{}", "linkedin.com": "in/p{}", "discord.com": "invite/p{}", "dexscreener.com": "a/p{}", "birdeye.so": "token/p{}", "gmgn.ai": "token/p{}", "pump.fun": "coin/p{}", "coingecko.com": "coins/p{}", "coinmarketcap.com": "currencies/p{}"}
    for site, n in enumerate([0, 1, 5, 60, 400, 3000]):
        for pos in range(n):
            host = rng.choice(kinds if site % 2 else kinds[1:])
            path = paths.get(host, "token/p{}" if "scan" in host else "p{}").format(rng.randrange(6))
            rows.append((site, f"https://{host}/{rng.choice([path, path.upper() if host == 'x.com' else path])}{rng.choice(['', '/'])}", pos))
    links = spark.createDataFrame(rows, "site_id long, url string, pos int")
    single = {(r.site_id, r.pos): (r.kind, r.url) for r in socials._with_profile(links.withColumn("root", F.lit(None).cast("string")), socials.RULES).where("p is not null").select("site_id", "pos", "p.kind", "p.url").collect()}
    handles = [(site, "card") for site in range(6)] + [(0, None)]
    want = []
    for site in range(6):
        seen, per, out = set(), {}, []
        for pos in range(4000):
            kind, url = single.get((site, pos), (None, None))
            if kind is None or url.lower() in seen or per.get(kind, 0) == 3 or len(out) == 40:
                continue
            seen.add(url.lower())
            per[kind] = per.get(kind, 0) + 1
            out.append((kind, url))
        if "x" not in per and len(out) < 40:
            out.append(("x", "https://x.com/card"))
        want += [(site, i + 1, *x) for i, x in enumerate(out)]
    got = socials.site_socials(links.unionByName(links.limit(50)), handles=spark.createDataFrame(handles, "site_id long, handle string"))
    assert sorted((r.site_id, r["rank"], r.kind, r.url) for r in got.collect()) == want


@pytest.mark.parametrize(
    "html,handle",
    [
        ('<meta name="twitter:site" content="@Drift">', "Drift"), ("<meta content=@b_2 name=twitter:creator>", "b_2"), ('<meta name="twitter:site" content="@home"><meta name=\'twitter:creator\' content="me">', "me"),
        ('<meta name="twitter:card" content="me">', None), ('<!-- <meta name="twitter:site" content="@a"> -->', None), ('<meta name="twitter:site" content="a b">', None), ("", None), (None, None),
    ],
)
def test_accounts_of_cards(spark, html, handle):
    assert spark.createDataFrame([(html,)], "h string").select(socials.twitter_handle(F.col("h"))).first()[0] == handle


def test_no_links(spark):
    none = spark.createDataFrame([], "site_id long, url string, pos int")
    assert socials.site_socials(none, handles=spark.createDataFrame([], "site_id long, handle string")).collect() == []


SCANS = "site_id long, url string, final_url string, status int, blocked boolean, error string, content_type string, headers map<string,string>, html string, title string"
HOME = """<html><head><title>Own\n site</title><meta name=generator content="Hugo 0.1"><meta name="twitter:site" content="@own"><script src="/app.js?v=1"></script><script src="https://cdn.own.com/lib.js"></script>
<script src="https://other.com/x.js"></script><script src="/cdn-cgi/y.js"></script><link rel=preload as=script href=/pre.mjs><link rel=preload as=style href=/pre.css></head><body>
<a href="https://docs.own.com/a">d</a><a href="/b">b</a><a href="https://github.com/own/repo">g</a><pre>gtm.js</pre><script>fetch("https://api.own.com/x"); f("/api/users/list"); f("/about")</script></body></html>"""
LOOKS = [
    (1, "https://own.com/", "https://www.own.com/", 200, False, None, None, {"server": " nginx/1.2 ", "set-cookie": "a=1"}, HOME, "clash"),
    (2, "https://down.org/", None, 0, None, None, None, None, None, None),
    (3, "https://wall.io/", "https://wall.io/", 403, True, None, "text/html", {}, HOME, None),
    (4, "https://data.dev/", "https://data.dev/", 200, False, None, "application/json", None, '{"a": "https://x.com/me"}', None),
    (5, None, None, None, None, None, None, None, None, None),
    (6, "https://slow.com/", "https://slow.com/", 429, False, None, "text/html", None, "", None),
]


def reports(spark, scans, bundles=(), found=(), addresses=(), watches=(), **settings):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    suffixes = made([(x,) for x in PUBLIC_SUFFIXES], "suffix string")
    noise = {mode: noise_domains(spark, mode) for mode in ("markup", "script")}
    out = report.site_reports(made(scans, SCANS), made(bundles, "site_id long, text string, url string"), made(found, "root string, host string, source string"), made(addresses, "host string, ip string"), made(watches, "id long, name string, url string, host string"), suffixes, noise, **settings)
    return {r.site_id: r for r in out.collect()}


def test_report_of_what_was_had(spark):
    bundles = [(1, 'a("/v1/tokens"); b="https://rpc.own.com/"; c="https://github.com/x"; d="https://own.com/"', "u"), (1, None, None), (9, 'x("/v1/none")', None)]
    found = [("own.com", "Old.own.com", "ct"), ("own.com", "old.own.com", "dns"), ("own.com", "own.com", "ct"), ("own.com", None, "ct"), ("own.com", "*.live.own.com", "ct"), ("wall.io", "a.wall.io", "dns"), (None, "x.y", "dns")]
    addresses = [("live.own.com", "192.0.2.9"), ("www.own.com", "192.0.2.2"), ("www.own.com", "192.0.2.1"), ("own.com", "192.0.2.7"), ("down.org", None), ("wall.io", "192.0.2.3")]
    watches = [(8, "by host", "https://www.own.com/x", "own.com"), (9, "by final url", "https://www.own.com/", "www.own.com"), (4, "walled", "https://wall.io/deep", "www.wall.io"), (3, "walled first", "https://wall.io/other", "wall.io"), (1, None, None, None)]
    rows = reports(spark, LOOKS, bundles + bundles, found + found, addresses + addresses, watches)
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    own = rows[1]
    assert (own.host, own.root_domain, own.final_url, own.status, own.error, own.title, own.image) == ("own.com", "own.com", "https://www.own.com/", 200, None, "Own site", None)
    assert tuple(own.build) == (None, 4, "Hugo 0.1") and tuple(own.server) == ("nginx/1.2", None, ["192.0.2.1", "192.0.2.2"])
    assert own.api_endpoints == ["/api/users/list", "/v1/tokens"] and own.code_hosts == ["api.own.com", "cdn.own.com", "other.com", "rpc.own.com"]
    assert [(s.kind, s.url) for s in own.socials] == [("docs", "https://docs.own.com/"), ("github", "https://github.com/own/repo"), ("x", "https://x.com/own")]
    assert tuple(own.links) == (2, 1) and own.watched.id == 9
    assert [(s.host, "+".join(s.sources), s.alive) for s in own.subdomains] == [
        ("live.own.com", "ct", True), ("www.own.com", "link", True), ("api.own.com", "code", False), ("cdn.own.com", "code", False), ("docs.own.com", "link", False), ("old.own.com", "dns+ct", False), ("rpc.own.com", "code", False),
    ]
    names = [t.name for t in own.technologies]
    assert "Hugo" in names and "Nginx" in names and "Google Tag Manager" not in names
    walled = rows[3]
    assert walled.error == report.CHALLENGED and walled.title is None and tuple(walled.links) == (0, 0) and walled.server.ips == ["192.0.2.3"] and walled.watched.id == 3 and [s.host for s in walled.subdomains] == ["a.wall.io"]
    assert rows[2].error == "unreachable" and rows[2].status == 0 and rows[2].server.ips == [] and rows[2].watched is None and rows[2].subdomains == []
    assert rows[4].socials == [] and rows[4].title is None and rows[4].error is None and rows[5].error == "unreachable" and rows[6].error == "HTTP 429 (rate limited)"


def test_reports_list_the_first_of_each(spark):
    """Live hosts go first, whoever tells of them; what is beyond the list still gives its sources to hosts that the page names."""
    page = "<html><body>" + "".join(f'<a href="https://h{k:04}.own.com/">x</a>' for k in range(195, 230)) + "</body></html>"
    found = [("own.com", f"h{k:04}.own.com", source) for k in range(400) for source in ("dns", "ct")]
    bundles = [(1, "".join(f'a("/api/p{k:04}/list");' for k in range(400)), None)]
    row = reports(spark, [(1, "https://own.com/", None, 200, False, None, "text/html", None, page, None)], bundles, found, [("h0220.own.com", "192.0.2.1"), ("h0399.own.com", "192.0.2.1")])[1]
    assert [s.host for s in row.subdomains] == ["h0220.own.com", "h0399.own.com"] + [f"h{k:04}.own.com" for k in range(198)]
    assert {tuple(s.sources) for s in row.subdomains[1:100]} == {("dns", "ct")} and row.subdomains[0].sources == row.subdomains[199].sources == ["dns", "ct", "link"]
    assert row.api_endpoints == [f"/api/p{k:04}/list" for k in range(200)]


def test_report_of_nothing(spark):
    assert reports(spark, []) == {}


def test_scripts_that_a_report_wants(spark):
    scans = spark.createDataFrame(LOOKS, SCANS)
    suffixes = spark.createDataFrame([(x,) for x in PUBLIC_SUFFIXES], "suffix string")
    want = ["https://cdn.own.com/lib.js", "https://www.own.com/app.js?v=1", "https://www.own.com/pre.mjs"]
    assert sorted(map(tuple, report.scan_bundles(scans, suffixes).collect())) == [(1, u) for u in want]
    assert sorted(map(tuple, report.scan_bundles(scans, suffixes, most=2).collect())) == [(1, u) for u in want[:2]]
