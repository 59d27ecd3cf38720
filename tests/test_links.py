"""Links, sitemaps and reports: expressions that stay small, and what is cut before it is joined."""

from pyspark.sql import functions as F

from driftline.functions import urls as u
from driftline.operators import extract as x
from driftline.operators import socials


def plan_chars(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_links_and_profiles_are_small_expressions(spark):
    """Copies of a value within an expression once made code too large to be compiled (170,541 and 404,281 characters of these plans)."""
    pages = spark.createDataFrame([(1, "https://a.com/x/", '<a href="?q=1">a</a><a href=\'../y#z\'>b</a><a href=//B.com:443/>c</a><a href="">d</a>')], "page_id long, url string, html string")
    edges = x.link_edges(pages, places=True)
    assert plan_chars(edges) < 50_000
    assert sorted((r.dst, r.pos) for r in edges.collect()) == [("https://a.com/x?q=1", 0), ("https://a.com/y", 1), ("https://b.com/", 2)]
    links = spark.createDataFrame([(1, "https://x.com/me", 0), (1, "https://a.com/b", 1), (1, None, 2)], "site_id long, url string, pos int")
    found = socials.site_socials(links)
    assert plan_chars(found) < 150_000
    assert [(r.kind, r.url) for r in found.collect()] == [("x", "https://x.com/me")]


def test_parts_worked_out_once_are_as_before(spark):
    cases = {"http://A.com": "http://a.com/", "https://a.com:80/?": "https://a.com:80/", "https://u@a.com.:443//b/../c/index.html?utm_x=1&b=2&a=": "https://a.com/c?a=&b=2", "https:///x": None, "ftp://a.com/": None, "https://a.com/..": "https://a.com/", "https://a.com/b/.": "https://a.com/b", "": None, None: None, "https://ü.com/": "https://xn--tda.com/"}
    rows = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in rows.select("url", u.canonical(F.col("url")).alias("c")).collect()} == cases
    tags = {"<a href=\"it's\">": "it's", "<a href='\"'>": '"', "<a href=\"\" x>": "", "<a b href=x&amp;y>": "x&y", "<a b>": None, "<a data-href=1 href='2'>": "2"}
    rows = spark.createDataFrame([(k,) for k in tags], "tag string")
    assert {r.tag: r.v for r in rows.select("tag", x.attribute(F.col("tag"), "href").alias("v")).collect()} == tags


def test_documents_behind_the_first_pages_are_left_out(spark):
    """Of a site with pages enough only the first documents are kept; one whose documents name the same pages keeps all; nothing else changes."""
    from driftline.operators import tables

    docs = [(s, s * 100 + d, d // 3) for s in (1, 2, 3) for d in range(30)]
    own = lambda s, d: [f"https://a.com/{d * 2 + k}" if s == 1 else f"https://a.com/{k}" if d < 29 else f"https://a.com/last{k}" for k in range(3)]
    pages = [(doc, k, url) for s, doc, _ in docs if s < 3 for k, url in enumerate(own(s, doc - s * 100))] + [(300, 0, "https://a.com/"), (300, 1, "https://A.com"), (329, 0, "ftp://x")]
    levels, listed = spark.createDataFrame(docs, "site_id long, doc long, level int"), spark.createDataFrame(pages, "doc long, pos int, url string")
    want = []
    for s in (1, 2, 3):
        seen = {}
        for _, doc, level in sorted((d for d in docs if d[0] == s), key=lambda d: (d[2], d[1])):
            for d, pos, url in sorted(p for p in pages if p[0] == doc):
                url = {"https://A.com": "https://a.com/", "ftp://x": None}.get(url, url)
                if url:
                    seen.setdefault(url, (s, url, level, d, pos))
        want += [(*r, len(seen) > 5) for r in list(seen.values())[:5]]
    got = tables.sitemap_urls(levels, listed, 5).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    kept = tables._first_documents(levels, listed, 5).groupBy("site_id").count().collect()
    assert {r.site_id: r["count"] for r in kept} == {1: 4, 2: 30, 3: 2}


def test_assets_read_markup_once(spark):
    """Comments and scripts are taken out of a page once for its assets, and once where it may have a base, whatever kinds are looked for."""
    html = '<!-- <script src=no.js> --><script src="/a.js">x="<link rel=stylesheet href=no.css>"</script><link rel="preload stylesheet" as=style href=s.css><link rel=modulepreload href=/m.js><link rel=preload as=font href=f><script>1</script><script src="data:x"></script><script src=/a.js></script>'
    assets = x.page_assets(spark.createDataFrame([(1, "https://a.com/b/c", html), (2, "https://a.com/", None)], "page_id long, url string, html string"))
    assert assets._jdf.queryExecution().optimizedPlan().toString().count("<!--") <= 2
    want = [(1, "preload", "https://a.com/b/s.css"), (1, "preload", "https://a.com/m.js"), (1, "script", "https://a.com/a.js"), (1, "style", "https://a.com/b/s.css")]
    assert sorted(tuple(r) for r in assets.collect()) == want
