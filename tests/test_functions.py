"""Column functions: values, and laws that hold for any text."""

import ipaddress
import random
import re
import time
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import addresses as ad
from driftline.functions import text as t
from driftline.functions import urls as u
from driftline.operators.diff import edit_script, split_lines, unified
from driftline.operators.extract import detect_technologies, implied, is_route, link_edges, page_assets, page_meta
from driftline.operators.status import parse_retry_after
from driftline.operators.tables import sitemap_tree
from driftline.operators.technology_match import Matcher, fixed_parts
from driftline.operators.technology_rules import RULES
from driftline.operators.urls import longest_prefix, rule_problems
from driftline.operators.visible_text import lines_of_page


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


URLS = [
    ("HTTPS://User:pw@Docs.A.io:443/a//b/../index.html/?b=2&utm_source=x&a=1&a=0&REF=q#top", "https://docs.a.io/a?a=1&a=0&b=2"),
    ("http://a.io", "http://a.io/"), ("http://a.io:8080/x/", "http://a.io:8080/x"), ("https://a.io/index.htm", "https://a.io/"), ("https://a.io./p?", "https://a.io/p"),
    ("mailto:a@b.c", None), ("javascript:void(0)", None), ("https://", None), ("", None), ("https://a.io/" + "x" * 9000, None), ("https://a.io/a/INDEX.HTML/index.html", "https://a.io/a"),
    ("https://bücher.de/x", "https://xn--bcher-kva.de/x"), ("https://a.io/a b", "https://a.io/a%20b"), ("https://a.io/a/./b/../c", "https://a.io/a/c"), ("https://a.io\\docs\\faq", "https://a.io/docs/faq"), ("https://a.io/../x/..", "https://a.io/"),
]


def test_canonical(spark):
    assert each(spark, u.canonical, [x for x, _ in URLS]) == [y for _, y in URLS]


RELATIVE = [
    ("/docs/faq/", "https://a.io/x/y", "https://a.io/docs/faq"), ("faq", "https://a.io/docs/", "https://a.io/docs/faq"), ("../up", "https://a.io/a/b/c", "https://a.io/a/up"), ("?page=2", "https://a.io/list", "https://a.io/list?page=2"),
    ("#top", "https://a.io/page?q=1", "https://a.io/page?q=1"), ("//cdn.a.io/x.js", "https://a.io/", "https://cdn.a.io/x.js"), ("https://b.io/x", "not a url", "https://b.io/x"), ("mailto:hi@a.io", "https://a.io/", None), ("/x", "not a url", None), ("a:b", "https://a.io/", None),
]


def test_canonical_of_references(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(RELATIVE)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(u.canonical(F.col("a"), F.col("b"))).collect()] == [c for _, _, c in RELATIVE]


def test_canonical_is_idempotent(spark):
    rng = random.Random(0)
    made = ["".join(rng.choice(["http://", "https://", "a.io", "/", "index.html", "?", "&", "utm_x=1", "b=2", "=", "#", ".", ":80", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    once = each(spark, u.canonical, made)
    assert each(spark, u.canonical, [x or "" for x in once]) == once


def test_url_class(spark):
    cases = {"https://a.io/x.pdf": "file", "https://a.io/x.JS": "asset", "https://a.io/x.zip": "skip", "https://a.io/x": "page", "https://a.io/_next/x": "asset", "https://a.io/static/x": "asset", "https://a.io/static/x.html": "page", "https://a.io/manifest.json": "asset", "https://a.io/d.json": "file", "https://a.io/wp-admin/x.pdf": "skip", "ftp://a.io/x": "skip", "https://a.io/.pdf": "page", "/docs/guide.pdf": "file", "https://a.io/.well-known/a.json": "asset", "https://a.io/blog/post.v2": "page", "https://a.io/static/w.pdf": "file", "https://a.io/_next/data/x.zip": "asset", "https://a.io/pkg.tar.gz": "skip"}
    assert each(spark, u.url_class, list(cases)) == list(cases.values())


MASKS = {"$12.5M": "$#M", "+3.2%": "#%", "v1.2.3": "v#", "2026-09-28": "#-#-#", "14:43": "#:#", "5 minutes ago": "# ago", "an hour ago": "# ago", "just now": "# ago", "3h ago": "# ago", "a-5": "a-#", "4 items": "# item", "1,234.56": "#", "(−4)": "(#)", "TVL $1,234,567.89 (+2.5%)": "TVL $# (#%)", "1, 2, 3": "#, #, #", "version 2.": "version #.", "Updated a few seconds ago": "Updated # ago", "a couple of days ago": "# ago", "a moment ago": "# ago", "24 comment(s) x": "# comment x", "3 bass_": "# bass_", "abc-def": "abc-def", "5 Agos": "# Ago", "no numbers": "no numbers", "": ""}


def test_mask_numbers(spark):
    assert each(spark, t.mask_numbers, list(MASKS)) == list(MASKS.values())


def test_mask_is_local_to_a_line(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice(["1", "2,3", " ", "-", "a", " minutes", " ago", "#", "items", "+", "é"]) for _ in range(rng.randint(0, 10))) for _ in range(300)]
    assert "\n".join(each(spark, t.mask_numbers, lines)) == each(spark, t.mask_numbers, ["\n".join(lines)])[0]


def test_formats(spark):
    sizes = {"0": "0 B", "1023": "1023 B", "1024": "1 KB", "12595": "12.3 KB", "4299161": "4.1 MB", "125829120": "120 MB", "-1": "?"}
    assert each(spark, lambda c: t.format_bytes(c.cast("long")), list(sizes)) == list(sizes.values())
    times = {"45000": "45s", "252000": "4m 12s", "10800000": "3h", "187200000": "2d 4h"}
    assert each(spark, lambda c: t.format_duration(c.cast("long")), list(times)) == list(times.values())


def test_retry_after(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cases = {"120": 120_000, "1.5": 1500, "-5": None, "": None, "soon": None, "Mon, 01 Jan 2024 00:01:00 GMT": 60_000, "Mon, 01 Jan 2020 00:01:00 GMT": 0, "999999999": 86_400_000}
    assert each(spark, lambda c: parse_retry_after(c, now), list(cases)) == list(cases.values())


@pytest.mark.parametrize("rule,url,hit", [("/profile/*", "https://a.io/profile/x/y", True), ("/profile/*", "https://a.io/profile", False), ("/b/**", "https://a.io/b/", True), ("/a/*/c", "https://a.io/a/b/c?x=1", True), ("/a/*/c", "https://a.io/a/b/d/c", False), (r"\.html$", "https://a.io/X.HTML", True)])
def test_exclude_rules(rule, url, hit):
    import re

    assert bool(re.search(u.glob_regex(rule), url)) == hit


def test_odd_rules_are_told():
    assert u.glob_regex("(x") is None and u.glob_regex("") is None and u.glob_regex("(a+)+$") is None
    told = rule_problems([(1, "(x"), (1, "/a/*"), (2, "(a+)+$"), (2, r"\.pdf$")])
    assert [(s, r) for s, r, _ in told] == [(1, "(x"), (2, "(a+)+$")] and "nested" in told[1][2]


ROUTES = ["/api/v1/claim", "/api/v2/users/:id", "/app/series", "/blog/[slug]", "/docs/points", "/users/@me", "/x/[...rest]", "/x/[[...rest]]", "/docs/"]
NO_ROUTES = ["/", "/a", "/x/", "//cdn.foo.com/x", "/a//b", "/_next/static/chunks/x", "/static/media/logo", "/static", "/node_modules/react", "/__next", "/@vite/client", "/_error", "/favicon.ico", "/sw.js", "/1/2", "/2024", "/1.0.3", "/%s", "/foo/g", "/foo/gi", "/gi", "/[a-z]", "/foo/[0-9]", "/foo/[", "/x/[a-z]", "/month", "/min", "/a b", "/" + "x" * 120, "/q?x=1", "/a.js/"]


def test_routes(spark):
    assert each(spark, is_route, ROUTES + NO_ROUTES) == [True] * len(ROUTES) + [False] * len(NO_ROUTES)


HEADS = [
    ("<meta content='d1' name='description'><META NAME=generator CONTENT=Tool/2 ><title>A</title><body><title>  </title>", ("A", "d1", "Tool/2", "", False)),
    ('<meta name="description" content="  "><meta property="og:description" content=" OG &amp;  desc "><link href=/c rel="alternate canonical"><title>First</title><svg><title>Icon</title></svg>', ("First", "OG & desc", "", "/c", False)),
    ('<meta name="ROBOTS" content="none"><!-- <meta name=description content=no> --><script>"<meta name=description content=no>"</script><p data-name="x" data-content="y>z">', ("", "", "", "", True)),
]


def test_page_meta(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEADS)], "i int, html string")
    made = page_meta(F.col("html"))
    got = df.orderBy("i").select(*(made[k] for k in ("title", "description", "generator", "canonical", "noindex"))).collect()
    assert [tuple(r) for r in got] == [w for _, w in HEADS]


LINKS = [
    ("https://a.io/d/p", "<a href='/one'>1</a><a class=\"x>y\" href=two>2</a><a href=\"three\">3</a><A HREF = \"/four/\">4</A><a data-href=\"/no\">5</a><a href=\"\">6</a><a>7</a><a href='mailto:x@a.io'>8</a>", ["https://a.io/d/three", "https://a.io/d/two", "https://a.io/four", "https://a.io/one"]),
    ("https://a.io/x/y", '<base href="https://cdn.a.io/sub/"><a href="page">x</a><script>"<a href=/no>"</script>', ["https://cdn.a.io/sub/page"]),
    ("https://a.io/", '<base href="javascript:alert(1)"><a href="/p?a=1&amp;b=2">x</a>', ["https://a.io/p?a=1&b=2"]),
    ("https://a.io/x", '<link rel="alternate" type="text/markdown" href="/x.md"><link rel="alternate" type="text/html" hreflang="fr" href="/fr"><link href="/de" rel=alternate><link rel=stylesheet href=/s.css><map><area href="/m"></map>', ["https://a.io/de", "https://a.io/fr", "https://a.io/m"]),
    ("https://a.io/x", None, []),
]


def test_links_as_pages_write_them(spark):
    df = spark.createDataFrame([(i, a, h) for i, (a, h, _) in enumerate(LINKS)], "page_id long, url string, html string")
    got = link_edges(df).collect()
    assert [sorted(r.dst for r in got if r.page_id == i) for i in range(len(LINKS))] == [w for _, _, w in LINKS]


def test_assets(spark):
    html = "<base href='https://cdn.a.io/s/'><script type=module src=app.js></script><script src='data:text/javascript,1'></script><link href=s.css rel=stylesheet><link as=script href='/a.js' rel=preload><link rel=modulepreload href=/b.mjs><link rel=preload as=font href=/f.woff2><link rel='stylesheet preload' as=style href=/d.css>"
    df = spark.createDataFrame([(1, "https://a.io/x", html), (2, "https://a.io/x", None)], "page_id long, url string, html string")
    want = {("script", "https://cdn.a.io/s/app.js"), ("style", "https://cdn.a.io/s/s.css"), ("style", "https://cdn.a.io/d.css"), ("preload", "https://cdn.a.io/a.js"), ("preload", "https://cdn.a.io/b.mjs"), ("preload", "https://cdn.a.io/d.css")}
    assert {(r.role, r.url) for r in page_assets(df).collect()} == want


def test_technologies(spark):
    signals = [(1, "generator", "WordPress 6.5.2"), (1, "style", "https://b.org/wp-includes/css/dist/x.css?ver=6.5.1"), (1, "header", "Server: nginx/1.25.3"), (1, "header", "x-powered-by: PHP/8.2.14"), (1, "script", "https://b.org/wp-includes/js/jquery/jquery.min.js?ver=3.7.1")]
    signals += [(2, "header", "server: nginx"), (2, "style", "/wp-includes/css/dist/x.css?ver=6.4.3"), (2, "header", None), (3, "html", "we like WordPress and nginx/1.2"), (4, "js", 'version:"18.3.1",rendererPackageName:"react-dom"'), (4, "script", "https://cdn.jsdelivr.net/npm/gsap@3.12.5/dist/gsap.min.js")]
    got = {(r.site_id, r.name): (r.category, r.version) for r in detect_technologies(spark.createDataFrame(signals, "site_id long, kind string, value string")).collect()}
    assert got == {(1, "WordPress"): ("cms", "6.5.2"), (1, "Nginx"): ("server", "1.25.3"), (1, "PHP"): ("language", "8.2.14"), (1, "jQuery"): ("ui", None), (2, "Nginx"): ("server", None), (2, "WordPress"): ("cms", "6.4.3"), (4, "React"): ("framework", "18.3.1"), (4, "GSAP"): ("ui", "3.12.5")}
    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(20)] + [("t20", "t0")], "name string, implies string")
    assert implied(chain).count() == 21 * 20


def test_lines_of_preformatted_text_and_items():
    page = lines_of_page
    assert page("<pre>line one\n  line two</pre><p>next</p>") == ["line one", "line two", "next"]
    assert page("<pre><code><span>a</span><span>b</span>\r\nc</code></pre>x <code>y\nz</code>") == ["ab", "c", "x y z"]
    assert page("<nav><a>Docs</a><a>Blog</a></nav>") == ["Docs", "Blog"] and page("<nav><a>Docs</a> <a>Blog</a></nav>") == ["Docs Blog"]
    assert page("<p><span>$</span><span>10</span></p>") == ["$10"] and page("<p><span>TVL</span><span>$1,024</span></p>") == ["TVL", "$1,024"]
    assert page("<p><span>10 </span><span>SOL</span></p>") == ["10 SOL"] and page("<p><b>a</b><i>b</i></p>") == ["ab"]
    assert page("<p>see <a>x</a><a>y</a></p>") == ["see xy"] and page("<div><a>x</a><svg></svg><a>y</a></div>") == ["xy"] and page("<div><a>x</a><span></span><a>y</a></div>") == ["x", "y"]
    assert page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f") == ["a", "b", "c", "d", "e", "f"] and page("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert page(None) == [] and page("<div hidden>x<p>y</div>z</b>") == ["z"] and page("<div>" * 5000 + "deep") == ["deep"]


def plain_lines(tree, kept=False, written=False, items=False):
    """The same by recursion over a generated tree: '\\n' marks the ends of lines."""
    out = ""
    for x in tree[1]:
        if isinstance(x, str):
            out += x if kept else re.sub(r"\s", " ", x)
            continue
        tag = x[0]
        parts = items or tag in ("div", "pre", "li")
        as_written = written or tag in ("pre", "code")
        glued = [(a, b) for a, b in zip(x[1], x[1][1:], strict=False)] if not as_written and not any(isinstance(c, str) and c.strip() for c in x[1]) else []
        shown = lambda c: plain_text(c)
        full = [c for c in x[1] if isinstance(c, str) or shown(c)]
        glued = zip(full, full[1:], strict=False) if glued else []
        own = any(not isinstance(a, str) and not isinstance(b, str) and not {a[0], b[0]} & {"b", "code"} and any(c.isalpha() for c in shown(a) + shown(b)) and not shown(a)[-1].isspace() and not shown(b)[0].isspace() for a, b in glued)
        text = plain_lines(x, kept or tag == "pre", as_written, own)
        out += f"\n{text}\n" if parts else text
    return out


def plain_text(tree):
    return tree if isinstance(tree, str) else "".join(map(plain_text, tree[1]))


trees = st.recursive(st.sampled_from(["a", "b1", " ", "2", "\n", "x\ny", " c "]), lambda kids: st.tuples(st.sampled_from(["div", "span", "b", "a", "pre", "code"]), st.lists(kids, max_size=4)), max_leaves=14)


@given(st.lists(trees, max_size=5))
@settings(max_examples=300, deadline=None)
def test_lines_are_those_of_a_plain_walk(kids):
    def merged(children):  # texts side by side are one
        out = []
        for c in children:
            c = c if isinstance(c, str) else (c[0], merged(c[1]))
            if isinstance(c, str) and out and isinstance(out[-1], str):
                out[-1] += c
            else:
                out.append(c)
        return out

    kids = merged(kids)
    html = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(html, t[1]))}</{t[0]}>"
    want = [" ".join(x.split()) for x in plain_lines(("", kids)).split("\n")]
    assert lines_of_page("".join(map(html, kids))) == [x for x in want if x]


def technologies(spark, *signals):
    df = spark.createDataFrame([(1, kind, value) for kind, value in signals], "site_id long, kind string, value string")
    return {r.name for r in detect_technologies(df).collect()}


def test_technologies_are_not_guessed(spark):
    """Words in code or copy, near misses, plain links and other sites' hosts say nothing; several weak signs do."""
    code = 'const stripe = getStripe(); var phantom = true; let next = items.next(); React.createElement("div"); var wordpress = "WordPress"; var tailwind = "items-center"; var sentry = "sentry"; var webflow = "webflow";'
    copy = "<html><body><p>We moved from WordPress to Next.js; pay with Stripe or Phantom on Solana.</p><p>Built with React and Tailwind. Ask us on Discord.</p></body></html>"
    assert technologies(spark, ("js", code), ("html", copy)) == set()
    assert technologies(spark, ("js", 'import "svelte-hmr"; log("GSAP is fun");'), ("host", "api-foo.vercel.app"), ("host", "notplausible.io"), ("link", "webflow.com")) == set()
    assert technologies(spark, ("js", 'log("GSAP 3.12.5"); c = "svelte-1a2b3c"'), ("site", "x.vercel.app"), ("host", "eu.plausible.io"), ("link", "buy.stripe.com")) == {"GSAP", "Svelte", "Vercel", "Plausible", "Stripe"}
    assert technologies(spark, ("html", '<div class="flex items-center mx-auto">'), ("html", '<div class="text-sm rounded-lg">')) == set()
    assert technologies(spark, ("html", '<div class="flex-col items-center mx-auto"><p class="text-sm">')) == {"Tailwind CSS"}


@given(st.lists(st.sampled_from(["server: nginx/1.2", "SERVER: NGINX", "_ga", "_ga_1", "x-powered-by: php/8.1", "/jquery-3.1.js", "/vue@3.2.1/", " ", "İ", "/_next/static/", "ng-version='15.1'", "hx-get="]), max_size=6))
@settings(max_examples=150, deadline=None)
def test_technology_automaton_is_every_pattern(parts):
    """In short values, what the automaton finds is what each pattern finds by itself."""
    value = "".join(parts)
    for kind in ("header", "cookie", "script", "html", "js", "generator"):
        want = {(n, (m.group(1) or None) if m.re.groups else None) for n, _, k, p in RULES if k == kind for m in [re.search(p, value, re.I | re.A)] if m}
        assert {(n, v) for n, _, v, _ in Matcher(RULES, kind).matches(value)} == want


def test_technology_rules_cost_one_pass():
    """Ten times the rules, hardly more time; a pattern that ends at its window's end has to end there in the value too."""
    text = "lorem ipsum dolor sit amet consectetur " * 60_000
    took = []
    for n in (300, 3000):
        rules = [(f"T{i}", "x", "html", rf"\bmark{i:05}x=.(\d+)") for i in range(n)]
        own = Matcher(rules, "html")
        began = time.process_time()
        assert [x[:3] for x in own.matches(text + " mark00007x='42'")] == [("T7", "x", "42")]
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.3
    own = Matcher([("T", "x", "html", r"needle\w*$")], "html")
    assert list(own.matches("needle" + "a" * 300)) and not list(own.matches("needle" + "a" * 300 + " b"))
    assert fixed_parts(r"^(?:server:\s*cloudflare|cf-ray:)") == {"cf-ray:", "cloudflare"} and fixed_parts(r"\w+") is None


def test_sitemap_tree(spark):
    refs = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(5, 0)], "doc long, child long")
    docs, roots = spark.createDataFrame([(i, True) for i in range(10)], "doc long, ok boolean"), spark.createDataFrame([(1, 0), (2, 7), (3, 99)], "site_id long, doc long")
    tree = lambda **k: sorted(map(tuple, sitemap_tree(docs, refs, roots, **k).collect()))
    assert tree(max_level=3) == [(1, 4, True, False), (2, 3, True, False), (3, 1, False, False)]
    assert tree() == [(1, 10, True, False), (2, 3, True, False), (3, 1, False, False)]
    assert tree(max_level=None, max_docs=3) == [(1, 3, False, True), (2, 3, True, False), (3, 1, False, False)]


lines = st.lists(st.sampled_from("abcde"), max_size=9)


@given(lines, lines)
@settings(max_examples=300, deadline=None)
def test_edit_script(a, b):
    ops = edit_script(a, b)
    assert [v for o, v in ops if o != "+"] == a and [v for o, v in ops if o != "-"] == b
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert sum(o == "=" for o, _ in ops) == table[-1][-1]


def test_unified():
    assert unified(edit_script(list("abcdefghij"), list("abXdefghYj"))) == "  b\n- c\n+ X\n  d\n…\n  h\n- i\n+ Y\n  j"
    assert unified(edit_script(list("abc"), list("abc"))) == ""
    assert unified(edit_script([], [str(i) for i in range(50)])).endswith("\n… (+20 more changed lines)")
    assert unified(edit_script(["x" * 500], [])) == "- " + "x" * 180 + "…" and unified(edit_script([], ["a", "b"]), most=0) == "… (+2 more changed lines)"
    ten = [f"l{i}" for i in range(10)]
    two = [*ten[:2], "A", *ten[3:7], "B", *ten[8:]]
    assert unified(edit_script(ten, two), context=0) == "- l2\n+ A\n…\n- l7\n+ B"


def test_split_lines():
    assert split_lines("") == [] and split_lines(None) == [] and split_lines("a\r\nb\rc\n") == ["a", "b", "c"] and split_lines("\n") == [""] and split_lines("a\n\nb") == ["a", "", "b"]


def test_parts_over_the_budget_are_counted_alone():
    """A part that takes too many steps tells what one side has more often; what is before and after it stays exact."""
    rng = random.Random(3)
    one, two = ([rng.choice("ab") for _ in range(400)] for _ in range(2))
    head, tail = [f"h{i}" for i in range(50)], [f"t{i}" for i in range(50)]
    a, b = head + ["only a"] + tail + one, [*head[:20], "only b", *head[20:]] + tail + two
    ops = edit_script(a, b, budget=100)
    assert ("-", "only a") in ops and ("+", "only b") in ops and [v for o, v in ops if o == "="][:100] == head + tail
    more = Counter(one) - Counter(two), Counter(two) - Counter(one)
    assert Counter(v for o, v in ops if o == "-") - Counter(["only a"]) == more[0] and Counter(v for o, v in ops if o == "+") - Counter(["only b"]) == more[1]
    exact = edit_script(a, b)
    assert [v for o, v in exact if o != "+"] == a and [v for o, v in exact if o != "-"] == b


@given(st.lists(st.sampled_from("abc"), min_size=20, max_size=60), st.lists(st.sampled_from("abc"), min_size=20, max_size=60))
@settings(max_examples=100, deadline=None)
def test_edit_script_of_few_kinds_is_minimal(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("driftline.operators.diff.CHAINED", 0)
        assert sum(o == "=" for o, _ in edit_script(a, b)) == row[-1]


def test_edit_script_of_long_texts():
    """Ten thousand lines of every shape, in little time and memory."""
    base = [f"Paragraph {i}: lorem ipsum dolor sit amet" for i in range(10_000)]
    shuffled = list(base)
    random.Random(42).shuffle(shuffled)
    third = [x + " edited" if i % 3 == 0 else x for i, x in enumerate(base)]
    shapes = {"few": (base[:10] + ["edited"] + base[11:5000] + base[5001:], 3), "third": (third, 6668), "all": ([x.upper() for x in base], 20_000), "moved": (base[5000:] + base[:5000], 10_000), "shuffled": (shuffled, None), "empty": ([], 10_000), "same": (["x"] * 10_000, 20_000)}
    tracemalloc.start()
    began = time.process_time()
    for other, edits in shapes.values():
        ops = edit_script(base, other)
        assert [v for o, v in ops if o != "+"] == base and [v for o, v in ops if o != "-"] == other
        assert edits is None or sum(o != "=" for o, _ in ops) == edits
    assert sum(o == "=" for o, _ in edit_script(["x", "y"] * 3000, ["y", "x"] * 3000)) == 5999
    rng = random.Random(1)
    for kinds in (7, 200):
        one, two = ([str(rng.randrange(kinds)) for _ in range(5000)] for _ in range(2))
        ops = edit_script(one, two)
        assert [v for o, v in ops if o != "+"] == one and [v for o, v in ops if o != "-"] == two and any(o == "=" for o, _ in ops)
    assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_rank_of_a_hot_key_is_that_of_one_window(spark):
    from pyspark.sql import Window

    from driftline.operators.plan import ranked

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 7 > 0, F.col("id") % 5).alias("site"), F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 1000).alias("at"), "id", F.lit("kept").alias("n")
    )
    order = [F.col("at").asc_nulls_first(), F.col("id").desc()]
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    steps = [F.floor(F.col("at") / 100), F.when(F.col("at").isNull(), -F.floor(F.col("id") / 50))]
    for by in (steps, steps[:1]):
        assert sorted(ranked(rows, ["site"], order, by).collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert ranked(rows.limit(0), ["site"], order, steps).count() == 0


def test_root_domains_of_a_published_list(spark, tmp_path):
    from driftline.operators.urls import root_domain
    from driftline.sources.fetch_log import read_public_suffixes

    (tmp_path / "list.dat").write_text("// a comment\n\ncom\nuk\nCO.UK  more\n*.ck\n!www.ck\n")
    suffixes = read_public_suffixes(spark, str(tmp_path / "list.dat"))
    assert {r[0] for r in suffixes.collect()} == {"com", "uk", "co.uk", "*.ck", "!www.ck"}
    expected = {"a.b.com": "b.com", "com": "com", "a.co.uk": "a.co.uk", "x.a.co.uk": "a.co.uk", "co.uk": None, "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "1.2.3.4": "1.2.3.4", "host": "host", "a.b.zz": "b.zz"}
    hosts = spark.createDataFrame([(h,) for h in expected], "host string")
    assert {r.host: r.root_domain for r in root_domain(hosts, suffixes).collect()} == expected


def test_addresses_of_both_families(spark):
    rng = random.Random(6)
    texts = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "::", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::1", "::1.2.3.4", "::1.2.3.456", "1.2.3.4::", "fe80::1%en0", "[::1]", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", ":1", "1:", "A::b"]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(30)] + [f(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 40, 96]) << rng.choice([0, 16, 32]) & (1 << 128) - 1)) for _ in range(60) for f in (str, lambda a: a.exploded)]

    def digits(text):
        try:
            own = ipaddress.ip_address(text.strip("[]").partition("%")[0])
        except ValueError:
            return None
        return f"{int(own) + (0xFFFF << 32 if own.version == 4 else 0):032x}"

    assert each(spark, ad.address_digits, texts) == [digits(x) for x in texts]
    assert each(spark, ad.network_prefix, ["1.2.3.4", "::ffff:1.2.3.9", "2001:db8:1:2::", "2001:db8:1::9", "x"]) == [f"{ad.MAPPED}010203"] * 2 + ["20010db80001"] * 2 + [None]


def test_longest_prefix_is_brute_force(spark):
    rng = random.Random(2)
    bits = [0, 1, 5, 8, 13, 24, 31, 32]
    ranges = [str(ipaddress.ip_network((rng.getrandbits(32) & 0xC0FF0FFF, n), strict=False)) for n in bits for _ in range(6)]
    ranges += [str(ipaddress.ip_network((rng.getrandbits(128) & ~(0xFFFF << 96), n), strict=False)) for n in (3, 16, 47, 64, 128) for _ in range(6)] + ["nonsense", "1.2.3.4/40", "::/129", None]
    inside = [str(ipaddress.ip_network(r)[0] + rng.randrange(4)) for r in ranges[: len(bits) * 6 - 12]]
    addresses = inside + [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0xC0FF0FFF)) for _ in range(100)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(0xFFFF << 96))) for _ in range(60)] + ["x", None, "::ffff:" + inside[9], inside[3], inside[3]]
    nets = [ipaddress.ip_network(r) for r in ranges[:-4]]

    def best(text):
        try:
            own = ipaddress.ip_address(text)
        except ValueError:
            return None
        own = getattr(own, "ipv4_mapped", None) or own
        return min(((-n.prefixlen, str(n)) for n in nets if n.version == own.version and own in n), default=(0, None))[1]

    got = longest_prefix(spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "i int, address string"), spark.createDataFrame([(r,) for r in ranges], "cidr string"))
    assert [r.range for r in got.orderBy("i").collect()] == [best(a or "") for a in addresses]
    nothing = longest_prefix(spark.createDataFrame([(1, "1.1.1.1")], "i int, address string"), spark.createDataFrame([], "cidr string"))
    assert [tuple(r) for r in nothing.collect()] == [(1, "1.1.1.1", None)]


def test_masks_are_worked_out_once_a_line(spark):
    """Conditions on masks must not be second evaluations of their patterns, which cost more than all else of these steps."""
    from driftline.operators.diff import align_numbers, lines_of, ticking_lines

    old, new = (spark.createDataFrame([(k, 0, f"{k} items of {n}") for k in range(3)], "k long, line_no int, line string") for n in (1, 2))
    masks = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(t.SIGNED)
    assert masks(ticking_lines(old, new, "k")) == 2 and masks(align_numbers(old, new, "k")) == 2
    assert lines_of(old.select("k", F.col("line").alias("text")), ["k"])._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_task_hands_on_differences_in_parts(spark):
    """However many rows a batch has, results are handed on after a bounded number of characters, and none is lost."""
    import pyarrow as pa

    from driftline.operators.diff import PART_CHARS, line_diff

    class Pairs:
        where = select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    n, line = 300, "x" * 10_000
    old, new = [f"{line}\n{k}" for k in range(n)], [None if k == 7 else f"{line}\n{k} now" for k in range(n)]
    parts = list(line_diff(Pairs())([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(old), pa.array(new)], ["key", "old", "new"])]))
    assert max(p.num_rows for p in parts) * 20_000 < PART_CHARS + 100_000
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["key"] for r in rows] == list(range(n)) and all(r["added"] == ([] if k == 7 else [f"{k} now"]) and r["removed"] == ([line, "7"] if k == 7 else [str(k)]) for k, r in enumerate(rows))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_page_diffs_shuffle_nothing(spark):
    """Alignment and diff once shuffled thirteen to fifteen times the input's bytes; both versions of a document come as one row."""
    from driftline.queries.text import QUERIES

    assert [exchanges(QUERIES[q](spark, "/root/testdata/sf0.001")) for q in ("d8_page_diff", "t6_align_numbers")] == [0, 0]


def test_tables_of_lines_and_pairs_are_aligned_alike(spark):
    """Random versions with repeated lines, lines without numbers, empty ones, and pages of one version only, against a walk over each page."""
    from driftline.operators.diff import align_numbers, align_pairs, diff_pairs, page_diff, paired

    rng = random.Random(7)
    words = ["{} items", "{} of 7", "a b", "", "{} items and {} more", "up {}%"]
    page = lambda: [rng.choice(words).format(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(9))]
    pages = {k: (page() if k % 9 else [], page() if k % 7 else []) for k in range(1, 120)}
    pages |= {200: (["x", ""], ["x"]), 201: (["3 items"] * 3, ["4 items", "5 items"]), 202: ([None, "3 items"], ["4 items"])}
    table = lambda side: spark.createDataFrame([(k, i, line) for k, p in pages.items() for i, line in enumerate(p[side])], "k long, line_no int, line string")
    every = sorted({line for p in pages.values() for side in p for line in side if line is not None})
    masks = {r.line: r.m for r in spark.createDataFrame([(x,) for x in every], "line string").select("line", t.mask_numbers(F.col("line")).alias("m")).collect()}

    def walked(old, new):
        free = [masks.get(x) if x not in old and masks.get(x) != x else None for x in new]
        out = []
        for line in old:
            at = free.index(masks[line]) if line is not None and line not in new and masks[line] != line and masks[line] in free else None
            out.append(line if at is None else new[at])
            if at is not None:
                free[at] = None
        return out

    want = {k: walked(*p) for k, p in pages.items()}
    old, new = table(0), table(1)
    got = align_numbers(old, new, "k")
    assert got.schema["line_no"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, i, line) for k, lines in want.items() for i, line in enumerate(lines)), key=repr)
    rows = spark.createDataFrame([(k, *p) for k, p in pages.items()] + [(300, None, ["a"]), (301, ["1 b"], None)], "k long, old array<string>, new array<string>")
    assert {r.k: r.old for r in align_pairs(rows, "k").collect()} == want | {300: [], 301: ["1 b"]}
    told = {r.k: r for r in page_diff(old, new, "k").collect()}
    whole = {k: ([x for x in want[k] if x is not None], p[1]) for k, p in pages.items()}
    assert set(told) == {k for k, (a, b) in whole.items() if a != b} and told[200].removed == [""]
    for k, r in told.items():
        ops = edit_script(*whole[k])
        assert (r.added, r.removed) == ([v for o, v in ops if o == "+"], [v for o, v in ops if o == "-"])
    assert {r.k: r for r in diff_pairs(paired(old, new, "k"), "k").collect()} == told


def test_aligned_rows_are_handed_on_in_parts():
    import pyarrow as pa

    from driftline.operators.diff import PART_CHARS, _aligned_batches

    n, same = 900, b"x" * 10_000
    columns = {"id": pa.array(range(n)), "old": [[same, b"%d of 3" % k] for k in range(n)], "new": [[b"%d of 4" % k] for k in range(n)], "gone": [[None, b"m"]] * n, "fresh": [[b"m"]] * n}
    parts = list(_aligned_batches([pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))]))
    assert max(p.num_rows for p in parts) * 10_000 < PART_CHARS + 20_000
    assert [r for p in parts for r in p.to_pylist()] == [{"id": k, "old": [same, b"%d of 4" % k]} for k in range(n)]
