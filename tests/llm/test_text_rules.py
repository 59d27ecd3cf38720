import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from driftline.llm import chat
from driftline.llm import decontamination
from driftline.llm.decontamination import decontaminated, leaks, smith_waterman
from driftline.llm.main_text import best_region, extracted, learned, main_text
from driftline.llm.arrays import span_hashes
from driftline.llm.quality import _buckets, best_threshold, labelled_sample, quality

from .common import SCHEMA, documents, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(4)
    rows = documents()
    rows += [(800 + i, " ".join(f"{words(rng, 1)}{rng.choice(['***', '%%%', '###'])}" for _ in range(60)), "en", "s", 1) for i in range(40)]
    rows += [(900, "a b c d e f g h i\n" * 6 + words(rng, 10), "en", "s", 1), (901, "# | x\n\n# | x\n \n" * 9, "en", "s", 1)]
    rows += [(1000 + i, words(rng, 80), "en", "s", 1) for i in range(80)]
    labels = [(i, 1, 0) for i in range(60)] + [(1000 + i, 1, 0) for i in range(60)] + [(800 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, None), (99999, 1, 0)]
    got = quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *plain_stats(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    junk = [r.kept for r in got if r.doc_id is not None and 800 <= r.doc_id < 840]
    good = [r.kept for r in got if r.doc_id is not None and r.doc_id >= 1000]
    assert sum(junk) <= 2 and sum(good) >= 78


def test_quality_verdict_is_the_plain_ratio(spark):
    """Scores from counts of whole n-grams in their buckets, one document after the other, and the threshold by trying all cuts. Ids
    above 2**53 beside null ones."""
    rng, big = random.Random(14), 1 << 60
    rows = [(big + i, words(rng, 60), "en", "s", 1) for i in range(60)] + [(None, words(rng, 50), "en", "s", 1)]
    rows += [(big + 100 + i, " ".join(f"{words(rng, 1)}{rng.choice(['%%', '##'])}" for _ in range(40)), "en", "s", 1) for i in range(30)]
    labels = [(big + i, 1, 0) for i in range(40)] + [(big + 100 + i, 0, 0) for i in range(15)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r for r in quality(frame(spark, rows), labelled).collect()}

    def buckets(text):
        data = text.encode()
        array = np.frombuffer(data, np.uint8)
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        word = span_hashes(array, np.array([a for a, _ in at]), np.array([z for _, z in at]))
        return Counter(_buckets(word, np.zeros(len(word), np.int64))[0].tolist())

    good = labelled_sample(labelled, 1)
    held_out, trusted = {int(x) for x in good[3::4]}, {int(x) for k, x in enumerate(good) if k % 4 != 3}
    each = [(r[0], buckets(r[1])) for r in rows]
    corpus = sum((b for _, b in each), Counter())
    own = sum((b for i, b in each if i in trusted), Counter())
    size, n_corpus, n_own = 1 << 16, sum(corpus.values()), sum(own.values())
    p = lambda k: (corpus[k] + 1) / (n_corpus + size)
    ratio = lambda k: np.log((own[k] + size * p(k)) / (n_own + size)) - np.log(p(k))
    scores = [sum(n * ratio(k) for k, n in b.items()) / sum(b.values()) for _, b in each]
    for (i, text, *_), score in zip(rows, scores, strict=True):
        assert got[i, len(text.split())].score == pytest.approx(score)
    by = dict(zip([r[0] for r in rows], scores, strict=True))
    kept, bad = [by[i] for i in held_out], [by[i] for i, q, _ in labels if not q]
    cost = lambda cut: 10 * np.mean([x < cut for x in kept]) + np.mean([x >= cut for x in bad])
    cuts = [x.score for x in got.values() if x.kept]
    assert cost(min(cuts)) == min(cost(c) for c in [*scores, max(scores) + 1])
    assert all(x.kept == (x.score >= min(cuts)) for x in got.values() if not x.base_failed)


def test_toxic_documents_are_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 1), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(labelled_sample(labels, 1)) == [1, 3] and list(labelled_sample(labels, 0)) == [4]
    assert sorted(labelled_sample(labels.drop("toxic"), 1)) == [1, 2, 3]


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality(frame(spark), none).collect())
    assert quality(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_threshold():
    assert best_threshold(np.array([1.0, 2.0]), np.array([-1.0, 0.0])) == pytest.approx(0.5)
    assert best_threshold(np.array([]), np.array([1.0])) == -np.inf
    assert best_threshold(np.array([3.0, 1.0]), np.array([])) == 1.0


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_smith_waterman():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))]) for _ in range(2))
        score, equal, a0, a1, b0, b1 = smith_waterman(a, b)
        assert score == plain_alignment(a, b) and equal <= min(a1 - a0, b1 - b0)


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(18, 60)).capitalize() + ".") for i in range(30)] + [(30, None), (31, ""), (None, words(rng, 25)), (32, "two words"), (33, "the of and")]
    rows = [(i, words(rng, 200), "en", "s", 1) for i in range(150)]
    leaked = {}
    for i in range(40):
        item = items[i % 30]
        w = item[1].split()
        if i >= 20:  # an edit per eight words: replaced, left out or put in
            for _ in range(len(w) // 8):
                k, kind = rng.randrange(len(w)), rng.randrange(3)
                w[k : k + (kind != 2)] = [] if kind == 1 else [words(rng, 1)]
        leaked[1000 + i] = item[0]
        rows.append((1000 + i, f"{words(rng, 50)} {' '.join(w).upper() if i % 2 else ' '.join(w)}\n{words(rng, 50)}", "en", "s", 1))
    rows += [(2000 + i, items[3][1] + " " + words(rng, 30), "en", "hot", 1) for i in range(120)]  # leaked so often that it isn't rare any more
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (None, items[5][1], "en", "s", 1), (3002, words(rng, 20_000) + " " + items[7][1], "en", "s", 1)]
    benchmark = spark.createDataFrame([(*x, "doc_id") for x in items], "item_id long, text string, doc_id string")
    got = leaks(frame(spark, rows), benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {*leaked.items()} <= found
    assert {(2000 + i, 3) for i in range(120)} | {(None, 5), (3002, 7)} <= found
    assert not {d for d, _ in found if d is not None and d < 1000}
    clean = decontaminated(frame(spark, rows), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [*range(150), 3000, 3001]
    assert leaks(spark.createDataFrame([], SCHEMA), benchmark).count() == 0
    assert leaks(frame(spark, rows), benchmark.limit(0)).count() == 0


def places(spark, docs, item):
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rng = random.Random(60)
    rows = [(i, f"{words(rng, 70)} {d} {words(rng, 70)}", "en", "s", 1) for i, d in enumerate(docs)]
    out = [[] for _ in docs]
    for r in leaks(frame(spark, rows), benchmark).collect():
        out[r.doc_id].append((r.item_from, r.item_to))
    return [sorted(x) for x in out]


def test_leaks_of_parts_and_of_copies_in_a_row(spark):
    """Two ends of an item around other words, without its middle, and copies back to back: each place is reported."""
    w = [f"w{i}" for i in range(59)]
    ends, halves = [(0, 18), (41, 59)], " ".join
    changed = halves(w[:18] + [f"x{i}" for i in range(23)] + w[41:])
    got = places(spark, [changed, halves(w[:18] + w[41:]), halves(w[:18]), halves(w * 3), halves(w[:18] + w[:18]), halves(w[:10])], halves(w))
    assert got == [ends, ends, [(0, 18)], [(0, 59)] * 3, [(0, 18)] * 2, []]


def test_leaks_of_common_words(spark):
    """A passage of an item whose words are common in the corpus is found as in a small corpus."""
    rng = random.Random(61)
    common = [words(rng, 1) for _ in range(8)]
    part = [rng.choice(common) for _ in range(12)]
    item = " ".join([*part, *(f"w{i}" for i in range(24))])
    rows = [(0, f"{' '.join(f'a{i}' for i in range(40))} {' '.join(part)} {' '.join(f'b{i}' for i in range(40))}", "en", "s", 1)]
    rows += [(1 + i, " ".join(f"{rng.choice(common)} c{rng.randrange(9)}" for _ in range(400)), "en", "s", 1) for i in range(100)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for corpus in (rows[:1], rows):
        assert [(r.doc_id, r.doc_from, r.doc_to, r.item_from, r.item_to) for r in leaks(frame(spark, corpus), benchmark).collect()] == [(0, 40, 52, 0, 12)]


def test_leaks_are_brute_force(spark):
    """Every document against every item: whole tables of the alignment, no seeds."""
    rng = random.Random(62)
    items = [(i, words(rng, rng.randint(9, 50))) for i in range(25)]
    rows = []
    for i in range(80):
        w = items[rng.randrange(25)][1].split()
        a = rng.randrange(len(w))
        w = w[a : a + rng.randint(3, 50)]
        for _ in range(rng.choice([0, 0, 1, len(w) // 6, len(w) // 3])):
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            w[k : k + (kind != 2)] = ([] if kind == 1 else [words(rng, 1)]) or ([] if len(w) > 1 else ["x"])
        rows.append((i, f"{words(rng, rng.randint(0, 40))} {' '.join(w)} {words(rng, rng.randint(0, 40))}".strip(), "en", "s", 1))
    got = leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    number = {w: k for k, w in enumerate({w for x in [*items, *rows] for w in x[1].split()})}
    split = lambda x: np.array([number[w] for w in x.split()])
    passes = lambda score, equal, span, m: equal >= 8 and score >= span and (span >= 0.3 * m or equal >= 24)
    for doc, text, *_ in rows:
        for item, own in items:
            score, equal, _, _, b0, b1 = smith_waterman(split(text), split(own))
            if passes(score, equal, b1 - b0, len(own.split())):
                assert (doc, item) in found
    for r in got:
        a, b = split(rows[r.doc_id][1])[r.doc_from : r.doc_to], split(items[r.item_id][1])[r.item_from : r.item_to]
        assert plain_alignment(a, b) >= r.score and passes(r.score, r.equal_words, len(b), r.item_words) and r.item_words == len(items[r.item_id][1].split())
    assert len(found) > 30


def test_a_copy_elsewhere_hides_no_edited_leak(spark):
    """Items with every fourth word changed are found alone, beside a copy word for word, and in a corpus full of the item's other words."""
    rng = random.Random(71)
    item = [f"q{i}" for i in range(60)]
    edited = [" ".join(w if k % 4 != (i % 4) else f"e{i}x{k}" for k, w in enumerate(item)) for i in range(20)]
    rows = [(i, f"{words(rng, 20)} {x} {words(rng, 20)}", "en", "s", 1) for i, x in enumerate(edited)]
    more = [(100, " ".join(item), "en", "s", 1)]
    flood = [(200 + i, " ".join(f"{a} {b} {c} {words(rng, 2)}" for a, b, c in zip(item, item[1:], item[2:], strict=False)), "en", "s", 1) for i in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for corpus in (rows, rows + more, rows + more + flood):
        assert {r.doc_id for r in leaks(frame(spark, corpus), benchmark).collect()} >= {r[0] for r in rows}


def test_shared_wording_makes_no_pairs(spark):
    """Documents and items that all have one opening: rows grow with the documents, and what leaks beside the opening is found."""
    rng = random.Random(72)
    opening = "which of the following is the best answer to this question about"
    sizes = []
    for n in (40, 80, 160):
        items = [(i, f"{opening} {' '.join(f'i{i}w{k}' for k in range(50))}") for i in range(n)]
        rows = [(i, f"{words(rng, 10)} {opening} {' '.join(f'd{i}w{k}' for k in range(30))}", "en", "s", 1) for i in range(n)]
        rows += [(1000 + i, f"{opening} {words(rng, 20)} {' '.join(items[i][1].split()[20:50])}", "en", "s", 1) for i in range(0, n, 5)]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        docs = decontamination._lower(frame(spark, rows), "doc_id")
        seeds = decontamination._seeds(decontamination._item_grams(decontamination._items(benchmark)))
        sizes.append(decontamination._hits(docs, seeds).join(seeds, "gram").count())
        got = {(r.doc_id, r.item_id) for r in leaks(frame(spark, rows), benchmark).collect()}
        assert {(1000 + i, i) for i in range(0, n, 5)} <= got and {d for d, _ in got} == {1000 + i for i in range(0, n, 5)}
    assert sizes[2] < 2.3 * sizes[1] < 2.3**2 * sizes[0]


def test_wording_that_counts_is_found_once(spark):
    """A passage that many items share and that is a leak by itself: every document that has it is told, for the shortest item that has it."""
    rng = random.Random(73)
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{passage} {' '.join(f'i{i}w{k}' for k in range(10 + i))}") for i in range(40)]
    rows = [(i, f"{words(rng, 15)} {passage if i % 2 else words(rng, 30)} {words(rng, 15)}", "en", "s", 1) for i in range(60)]
    got = leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 0) for i in range(1, 60, 2)} and len(got) == 30


def test_recall_on_the_supplied_tables(spark):
    """All documents against all items by the whole alignment, on supplied tables."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    listed = lambda df, key: [(r[0], np.frombuffer(text, np.uint8)) for r in decontamination._lower(df, key).collect() for text in [r[1].encode()]]
    split = lambda text: decontamination._words(text, np.array([0, len(text)]))[0]
    all_items = [(i, split(x)) for i, x in listed(items, "item_id")]
    want = set()
    for doc, text in listed(docs, "doc_id"):
        whole = split(text)
        parts = [whole[k : k + 600] for k in range(0, max(1, len(whole) - 200), 400)]
        for part in parts:
            likely = decontamination._likely([part] * len(all_items), [w for _, w in all_items])
            want |= {(doc, i) for (i, w), yes in zip(all_items, likely, strict=True) if yes and any(True for _ in decontamination._places(part, w))}
    assert len(want) > 10 and want == found


def test_leaks_of_short_and_quoted_items(spark):
    """Signs of any script part words; an item of a word or two is no leak in running text, a short one has to be whole."""
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(0, f"he said “{ten}” and went", "en", "s", 1), (1, "said “Yes” and yes", "en", "s", 1), (2, "¡Yes!", "en", "s", 1), (3, "so it—goes on—and", "en", "s", 1), (4, "so it goes — on", "en", "s", 1), (5, "東京。大阪、京都。奈良", "xx", "s", 1)]
    benchmark = spark.createDataFrame([(0, ten.title()), (1, "Yes"), (2, "it goes on"), (3, "it went on"), (4, "大阪 京都 奈良")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_from, r.doc_to) for r in leaks(frame(spark, rows), benchmark).collect()}
    assert got == {(0, 0, 2, 12), (2, 1, 0, 1), (3, 2, 1, 4), (4, 2, 1, 4), (5, 4, 1, 4)}


def test_leaks_of_a_long_item(spark, monkeypatch):
    """An item of thousands of words: rows of the alignment's table are kept in part only."""
    rng = random.Random(63)
    item = words(rng, 2500).split()
    rows = [(0, f"{words(rng, 300)} {' '.join(item[:900] + item[940:])} {words(rng, 30)}", "en", "s", 1), (1, words(rng, 3000), "en", "s", 1)]
    got = leaks(frame(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [0] and got[0].equal_words == 2460 and (got[0].item_from, got[0].item_to) == (0, 2500)


def test_decontaminated_judges_rows_by_text(spark):
    rng = random.Random(64)
    item = words(rng, 30)
    rows = [(1, words(rng, 40)), (1, f"x {item}"), (None, f"y {item}"), (None, words(rng, 40)), (None, None), (2, words(rng, 40)), (2, item)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows])
    out = decontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


W = " ".join(["alpha beta gamma"] * 15)
PAGES = [
    (f'<body><div class="topnav"><a href="#">Home</a><a>News</a></div><div id="page"><div class="article-content"><h1>Title here</h1><p>{W}</p><ul><li><a href="x">one link</a></li><li>two</li></ul><div class="ad-slot">Buy now</div><p>{W} &eacute;t&eacute; x&nbsp;y</p></div><div class="sidebar-right"><p>{W}</p></div><div id="comments"><div class="comment"><p>{W}</p></div></div></div><footer>c</footer></body>', f"Title here {W} one link two {W} été x y"),
    (f"<header><h1>Site</h1><nav><a>a</a></nav></header><main><h1>T</h1><p>{W}</p><form><label>Name</label><input></form><p>{W}</p></main><aside><p>{W}</p></aside><footer><p>{W}</p></footer>", f"T {W} {W}"),
    (f'<div class="cookie-banner">We use cookies {W}</div><article><p>Short <b>te</b>xt</p></article><section class="comments"><p>{W}</p></section>', "Short text"),
    (f"<nav><ul><li><a>x</a></li></ul></nav><article><h1>H</h1><p><b>Open bold<br><p>{W}</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --></article>", f"H Open bold {W}"),
    ("", ""), (None, ""), ("<nav><a>x</a></nav>", ""), ("plain text only", "plain text only"), ("<<<>>> a < b", "<<<>>> a < b"), (f"<p>{W}", W),
]


ARTICLE = [f"<h1>Title here</h1><p>{W}</p><p>{W} more</p>", f"Title here {W} {W} more"]
MORE_PAGES = [
    # what an element has or stands in isn't what it is
    (f'<body class="single has-sidebar"><nav><a>x</a></nav>{ARTICLE[0]}<aside>{W}</aside></body>', ARTICLE[1]),
    (f'<body class="sidebar-left"><div class="content">{ARTICLE[0]}</div></body>', ARTICLE[1]),
    (f'<article class="post tag-login category-search">{ARTICLE[0]}</article>', ARTICLE[1]),
    (f'<article><h2 class="section-header">Part one</h2><p>{W}</p><figure class="header-image"><img><figcaption>A caption of it</figcaption></figure><p>{W}</p></article>', f"Part one {W} A caption of it {W}"),
    (f'<form id="whole"><div class="menu"><a>a</a></div><article>{ARTICLE[0]}</article></form>', ARTICLE[1]),
    (f'<div class="sidebar-layout"><div id="content">{ARTICLE[0]}</div><div class="sidebar"><p>{W}</p></div></div>', ARTICLE[1]),
    # names of boilerplate, also longer than the article
    (f'<div class="gdpr-consent"><p>{W}</p></div><article>{ARTICLE[0]}</article><div class="taboola"><a>{W}</a></div>', ARTICLE[1]),
    (f'<main>{ARTICLE[0]}</main><div class="discussion"><p>{W * 5}</p></div><div class="commentList"><article class="comment-body"><p>{W * 5}</p></article></div>', ARTICLE[1]),
    (f'<article>{ARTICLE[0]}<section class="comments"><article><p>{W * 9}</p></article></section></article>', ARTICLE[1]),
    (f'<article><h1>T</h1><div class="ad"><p>{W}</p></div><p>{W}</p><form><label>Mail</label></form><div class="newsletter-signup">{W}</div><p>{W}</p></article>', f"T {W} {W}"),
    (f'<article><header><h1>T</h1><p>by one</p></header><p>{W}</p><footer>rights</footer></article>', f"T by one {W}"),
]


def test_main_text_of_marks():
    for page, want in MORE_PAGES:
        assert main_text(page) == want, page.replace(W, "W")


def test_best_region_is_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        blocks = [(rng.choice([-3, -1, 0.5, 2, 4]), rng.choice([0, 0.2, 1, 2.5])) for _ in range(rng.randint(0, 12))]
        total = lambda a, z, b=blocks: sum(x for x, _ in b[a:z]) - sum(c for _, c in b[a + 1 : z])
        every = [(total(a, z), a, z) for a in range(len(blocks)) for z in range(a + 1, len(blocks) + 1)]
        first, end = best_region(blocks)
        most = max([x for x, _, _ in every], default=0)
        assert (total(first, end) if end else 0) == pytest.approx(max(most, 0))


def test_main_text(spark):
    for page, want in PAGES:
        assert main_text(page) == want
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extracted(df).collect()}
    assert all(got[i].text == want and got[i].n_chars == len(want) and got[i].url == f"u{i}" for i, (_, want) in enumerate(PAGES)) and got[None].text == "a"
    assert extracted(df.limit(0)).count() == 0


def test_main_text_is_linear():
    import time

    began = time.process_time()
    for part in ("<div>", "<p a='", "<", "<b ", "<script>", "<!--", "<li>x", '<a href="x', "</p>", "&amp"):
        main_text(part * 50_000)
    assert time.process_time() - began < 15
    assert learned().tags["article"] > 0 > learned().tags["nav"]


def test_preference_pairs_are_the_sql(spark):
    rng = random.Random(8)
    rows = []
    for c in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", words(rng, 3) if c % 7 else "same words"))
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "equal"), (51, 0, "user", "q"), (51, 1, "assistant", "equal"), (60, 0, "user", "only"), (61, 0, "assistant", "reply")]
    rows += [(70, 0, None, None), (70, 1, "assistant", None), (71, 0, "system", ""), (71, 1, "assistant", "é\U0001f600"), (50, 0, "user", "q"), (72, None, "assistant", "x"), (73, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = chat.preference_format(chat.reply_pairs(df))
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(chat.ORACLE_SQL)
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())
    by = {r.pair_id: r for r in got.collect()}
    assert by[50].status == "identical" and by[50].chosen == "" and by[60].status == "one_sided"
    assert chat.preference_format(chat.reply_pairs(df.limit(0))).count() == 0


def test_preference_prefix_of_any_pair(spark):
    a, b, c = {"role": "user", "text": "q"}, {"role": "assistant", "text": "r"}, {"role": "assistant", "text": "s"}
    pairs = spark.createDataFrame([(1, [a, b, a, b], [a, b, a, c]), (2, [a], [a, b]), (3, None, [a, b]), (4, [], []), (5, [b], [c])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r.pair_id: r for r in chat.preference_format(pairs).collect()}
    assert [got[k].prefix_turns for k in range(1, 6)] == [3, 1, 0, 0, 0]
    assert got[1].prompt.count("<|end|>") == 3 and got[1].chosen == "<|assistant|>\nr<|end|>\n" and got[1].chosen_segments == "0:14,1:9"
    assert sum(int(s.split(":")[1]) for s in got[3].rejected_segments.split(",")) == len(got[3].rejected)
