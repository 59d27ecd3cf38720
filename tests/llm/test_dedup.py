import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from driftline.llm import line_dedup
from driftline.llm.grouping import components
from driftline.llm.jaccard_join import deduplicated, jaccard_classes
from driftline.llm.suffix_dedup import intervals, maximal_repeats, repeats_with_places, suffix_dedup

from .common import SCHEMA, documents, frame, words


def test_line_dedup_is_the_sql(spark):
    rng = random.Random(1)
    lines = [words(rng, 3) for _ in range(30)] + ["", " "]
    rows = []
    for i in range(80):
        a = rng.randrange(len(lines))
        rows.append((i, "\n".join([*(words(rng, 2) for _ in range(rng.randint(0, 2))), *lines[a : a + rng.randint(0, 12)], *(rng.choice(lines) for _ in range(rng.randint(0, 3)))]) if i % 13 else None, "en", "s", 1))
    got = line_dedup.line_dedup(frame(spark, rows)).select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "text")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    cur = con.execute(line_dedup.ORACLE_SQL)
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    want = sorted(tuple(r[i] for i in order) for r in cur.fetchall())
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[3] for r in want)


def test_line_dedup_keeps_rows_and_columns(spark):
    df = frame(spark)
    out = line_dedup.line_dedup(df).collect()
    assert len(out) == len(documents()) and set(df.columns) <= set(out[0].asDict())
    by = {r.doc_id: r for r in out if r.doc_id in (400, 401)}
    assert by[400].n_removed_chunks == 0 and by[401].n_removed_lines > 20 and "new first line" in by[401].text
    assert {r.text for r in out if r.doc_id == 500} == {""}
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_removal(texts, width=200):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                cover[i] += 1
                cover[i + width] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 3, 8192])
def test_suffix_dedup_is_brute_force(spark, most):
    rng = random.Random(most)
    rows = documents()
    parts = [words(rng, 60) for _ in range(4)]
    for i in range(40):  # passages that overlap, at many cuts, in many surroundings
        p = rng.choice(parts)
        a = rng.randrange(0, 100)
        rows.append((600 + i, words(rng, rng.randint(0, 20)) + p[a : a + rng.randint(150, 320)] + words(rng, rng.randint(0, 20)), "en", "s", 1))
    rows += [(700, "ab" * 400, "en", "s", 1), (701, "=" * 700, "en", "s", 1), (702, "x" * 199, "en", "s", 1), (703, "y" * 200, "en", "s", 1), (704, "é" * 150, "en", "s", 1)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), most).collect()))
    want = sorted((r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, plain_removal([(r[1] or "").encode() for r in rows]), strict=True))
    assert got == want
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_maximal_repeats_are_brute_force():
    """Strings over two letters around an anchor, against all pairs: what two have in common on both sides, and who else has it."""
    rng = random.Random(17)
    for _ in range(150):
        pairs = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode(), "".join(rng.choice("ab") for _ in range(rng.randint(3, 8))).encode()) for _ in range(rng.randint(2, 9))})
        if len(pairs) < 2:
            continue
        before, after = [x for x, _ in pairs], [y for _, y in pairs]
        same = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        want = set()
        for (b1, a1), (b2, a2) in itertools.combinations(pairs, 2):
            left, right = same(b1, b2), same(a1, a2)
            if right and left + right >= 6:
                want.add((left, right, tuple(sorted(k for k in range(len(pairs)) if before[k][:left] == b1[:left] and len(before[k]) >= left and after[k][:right] == a1[:right] and len(after[k]) >= right))))
        got = {(left, right, tuple(sorted(m))) for left, right, m in maximal_repeats(before, after, 6)}
        assert got == want


def test_repeats_have_all_their_places(spark):
    rng = random.Random(18)
    passage, other = words(rng, 100)[:300], words(rng, 100)[:260]
    rows = [(i, f"{words(rng, 9)} {passage} {words(rng, 9)}") for i in range(5)] + [(9, f"{words(rng, 5)}|{other}|{words(rng, 5)}|{other}|{words(rng, 5)}")]
    docs = spark.createDataFrame([(i, i, t.encode()) for i, t in rows], "doc_id long, text_hash long, text binary")
    text, places = dict(rows), defaultdict(set)
    for r in repeats_with_places(docs).collect():
        places[r.group, r.length].add((r.doc_id, r.start))
    assert places and all(length >= 200 for _, length in places)
    for (_, length), where in places.items():
        found = {text[d][s : s + length] for d, s in where}
        assert len(found) == 1 and len(where) > 1
        piece = found.pop()
        assert where == {(d, s) for d, t in rows for s in range(len(t)) if t.startswith(piece, s)}


def test_interval_tree():
    found = set(intervals([1, 3, 3, 0, 2]))
    assert found == {(3, 1, 3, 1), (1, 0, 3, 0), (2, 4, 5, 0)}


def shingles(text):
    w = re.findall(r"[^ \t\n\v\f\r]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_documents(rows, bar=0.8):
    """(doc_id, text) -> (number of links, documents that links lead to), over all pairs."""
    sets = {r[:2]: shingles(r[1]) for r in rows}
    links, group = Counter(), {x: {x} for x in sets}
    for x, y in itertools.combinations(sets, 2):
        if sets[x] and sets[y] and len(sets[x] & sets[y]) >= bar * len(sets[x] | sets[y]):
            links[x] += 1
            links[y] += 1
            if group[x] is not group[y]:
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    return links, group


def plain_classes(rows, bar=0.8):
    """The same by doc_id, for rows of which each has its own."""
    links, group = plain_documents(rows, bar)
    return Counter({k[0]: n for k, n in links.items()}), {k[0]: min((x[0] for x in g if x[0] is not None), default=None) for k, g in group.items()}


def test_jaccard_join_is_brute_force(spark):
    rows = documents() + [(None, documents()[1][1], "en", "s", 1)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, rows)).collect())
    links, group = plain_documents(rows)
    least = lambda g: min((x[0] for x in g if x[0] is not None), default=None)
    assert got == Counter((r[0], least(group[r[:2]]), links[r[:2]]) for r in rows) and sum(links.values()) > 500


def test_jaccard_recall_on_supplied_tables(spark):
    """All links of the documents of the small supplied table, against brute force by common shingles."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no table")
    docs = spark.read.parquet(str(path))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets, by = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, x in sets.items():
        for k in x:
            by[k].append(i)
    common = Counter(p for x in by.values() for p in itertools.combinations(x, 2))
    want = Counter(i for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) for i in (a, b))
    got = {r.doc_id: r.n_links for r in jaccard_classes(docs).collect()}
    assert all(got[i] <= want[i] for i in got)
    print("recall", sum(got.values()) / sum(want.values()))
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0


def test_jaccard_join_of_a_large_group(spark):
    """More near copies than a bucket compares or, with small blocks, than a block holds."""
    from driftline.llm import jaccard_join as j

    rng = random.Random(5)
    base = words(rng, 150).split()
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = words(rng, 1) + str(i)
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, words(rng, 40), "en", "s", 1) for i in range(50)]
    old, j.BLOCK_SETS = j.BLOCK_SETS, 64
    try:
        got = {r.doc_id: r for r in jaccard_classes(frame(spark, rows)).collect()}
    finally:
        j.BLOCK_SETS = old
    links, root = plain_classes(rows)
    missed = sum(abs(got[i].n_links - links[i]) for i in root)
    assert missed <= 0.002 * sum(links.values()) and sum(got[i].class_id != root[i] for i in root) == 0


def test_deduplicated(spark):
    a, b, c = (words(random.Random(k), 40) for k in "abc")
    rows = documents() + [(5000, a, "x", "s", 1), (5001, a, "x", "s", 1), (5001, b, "x", "s", 1), (5002, c, "x", "s", 1)]
    rows += [(None, a, "x", "s", 1), (None, words(random.Random("d"), 40), "x", "s", 2), (None, words(random.Random("d"), 40), "x", "s", 1)]
    df = frame(spark, rows)
    out = deduplicated(df)
    assert out.columns == df.columns
    _, group = plain_documents(rows)
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(kept.values()) == 1 and {*kept} <= {*group}
    for members in group.values():
        own = [x for x in members if x in kept]
        assert len(own) == 1 and own[0][0] == min((x[0] for x in members if x[0] is not None), default=None)
    assert {(5000, a), (5001, b), (5002, c)} <= {*kept} and (5001, a) not in kept and (None, a) not in kept
    assert jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0 and deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(edges, "a long, b long"), 1)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_an_entry_is_one_row_however_many_repeats_hold_it(spark):
    """Passages that lie in each other: rows grow with the entries, not with the members of all repeats."""
    from pyspark.sql import functions as F

    from driftline.llm.suffix_dedup import repeat_groups

    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    base = letters(700)
    rows = [(k, letters(50) + base[200 - 3 * k : 420 + 4 * k] + letters(50)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("text"))
    every, few = repeat_groups(docs).count(), repeat_groups(docs, widest=True)
    entries = few.select("doc_id", "text_hash", "at").distinct().count()
    assert few.count() <= 2 * entries < every / 2
