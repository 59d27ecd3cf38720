"""Every query of the library against its SQL on the smallest supplied tables."""

import os

import duckdb
import pytest

from driftline.queries import collected

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = collected()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    cur = sql.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_whole_texts_are_decoded_and_collapsed(spark):
    long = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text) > 400}
    decoded = {r.doc_id: r.body_text for r in QUERIES["s2_decode_whole_bodies"](spark, SF).collect()}
    lines = {r.doc_id: r.one_line for r in QUERIES["t7_collapse_whole_text"](spark, SF).collect()}
    assert long and all(len(decoded[i]) == len(x) and len(lines[i].split()) == len(x.split()) for i, x in long.items())


def test_a_merge_touches_only_its_buckets(spark, tmp_path):
    """Only the folders of the updates' sites are read and written; a batch again, or late, changes nothing."""
    import glob

    from driftline.operators import tables

    schema, path = "site_id long, url string, at long, text string", f"{tmp_path}/pages"
    rows = [(s, f"u{k}", 10, "old") for s in range(200) for k in range(3)]
    tables.write_by_site(spark.createDataFrame(rows, schema), path, 16)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/site_bucket=*/*.parquet")}
    bucket = lambda ids: {r[0] for r in tables.with_bucket(spark.createDataFrame([(i,) for i in ids], "site_id long"), 16).select("site_bucket").collect()}
    before, sites = files(), spark.createDataFrame([(i,) for i in range(200)], "site_id long")
    updates = spark.createDataFrame([(3, "u0", 20, "new"), (3, "u9", 20, "added"), (5, "u1", 5, "late"), (999, "u0", 20, "gone")], schema)
    tables.merge_by_site(path, updates, sites, ["site_id", "url"], "at", 16)
    touched, after = bucket([3, 5, 999]), files()
    own = lambda f: int(f.split("site_bucket=")[1].split("/")[0])
    assert {f: t for f, t in before.items() if own(f) not in touched} == {f: t for f, t in after.items() if own(f) not in touched}
    want = sorted([r for r in rows if r != (3, "u0", 10, "old")] + [(3, "u0", 20, "new"), (3, "u9", 20, "added")])
    read = lambda: sorted(map(tuple, spark.read.parquet(path).drop("site_bucket").collect()))
    assert read() == want
    for again in (updates, spark.createDataFrame([(3, "u0", 15, "older")], schema)):
        tables.merge_sink(path, sites, ["site_id", "url"], "at", 16)(again, 0)
        assert read() == want
    plan = spark.read.parquet(path).where("site_bucket in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [site_bucket" in plan


def test_throttling_is_greedy(spark):
    """Against a plain walk: gaps of all sizes around the six hours, and a key with thousands of notices."""
    import random

    from pyspark.sql import functions as F

    from driftline.operators.status import throttled

    rng, rows, hour = random.Random(9), [], 3_600_000_000
    for key in range(30):
        t = rng.randrange(10**15, 2 * 10**15)
        for _ in range(rng.choice([1, 5, 40, 400])):
            rows.append((key, t))
            t += rng.choice([1, 6 * hour, 6 * hour - 1, 6 * hour + 1, rng.randrange(hour), rng.randrange(9 * hour), 100 * hour])
    want, last = [], {}
    for key, t in sorted(rows):
        if key not in last or t - last[key] >= 6 * hour:
            last[key] = t
            want.append((key, t))
    df = spark.createDataFrame(rows, "k long, t long").withColumn("at", F.timestamp_micros("t"))
    assert sorted((r.k, r.t) for r in throttled(df, ["k"], "at").collect()) == want


def test_addresses_of_any_key_are_looked_up(spark, tmp_path):
    """Keys whose product with both factors passes 64 bits, against integers of any size."""
    import ipaddress

    keys, suppliers = [0, 1, 15_000, 85_000, 86_001, 900_000, 2**31, 2**32 + 7, 5 * 10**15], [1, 77, 6_000, 4 * 10**9, 3 * 10**12]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    nets = {ipaddress.ip_network((k * 2654435761 % 2**32 >> (32 - bits) << (32 - bits), bits)) for k in suppliers for bits in (3, 9, 14, 17)}
    want = {}
    for k in keys:
        ip = ipaddress.ip_address(k * 40503 * 2654435761 % 2**32)
        own = [n for n in nets if ip in n]
        want[k] = ("::ffff:" * (k % 3 == 0) + str(ip), str(max(own, key=lambda n: n.prefixlen)) if own else None)
    assert {r.c_custkey: (r.address, r.range) for r in QUERIES["u14_longest_prefix"](spark, str(tmp_path)).collect()} == want


def test_a_short_page_of_events_has_its_cursor(spark, tmp_path):
    """A site with fewer events than a page holds: the cursor is that of the SQL, and nothing follows."""
    from driftline.operators.serve import history

    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id <> 8 or event_id % 7 = 0")
    few = events.where("user_id = 8").limit(3).unionByName(events.where("user_id <> 8"))
    few.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["a6_history"]).fetchall())
    assert 0 < len(want) < 20 and sorted(map(tuple, QUERIES["a6_history"](spark, str(tmp_path)).collect())) == want
    log = spark.createDataFrame([(1, k) for k in range(5)], "site_id long, event_id long")
    page = lambda before, limit: [(r.event_id, r.next_cursor, r.more) for r in history(log, 1, before, limit).orderBy("event_id").collect()]
    assert page(None, 3) == [(2, 2, True), (3, 2, True), (4, 2, True)] and page(2, 3) == [(0, 0, False), (1, 0, False)]


def most_rows(df) -> int:
    """The most rows that a step of the executed plan of a collected table made."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        found = max(found, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_sites_of_one_name_are_one_row_for_queries(spark):
    from driftline.operators.urls import resolve_site_reference

    sites = [(k, "Same" if k < 300 else f"Own {k}", f"http{'s' * (k % 2)}://h{k // 2}.example.com/") for k in range(1, 400)]
    asked = [(k, "same") for k in range(500)] + [(1000, " OWN 350 "), (1001, "7"), (1002, "https://h160.example.com"), (1003, "h161.example.com/"), (1004, "none"), (1005, None)]
    out = resolve_site_reference(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(sites, "site_id long, name string, start_url string"))
    assert sorted(map(tuple, out.collect())) == [(1000, 350), (1001, 7), (1002, 321), (1003, 323)]
    assert 1000 < most_rows(out) < 10_000


@pytest.mark.parametrize("name", ["s13_ingest_ct", "s13_salvaged_ct", "s15_ingest_http_probes"])
def test_rows_are_dealt_before_they_are_combined(spark, name):
    """Tasks that read a table, whose size is that of its files, hold no table of their rows."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan.split("Exchange ")[1]


@pytest.mark.parametrize("name", ["x3_visible_lines", "x8_snapshots_of_visible_lines"])
def test_lines_of_cut_references_and_missing_markup_are_as_in_sql(spark, tmp_path, name):
    """Headings that end within a reference, and pages without markup or a URL."""
    heads = ["a &quot", "a &quo", "a &amp", "a &am", "a &", "&lt", "b &gt c", "&#39", "&copy", "&middot d", "&ampquot; &amplt;", "&quot;&lt;b&gt; &amp;lt; &#39;x&#39; &copy; &middot;"]
    html = '<html><head><title>{0}</title></head><body><h1>{0}</h1><p>one <b>{0} two</b></p><footer>&copy; x</footer></body></html>'
    rows = [(k, f"https://a.com/{k}?b=1&c=2", html.format(x)) for k, x in enumerate(heads)]
    rows += [(100, "https://a.com/", None), (101, None, html.format("x")), (102, "https://a.com/", ""), (103, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == want
