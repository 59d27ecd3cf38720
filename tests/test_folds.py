"""Folds: single rules, and a stream replayed in batches against the table form."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.queries.base import fetch
from driftline.queries.streams import fold_log
from driftline.streaming import folds, windows
from driftline.streaming.state import fold_stream

SF = "/root/testdata/sf0.001"
MIN = 60_000


def play(kind, rows, until=None):
    state, out = {}, []
    for at, status, hash_, mask in rows:
        out += folds.walk(kind, state, {"at": int(at * MIN), "status": status, "blocked": status == 403, "hash": hash_, "mask": mask})
    out += folds.rest(kind, state, until * MIN) if until else []
    return [(k, a // MIN) for a, k, _ in out]


def page(*rows, until=None):
    return play(folds.PAGES, [(at, 200 if h else st, h or None, (h or "")[:1]) for at, h, st in ((*r, 200)[:3] for r in rows)], until)


def test_confirmed_and_transient():
    assert page((0, "a1"), (10, "b1"), (20, "b1")) == [("text", 20)]
    assert page((0, "a1"), (10, "b1"), (20, "a1")) == [("transient", 20)]
    assert page((0, "a1"), (10, None, 503), (20, "a1")) == []


def test_numbers_are_held_and_learned():
    assert page((0, "a1"), (10, "a2"), (11, "a2"), (13, "a2")) == [("number", 13)]
    rows = [(0, "a1"), (1, "a2"), (2, "a2"), (4, "a2"), (10, "a3"), (11, "a3"), (14, "a3"), (20, "a4"), (21, "a4")]
    assert page(*rows)[-1] == ("learned", 21)
    assert page(*rows, (30, "a5"), (31, "a5"), (40, "b6"), (41, "b6"))[-2:] == [("learned", 21), ("text", 41)]  # what is learned doesn't count


def test_numbers_that_differ_between_two_loads_tick():
    assert page((0, "a1"), (10, "a2"), (11, "a3"), (20, "a4"), (21, "a4")) == [("learned", 11)]
    assert page((0, "a1"), (10, "a2"), (14, "a3"), (20, "a4")) == []  # too far apart to tell


def lines(at, *texts):
    """A page of several lines, each two characters: a word and a number."""
    return {"at": at * MIN, "status": 200, "blocked": False, "hash": None, "mask": None, "lines": [hash(x) for x in texts], "masks": [hash(x[0]) for x in texts]}


def test_only_learned_lines_are_masked():
    """Of two lines that tick, the one that ticked is learned; a number that moves on the other is still told."""
    state, out = {}, []
    for row in [lines(0, "a1", "b1", "c1"), lines(10, "a2", "b1", "c1"), lines(11, "a3", "b1", "c1"), lines(20, "a9", "b1", "c1"), lines(30, "a4", "b2", "c1"), lines(31, "a5", "b2", "c1"), lines(34, "a6", "b2", "c1")]:
        out += folds.walk(folds.PAGES, state, row)
    assert [(k, at // MIN) for at, k, _ in out] == [("learned", 11), ("number", 34)]
    assert out[0][2] == str(hash("a")) and state["learned"] == [hash("a")]


def test_learned_lines_are_the_newest():
    assert folds.learn([1, 2, 3], [2, 4], 3) == [3, 2, 4] and folds.learn(None, [1, 2, 3, 4], 3) == [2, 3, 4]
    known = folds.learn(list(range(200)), [5, 200])
    assert len(known) == 200 and known[-2:] == [5, 200] and 0 not in known


def test_unstable_becomes_dynamic_and_is_trusted_again():
    rows = [(0, "a1"), (1, "b1"), (2, "c1"), (3, "d1"), (4, "e1")]
    assert page(*rows) == [("dynamic", 4)]
    assert page(*rows, (5, "f1"), (6 + 24 * 60, "f1")) == [("dynamic", 4), ("trusted", 5 + 24 * 60)]
    assert page(*rows, until=5 + 24 * 60) == [("dynamic", 4), ("trusted", 4 + 24 * 60)] and page(*rows, until=4 + 24 * 60) == [("dynamic", 4)]


def test_churn_mutes():
    rows = [(0, "a1")]
    for k, h in enumerate("bcde"):
        rows += [(1 + 2 * k, h + "1"), (2 + 2 * k, h + "1")]
    assert page(*rows) == [("text", 2), ("text", 4), ("text", 6), ("muted", 8)]


def test_flip_flop_is_silent():
    assert page((0, "a1"), (100, "b1"), (101, "b1"), (110, "a1"), (111, "a1")) == [("text", 101)]


def test_removed_twice_missing():
    assert page((0, "a1"), (5, None, 404), (10, None, 404), (20, "a1")) == [("removed", 10), ("back", 20)]
    assert page((5, None, 404), (10, None, 404)) == []
    assert play(folds.PAGES, [(0, 200, "a", "a"), (5, 404, None, ""), (5.5, 404, None, ""), (8, 404, None, "")]) == [("removed", 8)]


def test_outage_thresholds():
    rows = [(0, 200), (1, 503), (2, 403), (3, 0), (3.2, 429), (4, 502), (9, 404)]
    assert play(folds.OUTAGES, [(a, s, None, None) for a, s in rows]) == [("down", 4), ("up", 9)]
    assert play(folds.OUTAGES, [(a, 503, None, None) for a in (0, 0.1, 0.2)]) == []


def replayed(spark, tmp_path, batches, keys, kind, late, **more):
    """What a stream of these batches (tables with `at`) tells, and the watermark it ends with."""
    for k, part in enumerate(batches):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
    out, schema = [], batches[0].schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*").withColumn("ts", F.timestamp_millis("at"))
    query = fold_stream(source, keys, kind, "ts", late, **more).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return sorted(out)


@pytest.mark.parametrize("keys,kind", [(["site_id", "url"], folds.PAGES), (["site_id"], folds.OUTAGES), (["site_id"], folds.DEPLOYS)])
def test_stream_in_any_order_replays_the_table(spark, tmp_path, keys, kind):
    """Batches by time, rows of which come a batch too late (within the bound) and shuffled: the same events as the table's up to the
    watermark, in the same moments."""
    log = fold_log(fetch(spark, SF)).select(*keys, "at", "event_id", "status", "blocked", "hash", "mask").cache()
    first, last = log.agg(F.min("at"), F.max("at")).first()
    parts, late = 4, 8 * 24 * 60 * MIN
    own = F.least(F.floor((F.col("at") - first) * parts / (last - first + 1)), F.lit(parts - 1)).cast("int")
    moved = F.least(own + F.when(F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0, 1).otherwise(0), F.lit(parts - 1))
    batches = [log.where(moved == k).orderBy(F.xxhash64("event_id", F.lit(k))) for k in range(parts)]
    assert all(b.count() for b in batches)
    got = replayed(spark, tmp_path, batches, keys, kind, "8 days")
    assert got == sorted(map(tuple, folds.fold(log, keys, kind, until=last - late).collect())) and got


def test_lines_and_forgetting_on_a_stream(spark, tmp_path):
    """Learned lines are in the store with the rest of a page's state; what isn't seen for a day is forgotten, in the table as in the stream."""
    rng, rows, minute = random.Random(4), [], 0
    for k in range(240):
        minute += rng.choice([1, 1, 1, 2, 9, 30])
        minute += 26 * 60 if k % 60 == 59 else 0
        page_id = rng.randrange(3)
        texts = [f"a{k if rng.random() < 0.5 else 7}", f"b{k // 40}", rng.choice("cccd") + "0"]
        rows.append((page_id, minute * MIN, k, rng.choice([200, 200, 200, 200, 404, 503]), False, None, None, [hash(x) for x in texts], [hash(x[0]) for x in texts]))
    rows.append((99, (minute + 10 * 24 * 60) * MIN, 999, 200, False, None, None, [1], [1]))
    schema = "site_id long, at long, event_id long, status int, blocked boolean, hash string, mask string, lines array<long>, masks array<long>"
    batches = [spark.createDataFrame(rows[k : k + 60], schema) for k in range(0, len(rows), 60)]
    day = 24 * 60 * MIN
    got = replayed(spark, tmp_path, batches, ["site_id"], folds.PAGES, "2 hours", forget_ms=day)
    log = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, folds.fold(log, ["site_id"], folds.PAGES, until=rows[-1][1] - 120 * MIN, forget_ms=day).collect()))
    assert got == want and {"learned", "text"} <= {r[2] for r in got}
    assert want != sorted(map(tuple, folds.fold(log, ["site_id"], folds.PAGES, until=rows[-1][1] - 120 * MIN).collect()))


def test_windows_on_a_stream(spark, tmp_path):
    log = fetch(spark, SF).select("event_id", "site_id", "url", F.col("fetched_at").alias("at"), "status")
    log.unionByName(log.where("event_id % 4 = 0")).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    counts = []
    for k, df in enumerate([windows.dedup_observations(source, ["site_id", "url", "at"], late="40 days"), windows.change_rates(source, late="1 hour"), windows.outage_sessions(source, late="1 hour")]):
        n = []
        df.writeStream.outputMode("append").foreachBatch(lambda b, _, n=n: n.append(b.count())).option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start().awaitTermination(120)
        counts.append(sum(n))
    assert counts[0] == log.dropDuplicates(["site_id", "url", "at"]).count()
    assert 0 < counts[1] and 0 < counts[2]


def test_sink_is_idempotent(spark, tmp_path):
    got = []
    write = windows.notify_sink(str(tmp_path), lambda b: got.append(b.count()))
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "event_id long, kind string")
    write(batch, 0)
    write(batch, 0)
    assert got == [2, 2] and spark.read.parquet(f"{tmp_path}/batch=0").count() == 2


def test_timers_ring_and_late_rows_are_folded_in_order(spark, tmp_path):
    """A number change is told at the look after its time, a muted page is trusted without another row of it, and rows that come late, but not
    too late, count as if they had come in time."""
    base = 1_750_000_020_000
    minute = lambda m: base + m * MIN
    day = 24 * 60
    rows = {1: [(0, "a1"), (10, "a2"), (11, "a2"), (14, "a2")], 2: [(0, "a1"), (1, "b1"), (2, "c1"), (3, "d1"), (4, "e1")], 3: [(0, "a1"), (10, "b1"), (20, "b1")], 9: [(0, "z1"), (2 * day, "z1"), (2 * day + 60, "z1")]}
    late = {(3, 10)}
    every = [(k, minute(at), n, 200, False, h, h[0]) for k, own in rows.items() for n, (at, h) in enumerate(own)]
    batches = [[r for r in every if r[1] < minute(60) and (r[0], (r[1] - base) // MIN) not in late], [r for r in every if (r[0], (r[1] - base) // MIN) in late], [r for r in every if r[1] == minute(2 * day)], [r for r in every if r[1] > minute(2 * day)]]
    schema = "site_id long, at long, event_id long, status int, blocked boolean, hash string, mask string"
    got = replayed(spark, tmp_path, [spark.createDataFrame(part, schema) for part in batches], ["site_id"], folds.PAGES, "1 hour")
    assert [(k, (at - base) // MIN, kind) for k, at, kind, _ in got] == [(1, 14, "number"), (2, 4, "dynamic"), (2, 4 + day, "trusted"), (3, 20, "text")]


def test_late_rows_of_a_stream_are_put_aside(spark, tmp_path):
    """All rows behind the batches before them by the bound, and no others, are in the side table; the rest is folded in order."""
    rng, schema = random.Random(3), "event_id long, at long"
    parts = [[(100 * k + i, (k * 60 + rng.randrange(60) - (200 if rng.random() < 0.2 else 0)) * MIN) for i in range(40)] for k in range(4)]
    want, top = set(), None
    for part in parts:
        want |= {i for i, at in part if top is not None and at <= top - 90 * MIN}
        top = max(at for _, at in part) if top is None else max(top, *(at for _, at in part))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = source.writeStream.foreachBatch(windows.divide_late(f"{tmp_path}/out", "at", 90 * MIN)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    ids = lambda part: [r.event_id for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/{part}").collect()]
    assert sorted(ids("late")) == sorted(want) and want and sorted(ids("late") + ids("in_time")) == sorted(i for part in parts for i, _ in part)
