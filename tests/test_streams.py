"""Streams over several drops equal the batch jobs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagetide.operators import state
from pagetide.sources.versions import VersionedTable
from pagetide.streaming import jobs, keyed

T0 = dt.datetime(2024, 1, 1)


def drops(spark, tmp_path, batches, schema):
    folder = str(tmp_path / "drops")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(start):
    start.awaitTermination()


FEED = "source string, id long, ts timestamp_ntz, version string, url string"


def snapshots():
    rows = [("s" if i % 3 else "t", i, T0 + dt.timedelta(hours=i), None if i % 11 == 5 else str(i // 4 % 3), "u" if i % 13 else None) for i in range(90)]
    return rows + [(None, 100 + i, T0 + dt.timedelta(hours=90 + i), str(i // 2), "u") for i in range(6)] + [("s", 200, T0 + dt.timedelta(hours=95), "1", "u")] * 2


def test_change_feed_over_drops_and_restarts_equals_the_batch(spark, tmp_path):
    rows, out, checkpoint = snapshots(), str(tmp_path / "feed"), str(tmp_path / "c")
    for part in (rows[:30], rows[30:32], rows[32:70], rows[70:]):  # each run goes on from the state of the one before
        folder = drops(spark, tmp_path, [part], FEED)
        stream = jobs.file_stream(spark, folder, per_trigger=1)
        run(jobs.run_change_feed(stream, "source", F.to_date("ts"), ["ts", "id"], ["version", "url"], out, checkpoint))
    got = spark.read.parquet(out).select("source", "id", "ts", "version", "url").collect()
    want = state.change_feed(spark.read.parquet(folder), ["source"], F.to_date("ts"), ["ts", "id"]).select("source", "id", "ts", "version", "url").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "drops", "feed"]  # no folder of last values
    last = {r.key.source: r.value.value for r in keyed.read_state(spark, checkpoint, "last").collect()}
    newest = {r[0]: f'{{"version":"{r[3]}","url":"{r[4]}"}}' for r in sorted(rows, key=lambda r: r[2])}
    assert last == newest


def test_change_feed_forgets_idle_keys(spark, tmp_path):
    folder = drops(spark, tmp_path, [snapshots()[:30]], FEED)
    args = ("source", F.to_date("ts"), ["ts", "id"], ["version"], str(tmp_path / "feed"), str(tmp_path / "c"), 1)
    run(jobs.run_change_feed(jobs.file_stream(spark, folder), *args))
    drops(spark, tmp_path, [[("s", 999, T0 + dt.timedelta(hours=999), "0", "u"), ("s", 998, T0 + dt.timedelta(hours=998), "0", "u")]], FEED)
    run(jobs.run_change_feed(jobs.file_stream(spark, folder), *args))
    assert 998 in {r.id for r in spark.read.parquet(str(tmp_path / "feed")).collect()}  # the value before is gone, so this counts as new


SENT = "source string, version string, title string, url string, published_at timestamp_ntz, sent_at timestamp_ntz"
OLD = "source string, version string, title string, url string, published_at timestamp_ntz, last_notification timestamp_ntz, total long"


def test_state_merge_writes_deltas_and_replays_safely(spark, tmp_path):
    times = [T0 + dt.timedelta(hours=i) for i in range(60)]
    rows = [("s" if i % 3 else "t", str(i), "x", "u", t, t) for i, t in enumerate(times)]
    folder = drops(spark, tmp_path, [rows[:20], rows[20:35], rows[35:]], SENT)
    stream = jobs.file_stream(spark, folder, per_trigger=1)
    initial = spark.createDataFrame([(f"old{i}", "0", "x", "u", T0, T0, 7) for i in range(50)] + [("s", "0", "x", "u", T0, T0, 5)], OLD)
    out = str(tmp_path / "st")
    run(jobs.run_state_merge(stream, initial, out, str(tmp_path / "c"), deltas=100))
    table = VersionedTable(spark, out, "source")
    final = {r.source: (r.total, r.version) for r in table.read().collect()}
    assert final["s"] == (45, "59") and final["t"] == (20, "57") and final["old3"] == (7, "0") and len(final) == 52
    assert spark.read.parquet(out + "/data/*/*").count() == 51 + 3 * 2  # each batch wrote its own keys
    # A checkpoint that lost its commits replays all batches; the table has them already.
    run(jobs.run_state_merge(stream, initial, out, str(tmp_path / "again"), deltas=100))
    assert {r.source: (r.total, r.version) for r in table.read().collect()} == final
    table.compact(0)
    table.clean()
    assert {r.source: (r.total, r.version) for r in table.read().collect()} == final and spark.read.parquet(out + "/data/*/*").count() == 52


def test_counted_and_late_rows_are_all_rows(spark, tmp_path):
    schema = "k string, ts timestamp"
    minutes = [[0, 10, 70, 300], [5, 310, 250, 239], [9, 600, None], [1, 599, 660], []]
    out, late = str(tmp_path / "out"), str(tmp_path / "late")
    every = []
    for drop in minutes:
        folder = drops(spark, tmp_path, [[("ab"[m % 2] if m else None, m if m is None else T0 + dt.timedelta(minutes=m)) for m in drop]], schema)
        every += drop
        run(jobs.run_late_ledger(jobs.file_stream(spark, folder), "k", out, late, str(tmp_path / "c")))
    counted = {(r.k, r.window_start): r.n for r in jobs.counted_windows(spark, out).collect()}
    ledger = [(None if r.ts is None else (r.ts - T0).total_seconds() / 60, r.delay_ms and r.delay_ms / 60000) for r in spark.read.parquet(late).collect()]
    # Watermarks: none, 240, 250, 540, 600 minutes. A row is late if its hour had ended by then.
    assert sorted(ledger, key=str) == sorted([(5, 235), (239, 1), (9, 241), (None, None), (1, 539)], key=str)
    assert sum(counted.values()) + len(ledger) == len(every)
    assert counted[("b", T0 + dt.timedelta(hours=9))] == 1 and counted[("a", T0 + dt.timedelta(hours=5))] == 2


def test_sessions_keep_open_ones_only_and_append_closed_ones_once(spark, tmp_path):
    schema, rng = "k string, ts timestamp, error string", random.Random(4)
    busy = [("busy", T0 + dt.timedelta(seconds=20 * i), "x" if i % 50 == 0 else "") for i in range(3000)]  # one session of 17 hours
    gaps = [("tie", T0 + dt.timedelta(minutes=30 * i), None) for i in range(6)] + [("tie", T0 + dt.timedelta(minutes=200, microseconds=1), None)]
    rest = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(1200)), rng.choice(["", "x"])) for _ in range(150)]
    rows = sorted(busy + gaps + rest, key=lambda r: r[1])
    cuts = [0, 500, 501, 1700, 2500, len(rows)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        rng.shuffle(part)
        folder = drops(spark, tmp_path, [part], schema)
        run(jobs.run_sessions(jobs.file_stream(spark, folder, per_trigger=1), "k", out, checkpoint))
    names = ["k", "started", "expires", "total_operations", "failed"]
    closed, still = spark.read.parquet(out), keyed.open_sessions(spark, checkpoint)
    newest = rows[-1][1]
    assert closed.count() and not closed.where("late").count() and closed.where(F.col("expires") > newest - dt.timedelta(hours=1)).count() == 0
    assert 0 < still.count() < 8 and still.where(F.col("expires") < newest - dt.timedelta(hours=1)).count() == 0
    want = jobs.operation_sessions(spark.read.parquet(folder), "k").select(names)
    got = closed.select(names).unionByName(still.select(names))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # A row behind a session that has ended is shown as late and changes nothing.
    drops(spark, tmp_path, [[("a", T0 + dt.timedelta(seconds=1), "x")]], schema)
    run(jobs.run_sessions(jobs.file_stream(spark, folder, per_trigger=1), "k", out, checkpoint))
    late = spark.read.parquet(out).where("late").collect()
    assert [(r.k, r.total_operations, r.failed) for r in late] == [("a", 1, 1)]
    assert spark.read.parquet(out).where("not late").count() + keyed.open_sessions(spark, checkpoint).count() == want.count()


def test_a_key_with_many_open_sessions_has_one_timer(spark, tmp_path):
    schema = "k string, ts timestamp, error string"
    rows = [(k, T0 + dt.timedelta(minutes=31 * i, seconds=j), "x" if i % 7 == 0 else None) for k in ("a", "b", None) for i in range(60) for j in (0, 5)]
    folder, out, checkpoint = drops(spark, tmp_path, [rows], schema), str(tmp_path / "out"), str(tmp_path / "c")
    run(jobs.run_sessions(jobs.file_stream(spark, folder), "k", out, checkpoint, lateness="10 days"))
    still = keyed.open_sessions(spark, checkpoint)
    assert still.count() == 180 and spark.read.parquet(out).count() == 0
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(checkpoint)
    assert timers.count() == 3
    # The timer gives out all sessions that have ended and leaves one for the next.
    drops(spark, tmp_path, [[("a", T0 + dt.timedelta(days=10, hours=10), "x")]], schema)
    run(jobs.run_sessions(jobs.file_stream(spark, folder), "k", out, checkpoint, lateness="10 days"))
    closed, still = spark.read.parquet(out), keyed.open_sessions(spark, checkpoint)
    names = ["k", "started", "expires", "total_operations", "failed"]
    assert 0 < closed.count() < 180 and closed.count() + still.count() == 181 and not closed.where("late").count()
    assert still.where("k = 'b'").agg(F.min("expires")).first()[0] > T0 + dt.timedelta(hours=10)
    want = jobs.operation_sessions(spark.read.parquet(folder), "k").select(names)
    assert sorted(map(repr, closed.unionByName(still, allowMissingColumns=True).select(names).collect())) == sorted(map(repr, want.collect()))
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(checkpoint)
    assert timers.count() == 3


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "k string, ts timestamp"
    on_time = [("a", T0 + dt.timedelta(minutes=m)) for m in (0, 10, 300)]
    late = [("a", T0 + dt.timedelta(minutes=5)), ("a", T0 + dt.timedelta(minutes=600))]
    # A row is late against the watermark of the batch before its own.
    between = [("a", T0 + dt.timedelta(minutes=310))]
    folder = drops(spark, tmp_path, [on_time, between, late], schema)
    stream = jobs.file_stream(spark, folder, per_trigger=1)
    windows = jobs.request_windows(stream, "k", slide=None)
    jobs.write_stream(windows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r.window_start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (T0, 2) in got and (T0, 3) not in got


def test_first_seen_differs_from_change_feed(spark, tmp_path):
    schema = "version string, url string, ts timestamp"
    folder = drops(spark, tmp_path, [[("A", "u", T0), ("B", "u", T0 + dt.timedelta(minutes=1))], [("A", "u", T0 + dt.timedelta(minutes=2))]], schema)
    rows = jobs.first_seen(jobs.file_stream(spark, folder, per_trigger=1), ["version", "url"])
    jobs.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.version for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]


def test_open_windows_are_there_after_several_drops(spark, tmp_path):
    schema = "k string, ts timestamp, error string"
    rows = [("ab"[i % 2], T0 + dt.timedelta(minutes=7 * i), "x" if i % 5 == 0 else "") for i in range(60)]
    folder = drops(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], schema)
    stream = jobs.file_stream(spark, folder, per_trigger=1)
    batch = spark.read.parquet(folder)
    for slide in (None, "30 minutes"):
        out = str(tmp_path / f"w{slide}")
        jobs.write_updates(jobs.request_windows(stream, "k", slide=slide), out, out + "-c").awaitTermination()
        want = jobs.request_windows(batch, "k", slide=slide)
        assert sorted(jobs.latest(spark, out, ["k", "window_start"]).select(want.columns).collect()) == sorted(want.collect())


def test_a_single_file_streams_alone(spark, tmp_path):
    folder = drops(spark, tmp_path, [[("a", T0)], [("b", T0)]], "k string, ts timestamp")
    one = sorted(p for p in (tmp_path / "drops").iterdir() if p.suffix == ".parquet")[0]
    out = str(tmp_path / "o")
    jobs.write_stream(jobs.file_stream(spark, str(one)), out, out + "-c").awaitTermination()
    assert spark.read.parquet(out).count() == 1 and spark.read.parquet(folder).count() == 2
