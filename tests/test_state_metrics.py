"""Masking, responses, notices, state jobs, quotas: brute force and golden rows."""

import datetime as dt
import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pagetide.functions import masking as M
from pagetide.operators import metrics, notices, responses, state
from pagetide.sources import stores

T0 = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_masks(spark):
    key = "AIza" + "a" * 35
    text = f"{key} sk-{'b' * 48} Bot  {'c' * 59} https://discordapp.com/api/webhooks/1/x-y ab.cd@mail.example.com a@b.co 090-1234-5678 1234 5678 9012 3456 x090-1234-5678"
    assert one(spark, M.mask_text(F.lit(text))) == (
        "[API_KEY_MASKED] [API_KEY_MASKED] [API_KEY_MASKED] [WEBHOOK_MASKED] ab***@mail.example.com a***@b.co "
        "[PERSONAL_INFO_MASKED] [PERSONAL_INFO_MASKED] x090-1234-5678"
    )
    kept = one(spark, M.mask_text(F.lit(f"a {key} 090-1234-5678 {key}"), M.MaskOptions(keep_length=True)))
    assert kept == f"a {'*' * 39} {'*' * 13} {'*' * 39}"
    ids = one(spark, M.mask_text(F.lit("12345678901234567 1234567890123456 12345678901234567890"), M.MaskOptions(ids=True)))
    assert ids == "1234***4567 1234567890123456 12345678901234567890"
    assert one(spark, M.sanitise_error(F.lit("at /Users/me/x and C:\\Users\\me\\y"))) == "at /Users/[USER]/x and C:\\Users\\[USER]\\y"


def test_record_masking_walks_the_schema(spark):
    df = spark.createDataFrame(
        [((1, "a@bc.de", ["x@yy.zz"], {"apiKey": "s", "n": "q@rr.ss"}, (5,)),)],
        "r struct<id:int,note:string,lines:array<string>,m:map<string,string>,authInfo:struct<k:int>>",
    )
    r = df.select(M.mask_value(F.col("r"), df.schema["r"].dataType).alias("r")).first().r
    assert (r.id, r.note, r.lines, r.authInfo) == (1, "a***@bc.de", ["x***@yy.zz"], "[MASKED]")
    assert r.m == {"apiKey": "[MASKED]", "n": "q***@rr.ss"}


def test_setting_issues(spark):
    assert one(spark, M.setting_issues(F.lit("api_key"), F.lit("Test"))) == [
        "api_key appears to be too short for security", "api_key appears to be a test/demo key",
    ]
    assert one(spark, M.setting_issues(F.lit("level"), F.lit("test"))) == []


def test_responses_and_notices(spark):
    body = json.dumps({"summary": "s" * 1100, "keyChanges": ["a", 1, None, "b"], "newFeatures": "x", "skinContent": list("abcd")})
    rows = spark.createDataFrame(
        [("1", f"x\n```json\n{body}\n```\n"), ("2", "broken" * 100), ("3", "null"), ("4", '{"summary": 7}'), ("5", "[1]")],
        "version string, response string",
    )
    out = {r.version: r for r in responses.parse_responses(rows, "m", F.lit(T0)).collect()}
    assert out["1"].key_changes == ["a", "b"] and out["1"].new_features == [] and out["1"].important_bug_fixes == []
    assert out["2"].is_fallback and len(out["2"].summary) == 503 and out["2"].new_features is None
    assert out["3"].is_fallback and not out["4"].is_fallback and out["4"].summary == "" and out["5"].key_changes == []
    full = responses.parse_responses(rows, "m", F.lit(T0)).withColumns({
        "title": F.lit("T"), "url": F.lit("u"), "published_at": F.lit(T0), "image_url": F.lit("i"),
        "local_image_path": F.when(F.col("version") == "1", "p"),
    })
    payload = {r.version: json.loads(r.payload) for r in notices.outbox(full, "P", key="title").collect()}
    embed = payload["1"]["embeds"][0]
    assert embed["image"]["url"] == "attachment://patch_1.jpg" and embed["color"] == 0x00FF99
    fields = {f["name"]: f["value"] for f in embed["fields"]}
    assert fields[notices.SUMMARY_FIELD] == "s" * 1021 + "..." and fields[notices.CHANGES_FIELD] == "1. a\n\n2. b"
    assert fields["🎨 スキン・コンテンツ"] == "1. a\n\n2. b\n\n3. c"
    assert payload["4"]["embeds"][0]["image"]["url"] == "i"


def random_requests(seed, n=1500):
    """One key owns most rows, with dense spells, quiet gaps and equal times."""
    rng, rows = random.Random(seed), []
    clock = {k: T0 for k in "abc"}
    for i in range(n):
        k = rng.choice("aaaabc")
        clock[k] += dt.timedelta(seconds=rng.choice([0, 1, 30, 200, 200, 3600, 5400]) if rng.random() < 0.3 else rng.randint(1, 90))
        rows.append((i, k, clock[k]))
    rng.shuffle(rows)
    return rows


def test_rolling_counts_match_brute_force(spark):
    rows = random_requests(3)
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp_ntz")
    got = {r.event_id: r.in_window for r in metrics.rolling_counts(df, "k").collect()}
    by_key = defaultdict(list)
    for i, k, t in rows:
        by_key[k].append((t, i))
    for group in by_key.values():
        for t, i in group:
            assert got[i] == sum(t - dt.timedelta(hours=1) < u <= t for u, _ in group)


def test_change_feed_crosses_buckets(spark):
    rows, rng, t = [], random.Random(5), T0
    for i in range(800):
        t += dt.timedelta(hours=rng.choice([1, 5, 60]))
        rows.append((rng.choice("xxxxy"), i, t, rng.choice(["1", "2", None]), "u"))
    df = spark.createDataFrame(rows, "source string, id long, ts timestamp_ntz, version string, url string")
    got = {r.id for r in state.change_feed(df, ["source"], F.to_date("ts"), ["ts", "id"]).collect()}
    last, want = {}, set()
    for s, i, _, v, u in rows:
        if last.get(s, 0) != (v, u):
            want.add(i)
        last[s] = (v, u)
    assert got == want


def test_detection_uses_the_last_notice_only(spark):
    old = spark.createDataFrame([("s", "2", "/b"), ("n", None, None)], "source string, version string, url string")
    new = spark.createDataFrame([("s", "2", "/b"), ("s", "2", "/c"), ("s", "1", "/a"), ("n", "1", "/a"), ("z", "1", "/a")], "source string, version string, url string")
    assert sorted(map(tuple, state.new_releases(new, old).collect())) == [("n", "1", "/a"), ("s", "1", "/a"), ("s", "2", "/c"), ("z", "1", "/a")]


def test_stores(spark, tmp_path):
    path = str(tmp_path / "deep" / "records")
    schema = stores.RELEASE_SCHEMA
    assert stores.read_records(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("1.1/x", "t", "u", T0, "c", "", None), ("1.1/x", "t2", "u", T0 + dt.timedelta(1), "c", "", None), ("2", "t", "u", T0, None, None, None)], schema)
    stores.write_records(rows, path)
    assert stores.read_records(spark, path, schema).count() == 3
    store = str(tmp_path / "store")
    stores.write_releases(rows, store, F.lit(T0), "src")
    stores.write_releases(rows.where("version = '2'").withColumn("title", F.lit("new")), store, F.lit(T0), "src")
    back = {r.version: r for r in stores.read_store(spark, store).collect()}
    assert back["1.1/x"].title == "t2" and back["1.1/x"].version_key == "1.1_x" and back["2"].title == "new"
    stores.write_summaries(spark.createDataFrame([("1", "a", T0), ("1", "b", T0)], "version string, summary string, generated_at timestamp_ntz"), str(tmp_path / "sums"))
    assert [r.summary for r in stores.read_store(spark, str(tmp_path / "sums")).collect()] == ["b"]
    assert one(spark, state.backup_name(F.lit(T0))) == "state_backup_2024-01-01T00-00-00-000Z.json"


def test_bad_record_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"version": ')
    try:
        stores.read_records(spark, str(tmp_path / "bad.json"), stores.RELEASE_SCHEMA).collect()
    except Exception as err:
        assert "MALFORMED" in str(err) or "FAILFAST" in str(err)
    else:
        raise AssertionError("a malformed record must not pass")


def test_session_exports(spark, tmp_path):
    ops = spark.createDataFrame(
        [("s", "1", "dom_query", T0, 5.0, None), ("s", "2", "custom", T0, None, 'a "b", <c>')],
        "session_id string, op_id string, type string, ts timestamp_ntz, duration double, error string",
    )
    assert tuple(metrics.session_metrics(ops).select("total_operations", "successful", "failed", "mean_duration").first()) == (2, 1, 1, 5.0)
    out = str(tmp_path / "csv")
    stores.export_sessions(ops, out, "csv")
    back = spark.read.option("header", True).csv(out).orderBy("operation_id").collect()
    assert [r.success for r in back] == ["true", "false"] and back[1].error.startswith("a ")
    stores.export_sessions(ops, str(tmp_path / "json"))
    html = [r.html for r in stores.session_report(ops).orderBy("part", "order_key").collect()]
    assert "2 in all, 1 done, 1 failed" in html[0] and "<dd>none</dd>" in html[0] and "<dd>0 ms</dd>" in html[0]
    assert "&lt;c&gt;" in html[2] and html[3] == "</table></html>" and len(html) == 4
    visited = ops.withColumns({"url": F.when(F.col("op_id") == "2", F.lit("https://e.com/?a&b")), "ts": F.expr("ts + INTERVAL 2 SECONDS * cast(op_id AS int)")})
    head = stores.session_report(visited).where("part = 0").first().html
    assert "<dd>https://e.com/?a&amp;b</dd>" in head and "<dd>2000 ms</dd>" in head


def test_session_limits(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 2) for i in range(15)]
    df = spark.createDataFrame(rows, "session_id long, started timestamp_ntz, owner long")
    assert sorted(r.session_id for r in metrics.cap_sessions(df).collect()) == list(range(5, 15))
    assert metrics.cap_sessions(df, keep=3, by=["owner"]).count() == 6
    live = metrics.live_sessions(df, F.lit(T0 + dt.timedelta(minutes=40)).cast("timestamp_ntz"))
    assert sorted(r.session_id for r in live.collect()) == [10, 11, 12, 13, 14]
