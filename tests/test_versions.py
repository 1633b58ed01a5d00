"""Versioned tables, the stores on them, and the quarantine reader."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pagetide.sources import stores
from pagetide.sources.versions import VersionedTable, touched_buckets

T0 = dt.datetime(2024, 1, 1)
ROW = "k string, n long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def state(df):
    return {r.k: r.n for r in df.collect()}


def data_rows(table):
    return table.spark.read.parquet(table._at("data").toString() + "/*/*").count()


def test_upserts_write_their_own_keys_and_the_newest_row_wins(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    assert table.read().count() == 0 and table.newest() is None and table.clean() == 0 and table.compact() is None
    many = [(f"k{i}", i) for i in range(200)]
    assert table.upsert(rows(spark, *many), "2024-01-01") == 1
    table.upsert(rows(spark, ("k1", -1), ("new", 7)), "2024-01-02")
    table.upsert(rows(spark, ("k1", -2)).withColumn("more", F.lit("x")), "2024-01-03")
    assert data_rows(table) == 203  # a write holds its own keys only
    want = dict(many) | {"k1": -2, "new": 7}
    assert state(table.read()) == want and {r.more for r in table.read().where("k in ('k1', 'k2')").collect()} == {"x", None}
    assert state(table.read(as_of="2024-01-02")) == want | {"k1": -1} and state(table.read(version=1)) == dict(many)
    assert table.read(as_of="2023").count() == 0
    own = touched_buckets(table, rows(spark, ("k1", 0)))
    assert len(own) == 1 and state(table.read(buckets=own))["k1"] == -2 and table.read(buckets=own).count() < 150


def test_compaction_restore_and_cleanup(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=4)
    for i in range(4):
        table.upsert(rows(spark, *[(f"k{j}", 10 * i + j) for j in range(i, 12)]), f"2024-01-0{i + 1}")
    before = state(table.read())
    assert "Exchange" in table.read()._jdf.queryExecution().executedPlan().toString()
    assert table.compact(deltas=2) == 5 and state(table.read()) == before
    assert "Exchange" not in table.read()._jdf.queryExecution().executedPlan().toString()  # folded buckets need no merge
    assert table.compact(deltas=2) is None
    assert state(table.read(as_of="2024-01-01")) == {f"k{j}": j for j in range(12)}
    assert table.restore(1, "2024-01-09") == 6 and state(table.read()) == {f"k{j}": j for j in range(12)}
    table.upsert(rows(spark, ("k0", 5)))
    assert state(table.read())["k0"] == 5 and state(table.read(version=4)) == before
    assert table.clean(keep=1) > 0
    assert table.versions() == [7] and state(table.read()) == {f"k{j}": j for j in range(12)} | {"k0": 5}
    table.compact(deltas=0)
    table.clean()
    assert data_rows(table) == 12 and len(os.listdir(tmp_path / "t" / "data")) == 1
    assert not [n for n in os.listdir(tmp_path / "t" / "versions") if "_draft" in n]


def test_removed_keys_replayed_batches_and_two_writers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    table.upsert(rows(spark, ("a", 1), ("b", 2), (None, 3)), batch=0)
    assert table.upsert(rows(spark, ("a", 100)), batch=0) == 1 and state(table.read()) == {"a": 1, "b": 2, None: 3}
    table.upsert(rows(spark, ("c", 3)), batch=1, removed=rows(spark, ("a", 0)))
    assert state(table.read()) == {"b": 2, None: 3, "c": 3}
    table.compact(deltas=0)
    assert state(table.read()) == {"b": 2, None: 3, "c": 3}
    table.upsert(rows(spark).limit(0), batch=2)
    assert state(table.read()) == {"b": 2, None: 3, "c": 3}
    made = table.newest()
    with pytest.raises(RuntimeError):
        table._commit(made)  # the number is taken
    assert table.newest() == made


def test_a_failed_write_is_never_seen_and_is_cleaned(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    table.upsert(rows(spark, ("a", 1)), batch=0)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda made: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(rows(spark, ("a", 2)), batch=1)
    assert state(table.read()) == {"a": 1} and len(os.listdir(tmp_path / "t" / "data")) == 2
    table.upsert(rows(spark, ("a", 2)), batch=1)
    table.clean()
    assert state(table.read()) == {"a": 2}


def test_stores_leave_nothing_behind_and_keep_older_versions(spark, tmp_path):
    path = str(tmp_path / "sums")
    schema = "version string, summary string, generated_at timestamp_ntz"
    for day, text in enumerate("abc"):
        stores.write_summaries(spark.createDataFrame([("1/x", text, T0 + dt.timedelta(day)), (str(day), "s", T0)], schema), path, f"2024-01-0{day + 1}")
    assert {r.version_key: r.summary for r in stores.read_store(spark, path).collect()} == {"1_x": "c", "0": "s", "1": "s", "2": "s"}
    assert {r.version_key: r.summary for r in stores.read_store(spark, path, as_of="2024-01-02").collect()} == {"1_x": "b", "0": "s", "1": "s"}
    assert sorted(os.listdir(path)) == ["data", "versions"]
    stores.store_table(spark, path).clean()
    assert stores.read_store(spark, path).count() == 4 and stores.store_table(spark, path).versions() == [3]


def test_state_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "source string, version string, total long"
    days = {"2024-01-01": [("a", "1", 1), ("b", "1", 1)], "2024-01-02": [("a", "2", 2), ("b", "1", 1)], "2024-01-03": [("a", "2", 2), ("c", "1", 1)]}
    for day, data in days.items():
        stores.snapshot_state(spark.createDataFrame(data, schema), path, day)
    assert spark.read.parquet(path + "/data/*/*").count() == 5  # 2, 1 changed, 1 new and 1 gone
    for day, data in days.items():
        assert sorted(map(tuple, stores.state_as_of(spark, path, day + "T12").collect())) == data
    assert sorted(map(tuple, stores.restore_state(spark, path, "2024-01-01").collect())) == days["2024-01-01"]
    assert sorted(map(tuple, stores.state_as_of(spark, path, "2024-01-03").collect())) == days["2024-01-01"]
    with pytest.raises(ValueError):
        stores.restore_state(spark, path, "2023")


def test_bad_records_go_to_quarantine(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("total", T.LongType())])
    good = [{"version": "1", "total": 1}, {"version": "2"}, {"version": "3", "total": 3, "extra": [1]}]
    bad = {'{"version": ': "malformed", '["x"]': "malformed", '"text"': "malformed", '{"version": "4", "total": "many"}': "malformed",
           '{"total": 5}': "missing version", '{"version": null, "total": 6}': "missing version"}
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([*map(json.dumps, good), "", "  ", *bad]))
    (folder / "b.json").write_text('{"version": "9", "total": 9}\n{"version": \n')
    where = str(tmp_path / "quarantine")
    for _ in range(2):  # reading a drop again adds nothing
        got = stores.ingest_records(spark, str(folder), schema, where, ["version"])
        assert sorted(map(tuple, got.collect())) == [("1", 1), ("2", None), ("3", 3), ("9", 9)]
    kept = VersionedTable(spark, where, "record_id").read().collect()
    assert sorted((r.line, r.reason) for r in kept) == sorted([*bad.items(), ('{"version": ', "malformed")])
    assert {os.path.basename(r.file) for r in kept} == {"a.json", "b.json"}
    one, none = stores.checked_records(spark, str(tmp_path / "nothing"), schema, ["version"])
    assert one.count() == none.count() == 0 and one.columns == ["version", "total"]
