"""Streams with keyed state: change feed and operation sessions.

Both work in two levels within one query. First the rows of a trigger are grouped by key and
time bucket, so that a key which owns a large share of all rows is spread over tasks, and each
group is reduced to its changes or to fragments of sessions (many keys and buckets in one call). Then one small row per group
meets the state of its key in the state store (RocksDB): the last value, or the open sessions.
No folder holds state; replays and restarts are the checkpoint's.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Changed rows that need no state are spread over so many groups per key.
LANES = 64
SESSION_GAP_SECONDS, SESSION_SLOT_SECONDS = 1800, 3600
#: Keys and slots of a trigger are cut into session fragments in so many groups, each in one vectorised call.
FRAGMENT_LANES = 4096


@contextmanager
def keyed_state(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """Start queries with the state store that keyed state needs; the session's own settings come back after.

    State that the clock drops asks for batches without data over and over, so that a run over the files
    at hand would never end; ``idle_batches=False`` leaves those out.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if not idle_batches:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """Rows (key, value or list_element, partition_id) of a state variable after the last finished batch."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


# ---- change feed -----------------------------------------------------------
class LastValue(StatefulProcessor):
    """Settles the first row of each bucket against the value the key had before; other rows pass."""

    def __init__(self, columns: list[str], order: list[str], ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "value string", self.ttl_ms)

    def _shown(self, row: Row) -> Row:
        return Row(**{c: row[c] for c in self.columns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1]:
            for row in rows:
                yield self._shown(row)
            return
        before = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order]):
            if row["_value"] != before:
                yield self._shown(row)
            before = row["_after"]
        self.last.update((before,))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, bucket: Column, order: list[str], values: list[str], ttl_ms: int | None = None) -> DataFrame:
    """Rows whose values differ from those of the row before them, by key in the given order.

    Every batch is expected to come after the one before it, as files are dropped. A task holds the rows
    of one key, bucket and trigger; the state is one value per key, forgotten after ``ttl_ms`` without a row.
    """
    columns = list(dict.fromkeys([key, *order, *values]))
    rows = stream.select(*columns, bucket.alias("_bucket"), F.to_json(F.struct(*values)).alias("_value"))
    kept = [rows.schema[c] for c in columns]
    extra = [T.StructField("_value", T.StringType()), T.StructField("_after", T.StringType()), T.StructField("_lane", T.IntegerType())]

    def first_and_changed(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start"))
        value = table.column("_value").combine_chunks()
        n = len(value)
        keep = np.r_[0, 1 + np.flatnonzero(pc.not_equal(value.slice(1), value.slice(0, n - 1)).to_numpy(zero_copy_only=False))]
        lane = np.r_[0, 1 + np.arange(len(keep) - 1) % LANES].astype(np.int32)
        out = table.select([*columns, "_value"]).take(keep)
        return out.append_column("_after", pa.array([value[-1].as_py()] * len(keep), pa.string())).append_column("_lane", pa.array(lane))

    borders = rows.groupBy(key, "_bucket").applyInArrow(first_and_changed, T.StructType([*kept, *extra]))
    mode = "ProcessingTime" if ttl_ms else "None"  # state is dropped by the clock
    return borders.groupBy(key, "_lane").transformWithState(LastValue(columns, order, ttl_ms), T.StructType(kept), "Append", mode)


# ---- sessions --------------------------------------------------------------
FRAGMENT = "started long, last long, total_operations long, failed long"
MICROS = 1_000_000


class OpenSessions(StatefulProcessor):
    """Joins fragments to the key's open sessions; a session leaves when the watermark passes its quiet gap."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getListState("open", FRAGMENT)

    def _shown(self, key, session, late: bool) -> Row:
        started, last, total, failed = session
        return Row(**{self.key: key[0], "started": started, "expires": last + self.gap, "total_operations": total, "failed": failed, "late": late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for row in rows:
            part = (row["started"], row["last"], row["total_operations"], row["failed"])
            if part[1] + self.gap <= now and not any(a <= part[1] + self.gap and part[0] <= b + self.gap for a, b, *_ in parts):
                yield self._shown(key, part, True)
            else:
                parts.append(part)
        joined: list[tuple] = []
        for part in sorted(parts):
            if joined and part[0] <= joined[-1][1] + self.gap:
                a, b, n, bad = joined[-1]
                joined[-1] = (a, max(b, part[1]), n + part[2], bad + part[3])
            else:
                joined.append(part)
        if joined:
            self._keep(joined)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = timerValues.getCurrentWatermarkInMs() * 1000, []
        for part in sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []:
            if part[1] + self.gap <= now:
                yield self._shown(key, part, False)
            else:
                left.append(part)
        self._keep(left) if left else self.open.clear()

    def _keep(self, sessions: list[tuple]) -> None:
        """One timer, for the session that ends first; it gives out all that have ended and sets the next."""
        self.open.put(sessions)
        self.handle.registerTimer(-(-(min(last for _, last, *_ in sessions) + self.gap) // 1000))

    def close(self) -> None:
        pass


def closed_sessions(
    stream: DataFrame, key: str, ts: str = "ts", gap_seconds: int = SESSION_GAP_SECONDS, lateness: str = "1 hour",
    slot_seconds: int = SESSION_SLOT_SECONDS,
) -> DataFrame:
    """Sessions that ended, each once: key, started, expires, total_operations, failed, late.

    A session takes every row not later than the gap behind its last one. ``late`` marks what came after
    its session had ended; it is given out alone and never changes a session. ``open_sessions`` has the rest.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    failed = F.coalesce(F.col("error") != "", F.lit(False)).cast("long")
    rows = stream.select(key, micros.alias("at"), failed.alias("failed"), F.floor(micros / (slot_seconds * MICROS)).alias("_slot"))
    rows = rows.withColumn("_lane", F.pmod(F.xxhash64(key, "_slot"), F.lit(FRAGMENT_LANES)))
    gap, own = gap_seconds * MICROS, rows.schema[key]

    def fragments(table):
        """Runs of rows within the gap, for every key and slot of a lane."""
        import numpy as np
        import pyarrow as pa

        names = table.column(key).combine_chunks()
        code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
        at, bad, slot = (table.column(c).to_numpy() for c in ("at", "failed", "_slot"))
        turn = np.lexsort((at, slot, code))
        code, at, bad, slot = code[turn], at[turn], bad[turn], slot[turn]
        cuts = np.r_[0, 1 + np.flatnonzero((np.diff(code) != 0) | (np.diff(slot) != 0) | (np.diff(at) > gap))]
        ends = np.r_[cuts[1:], len(at)]
        return pa.table({
            key: names.take(pa.array(turn[cuts])), "started": at[cuts], "last": at[ends - 1],
            "total_operations": ends - cuts, "failed": np.add.reduceat(bad, cuts)})

    parts = T.StructType([own, *T.StructType.fromDDL(FRAGMENT)])
    clocked = (
        rows.where("at is not null").groupBy("_lane").applyInArrow(fragments, parts)
        .withColumn("_clock", F.timestamp_micros("last")).withWatermark("_clock", lateness).drop("_clock")  # late rows are shown, not dropped
    )
    shown = T.StructType([own, *T.StructType.fromDDL("started long, expires long, total_operations long, failed long, late boolean")])
    out = clocked.groupBy(key).transformWithState(OpenSessions(key, gap), shown, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "expires")})


def open_sessions(spark: SparkSession, checkpoint: str, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions that a stream's state still holds, in the columns of ``closed_sessions``."""
    rows = read_state(spark, checkpoint, "open").select("key.*", "list_element.*")
    key = rows.columns[0]
    return rows.select(
        key, F.timestamp_micros("started").alias("started"), F.timestamp_micros(F.col("last") + gap_seconds * MICROS).alias("expires"),
        "total_operations", "failed", F.lit(False).alias("late"))
