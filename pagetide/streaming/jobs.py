"""Structured Streaming forms of the batch jobs.

Pages and releases go through ``foreachBatch`` because the batch plans use
analytic windows. Every batch writes into a folder of its own, or once into a
versioned table, so a replayed batch gives the same result. Keyed state is in
the state store (``keyed``) or in such a table, never rewritten as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetide.operators.state import merge_state
from pagetide.sources.versions import DELTAS, VersionedTable, touched_buckets
from pagetide.streaming.keyed import SESSION_GAP_SECONDS, changes, closed_sessions, keyed_state

QUOTA_WINDOW, QUOTA_SLIDE, LATENESS, SESSION_GAP = "1 hour", "5 minutes", "1 hour", "30 minutes"
FILES_PER_TRIGGER = 256


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path names a folder in its own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def file_stream(spark: SparkSession, path: str, per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stream over a folder of parquet drops, or over a single file; a batch takes ``per_trigger`` files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def _batch_folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch:012d}"


def run_per_batch(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Apply a batch job to every micro-batch; a page is never split over batches."""

    def write(rows: DataFrame, batch: int) -> None:
        job(rows).write.mode("overwrite").parquet(_batch_folder(out, batch))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_change_feed(
    stream: DataFrame, key: str, bucket: Column, order: list[str], values: list[str], out: str, checkpoint: str, ttl_ms: int | None = None
) -> StreamingQuery:
    """Change feed across micro-batches; the last value of each key is in the state store."""
    feed = changes(stream, key, bucket, order, values, ttl_ms)
    with keyed_state(stream.sparkSession, idle_batches=ttl_ms is None):
        return write_updates(feed, out, checkpoint, "append")


def run_state_merge(
    stream: DataFrame, initial: DataFrame, out: str, checkpoint: str, key: str = "source", deltas: int = DELTAS
) -> StreamingQuery:
    """Upsert sent notices into the versioned state table at ``out``.

    A batch reads the buckets of its keys, writes a delta with its keys only and is skipped if the table has it.
    """

    def write(sent: DataFrame, batch: int) -> None:
        table = VersionedTable(sent.sparkSession, out, key)
        if not table.versions():
            table.upsert(initial, batch=-1)
        state = table.read(buckets=touched_buckets(table, sent)).join(sent.select(key).distinct(), key, "left_semi")
        table.upsert(merge_state(state, sent, key), batch=batch)
        table.compact(deltas)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_late_ledger(
    stream: DataFrame, key: str, out: str, ledger: str, checkpoint: str, ts: str = "ts",
    width: str = QUOTA_WINDOW, lateness: str = LATENESS,
) -> StreamingQuery:
    """Requests per key and tumbling window in a versioned table; rows whose window had closed go to the ledger.

    The clock is the newest time seen in the batches before, observed while a batch is written; a window closes
    when the clock passes its end by ``lateness``. A ledger row has its window and by how far (``delay_ms``) it
    came behind the watermark, so that counted and late rows are all rows, those without a time included (with no
    window, in the ledger).
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark, clock = rows.sparkSession, f"{out}-clock"
        before = spark.read.parquet(_batch_folder(clock, batch - 1)).first()[0] if batch else None
        watermark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        span = F.window(ts, width)
        seen = Observation(f"clock-{batch}")
        marked = rows.observe(seen, F.max(ts).alias("newest")).withColumns({
            "window_start": span["start"], "window_end": span["end"], "delay_ms": F.floor((F.unix_micros(watermark) - F.unix_micros(F.col(ts))) / 1000)})
        late = F.coalesce(F.col("window_end") <= watermark, F.col(ts).isNull())
        # F.window leaves rows without a time out, so they are marked apart.
        timeless = rows.where(F.col(ts).isNull()).withColumns({c: F.lit(None).cast(t) for c, t in (("window_start", "timestamp"), ("window_end", "timestamp"), ("delay_ms", "long"))})
        marked.where(late).unionByName(timeless).write.mode("overwrite").parquet(_batch_folder(ledger, batch))
        newest = max((t for t in (before, seen.get["newest"]) if t is not None), default=None)
        spark.createDataFrame([(newest,)], "newest timestamp").write.mode("overwrite").parquet(_batch_folder(clock, batch))
        fresh = marked.where(~late).groupBy(key, "window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))
        fresh = fresh.withColumn("window_key", F.to_json(F.struct(key, F.unix_micros("window_start").alias("at"))))
        table = VersionedTable(spark, out, "window_key")
        if table.versions():
            old = table.read(buckets=touched_buckets(table, fresh)).select("window_key", F.col("n").alias("_n"))
            fresh = fresh.join(old, "window_key", "left").withColumn("n", F.col("n") + F.coalesce("_n", F.lit(0))).drop("_n")
        table.upsert(fresh, batch=batch)
        table.compact()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counted_windows(spark: SparkSession, out: str) -> DataFrame:
    """Windows that ``run_late_ledger`` counted, open ones too."""
    return VersionedTable(spark, out, "window_key").read().drop("window_key")


def run_sessions(
    stream: DataFrame, key: str, out: str, checkpoint: str, ts: str = "ts", gap_seconds: int = SESSION_GAP_SECONDS, lateness: str = LATENESS
) -> StreamingQuery:
    """Append each session once, when it has ended; ``open_sessions`` reads those that have not."""
    with keyed_state(stream.sparkSession):
        return write_updates(closed_sessions(stream, key, ts, gap_seconds, lateness), out, checkpoint, "append")


def request_windows(
    stream: DataFrame, key: str, ts: str = "ts", width: str = QUOTA_WINDOW,
    slide: str | None = QUOTA_SLIDE, lateness: str = LATENESS,
) -> DataFrame:
    """Requests per key and window: sliding, or tumbling when ``slide`` is None."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(key, span.alias("w"))
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    )


def operation_sessions(
    stream: DataFrame, key: str, ts: str = "ts", gap: str = SESSION_GAP, lateness: str = LATENESS
) -> DataFrame:
    """Sessions that end after a quiet gap, over a batch; ``closed_sessions`` is the same rule with open sessions as state.

    The expiry rule of ``metrics`` measures age from the session start instead.
    """
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(
            F.count("*").alias("total_operations"),
            F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("failed"),
        )
        .select(
            key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"),
            "total_operations", "failed",
        )
    )


def first_seen(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """First row of each release within the watermark, over all history.

    Unlike the change feed, a release that comes back later is not repeated.
    """
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def write_updates(rows: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write what each batch changed (``update``) or finished (``append``), a folder per batch.

    After ``update``, windows that are still open are there as well: ``latest`` reads the present state.
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        batch_rows.write.mode("overwrite").parquet(_batch_folder(out, batch))

    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row of each key over the batch folders of an ``update`` stream."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def write_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a folder; rows behind the watermark are dropped."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
