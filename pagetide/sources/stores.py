"""Readers and writers: pages, JSON records, release and summary stores, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions.urls import version_key
from pagetide.operators.metrics import session_metrics
from pagetide.sources.versions import VersionedTable

# ---- fixed values ---------------------------------------------------------
STORE_VERSION = "1.0.0"
RELEASE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("content", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("local_image_path", T.StringType()),
])
# ---------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records; a missing path is an empty table, a bad record an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def checked_records(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Good records, and the bad ones as (file, line, reason); a missing path has neither.

    ``malformed``: not a JSON object, or a value of another type than the schema's;
    ``missing <field>``: a required field is absent or null. Blank lines are no records.
    """
    try:
        lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "line string, file string")
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    reason = F.when(~F.col("line").rlike(r"^\s*\{") | F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "malformed")
    for field in required:
        reason = reason.when(F.col(f"r.{field}").isNull(), f"missing {field}")
    rows = lines.where(F.trim("line") != "").withColumn("r", parsed).withColumn("reason", reason)
    return rows.where("reason is null").select(*[f"r.{f.name}" for f in schema]), rows.where("reason is not null").select("file", "line", "reason")


def ingest_records(
    spark: SparkSession, path: str, schema: T.StructType, quarantine: str, required: Sequence[str] = ()
) -> DataFrame:
    """Good records of a drop; its bad ones are appended to the quarantine table, each once however often the drop is read."""
    good, bad = checked_records(spark, path, schema, required)
    known = [F.sha2(F.concat_ws("\n", "file", "line"), 256).alias("record_id")]
    bad = bad.select(*known, "*").dropDuplicates(["record_id"])
    table = VersionedTable(spark, quarantine, "record_id")
    if table.versions():
        bad = bad.join(table.read().select("record_id"), "record_id", "left_anti")
    table.upsert(bad)
    return good


def write_records(df: DataFrame, path: str) -> None:
    """Overwrite a folder of JSON records; parent folders are made."""
    df.write.mode("overwrite").json(path)


def _one_per_version(df: DataFrame, *order: str) -> DataFrame:
    """Last row of each version key, as a store keeps one record per key."""
    keyed = df.withColumn("version_key", version_key(F.col("version")))
    cols = [c for c in keyed.columns if c != "version_key"]
    last = F.max_by(F.struct(*cols), F.struct(*order))
    return keyed.groupBy("version_key").agg(last.alias("r")).select(
        "r.*", "version_key"
    )


def release_store_rows(releases: DataFrame, saved_at: Column, source_url: str) -> DataFrame:
    """Rows as stored: one per version key, with the save time and origin."""
    return _one_per_version(releases, "published_at", "url").withColumns({
        "saved_at": saved_at,
        "metadata": F.struct(
            F.lit(STORE_VERSION).alias("scraper_version"), F.lit(source_url).alias("source_url")
        ),
    })


def store_table(spark: SparkSession, path: str) -> VersionedTable:
    """Versioned table of a release or summary store."""
    return VersionedTable(spark, path, "version_key")


def _write_store(rows: DataFrame, path: str, stamp: str | None) -> int:
    """Upsert by version key as a delta; deltas are folded now and then, older versions stay until ``clean``."""
    table = store_table(rows.sparkSession, path)
    number = table.upsert(rows, stamp)
    return table.compact() or number


def write_releases(releases: DataFrame, path: str, saved_at: Column, source_url: str, stamp: str | None = None) -> int:
    """Overwrite the records of the versions given, other versions stay; the number of the store's new version."""
    return _write_store(release_store_rows(releases, saved_at, source_url), path, stamp)


def write_summaries(summaries: DataFrame, path: str, stamp: str | None = None) -> int:
    """Keep one summary per version key, the last generated; the number of the store's new version."""
    return _write_store(_one_per_version(summaries, "generated_at", "summary"), path, stamp)


def read_store(spark: SparkSession, path: str, schema: T.StructType | None = None, as_of: str | None = None) -> DataFrame:
    """Records of a store, now or as they were at a stamp; a store that is not there is empty."""
    return store_table(spark, path).read(schema, as_of=as_of)


def snapshot_state(state: DataFrame, path: str, stamp: str, key: str = "source") -> int:
    """Save the state, one row per key, under a stamp (ISO time); the version's number.

    Rows that did not change since the last snapshot are not written again; keys that left are marked as gone.
    """
    table, removed = VersionedTable(state.sparkSession, path, key), None
    if table.versions():
        last = table.read().select(state.columns)
        removed = last.join(state, last[key].eqNullSafe(state[key]), "left_anti")
        state = state.exceptAll(last)
    return table.upsert(state, stamp, removed=removed)


def state_as_of(spark: SparkSession, path: str, stamp: str, key: str = "source") -> DataFrame:
    """The state as the last snapshot at or before a stamp had it."""
    return VersionedTable(spark, path, key).read(as_of=stamp)


def restore_state(spark: SparkSession, path: str, stamp: str, key: str = "source") -> DataFrame:
    """Make an older snapshot the newest one and return its rows; the snapshots between stay readable."""
    table = VersionedTable(spark, path, key)
    number = table.at(stamp)
    if number is None:
        raise ValueError(f"no snapshot at or before {stamp}")
    return table.read(version=table.restore(number))


def session_rows(ops: DataFrame) -> DataFrame:
    """Export columns of recorded operations."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return ops.select(
        "session_id", F.col("op_id").alias("operation_id"), "type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.coalesce(F.col("duration").cast("string"), F.lit("")).alias("duration"),
        (~failed).alias("success"), F.coalesce("error", F.lit("")).alias("error"),
    )


def export_sessions(ops: DataFrame, path: str, fmt: str = "json") -> None:
    """Write exports as ``json`` or ``csv`` (with header and quoting)."""
    rows, out = session_rows(ops), None
    out = rows.write.mode("overwrite")
    if fmt == "json":
        out.json(path)
    elif fmt == "csv":
        out.option("header", True).option("quoteAll", False).csv(path)
    else:
        raise ValueError(f"Unsupported export format: {fmt}")


def _escape(text: Column) -> Column:
    out = text
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def _tagged(tag: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{tag}>"))


def session_report(ops: DataFrame, url: str = "url") -> DataFrame:
    """HTML report lines (session_id, part, order_key, html): head, a table row per operation, end.

    The lines of a session are rows rather than one string, so a session of any
    size never has to fit in one task. Sort by part and order_key to read it.
    The address is the first that the session's operations name in ``url``, if
    there is such a column; the length runs from the first to the last operation.
    """
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    if url not in ops.columns:
        ops = ops.withColumn(url, F.lit(None).cast("string"))
    address = ops.where(F.col(url).isNotNull()).groupBy("session_id").agg(F.min_by(url, "ts").alias("address"))
    stats = session_metrics(ops).join(address, "session_id", "left")
    length = F.timestamp_diff("MILLISECOND", F.col("started"), F.col("ended")).cast("string")
    name = _escape(F.col("session_id").cast("string"))
    facts = {
        "Start": F.date_format("started", iso),
        "Address": F.coalesce(_escape(F.col("address")), F.lit("none")),
        "Length": F.concat(length, F.lit(" ms")),
        "Operations": F.format_string("%d in all, %d done, %d failed", "total_operations", "successful", "failed"),
        "Mean time": F.format_string("%.2f ms", F.coalesce("mean_duration", F.lit(0.0))),
    }
    head = stats.select(
        "session_id", F.lit(0).alias("part"), F.lit("").alias("order_key"),
        F.concat(
            F.lit('<!doctype html><html lang="en"><meta charset="utf-8">'), _tagged("title", "Session ", name), _tagged("h1", "Session ", name),
            _tagged("dl", *[x for k, v in facts.items() for x in (_tagged("dt", k), _tagged("dd", v))]), F.lit("<table>"),
        ).alias("html"),
    )
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    cells = (
        F.date_format("ts", iso), F.col("op_id").cast("string"), F.col("type"),
        F.concat(F.coalesce(F.col("duration").cast("string"), F.lit("0")), F.lit(" ms")), F.coalesce("error", F.lit("")),
    )
    body = ops.select(
        "session_id", F.lit(1).alias("part"),
        F.concat_ws(" ", F.date_format("ts", iso), F.lpad(F.col("op_id").cast("string"), 20, "0")).alias("order_key"),
        F.concat(
            F.lit('<tr class="'), F.when(failed, "failed").otherwise("done"), F.lit('">'),
            *[_tagged("td", _escape(c)) for c in cells], F.lit("</tr>"),
        ).alias("html"),
    )
    tail = stats.select("session_id", F.lit(2).alias("part"), F.lit("").alias("order_key"), F.lit("</table></html>").alias("html"))
    return head.unionByName(body).unionByName(tail)
