"""Release state: detection, change feed, upkeep, enrichment, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.urls import image_file_key, version_key
from pagetide.operators.ordered import lag_by_key

# ---- fixed values ---------------------------------------------------------
CACHE_DAYS, RELEASE_DAYS, IMAGE_DAYS = 7, 90, 30
CHECK_MINUTES = 90
ALERT_CODES = ("SCRAPING_ERROR", "DISCORD_ERROR")
ERROR_LABELS = {
    "SCRAPING_ERROR": "スクレイピングエラー",
    "NETWORK_ERROR": "ネットワークエラー",
    "DISCORD_ERROR": "Discord通知エラー",
}
OTHER_LABEL = "アプリケーションエラー"
# ---------------------------------------------------------------------------


def new_releases(releases: DataFrame, state: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose version and url are not both those of the last notice."""
    last = state.where("version is not null").select(key, "version", "url")
    return releases.join(last, [key, "version", "url"], "left_anti")


def change_feed(
    snapshots: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: Sequence[str] = ("version", "url"),
) -> DataFrame:
    """Snapshots that differ from the one before them: A, B, A gives three rows."""
    seen = lag_by_key(snapshots, keys, bucket, order, values)
    same = F.col("prev").isNotNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"prev.{v}"))
    return seen.where(~same).drop("prev")


def merge_state(state: DataFrame, sent: DataFrame, key: str = "source") -> DataFrame:
    """Replace the last release of each source and add to its counter.

    ``sent`` has key, version, title, url, published_at, sent_at; it is reduced
    per source before it meets the state.
    """
    fields = ("version", "title", "url", "published_at")
    order = F.struct("sent_at", "version", "url")
    fresh = sent.groupBy(key).agg(
        F.max_by(F.struct(*fields, "sent_at"), order).alias("new"), F.count("*").alias("added")
    )
    old = state.select(key, F.struct(*fields, "last_notification", "total").alias("old"))
    had = F.col("new").isNotNull()
    return old.join(fresh, key, "full").select(
        key,
        *[F.when(had, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fields],
        F.when(had, F.col("new.sent_at")).otherwise(F.col("old.last_notification")).alias("last_notification"),
        (F.coalesce("old.total", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("total"),
    )


def repair_state(state: DataFrame, as_of: Column) -> DataFrame:
    """Negative counters become 0 and future notice times become ``as_of``."""
    return state.withColumns({
        "total": F.greatest(F.col("total"), F.lit(0)),
        "last_notification": F.when(
            F.col("last_notification") > as_of, as_of
        ).otherwise(F.col("last_notification")),
    })


def readable_releases(store: DataFrame) -> DataFrame:
    """Stored rows with all required fields; empty optional values drop out."""
    need = ("version", "title", "url", "published_at")
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    return store.where(ok).select(
        *need,
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("content", "image_url", "local_image_path")],
    )


def with_details(releases: DataFrame, store: DataFrame) -> DataFrame:
    """Releases whose stored record exists and has content."""
    known = readable_releases(store).where("content is not null")
    have = known.select(version_key(F.col("version")).alias("k")).distinct()
    return releases.join(have, version_key(releases["version"]) == have["k"], "left_semi")


def enrich(releases: DataFrame, store: DataFrame, details: DataFrame, on: str = "url") -> DataFrame:
    """Stored details when a record with content exists, else fresh ones."""
    known = readable_releases(store).where("content is not null").select(
        version_key(F.col("version")).alias("_k"),
        F.struct("content", "image_url", "local_image_path", "published_at").alias("c"),
    )
    # The store holds one record per version key; keep the newest if it does not.
    cache = known.groupBy("_k").agg(F.max_by("c", F.struct("c.published_at", "c.content")).alias("cache"))
    # One row per address: the newest fetch if the details say when, else the one with the most content.
    newest = F.struct(*([F.col("fetched_at")] if "fetched_at" in details.columns else []), F.length("content"), "content", "image_url")
    fresh = details.groupBy(on).agg(F.max_by(F.struct("content", "image_url"), newest).alias("fresh"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    hit = F.col("cache").isNotNull()
    base = releases.withColumn("_k", version_key(F.col("version")))
    joined = base.join(cache, "_k", "left").join(fresh, on, "left")
    return joined.withColumns({
        "details_from": F.when(hit, "store").otherwise("page"),
        "content": F.coalesce(F.when(hit, some("cache.content")).otherwise(some("fresh.content")), "content"),
        "image_url": F.coalesce(
            F.when(hit, some("cache.image_url")).otherwise(some("fresh.image_url")), "image_url"
        ),
        "local_image_path": F.when(hit, some("cache.local_image_path")),
    }).drop("_k", "cache", "fresh")


def choose_image(releases: DataFrame, inventory: DataFrame) -> DataFrame:
    """Local path when its file is in the inventory, else the URL, else none.

    ``inventory`` has one ``file_key`` per stored image.
    """
    have = inventory.select(F.col("file_key").alias("_f")).distinct().withColumn("_have", F.lit(True))
    key = image_file_key(F.coalesce("image_url", F.lit("")), F.col("version"))
    joined = releases.withColumn("_f", key).join(have, "_f", "left")
    local = (F.col("local_image_path") != "") & F.coalesce("_have", F.lit(False))
    remote = F.nullif("image_url", F.lit(""))
    return joined.withColumns({
        "image_kind": F.when(local, "local").when(remote.isNotNull(), "remote").otherwise("none"),
        "image": F.when(local, F.col("local_image_path")).otherwise(remote),
    }).drop("_f", "_have")


def fresh_rows(rows: DataFrame, stamp: str, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.col(stamp) >= as_of - F.make_dt_interval(F.lit(days)))


def with_retention(rows: DataFrame, stamp: str, as_of: Column, days: int = RELEASE_DAYS) -> DataFrame:
    """Mark rows as keep or drop by age; nothing is deleted here."""
    old = F.col(stamp) < as_of - F.make_dt_interval(F.lit(days))
    return rows.withColumn("action", F.when(old, "drop").otherwise("keep"))


def route_errors(errors: DataFrame, code: str = "code") -> DataFrame:
    """Add the label of each error and whether it raises an alert."""
    label = F.lit(OTHER_LABEL)
    for c, text in ERROR_LABELS.items():
        label = F.when(F.col(code) == c, text).otherwise(label)
    return errors.withColumns({"label": label, "alert": F.col(code).isin(*ALERT_CODES)})


def run_stats(
    runs: DataFrame, key: str = "source", started: str = "started", ok: str = "ok", minutes: int = CHECK_MINUTES
) -> DataFrame:
    """Successful runs, last start and next due time per source."""
    done = F.col(ok)
    return runs.groupBy(key).agg(
        F.count_if(done).alias("total_executions"), F.max(F.when(done, F.col(started))).alias("last_execution")
    ).withColumn(
        "next_execution", F.col("last_execution") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    )


def backup_name(stamp: Column) -> Column:
    """Name of a state snapshot; colons and dots of the time become dashes."""
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")
    return F.concat(F.lit("state_backup_"), iso, F.lit(".json"))
