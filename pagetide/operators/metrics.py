"""Operation metrics, sessions and request quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions.clock import micros

# ---- fixed values ---------------------------------------------------------
QUOTA, QUOTA_SECONDS = 20, 3600
MAX_SESSIONS, SESSION_MINUTES = 10, 30
# ---------------------------------------------------------------------------


def operation_metrics(log: DataFrame, operation: str = "operation", ok: str = "success") -> DataFrame:
    return log.groupBy(operation).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(ok)).alias("successful"),
        F.count_if(~F.col(ok)).alias("failed"),
    )


def selector_rates(log: DataFrame, selector: str = "selector") -> DataFrame:
    """Share of hits per selector; an attempt that found nothing is not recorded.

    ``outcome`` is hit, miss or error.
    """
    return (
        log.where("outcome <> 'miss'")
        .groupBy(selector)
        .agg(F.avg((F.col("outcome") == "hit").cast("int")).alias("success_rate"))
    )


def session_metrics(ops: DataFrame, session: str = "session_id") -> DataFrame:
    """Counts, mean duration and length of each session."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return ops.groupBy(session).agg(
        F.count("*").alias("total_operations"),
        F.count_if(~failed).alias("successful"),
        F.count_if(failed).alias("failed"),
        F.avg("duration").alias("mean_duration"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )


def cap_sessions(
    sessions: DataFrame, keep: int = MAX_SESSIONS, by: Sequence[str] = (), start: str = "started",
    session: str = "session_id",
) -> DataFrame:
    """The newest sessions; the oldest start goes first when there are too many."""
    if not by:
        return sessions.orderBy(F.desc(start), F.desc(session)).limit(keep)
    newest = Window.partitionBy(*by).orderBy(F.desc(start), F.desc(session))
    return sessions.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep).drop("_rank")


def live_sessions(
    sessions: DataFrame, as_of: Column, minutes: int = SESSION_MINUTES, start: str = "started"
) -> DataFrame:
    """Sessions whose age from their start is within the limit."""
    return sessions.where(F.col(start) >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def rolling_counts(
    requests: DataFrame, key: str, ts: str = "ts", limit: int = QUOTA, seconds: int = QUOTA_SECONDS,
    slots: int = 60,
) -> DataFrame:
    """Requests of the key in the window that ends with each row.

    The lower bound is exclusive. Neither a busy key nor a busy hour ends up in
    one task: rows are grouped by (key, slot), a slot being 1/``slots`` of the
    window. A slot sees its own rows, the rows that leave the window during it
    (shifted by one window), and one carry row with the pre-aggregated count of
    the slots between.
    """
    width = seconds * 1_000_000
    span = next(n for n in range(slots, 0, -1) if width % n == 0)
    step = width // span
    at = requests.withColumn("_at", micros(requests, ts))
    slot = F.floor(F.col("_at") / step).cast("long")
    counts = at.groupBy(key, slot.alias("_slot")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_slot").rangeBetween(-span, -1)
    carried = counts.select(
        key, "_slot", (F.col("_slot") * step).alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_delta"),
    )
    own = at.withColumns({"_slot": slot, "_delta": F.lit(1).cast("long"), "_own": F.lit(True)})
    leaving = at.select(
        key, (slot + span).alias("_slot"), (F.col("_at") + step * span).alias("_at"),
        F.lit(-1).cast("long").alias("_delta"),
    )
    both = own.unionByName(carried, allowMissingColumns=True).unionByName(leaving, allowMissingColumns=True)
    upto = Window.partitionBy(key, "_slot").orderBy("_at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        both.withColumn("in_window", F.sum("_delta").over(upto))
        .where("_own")
        .drop("_at", "_slot", "_delta", "_own")
        .withColumn("allowed", F.col("in_window") - 1 < limit)
    )
