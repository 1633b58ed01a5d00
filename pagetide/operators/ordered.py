"""Ordered look-back per key without holding a key in one task.

A key may own a large share of all rows, so rows are grouped by (key, time
bucket) and what a bucket needs from earlier ones travels as one carry row.
The carry rows come from a pre-aggregated table with one row per key and
non-empty bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carry(df: DataFrame, keys: Sequence[str], tail: Column) -> DataFrame:
    """Per (key, bucket): the tail of the nearest earlier non-empty bucket."""
    tails = df.groupBy(*keys, "_bucket").agg(tail.alias("_tail"))
    over = Window.partitionBy(*keys).orderBy("_bucket")
    return tails.withColumn("_tail", F.lag("_tail").over(over)).where("_tail is not null")


def lag_by_key(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    values: Sequence[str],
    into: str = "prev",
) -> DataFrame:
    """Add a struct of ``values`` of the previous row of the same key."""
    rows = df.withColumn("_bucket", bucket)
    packed, place = F.struct(*values), F.struct(*order)
    carried = _carry(rows, keys, F.max_by(packed, place))
    marked = rows.withColumns({"_now": packed, "_is_row": F.lit(True)})
    carry_rows = carried.select(*keys, "_bucket", F.col("_tail").alias("_now"), F.lit(False).alias("_is_row"))
    both = marked.unionByName(carry_rows, allowMissingColumns=True)
    over = Window.partitionBy(*keys, "_bucket").orderBy("_is_row", *order)
    return (
        both.withColumn(into, F.lag("_now").over(over))
        .where("_is_row")
        .drop("_bucket", "_now", "_is_row")
    )
