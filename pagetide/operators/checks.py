"""Validation of URL tables and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import urls as U


def validate_urls(
    rows: DataFrame, url: str = "url", policy: U.ImagePolicy = U.DEFAULT_POLICY
) -> DataFrame:
    """One result per input row, in one projection."""
    return rows.withColumn("check", U.check_image(F.col(url), policy)).select("*", "check.*").drop("check")


def validation_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    )


def validation_distributions(checked: DataFrame) -> DataFrame:
    """(dimension, value, n) for reason, protocol and format in one aggregation.

    Reasons count rejected rows, formats accepted ones, protocols all rows.
    """
    sets = checked.groupingSets(
        [[F.col("reason")], [F.col("protocol")], [F.col("format")]],
        F.col("reason"), F.col("protocol"), F.col("format"),
    ).agg(
        F.count("*").alias("n"),
        F.grouping(F.col("reason")).alias("gr"),
        F.grouping(F.col("protocol")).alias("gp"),
        F.grouping(F.col("format")).alias("gf"),
    )
    dim = F.when(F.col("gr") == 0, "reason").when(F.col("gp") == 0, "protocol").otherwise("format")
    value = F.when(F.col("gr") == 0, F.col("reason")).when(
        F.col("gp") == 0, F.col("protocol")
    ).otherwise(F.col("format"))
    return sets.select(dim.alias("dimension"), value.alias("value"), "n").where("value is not null")
