"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind."""
    ts = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(ts)
    days = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return days + clock + seconds
