"""Operator 9: consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of arcs. Spark sums the bytes of each arc (one
aggregate with map-side combine, at most ``arcs`` rows), the driver walks those
sums once: an arc belongs to the next virtual node clockwise, and whatever finds
that shard full continues clockwise to the next shard with room. So no shard gets
more than (1 + epsilon) times the mean, and only overflow leaves its home shard.
An arc that meets a border is split by bytes, so a hot arc needs no special case.

Rows: the ring key decides the arc, (key, size, checksum) the order inside it. Rows
without a key are placed by the checksum of their text; repeated rows are each
placed; null text has size 1; an empty table gives an empty table. Input columns
named like the result's are not read unless they are the named inputs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagetide.llm.common import stored, table

ARCS = 1 << 16
PARTS = T.StructType([
    T.StructField("arc", T.IntegerType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()), T.StructField("shard", T.IntegerType()),
])


def virtual_nodes(shards: Sequence[int], replicas: int, arcs: int = ARCS) -> list[tuple[int, int]]:
    """(arc, shard) of every virtual node in ring order; depends on the shard's own number only."""
    def at(text: str) -> int:
        return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big") % arcs

    return sorted((at(f"shard {s} node {r}"), s) for s in shards for r in range(replicas))


def walk(loads: dict[int, int], nodes: list[tuple[int, int]], capacity: int, arcs: int = ARCS) -> list[tuple[int, int, int, int]]:
    """Parts (arc, from byte, to byte, shard) of every loaded arc.

    First every arc fills its home shard in ring order, then the overflow moves on;
    that way a shard is not filled by strangers before its own keys came.
    """
    order: list[list[int]] = []  # distinct shards clockwise from each virtual node
    ring = [s for _, s in nodes]
    for i in range(len(ring)):
        order.append(list(dict.fromkeys(ring[i:] + ring[:i])))
    room = dict.fromkeys(ring, capacity)
    parts, waiting, k = [], [], 0
    for arc in sorted(loads):
        while k < len(nodes) and nodes[k][0] < arc:
            k += 1
        home, size = k % len(nodes), loads[arc]
        take = min(size, room[order[home][0]])
        if take:
            parts.append((arc, 0, take, order[home][0]))
            room[order[home][0]] -= take
        if take < size:
            waiting.append((arc, home, take, size))
    for arc, home, low, size in waiting:
        for shard in order[home][1:]:
            take = min(size - low, room[shard])
            if take:
                parts.append((arc, low, low + take, shard))
                room[shard] -= take
                low += take
            if low == size:
                break
    return parts


def assign_shards(
    docs: DataFrame, key: str, text: str, shards: int, epsilon: float = 0.001, replicas: int = 64,
    arcs: int = ARCS, keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot) and the columns named in ``keep``.

    A row goes to the part of its arc that holds the middle of its bytes, so a shard's
    load differs from its bound by half a row per border at most. ``slot`` numbers
    the rows of a shard from 0: whole arcs are counted, rows only inside one arc.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body)
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), crc.cast("string")))
    size = (F.octet_length(body) + 1).cast("long")
    arc = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") % arcs).cast("int")
    extra = [c for c in dict.fromkeys(keep) if c not in (key, "size", "text_crc32", "shard", "slot")]
    rows = docs.select(F.col(key), *extra, size.alias("size"), crc.alias("text_crc32"), arc.alias("_arc"))
    sums = docs.select(arc.alias("arc"), size.alias("size")).groupBy("arc").agg(F.sum("size").alias("load"))
    loads = {r.arc: r.load for r in sums.collect()}  # at most ``arcs`` rows, whatever the table
    capacity = math.ceil((1 + epsilon) * sum(loads.values()) / shards)
    parts = walk(loads, virtual_nodes(range(shards), replicas, arcs), capacity, arcs)
    own = Window.partitionBy("_arc").orderBy(F.col(key), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(own) - F.col("size") / 2
    borders = spark.createDataFrame(parts, PARTS)  # arcs + splits rows at most
    placed = rows.withColumn("_middle", middle).join(
        F.broadcast(borders), (F.col("_arc") == F.col("arc")) & (F.col("_middle") >= F.col("low")) & (F.col("_middle") < F.col("high"))
    ).drop("arc", "low", "high", "_middle")
    numbered = stored(
        placed.withColumn("_n", F.row_number().over(Window.partitionBy("_arc", "shard").orderBy(F.col(key), "size", "text_crc32")) - 1),
        "shards",
    )
    counts = numbered.groupBy("shard", "_arc").count()
    ahead = Window.partitionBy("shard").orderBy("_arc").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_arc", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), ["shard", "_arc"]).select(
        key, *extra, "size", "text_crc32", "shard", (F.col("_start") + F.col("_n")).cast("long").alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards of near-equal bytes."""
    rows = assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
