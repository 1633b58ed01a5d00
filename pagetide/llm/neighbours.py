"""Operator 1: approximate nearest neighbours with shifted space-filling curves.

Each ordering turns the vectors by its own random rotation, keeps a few coordinates, maps
them to quantile cells with a random shift and sorts by the Hilbert key of the cells. Spark
range-partitions all orderings at once; ranks come from partition counts. The order is cut
into windows of equal length; a query meets the window of its key and the two beside it,
each window scores its queries exactly, and the best of all orderings merge.

Equal vectors are one point: it carries its smallest ids (k + 1 of them, no more can ever
be among the k nearest), so a group of copies of any size fills no window and ties stay
exact. A task holds one window and its queries; the fit uses a bounded sample.

Inner products are ranked as angles after adding the coordinate that brings every vector
to the largest norm; scores are of the original vectors, in double precision.

Rows: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part; a repeated id counts once; null ids take no part; an empty table
gives an empty result; fewer candidates than k give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetide.llm.common import stored, table

ORDERINGS = 16
DIMENSIONS = 8
BITS = 7
WINDOW = 2048
#: Vectors that the quantile cells are fitted on, at most.
SAMPLE = 4096
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (numbers below 2**bits); J. Skilling's transform."""
    x, one = cells.T.astype(np.uint64), np.uint64(1)
    side = one << np.uint64(bits - 1)
    q = side
    while q > one:
        low = q - one
        for i in range(len(x)):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap if i else np.uint64(0)
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), side
    while q > one:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for j in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(j)) & one)
    return key.astype(np.int64)


class Curves:
    """Rotations, cuts and shifts of all orderings, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, norm: float, orderings: int, dimensions: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.bits = norm, bits
        width = sample.shape[1] + 1
        kept = min(dimensions, width)
        self.turns = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, :kept] for _ in range(orderings)]
        self.shifts = rng.random((orderings, kept))
        grid = np.linspace(0, 1, 257)
        self.cuts = [np.quantile(self.lifted(sample) @ turn, grid, axis=0) for turn in self.turns]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (vectors ** 2).sum(1), 0))
        return np.column_stack([vectors, rest])

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        lifted, grid, out = self.lifted(vectors), np.linspace(0, 1, 257), []
        for turn, shift, cuts in zip(self.turns, self.shifts, self.cuts):
            flat = lifted @ turn
            level = np.column_stack([np.interp(flat[:, i], cuts[:, i], grid) for i in range(flat.shape[1])])
            cells = np.minimum((level + shift) / 2 * (1 << self.bits), (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits))
        return out


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, bits: int = BITS, window: int = WINDOW,
    sample: int = SAMPLE, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found per query row, the query's own id left out."""
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not width:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("v") == width[0].n)
    # The smallest ids of each distinct vector; Spark cuts groups before the shuffle.
    first = Window.partitionBy("v").orderBy("vec_id")
    small = rows.groupBy("v", "vec_id").agg(F.max("q").alias("q")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    asked = rows.where("q").select("v").distinct().withColumn("q", F.lit(True))
    points = stored(
        small.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(asked, "v", "left")
        .select("v", "ids", F.element_at("ids", 1).alias("id"), F.coalesce("q", F.lit(False)).alias("q")), "points")
    norm = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    fit = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    curves = Curves(np.array([np.asarray(x) for x in fit]), norm, orderings, dimensions, bits, seed)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for i, keys in enumerate(curves.keys(np.stack(batch["v"].to_numpy()))):
                    yield pd.DataFrame({"ordering": i, "curve": keys, "id": batch["id"].to_numpy()})

    ranged = points.select("id", "v").mapInPandas(keyed, "ordering int, curve long, id long").repartitionByRange("ordering", "curve", "id")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "curve")
    counts = ranged.groupBy("ordering", "part").count()
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("ordering", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("ordering", "part").orderBy("curve", "id")
    ranks = ranged.withColumn("_n", F.row_number().over(inside) - 1).join(starts, ["ordering", "part"]).select(
        "id", "ordering", F.floor((F.col("start") + F.col("_n")) / window).alias("block"))
    placed = ranks.join(points.select("id", "v", "q"), "id")
    members = placed.select("ordering", "block", "id", "v", F.lit(False).alias("asks"))
    asking = placed.where("q").select(
        "ordering", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), "id", "v", F.lit(True).alias("asks"))

    def score(group: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best members for each asking point of one window; its own is among them."""
        asks, has = group[group["asks"]], group[~group["asks"]].sort_values("id")
        if not len(asks) or not len(has):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
        left, right = np.stack(asks["v"].to_numpy()), np.stack(has["v"].to_numpy())
        ids, most, out = has["id"].to_numpy(), min(k + 1, len(has)), []
        for i in range(0, len(left), 512):
            sims = left[i:i + 512] @ right.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, :most]  # ids ascend, so ties go to the smaller
            out.append(pd.DataFrame({
                "query": np.repeat(asks["id"].to_numpy()[i:i + 512], most), "id": ids[best].ravel(),
                "score": np.take_along_axis(sims, best, 1).ravel(),
            }))
        return pd.concat(out)

    found = members.unionByName(asking).groupBy("ordering", "block").applyInPandas(score, "query long, id long, score double")
    # Products of equal pairs differ by rounding between windows: keep one per pair and score it anew.
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= 2 * k + 2).select("query", "id")
    pairs = found.join(points.select(F.col("id").alias("query"), F.col("v").alias("a")), "query").join(
        points.select("id", "ids", F.col("v").alias("b")), "id")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("query", F.explode("ids").alias("vec_id"), dot.alias("score"))
    near = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    asked_ids = rows.where("q").select(F.col("vec_id").alias("query_id"), "v").distinct()
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    results = asked_ids.join(points.select(F.col("id").alias("query"), "v"), "v").select("query_id", "query").join(lists, "query")
    kept = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return results.select("query_id", F.posexplode(kept).alias("_i", "_x")).select(
        "query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.s")).alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
