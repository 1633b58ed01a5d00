"""Operator 11: vectors compressed to one code per part, learned exactly on Hilbert-sorted blocks.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. The pieces of a position are sorted by the Hilbert key of their leading components
and cut into flat blocks of a few hundred pieces, which store their values in one array, the
smallest and largest value of each component (the box) and the component sums. In each round
the distances of a block's box to all entries tell which entries can be nearest to any of its
pieces: an entry stays on the block's list if its least distance to the box does not exceed
the smallest of the largest distances. A list of one takes the whole block by its sums; a
longer one is settled by a small kernel in 64-bit integers, over the listed entries alone.
Rounds are jobs over the stored blocks; each task sends one sum per entry and component, so
the driver gets parts x entries x components numbers.

All values are exact, so neither the order of the blocks nor lost tasks can change a result.
Equal pieces have equal keys and are told apart by row number in the range partitioning, so a
vector that a third of all rows hold is spread over tasks (and its boxes are points).

Rows: vectors that are null or hold null or non-finite components take no part, nor do those
whose length is not that of the smallest id whose vector can be cut into equal parts; zero
vectors do. Components beyond +-2**26 after scaling are held there, as their squares would
leave 64 bits. Repeated ids are rows of their own, ties for the first entries go by vector;
null ids come last; fewer rows than entries make a smaller codebook; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import stored, table
from pagetide.llm.neighbours import hilbert_keys

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 1 << 26
#: Pieces in a block, at most.
BLOCK = 256
#: Leading components and their bits in a Hilbert key (at most 62 bits in all).
CURVE_DIMENSIONS, CURVE_BITS = 8, 7


def whole(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))


def blocks_of(rows: DataFrame, parts: int, width: int, reach: int, label: T.DataType, block: int) -> DataFrame:
    """Flat blocks of the pieces of all rows (rid, vec_id, label, v); cells of the curve divide -reach to reach."""
    depth = min(width, CURVE_DIMENSIONS)

    def cut(batches: Iterator) -> Iterator:
        """A row per piece with its place on the curve; ids and labels go with the first part."""
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, parts, width)
            for p in range(parts):
                lead = np.clip(pieces[:, p, :depth].astype(np.int64), -reach, reach - 1) + reach
                keys = hilbert_keys((lead << CURVE_BITS) // (2 * reach), CURVE_BITS)
                flat = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * width + 1, width, dtype=np.int32), pieces[:, p].ravel())
                own = [batch.column(c) if p == 0 else pa.nulls(batch.num_rows, batch.column(c).type) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, p, np.int32)), pa.array(keys), batch.column("rid"), flat, *own],
                    ["part", "curve", "rid", "v", "vec_id", "label"])

    def pack(batches: Iterator) -> Iterator:
        """Sorted pieces to blocks; a block ends with its part, its size or the batch."""
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column("part").to_numpy()
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            cuts = np.unique(np.concatenate([np.arange(a, b, block) for a, b in zip(first, [*first[1:], n])]))
            v = batch.column("v").flatten().to_numpy().reshape(n, width)
            at = np.r_[cuts, n].astype(np.int32)
            lists = lambda x, k=1: pa.ListArray.from_arrays(pa.array(at * np.int32(k)), x)
            rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), x.ravel())
            yield pa.RecordBatch.from_arrays([
                pa.array(part[cuts]), lists(batch.column("rid")), lists(batch.column("vec_id")), lists(batch.column("label")), lists(v.ravel(), width),
                rows(np.minimum.reduceat(v, cuts)), rows(np.maximum.reduceat(v, cuts)), rows(np.add.reduceat(v.astype(np.int64), cuts)),
            ], ["part", "rids", "vec_ids", "labels", "v", "low", "high", "sums"])

    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("curve", T.LongType()), T.StructField("rid", T.LongType()),
                         T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("vec_id", T.LongType()), T.StructField("label", label)])
    lists = [("rids", T.LongType()), ("vec_ids", T.LongType()), ("labels", label), ("v", T.IntegerType()), ("low", T.IntegerType()),
             ("high", T.IntegerType()), ("sums", T.LongType())]
    by = ["part", "curve", "rid"]
    ordered = rows.mapInArrow(cut, kind).repartitionByRange(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(pack, T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.ArrayType(t)) for c, t in lists]]))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """blocks x entries: whether an entry can be nearest to a piece inside the block's box.

    ``low`` and ``high``: blocks x width; ``entries``: blocks x entries x width.
    """
    left, right = low[:, None, :] - entries, entries - high[:, None, :]
    least = (np.maximum(np.maximum(left, right), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(left), np.abs(right)) ** 2).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest_entries(pieces: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Number of the nearest entry of each piece, the lower one of equals; all in 64-bit integers."""
    return ((entries ** 2).sum(1) - 2 * (pieces @ entries.T)).argmin(1)


def block_arrays(batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """part, low, high (64-bit), flat pieces and the first piece of each block of a batch."""
    own = [batch.column(c).flatten().to_numpy().reshape(-1, width) for c in ("low", "high", "v")]
    sizes = np.asarray(batch.column("rids").value_lengths())
    return batch.column("part").to_numpy(), own[0].astype(np.int64), own[1].astype(np.int64), own[2], np.r_[0, np.cumsum(sizes)]


def entry_sums(blocks: DataFrame, books: np.ndarray) -> dict[tuple[int, int, int], int]:
    """(part, entry, component) -> sum over the pieces nearest to the entry; component ``width`` counts them."""
    parts, entries, width = books.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, low, high, v, at = block_arrays(batch, width)
            sums = batch.column("sums").flatten().to_numpy().reshape(-1, width)
            can = shortlists(low, high, books[part])
            for b, listed in enumerate(can):
                few = np.flatnonzero(listed)
                own = total[part[b]]
                if len(few) == 1:
                    own[few[0], :width] += sums[b]
                    own[few[0], width] += at[b + 1] - at[b]
                else:
                    x = v[at[b]:at[b + 1]].astype(np.int64)
                    code = few[nearest_entries(x, books[part[b], few])]
                    np.add.at(own, (code[:, None], np.arange(width)), x)
                    own[:, width] += np.bincount(code, minlength=entries)
        where = np.argwhere(total[:, :, width] > 0)
        if len(where):
            p, e = (np.repeat(where[:, i], width + 1).astype(np.int32) for i in (0, 1))
            i = np.tile(np.arange(width + 1, dtype=np.int32), len(where))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(i), pa.array(total[p, e, i])], ["part", "entry", "at", "total"])

    rows = blocks.select("part", "rids", "v", "low", "high", "sums").mapInArrow(run, "part int, entry int, at int, total long")
    return {(r.part, r.entry, r["at"]): r.total for r in rows.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()}


def assigned(blocks: DataFrame, books: np.ndarray, label: T.DataType) -> DataFrame:
    """rid, part, code, error of every piece, with vec_id and label in the rows of the first part."""
    width = books.shape[2]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            part, low, high, v, at = block_arrays(batch, width)
            codes, errors = np.empty(len(v), np.int32), np.empty(len(v), np.int64)
            for b, listed in enumerate(shortlists(low, high, books[part])):
                few, x = np.flatnonzero(listed), v[at[b]:at[b + 1]].astype(np.int64)
                code = few[nearest_entries(x, books[part[b], few])] if len(few) > 1 else np.full(len(x), few[0])
                codes[at[b]:at[b + 1]] = code
                errors[at[b]:at[b + 1]] = ((x - books[part[b], code]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rids").flatten(), pa.array(np.repeat(part, np.diff(at))), pa.array(codes), pa.array(errors),
                 batch.column("vec_ids").flatten(), batch.column("labels").flatten()],
                ["rid", "part", "code", "error", "vec_id", "label"])

    kind = T.StructType([T.StructField("rid", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("code", T.IntegerType()),
                         T.StructField("error", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("label", label)])
    return blocks.select("part", "rids", "vec_ids", "labels", "v", "low", "high").mapInArrow(run, kind)


@dataclass
class Compressed:
    codes: DataFrame  # vec_id, label, code (hex digits), error; a row per vector
    books: list  # part -> entry -> components


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> Compressed:
    """Codes of all vectors and the codebooks after the given number of rounds; at most 256 entries."""
    spark = vectors.sparkSession
    rows = vectors.where(whole(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), scaled(F.col(vector), scale).alias("v"))
    rows = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    kind = rows.schema["label"].dataType
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        none = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return Compressed(spark.createDataFrame([], none), [])
    rows = rows.where(F.size("v") == len(head[0].v))
    width = len(head[0].v) // parts
    first = np.array([r.v for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))
    reach = max(1, int(np.abs(first).max()))  # only how tight boxes are depends on it
    blocks = stored(blocks_of(rows.withColumn("rid", F.monotonically_increasing_id()), parts, width, reach, kind, block), "vector-blocks")
    for _ in range(rounds):
        sums = entry_sums(blocks, books)
        for (p, e, i), total in sums.items():
            if i < width:
                books[p, e, i] = total // sums[p, e, width]
    pieces = assigned(blocks, books, kind)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
    codes = pieces.groupBy("rid").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), shown.alias("code"), F.sum("error").alias("error"))
    return Compressed(codes.drop("rid"), books.tolist())


def books_digest(books: list) -> str:
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the digest of the codebooks."""
    out = compress(table(spark, sf_dir, "embeddings"))
    codes = stored(out.codes, "vector-codes")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(out.books)).alias("codebooks_sha256"))
