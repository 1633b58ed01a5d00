"""Operator 5: mixing sources to target weights. DataFrame functions only.

Words of a source form one stream, cut into blocks of fixed length. Targets give each
source a number of slots. First each output shard draws its source counts: a multinomial
draw conditioned on the sources' totals, made by one pseudorandom permutation of all slots
onto the places of the shards. Shards vary, totals don't. A shard then fills its places
from the counts: shard after shard takes a source's next slots, and each slot passes through
the source's permutation of block indexes, one per pass, so a block comes at most once per
pass. Slots and blocks join by (source, block).

No step gathers a source: streams are laid out with sums per (source, hash bucket) and
running sums inside a bucket, draws come from chunks of a source, counts are summed up per
group of shards first, and slots and blocks meet in a merge join keyed by (source, block):
their number is not known when the join is planned, so they are never broadcast.

Rows: null source is a source of its own, the last; null or blank text has size 0 and
takes nothing; repeated rows are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetide.llm.common import SPACE_CHARS, SPACES, md5_long, stored, table, word_count

BUCKETS = 4096
ROUNDS = 12
PRIME = (1 << 31) - 1
CHUNK = 4096
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2.0
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
#: Shards whose counts are summed up before a source's running sum.
SHARD_GROUP = 1024


def source_key(source: Column) -> Column:
    """Text key of a source that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def round_keys(name: Column, n: Column) -> Column:
    """Keys of a permutation of 0..n-1: one (shift, factor, term) per round."""
    def key(i: Column, part: str) -> Column:
        return md5_long(F.concat_ws("|", name, i.cast("string"), F.lit(part)))

    return F.transform(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        lambda i: F.struct(
            (key(i, "k") % F.greatest(n, F.lit(1))).alias("k"), (key(i, "a") % (PRIME - 1) + 1).alias("a"),
            (key(i, "b") % PRIME).alias("b"),
        ),
    )


def permute(x: Column, n: Column, keys: Column) -> Column:
    """Swap-or-not permutation of 0..n-1: each round swaps x with its partner or not, by a bit of the pair."""
    def step(x: Column, r: Column) -> Column:
        other = (r["k"] + n - x) % n
        bit = F.shiftright((F.greatest(x, other) % PRIME * r["a"] + r["b"]) % PRIME, 15).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, x, step)


def source_targets(sizes: DataFrame, share: float = SHARE, repeats: float = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source (skey, source, size) -> weight, target; one row per source meets in the windows here.

    Water level: sources in the order of cap / weight; those whose cap lies below the
    level that the rest would reach get their cap, the others weight x level.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    turns = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(turns, (F.row_number().over(order) - 1) % len(weights) + 1))
    rows = rows.withColumn("_cap", F.col("size") * F.lit(repeats)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rows = rows.withColumn(
        "_level",
        (F.sum("size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    ).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    # Once a source keeps below its cap, so do all behind it.
    first = F.min(F.when(~F.col("_full"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(Window.partitionBy())
    return rows.withColumn("_first", first).withColumn(
        "target",
        F.when(F.col("_first").isNull() | (F.col("_ratio") <= F.col("_first")["_level"]), F.col("_cap"))
        .otherwise(F.col("weight") * F.col("_first")["_level"]),
    ).select("skey", "source", "size", "weight", "target")


@dataclass
class Mix:
    """rows: documents with their place; sources: targets and slot counts; slots: what each place of
    each output shard holds; pieces: words of documents in each block; blocks: slots with their pieces."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    @property
    def blocks(self) -> DataFrame:
        return self.slots.hint("merge").join(self.pieces.hint("merge"), ["skey", "block"])


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE,
    repeats: float = REPEATS, weights: tuple = WEIGHTS, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS,
    whole: bool = False,
) -> Mix:
    """Plan of the mix. ``block``: words per block; ``shard_blocks``: blocks per output shard; ``whole``: the
    plan's rows carry the documents (column ``document``), as ``mixed_documents`` needs them."""
    carried = [F.struct(*[F.col(c) for c in docs.columns]).alias("document")] if whole else []
    rows = docs.select(
        *carried,
        F.col(key).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("skey"),
        word_count(F.col(text)).alias("size"),
        (md5_long(F.coalesce(F.col(key).cast("string"), F.lit(""))) % BUCKETS).cast("int").alias("bucket"),
    )
    if not whole:
        rows = stored(rows, "mix-rows")  # so that texts are read once
    sums = rows.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("skey", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_sum", F.sum("size").over(inside)).join(bases, ["skey", "bucket"]).select(
        *(["document"] if whole else []), "doc_id", "source", "skey", "size", (F.col("_base") + F.col("_sum") - F.col("size")).alias("start")
    )
    sources = source_targets(sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("size")), share, repeats, weights)
    n_blocks = F.ceil(F.col("size") / block).cast("long")
    passes = F.floor(F.col("target") / F.col("size")).cast("long")
    rest = F.round((F.col("target") - passes * F.col("size")) / block).cast("long")
    sources = sources.withColumn("n_blocks", n_blocks).withColumn(
        "n_slots", F.when(F.col("size") > 0, F.least(passes * F.col("n_blocks") + rest, F.lit(int(repeats)) * F.col("n_blocks"))).otherwise(0)
    ).withColumn("_ahead", F.coalesce(F.sum("n_slots").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = sources.withColumn("_all", F.sum("n_slots").over(Window.partitionBy()))
    keyed = sources.where("n_slots > 0").select(
        "skey", "n_blocks", "n_slots", "_ahead", "_all",
        F.transform(
            F.sequence(F.lit(0), F.lit(int(repeats) - 1)),
            lambda p: round_keys(F.concat_ws("|", "skey", p.cast("string")), F.col("n_blocks")),
        ).alias("_keys"),
        round_keys(F.lit("places"), F.col("_all")).alias("_places"),
    )
    chunks = keyed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK))))
    draws = spread(chunks, "skey", "_chunk").withColumn(
        "_j", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.col("n_slots")) - 1))
    )
    place = permute(F.col("_ahead") + F.col("_j"), F.col("_all"), F.col("_places"))
    counts = draws.groupBy("skey", F.floor(place / shard_blocks).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    slots = filled(counts, keyed)
    pieces = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    ).select(
        "skey", "block", "doc_id", "size", "start",
        F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("from_word"),
        F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")).alias("to_word"),
    )
    return Mix(placed, sources.select("skey", "source", "size", "weight", "target", "n_blocks", "n_slots"), slots, pieces)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A few rows that each make many, dealt to all tasks: a stated number is not lowered for their small size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def filled(counts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Places of the shards (skey, turn, block, shard, slot) from the drawn counts (skey, shard, n) of their sources."""
    group = F.floor(F.col("shard") / SHARD_GROUP).alias("_group")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda *keys: F.coalesce(F.sum("n").over(before(*keys)), F.lit(0))
    rows = counts.withColumn("_group", group)
    groups = rows.groupBy("skey", "_group").agg(F.sum("n").alias("n")).select("skey", "_group", ahead("skey", "_group").alias("_base"))
    rows = rows.withColumn("_first", ahead("skey", "_group", "shard")).withColumn("_slot", ahead("shard", "skey"))
    rows = rows.join(groups, ["skey", "_group"]).join(keyed.select("skey", "n_blocks", "_keys"), "skey")
    rows = spread(rows, "skey", "shard")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.withColumn("_j", F.col("_base") + F.col("_first") + F.col("_i"))
    turn = F.floor(F.col("_j") / F.col("n_blocks"))
    return rows.select(
        "skey", turn.alias("turn"),
        permute(F.col("_j") % F.col("n_blocks"), F.col("n_blocks"), F.element_at("_keys", (turn + 1).cast("int"))).alias("block"),
        "shard", (F.col("_slot") + F.col("_i")).alias("slot"),
    )


def mixed_documents(plan: Mix, text: str = "text") -> DataFrame:
    """The documents of the mix: a row per document and turn with the words of its drawn blocks, in order.

    Words are joined by single spaces; the other columns stay. Needs a plan with ``whole=True``.
    """
    takes = plan.blocks.groupBy("skey", "start", "size", "turn").agg(
        F.array_sort(F.collect_list(F.struct(F.col("from_word").cast("int").alias("a"), F.col("to_word").cast("int").alias("b")))).alias("takes"))  # of one document
    rows = plan.rows.where("size > 0").join(takes, ["skey", "start", "size"])
    words = F.split(F.btrim(F.col(f"document.{text}"), F.lit(SPACE_CHARS)), f"[{SPACES}]+")
    cut = F.concat_ws(" ", F.flatten(F.transform("takes", lambda t: F.slice(F.col("_words"), t["a"] + 1, t["b"] - t["a"]))))
    return rows.withColumn("_words", words).withColumn("_cut", cut).select(
        *[F.col("_cut").alias(c) if c == text else F.col("document")[c].alias(c) for c in rows.schema["document"].dataType.names])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return taken_words(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def taken_words(plan: Mix) -> DataFrame:
    """Rows of the documents with source_size, target and taken."""
    taken = plan.blocks.groupBy("skey", "start", "doc_id", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows, own = plan.rows.alias("r"), taken.alias("t")
    # A start belongs to one row of a positive size; rows of size 0 may share it and take nothing.
    on = (F.col("r.skey") == F.col("t.skey")) & (F.col("r.start") == F.col("t.start")) & (F.col("r.size") == F.col("t.size"))
    return rows.join(own, on, "left").select("r.*", F.coalesce(F.col("t.taken"), F.lit(0)).cast("long").alias("taken")).join(
        plan.sources.select("skey", F.col("size").alias("source_size"), "target"), "skey"
    )
