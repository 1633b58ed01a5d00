"""Operator 12: a Merkle manifest of a dataset, rolled up in nested structs.

Every row is a leaf: the sha256 of its fields, each with its length. Leaves of a group are
ranked by key; the rank in base 16 gives each leaf its place in the tree. Inside blocks of
``FAN ** DIGITS`` leaves the digits are grouped away one after the other, lowest first, and
each grouping nests what it took into the node above. A block becomes one row of bounded
size, a floor of blocks is a stored table, and the digests of its blocks are the leaves of
the next floor, until each group has one digest; these are rolled up by the same steps.

Proofs go the other way: a floor's blocks meet the paths of the floor above in a grouping by
place (one block and one path each), then the nested structs are exploded, digit by digit,
while left and right siblings are put in front of the path. There is no join between leaves,
nodes or proofs; the one join adds each task's first rank to the sorted leaves, and no row is
ever larger than a block and one path.

Ranks: leaves are range-partitioned by group, key, digest and input position, so neither a
group nor a repeated key has to fit in a task; counts per task and group give the offsets.

Rows: nulls are written as ``-`` and come first; rows that repeat a key are ordered by their
leaf, equal ones in any order (their rows are the same up to their places); empty and long
texts are plain values; a group of one leaf has that leaf as its root; an empty table gives
an empty result; equally named further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetide.llm.common import stored, table

FAN = 16
#: Digits grouped away inside a block.
DIGITS = 2
BLOCK = FAN ** DIGITS
HEX = 64
PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 of the values, each ``-`` or its UTF-8 length, a colon and itself."""
    shown = []
    for value in values:
        text = value.cast("string")
        shown.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*shown), 256)


def ranked(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``pos`` (from 0) and ``total`` within their tree; ``tree`` is never null."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "_tie")]
    cut = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    cut = stored(cut.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    spans = cut.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(tree)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(tree, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total"))
    return cut.join(spans, [tree, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def rolled_up(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One floor: blocks (tree, pos, total, digest, kids) of the nodes (tree, pos, total, digest, *carry).

    ``total`` stays the number of nodes the floor was made of.
    """
    digits = [F.floor(F.col("pos") / FAN ** i).cast("long") % FAN for i in range(DIGITS)]
    rows = nodes.select(
        "tree", "total", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "digest", *carry,
        *[d.cast("int").alias(f"d{i}") for i, d in enumerate(digits)],
    ).repartition("tree", "block")  # serves all groupings below
    inner = ["digest", *carry]
    for i in range(DIGITS):
        left = [f"d{j}" for j in range(i + 1, DIGITS)]
        rows = rows.groupBy("tree", "total", "block", *left).agg(F.array_sort(F.collect_list(F.struct(f"d{i}", *inner))).alias("kids"))
        rows = rows.withColumn("digest", F.when(several(i), F.sha2(run_of("kids"), 256)).otherwise(run_of("kids")))
        inner = ["digest", "kids"]
    return rows.select("tree", F.col("block").alias("pos"), "total", "digest", "kids")


def several(level: int) -> Column:
    """Whether the tree has more than one node at a level of the floor, so that another level follows."""
    return F.col("total") > FAN ** level


def run_of(kids: str) -> Column:
    return F.concat_ws("", F.transform(kids, lambda k: k["digest"]))


def tower(nodes: DataFrame, carry: Sequence[str], name: str) -> list[DataFrame]:
    """Stored floors from the nodes up to one block per tree."""
    floors: list[DataFrame] = []
    while True:
        floor = stored(rolled_up(nodes, carry), f"{name}-{len(floors)}")
        floors.append(floor)
        largest = floor.agg(F.max("total")).first()[0]
        if largest is None or largest <= BLOCK:
            return floors
        nodes, carry = floor.select("tree", "pos", F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), "digest"), ()


def descended(floors: Sequence[DataFrame], tops: DataFrame, carry: Sequence[str], also: Sequence[str]) -> DataFrame:
    """tree, pos, digest, path, *carry, *also of the lowest nodes; ``tops`` has tree, pos, path, *also of the top blocks."""
    for k in reversed(range(len(floors))):
        own = tuple(carry) if k == 0 else ()
        met = floors[k].select("tree", "pos", "total", "kids").unionByName(tops.select("tree", "pos", "path", *also), allowMissingColumns=True)
        rows = met.groupBy("tree", "pos").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("total", "kids", "path", *also)])
        for i in reversed(range(DIGITS)):
            run, kept = run_of("kids"), ("digest", *own) if i == 0 else ("digest", "kids")
            rows = rows.select("tree", "pos", "total", "path", *also, run.alias("run"), F.posexplode("kids").alias("at", "kid"))
            around = F.struct(
                F.substr("run", F.lit(1), F.col("at") * HEX).alias("left"), F.substr("run", F.col("at") * HEX + HEX + 1).alias("right"))
            rows = rows.select(
                "tree", (F.col("pos") * FAN + F.col(f"kid.d{i}")).alias("pos"), "total", *also,
                F.when(several(i), F.concat(F.array(around), "path")).otherwise(F.col("path")).alias("path"), *[f"kid.{c}" for c in kept])
        tops = rows.drop("total")
    return tops


def manifest(rows: DataFrame, carry: Sequence[str], group: str = "source", key: str = "doc_id") -> DataFrame:
    """leaf, subroot, root, path and the carried columns; ``rows`` has group, key, leaf and the columns to carry.

    ``path`` lists left and right siblings from the leaf's run up to the root's.
    """
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n")))
    carry = tuple(dict.fromkeys(carry))
    order = [key, "leaf"]
    keyed = keyed.select("tree", "leaf", *[c for c in dict.fromkeys((key, *carry)) if c != "leaf"])
    leaves = ranked(keyed, "tree", order, "manifest-leaves").withColumnRenamed("leaf", "digest")
    floors = tower(leaves, carry, "manifest")
    subroots = floors[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    above = tower(ranked(subroots, "tree", ["name"], "manifest-groups"), ("name",), "manifest-root")
    top = above[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    groups = descended(above, top, ("name",), ("root",))
    tops = groups.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    out = descended(floors, tops, carry, ("subroot", "root"))
    return out.select(F.col("digest").alias("leaf"), "subroot", "root", "path", *carry)


def proof_digest(path: str = "path") -> Column:
    """sha256 of all siblings of a path."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def folded(leaf: str, path: str = "path") -> Column:
    """Root that a leaf and its siblings lead to."""
    return F.aggregate(path, F.col(leaf), lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its possibly tampered text leads to."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    upper = "".join(map(chr, range(65, 91)))
    tampered = leaf_digest([*fields[:-1], F.translate("text", upper, upper.lower())])
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    leaves = docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), F.when(touched, tampered).alias("changed"))
    found = manifest(leaves, ("doc_id", "changed"))
    found = found.withColumn("tried", F.coalesce("changed", "leaf")).withColumn("folded_root", folded("tried"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
