"""From raw documents to shards: quality, near duplicates, benchmark leaks, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result as
Parquet in the shared folder and hands the table to the next stage. All stages but the last
return the columns of documents. Each works on all that the stage before kept.

Rows: null or empty texts are scored as empty, stay in near-duplicate removal (they link with
nothing), hold no test item and have no words to mix. Repeated rows of one doc_id are reduced
to one by near-duplicate removal; rows without doc_id are told apart by their text there.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagetide.llm import contamination, jaccard, mixing, quality, sharding
from pagetide.llm.common import stored, table

MIX_BLOCK_WORDS = 256
SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, name="_quality")
    return scored.where(F.col("_quality") >= quality.THRESHOLD).drop("_quality")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each similarity class; of rows without id, one per text."""
    classes = jaccard.similarity_classes(docs)
    kept = classes.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    unnamed = docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return named.unionByName(unnamed).select(docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, as documents; a document drawn in two turns has two rows."""
    plan = mixing.mix(docs, block=MIX_BLOCK_WORDS, whole=True)
    return mixing.mixed_documents(plan).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return sharding.assign_shards(docs, "doc_id", "text", SHARDS, keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality", good_documents),
    ("near duplicates", one_of_each),
    ("decontamination", clean_documents),
    ("mixing", mixture),
    ("sharding", sharded),
]

#: Compression, the similarity join's components and BM25 retrieval have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
