"""Element tables: the elements of a page corpus, parsed once and read without a shuffle.

A table is bucketed by page and sorted by page and position. It holds tag, span, depth, parent
and attributes of every element; the root row of a page also has the page's tokens, its text
index and the digest of its HTML. Whatever groups or windows by page reads the buckets as they
lie, so selectors, texts and structure need no exchange.

``refresh`` takes the pages of a later crawl: pages whose HTML did not change are left alone,
the others are parsed and appended under the next fetch number. ``read`` shows the newest fetch
of each page, so two fetches of a page never mix. A task writes whole pages, so an append that
was cut short leaves whole pages too, and the next refresh goes on from there.

One page is the largest group. A key that the pages repeat is one page (see ``elements``);
null keys are one page as well; a page without HTML has its root row only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators.elements import elements

BUCKETS = 64


def _parsed(pages: DataFrame, key: str, html: str, buckets: int, fetch: int) -> DataFrame:
    # Dealt like the buckets, so that a task parses and writes one bucket and nothing moves again.
    dealt = pages.select(key, html).repartition(buckets, key)
    els = elements(dealt, key, html, tree=True, index=True, spread=False)
    root = F.col("open") == 0
    digest = F.sha2(F.array_join("toks", ""), 256)  # the tokens are the cleaned HTML, cut
    return els.withColumns({"fetch": F.lit(fetch), "digest": F.when(root, digest)})


def _store(rows: DataFrame, name: str, key: str, buckets: int, path: str | None) -> None:
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key, "open")
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("append").saveAsTable(name)


def write_elements(
    pages: DataFrame, name: str, path: str | None = None, key: str = "page_id", html: str = "html", buckets: int = BUCKETS
) -> None:
    """Parse pages into a new table of the catalog, at ``path`` if given."""
    _store(_parsed(pages, key, html, buckets, 0), name, key, buckets, path)


def page_digests(spark: SparkSession, name: str, key: str = "page_id") -> DataFrame:
    """key, digest and fetch of the newest fetch of each page; reads three narrow columns."""
    roots = spark.table(name).where("open = 0").select(key, "digest", "fetch")
    return roots.groupBy(key).agg(F.max_by("digest", "fetch").alias("digest"), F.max("fetch").alias("fetch"))


def refresh(pages: DataFrame, name: str, key: str = "page_id", html: str = "html", buckets: int = BUCKETS) -> int:
    """Append the pages that are new or whose markup changed, under the next fetch number, which is returned."""
    spark = pages.sparkSession
    have = page_digests(spark, name, key)
    last = have.agg(F.max("fetch")).first()[0]
    own = pages.groupBy(key).agg(F.max(html).alias(html)).withColumn("_digest", F.sha2(H.clean_html(F.coalesce(html, F.lit(""))), 256))
    old = have.select(F.col(key).alias("_key"), F.col("digest").alias("_old"))
    changed = own.join(old, own[key].eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_old")), "left_anti")
    number = 0 if last is None else last + 1
    _store(_parsed(changed, key, html, buckets, number), name, key, buckets, None)
    return number


def read_elements(spark: SparkSession, name: str, key: str = "page_id") -> DataFrame:
    """Elements of the newest fetch of every page."""
    newest = F.max("fetch").over(Window.partitionBy(key))
    return spark.table(name).withColumn("_newest", newest).where("fetch = _newest").drop("_newest", "fetch", "digest")
