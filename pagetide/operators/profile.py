"""Structure profiles of pages: classes, images, links, depth, children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import text as X
from pagetide.functions.urls import EXTENSION
from pagetide.operators.elements import attach_content
from pagetide.operators.extract import image_source
from pagetide.operators.selectors import in_rank, match

# ---- fixed values ---------------------------------------------------------
GRID_SELECTOR = ".sc-4d29e6fd-0"
MAX_CLASSES, MAX_SELECTORS = 50, 100
SHORT_TEXT, LONG_TEXT = 100, 200
# ---------------------------------------------------------------------------


def _cut(column: str, chars: int | None) -> Column:
    """The text, or its first ``chars`` characters."""
    return (F.col(column) if chars is None else F.substring(column, 1, chars)).alias(column)


def _at_most(count: Column, limit: int | None) -> Column:
    return count if limit is None else F.least(count, F.lit(limit))


def with_child_counts(els: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``child_count``; needs ``parent``. Each element meets its children
    in a small window keyed by the parent position."""
    cols = els.columns
    roles = els.select(
        *cols, F.explode(F.array(F.col("open"), F.coalesce("parent", F.lit(-1)))).alias("family")
    )
    is_self = F.col("family") == F.col("open")
    kin = Window.partitionBy(key, "family")
    return (
        roles.withColumn("child_count", F.count_if(~is_self).over(kin))
        .where(is_self)
        .drop("family")
    )


def _page_names(els: DataFrame, key: str, per_element: Column) -> DataFrame:
    """Names of a page in document order, one array per page."""
    listed = els.groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.when(F.size(per_element) > 0, F.struct("open", per_element.alias("names"))))
        ).alias("xs")
    )
    return listed.select(key, F.flatten(F.col("xs.names")).alias("names"))


def available_classes(els: DataFrame, key: str = "page_id", top: int = MAX_CLASSES) -> DataFrame:
    """Distinct classes in document order, first ``top`` of each page."""
    names = _page_names(els, key, H.class_list())
    return names.select(
        key, F.posexplode(F.slice(F.array_distinct("names"), 1, top)).alias("rank", "class_name")
    )


def unique_selectors(els: DataFrame, key: str = "page_id", top: int = MAX_SELECTORS) -> DataFrame:
    """``#id`` selectors first, then ``.class``; distinct, first ``top`` per page."""
    el_id = H.attr("id")
    ids = F.when(el_id != "", F.concat(F.lit("#"), el_id))
    listed = els.groupBy(key).agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    ids.isNotNull() | (F.size(H.class_list()) > 0),
                    F.struct("open", ids.alias("i"), H.class_list().alias("c")),
                )
            )
        ).alias("xs")
    )
    classes = F.transform(F.flatten(F.col("xs.c")), lambda c: F.concat(F.lit("."), c))
    every = F.array_distinct(F.concat(F.array_compact(F.col("xs.i")), classes))
    return listed.select(key, F.posexplode(F.slice(every, 1, top)).alias("rank", "selector"))


def image_elements(els: DataFrame, key: str = "page_id") -> DataFrame:
    src = image_source()
    empty = F.lit("")
    return els.where("tag = 'img'").select(
        key, "open",
        H.class_list().alias("classes"),
        F.coalesce(H.attr("alt"), empty).alias("text"),
        F.nullif(H.attr("src"), empty).alias("src"),
        F.nullif(H.attr("data-src"), empty).alias("data_src"),
        F.nullif(H.attr("alt"), empty).alias("alt"),
        F.nullif(F.lower(F.regexp_extract(src, EXTENSION, 1)), empty).alias("format"),
        F.coalesce(src != "", F.lit(False)).alias("is_valid"),
    )


def link_elements(els: DataFrame, key: str = "page_id", text_chars: int | None = SHORT_TEXT) -> DataFrame:
    """``a[href]`` elements; needs ``parent`` for the child counts."""
    counted = with_child_counts(els, key)
    href = H.attr("href")
    keep = (F.col("tag") == "a") & F.array_contains("attr_names", "href")
    rows = attach_content(
        counted, keep, ["open", "attr_names", "attr_values", "child_count"], key
    )
    empty = F.lit("")
    return rows.select(
        key, "open", H.class_list().alias("classes"),
        _cut("text", text_chars), "child_count",
        F.coalesce(href, empty).alias("href"),
        F.nullif(H.attr("target"), empty).alias("target"),
        F.nullif(H.attr("rel"), empty).alias("rel"),
        (href.startswith("http://") | href.startswith("https://")).alias("is_external"),
    )


def grid_containers(
    els: DataFrame, selector: str = GRID_SELECTOR, key: str = "page_id", text_chars: int | None = SHORT_TEXT
) -> DataFrame:
    """Elements of one selector with classes, short text and child count."""
    found = match(with_child_counts(els, key), [selector], key)
    rows = attach_content(
        found, F.size("hits") > 0, ["open", "tag", "attr_names", "attr_values", "child_count"], key
    )
    return rows.select(
        key, "open", "tag", H.class_list().alias("classes"),
        _cut("text", text_chars), "child_count",
    )


def structure_depth(els: DataFrame, key: str = "page_id") -> DataFrame:
    """Levels of nesting with the body as 1; 0 without a body. Needs ``depth``."""
    page = Window.partitionBy(key)
    body = F.min(F.when(F.col("tag") == "body", F.struct("open", "close", "depth"))).over(page)
    inside = (F.col("open") >= F.col("body.open")) & (F.col("open") < F.col("body.close"))
    return (
        els.withColumn("body", body)
        .groupBy(key)
        .agg(
            F.coalesce(
                F.max(F.when(inside, F.col("depth") - F.col("body.depth") + 1)), F.lit(0)
            ).alias("structure_depth")
        )
    )


def page_structure(
    els: DataFrame, grid: str = GRID_SELECTOR, key: str = "page_id",
    max_classes: int | None = None, max_selectors: int | None = None,
) -> DataFrame:
    """One row per page with the counts of every structure profile; counts stop at the given limits only."""
    page = Window.partitionBy(key)
    found = match(els, [grid], key)
    body = F.min(F.when(F.col("tag") == "body", F.struct("open", "close", "depth"))).over(page)
    inside = (F.col("open") >= F.col("body.open")) & (F.col("open") < F.col("body.close"))
    el_id = F.when(H.attr("id") != "", H.attr("id"))
    classes = F.flatten(F.collect_set(H.class_list()))
    stats = found.withColumn("body", body).groupBy(key).agg(
        F.count_if(F.col("open") > 0).alias("total_elements"),
        F.size(F.array_distinct(classes)).alias("n_classes"),
        F.size(F.collect_set(el_id)).alias("n_ids"),
        F.count_if(in_rank(0)).alias("grid_containers"),
        F.count_if(F.col("tag") == "img").alias("image_elements"),
        F.count_if((F.col("tag") == "a") & F.array_contains("attr_names", "href")).alias("link_elements"),
        F.coalesce(
            F.max(F.when(inside, F.col("depth") - F.col("body.depth") + 1)), F.lit(0)
        ).alias("structure_depth"),
    )
    return stats.select(
        key, "total_elements",
        _at_most(F.col("n_classes"), max_classes).alias("available_classes"),
        "grid_containers", "image_elements", "link_elements", "structure_depth",
        _at_most(F.col("n_ids") + F.col("n_classes"), max_selectors).alias("unique_selectors"),
    )


def element_analysis(
    els: DataFrame, selectors: Sequence[str], key: str = "page_id", text_chars: int | None = LONG_TEXT
) -> DataFrame:
    """Profile of the first match per page; tag ``none`` and not valid if absent."""
    found = match(els, selectors, key)
    page = Window.partitionBy(key)
    best = F.min(
        F.when(F.size("hits") > 0, F.struct(F.array_min("hits").alias("r"), F.col("open").alias("at")))
    ).over(page)
    marked = found.withColumn("best", best)
    is_root = F.col("open") == 0
    rows = attach_content(
        marked, is_root | (F.col("open") == F.col("best.at")),
        ["open", "tag", "attr_names", "attr_values"], key,
    )
    # The root row keeps pages without a match; a match sorts after it.
    first = rows.groupBy(key).agg(
        F.max(F.struct("open", "tag", "attr_names", "attr_values", "text")).alias("e")
    ).select(key, "e.*")
    there = F.col("open") > 0
    href = F.nullif(H.attr("href"), F.lit(""))
    return first.select(
        key,
        F.when(there, 1).otherwise(0).alias("element_count"),
        F.when(there, F.col("tag")).otherwise("none").alias("tag"),
        H.class_list().alias("classes"),
        H.attribute_map(F.col("attr_names"), F.col("attr_values")).alias("attributes"),
        F.when(there, _cut("text", text_chars)).otherwise("").alias("text"),
        href.alias("href"),
        (there & (X.trim_space(F.col("text")) != "")).alias("is_valid"),
    )


def element_children(
    els: DataFrame, selectors: Sequence[str], key: str = "page_id", text_chars: int | None = SHORT_TEXT
) -> DataFrame:
    """Children of the first match per page, in order. Needs ``parent``."""
    found = match(with_child_counts(els, key), selectors, key)
    page = Window.partitionBy(key)
    best = F.min(
        F.when(F.size("hits") > 0, F.struct(F.array_min("hits").alias("r"), F.col("open").alias("at")))
    ).over(page)
    rows = attach_content(
        found.withColumn("best", best), F.col("parent") == F.col("best.at"),
        ["open", "tag", "attr_names", "attr_values", "child_count"], key,
    )
    return rows.select(
        key, "open", "tag", H.class_list().alias("classes"),
        _cut("text", text_chars), "child_count",
    )


def image_analysis(images: DataFrame, key: str = "page_id") -> DataFrame:
    """Totals and source-length statistics per page over ``image_elements``."""
    size = F.length(F.coalesce("src", "data_src"))
    return images.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_size"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_size"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_size"),
    )


def image_formats(images: DataFrame, key: str = "page_id") -> DataFrame:
    return images.where("format is not null").groupBy(key, "format").agg(F.count("*").alias("n"))
