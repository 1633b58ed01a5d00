"""Pattern hits, XPath lookups, positions and chunked extraction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import text as X
from pagetide.operators.elements import attach_content, elements
from pagetide.operators.selectors import match, needs_tree

# ---- fixed values ---------------------------------------------------------
XPATHS = {
    "//div": "div",
    "//span": "span",
    "//a": "a",
    "//img": "img",
    "//*[@class]": "[class]",
    "//*[@id]": "[id]",
}
CHUNK_CHARS = 65536
STEP_X, STEP_Y = 10, 20
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """Named pattern; ``keep`` and ``value`` map an element row to a Column.

    Both may use the columns tag, attr_names, attr_values and text.
    """

    name: str
    selectors: Sequence[str]
    regex: str | None = None
    keep: Callable[[], Column] | None = None
    value: Callable[[], Column] | None = None
    priority: int = 0


def xpath_hits(pages: DataFrame, xpath: str, key: str = "page_id") -> DataFrame:
    """Elements of one of the six known paths; any other path gives no rows."""
    els = elements(pages, key)
    css = XPATHS.get(xpath)
    keep = F.size("hits") > 0
    found = match(els, [css or ""], key)
    cols = ["open", "tag", "attr_names", "attr_values"]
    return attach_content(found, keep, cols, key, inner_html=True)


def match_confidence(text: Column) -> Column:
    """0.5, plus 0.3 for an id, 0.2 for a class and 0.1 for non-blank text."""
    score = (
        F.lit(0.5)
        + F.when(F.coalesce(H.attr("id"), F.lit("")) != "", 0.3).otherwise(0.0)
        + F.when(F.coalesce(H.attr("class"), F.lit("")) != "", 0.2).otherwise(0.0)
        + F.when(X.trim_space(text) != "", 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


def pattern_hits(pages: DataFrame, patterns: Sequence[Pattern], key: str = "page_id") -> DataFrame:
    """Hits per pattern with confidence and position; an element found by two selectors counts twice."""
    ranked = sorted(patterns, key=lambda p: -p.priority)
    owners = [(i, s) for i, p in enumerate(ranked) for s in p.selectors]
    sels = [s for _, s in owners]
    els = match(with_positions(elements(pages, key, tree=True), key), sels, key)
    rows = attach_content(
        els, F.size("hits") > 0, ["open", "tag", "attr_names", "attr_values", "hits", "x", "y"], key
    ).withColumn("hit", F.explode("hits"))
    owner = F.get(F.array(*[F.lit(i) for i, _ in owners]), F.col("hit"))
    rows = rows.withColumn("p", owner)
    value = F.col("text")
    keep = F.lit(True)
    for i, p in enumerate(ranked):
        mine = F.col("p") == i
        if p.value:
            value = F.when(mine, p.value()).otherwise(value)
        if p.keep:
            keep = keep & (~mine | F.coalesce(p.keep(), F.lit(False)))
    rows = rows.where(keep).withColumn("value", value)
    for i, p in enumerate(ranked):
        if p.regex:
            rows = rows.where((F.col("p") != i) | F.col("value").rlike(p.regex))
    names = F.array(*[F.lit(p.name) for p in ranked])
    return rows.select(
        key,
        F.get(names, F.col("p")).alias("pattern"),
        F.col("p").alias("pattern_order"),
        F.get(F.array(*[F.lit(s) for s in sels]), F.col("hit")).alias("selector"),
        "open", "tag", "value",
        match_confidence(F.col("text")).alias("confidence"), "x", "y",
    )


def with_positions(els: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``x`` and ``y``, a layout guess: x adds 10 per earlier sibling along the path, y 20 per level.

    The sum along the path is a running sum over opening and closing positions,
    so no element is paired with its ancestors. Needs ``depth`` and ``parent``.
    """
    cols = [c for c in els.columns if c != key]
    sib = Window.partitionBy(key, "parent").orderBy("open")
    own = F.when((F.col("depth") >= 1) & (F.col("open") > 0), (F.row_number().over(sib) - 1) * STEP_X).otherwise(0)
    wide = F.col("close") > F.col("open")
    events = els.withColumn("own", own).select(
        key, F.struct(*cols).alias("el"),
        F.inline(F.array(
            F.struct(F.col("open").alias("at"), F.lit(1).alias("ord"), F.col("own").alias("dx")),
            F.struct(
                F.when(wide, F.col("close")).otherwise(F.col("open")).alias("at"),
                F.when(wide, 0).otherwise(2).alias("ord"),
                (-F.col("own")).alias("dx"),
            ),
        )),
    ).withColumn("el", F.when(F.col("ord") == 1, F.col("el")))  # the closing event is a marker only
    along = Window.partitionBy(key).orderBy("at", "ord").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        events.withColumn("x", F.sum("dx").over(along))
        .where("ord = 1")
        .select(key, *[F.col(f"el.{c}").alias(c) for c in cols], "x", (F.col("el.depth") * STEP_Y).alias("y"))
    )


def element_positions(els: DataFrame, key: str = "page_id") -> DataFrame:
    """Position of every element, see ``with_positions``."""
    narrow = els.select(key, "open", "close", "tag", "depth", "parent")
    return with_positions(narrow, key).where("open > 0").select(key, "open", "tag", "x", "y")


def page_chunks(
    pages: DataFrame, size: int = CHUNK_CHARS, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """Cut every page into pieces of ``size`` characters; one pass per page."""
    pieces = F.regexp_extract_all(F.col(html), F.lit(rf"[\s\S]{{1,{size}}}"), F.lit(0))
    return pages.select(
        key, F.size(pieces).alias("n"), F.posexplode(pieces).alias("chunk", html)
    ).select(
        key, "chunk", (F.col("chunk") * size).alias("position"),
        (F.col("chunk") == F.col("n") - 1).alias("is_last"), html,
    )


def chunk_hits(
    pages: DataFrame, selectors: Sequence[str], size: int = CHUNK_CHARS, key: str = "page_id"
) -> DataFrame:
    """Each piece is parsed alone; a tag cut in two is lost or shortened."""
    chunks = page_chunks(pages, size, key)
    keys = [key, "chunk"]
    els = match(elements(chunks, keys, tree=needs_tree(selectors)), selectors, keys)
    rows = attach_content(
        els, F.size("hits") > 0, ["open", "tag", "attr_names", "attr_values", "hits"], keys, inner_html=True
    ).withColumn("hit", F.explode("hits"))
    return rows.select(
        *keys, F.get(F.array(*[F.lit(s) for s in selectors]), F.col("hit")).alias("selector"),
        (F.col("chunk") * size).alias("position"), "open", "tag", "text", "inner_html",
        "attr_names", "attr_values",
    )
