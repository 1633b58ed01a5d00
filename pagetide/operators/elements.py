"""Token and element tables of a page corpus.

A page is one row, so every group below is bounded by one document. The only
shuffle is the one that co-locates a page's rows, and it moves the compact HTML
rather than the exploded tokens; every window then reuses that distribution.
Its tasks follow the plain size of the HTML, which is what the windows of a
task grow with; the compressed size of a shuffle says little about it.
No step joins tokens with tokens: levels, scopes, clamps and parents all come
from running windows, so the cost stays O(n log n) per page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H

DOCUMENT = "#document"
# ---- fixed values ---------------------------------------------------------
TASK_BYTES = 4 << 20  # HTML of a task: its windows hold about a hundred times as much
LEAST_BYTES = 256 << 10  # what a task is worth while cores are free
PAGE_BYTES = 100  # what a page weighs besides its HTML
DIRECT_TASKS = 200  # to so many tasks rows are written one by one; for more, the writing task holds its rows
HELD_BYTES = 64 << 20  # HTML that a writing task may hold
# ---------------------------------------------------------------------------
_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def page_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, tag, token) for every tag and text run; map-only."""
    tok = F.col("token")
    return (
        pages.select(key, F.posexplode(H.html_tokens(F.col(html))).alias("p", "token"))
        .select(
            key,
            (F.col("p") + 1).alias("pos"),
            H.token_kind(tok).alias("kind"),
            F.when(H.token_kind(tok) != 0, H.tag_name(tok)).alias("tag"),
            "token",
        )
    )


def _weights(pages: DataFrame, html: str) -> tuple[int, int]:
    """Plain size of the HTML of all pages and of the largest task that reads them: one small job sums it up."""
    weight = F.coalesce(F.octet_length(html), F.lit(0)) + F.lit(PAGE_BYTES).cast("long")
    read = pages.select(F.spark_partition_id().alias("task"), weight.alias("w")).groupBy("task").agg(F.sum("w").alias("w"))
    return tuple(read.agg(*[F.coalesce(f("w"), F.lit(0)) for f in (F.sum, F.max)]).first())


def _tasks(pages: DataFrame, total: int) -> int:
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return max(-(-total // TASK_BYTES), min(cores, total // LEAST_BYTES), 2)


def page_tasks(pages: DataFrame, html: str = "html") -> int:
    """Tasks for the windows over these pages, by the plain size of their HTML."""
    return _tasks(pages, _weights(pages, html)[0])


def spread_rows(rows: DataFrame, tasks: int) -> DataFrame:
    """The rows dealt evenly to so many tasks, ``DIRECT_TASKS`` at most, whatever their keys.

    No task holds the rows it reads: they go by a number of their own, as Spark sorts a task's rows to deal them in turn.
    """
    numbered = rows.withColumn("_dealt", F.monotonically_increasing_id())
    return numbered.repartition(min(tasks, DIRECT_TASKS), "_dealt").drop("_dealt")


def spread_pages(pages: DataFrame, key: str | Sequence[str] = "page_id", html: str = "html") -> DataFrame:
    """The pages dealt by key to as many tasks as their HTML needs; whatever groups by key then stays there.

    Where few tasks read much HTML, as from files of large row groups, and there are too many tasks to deal to directly,
    the pages are spread first, so that no task holds a whole row group's HTML to write it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    own = pages.select(*keys, html)
    total, largest = _weights(own, html)
    tasks = _tasks(own, total)
    if tasks > DIRECT_TASKS and largest > max(HELD_BYTES, 2 * total // DIRECT_TASKS):
        own = spread_rows(own, DIRECT_TASKS)
    return own.repartition(tasks, *keys)


def _located(pages: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """One row per page, with the rows of a page in one place.

    A key names one page: of rows that repeat it the greatest HTML counts. To keep several
    fetches of a page, make the fetch part of the key.
    """
    return pages.select(*keys, html).groupBy(*keys).agg(F.max(html).alias(html))


def _carried(index: bool) -> list[str]:
    """Columns that only a page's root row fills."""
    return ["toks", "index"] if index else ["toks"]


def _with_index(located: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the page's text index to its tokens: its whole text as bytes, and where each token's text ends."""
    token = F.col("token")
    rows = located.select(*keys, F.posexplode_outer("toks").alias("p", "token")).withColumn(
        "piece", F.when(H.is_text(token), H.decode_entities(token)).otherwise("")
    )
    along = Window.partitionBy(*keys).orderBy("p").rowsBetween(*_BEFORE)
    rows = rows.withColumn("upto", F.sum(F.octet_length("piece")).over(along).cast("int"))
    one = F.when(F.col("p").isNotNull(), F.struct("p", "token", "piece", "upto"))
    xs = F.array_sort(F.collect_list(one))
    return rows.groupBy(*keys).agg(xs.alias("xs")).select(
        *keys, F.col("xs.token").alias("toks"),
        F.struct(F.encode(F.array_join("xs.piece", ""), "UTF-8").alias("text"), F.col("xs.upto").alias("ends")).alias("index"),
    )


def _tag_rows(pages: DataFrame, keys: Sequence[str], html: str, index: bool = False) -> DataFrame:
    """Tag tokens plus one root row per page that alone carries the token array and the text index."""
    located = pages.select(*keys, H.html_tokens(F.col(html)).alias("toks"))
    located = _with_index(located, keys) if index else located
    carry = _carried(index)
    none = [F.lit(None).cast(located.schema[c].dataType).alias(c) for c in carry]
    root = F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("token"), *carry))
    tags = F.filter(
        F.transform(
            F.col("toks"),
            lambda t, i: F.struct((i + 1).alias("pos"), t.alias("token"), *none),
        ),
        lambda s: s["token"].startswith("<"),
    )
    rows = located.select(*keys, F.inline(F.concat(root, tags)))
    kind = H.token_kind(F.col("token"))
    rows = rows.select(
        *keys, "pos", "token", *carry, kind.alias("kind"),
        F.when(F.col("pos") == 0, F.lit(DOCUMENT)).otherwise(H.tag_name(F.col("token"))).alias("tag"),
    ).where((F.col("kind") != 0) | (F.col("pos") == 0))
    group = (
        F.when(F.col("pos") == 0, "root")
        .when(F.col("tag").isin(H.VOID), "void")
        .when(F.col("tag").isin(H.IMPLIED), "implied")
        .when(F.col("tag").isin(H.INLINE), "inline")
        .when(F.col("tag").isin(H.WRAPPER), "wrapper")
        .otherwise("block")
    )
    return rows.withColumn("cls", group)


def element_spans(
    pages: DataFrame, key: str | Sequence[str] = "page_id", html: str = "html", index: bool = False, spread: bool = True
) -> DataFrame:
    """One row per element with its first and last token position.

    Columns: key, open, close, tag, token, toks, and with ``index`` the text
    index. The root row (open 0, tag ``#document``) exists for every page and
    carries the page's token array and index. Spans are properly nested by
    construction: the last step pairs opening and closing positions per
    nesting level. Pages that already lie by key, in tasks of a fitting size,
    are taken as they lie without ``spread``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    carry = _carried(index)
    dealt = spread_pages(pages, keys, html) if spread else pages
    rows = _tag_rows(_located(dealt, keys, html), keys, html, index)
    kind, pos, cls, tag = F.col("kind"), F.col("pos"), F.col("cls"), F.col("tag")
    is_open = kind == 1
    end_of_page = F.lit(2147483647)

    # 1. Balanced tags: the close of an open is the next token on its level.
    run = Window.partitionBy(*keys, "tag").orderBy("pos").rowsBetween(*_BEFORE)
    rows = rows.withColumn("lvl", F.sum("kind").over(run) - F.when(is_open, 1).otherwise(0))
    level = Window.partitionBy(*keys, "tag", "lvl").orderBy("pos")
    rows = rows.withColumn("pair", F.lead("pos").over(level)).withColumn(
        "paired", F.coalesce(F.lag("kind").over(level) == 1, F.lit(False))
    )

    # 2. Innermost closed block around every token, by nesting depth.
    closes_all = cls.isin("block", "wrapper")
    block_open = is_open & closes_all & F.col("pair").isNotNull()
    block_close = (kind == -1) & closes_all & F.col("paired")
    in_page = Window.partitionBy(*keys).orderBy("pos").rowsBetween(*_BEFORE)
    rows = rows.withColumn(
        "bd", F.sum(F.when(block_open, 1).when(block_close, -1).otherwise(0)).over(in_page)
    )
    in_depth = Window.partitionBy(*keys, "bd").orderBy("pos").rowsBetween(*_BEFORE)
    scope = F.last(
        F.when(block_open, F.struct(pos.alias("at"), F.col("pair").alias("end"))), True
    ).over(in_depth)
    # A block open belongs to its own depth; its enclosing scope is not needed
    # here because unclosed blocks are not counted in the depth.
    rows = rows.withColumn("scope", F.when(F.col("bd") > 0, scope))

    # 3. Implied ends: next token of the family in the same scope. A row ends at
    # the next row token only, a cell at the next cell or row token.
    family = (
        F.when(cls != "implied", tag)
        .when(tag.isin("dt", "dd"), "dt+dd")
        .when(tag.isin("tr", "td", "th"), "tr+td+th")
        .otherwise(tag)
    )
    near = Window.partitionBy(*keys, "scope.at", "family").orderBy(F.desc("pos"))
    later = near.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("family", family).withColumn(
        "next_in_scope",
        F.when(tag == "tr", F.last(F.when(tag == "tr", pos), True).over(later))
        .otherwise(F.lag("pos").over(near)),
    )
    end = (
        F.when(cls == "root", end_of_page)
        .when(cls == "void", pos)
        .when(cls == "implied", F.coalesce("next_in_scope", "scope.end", end_of_page))
        .when(cls == "block", F.coalesce("pair", "scope.end", end_of_page))
        .otherwise(F.col("pair"))
    )
    spans = rows.where(is_open | (cls == "root")).select(
        *keys, pos.alias("open"), end.alias("end"), "tag", "token", *carry, "cls"
    )

    # 4. Pair opens and closes per level; open inline tags end with their container.
    void = cls == "void"
    point = F.struct(F.col("open").alias("at"), F.lit(1).alias("ord"), F.lit(True).alias("is_el"))
    shut = F.struct(F.col("end").alias("at"), F.lit(0).alias("ord"), F.lit(False).alias("is_el"))
    spanning = ~void & F.col("end").isNotNull()
    events = spans.select(
        *keys, "open", "end", "tag", "cls", "token", *carry,
        F.inline(F.when(spanning, F.array(point, shut)).otherwise(F.array(point))),
    ).select(
        *keys, "open", "tag", "at", "ord", "is_el", "cls",
        F.when(F.col("is_el"), F.col("token")).alias("token"),
        *[F.when(F.col("is_el"), F.col(c)).alias(c) for c in carry],
        F.when(F.col("is_el") & ~spanning, 0).when(F.col("is_el"), 1).otherwise(-1).alias("step"),
    )
    along = Window.partitionBy(*keys).orderBy("at", "ord").rowsBetween(*_BEFORE)
    events = events.withColumn(
        "d", F.sum("step").over(along) - F.when(F.col("is_el"), 0).otherwise(-1)
    )
    back = (
        Window.partitionBy(*keys, "d")
        .orderBy(F.desc("at"), F.desc("ord"))
        .rowsBetween(*_BEFORE)
    )
    shut_at = F.last(F.when(~F.col("is_el"), F.col("at")), True).over(back)
    return (
        events.withColumn("shut_at", shut_at)
        .where("is_el")
        .select(
            *keys, "open",
            F.when(F.col("cls") == "void", F.col("open"))
            .otherwise(F.coalesce("shut_at", end_of_page)).alias("close"),
            "tag", "token", *carry,
        )
    )


def with_tree(spans: DataFrame, key: str | Sequence[str] = "page_id") -> DataFrame:
    """Add ``depth`` (html 0, body 1) and ``parent`` (position, root is 0)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in spans.columns if c not in keys]
    wide = F.col("close") > F.col("open")
    opened = F.struct(F.col("open").alias("at"), F.lit(1).alias("ord"))
    closed = F.struct(F.col("close").alias("at"), F.lit(0).alias("ord"))
    # Only the opening event carries the element; the closing one is a marker.
    events = spans.select(
        *keys, F.struct(*cols).alias("el"), wide.alias("wide"),
        F.inline(F.when(wide, F.array(opened, closed)).otherwise(F.array(opened))),
    ).select(
        *keys, "at", "ord",
        F.when(F.col("ord") == 1, F.col("el")).alias("el"),
        F.when(F.col("ord") == 0, -1).when(F.col("wide"), 1).otherwise(0).alias("step"),
    )
    along = Window.partitionBy(*keys).orderBy("at", "ord").rowsBetween(*_BEFORE)
    deep = (
        events.withColumn("d", F.sum("step").over(along))
        .where("ord = 1")
        .select(*keys, "el", (F.col("d") - F.col("step") - 1).alias("depth"))
    )
    # Each element shows up on its own level (as a possible parent) and on the
    # level above (as a child looking for the last opened parent).
    roles = deep.select(
        *keys, "el", "depth",
        F.inline(F.array(
            F.struct(F.col("depth").alias("k"), F.lit(True).alias("as_parent")),
            F.struct((F.col("depth") - 1).alias("k"), F.lit(False).alias("as_parent")),
        )),
    )
    roles = roles.select(
        *keys, "depth", "k", "as_parent", F.col("el.open").alias("at"),
        F.when(~F.col("as_parent"), F.col("el")).alias("el"),
        F.when(F.col("as_parent") & (F.col("el.close") > F.col("el.open")), F.col("el.open")).alias("p"),
    )
    up = Window.partitionBy(*keys, "k").orderBy("at").rowsBetween(*_BEFORE)
    return (
        roles.withColumn("parent", F.last("p", True).over(up))
        .where("not as_parent")
        .select(*keys, *[F.col(f"el.{c}").alias(c) for c in cols], "depth", "parent")
    )


def with_attributes(elements: DataFrame) -> DataFrame:
    """Add the attribute name and value arrays of each element."""
    tok = F.col("token")
    return elements.withColumns(
        {"attr_names": H.attribute_names(tok), "attr_values": H.attribute_values(tok)}
    )


def open_tags(pages: DataFrame, key: str | Sequence[str] = "page_id", html: str = "html") -> DataFrame:
    """Elements without their spans: key, open, tag, token and attributes.

    Map-only: enough for everything that looks at single tags (links, images,
    classes, ids), and far cheaper than the span model. Keeps the root row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = _tag_rows(pages, keys, html).where("kind = 1 or pos = 0")
    return with_attributes(rows.select(*keys, F.col("pos").alias("open"), "tag", "token"))


def elements(
    pages: DataFrame,
    key: str | Sequence[str] = "page_id",
    html: str = "html",
    tree: bool = False,
    index: bool = False,
    spread: bool = True,
) -> DataFrame:
    """Element table with attributes, optionally with depth and parent, and with the text index."""
    spans = element_spans(pages, key, html, index, spread)
    return with_attributes(with_tree(spans, key) if tree else spans)


def page_tokens_of() -> Column:
    """Aggregate giving the token array of a page.

    Not ``first``: its buffer is copied for every row of the page.
    """
    return F.get(F.collect_list("toks"), F.lit(0))


def attach_content(
    els: DataFrame,
    keep: Column,
    columns: Sequence[str],
    key: str | Sequence[str] = "page_id",
    text: bool = True,
    inner_html: bool = False,
) -> DataFrame:
    """Rows of ``els`` where ``keep`` holds, with their text and inner markup.

    The page's tokens sit in the root row only; the wanted spans of a page meet
    them in one per-page row and each span is sliced out directly. With a text
    index a span's text is two look-ups and one slice, however deep it nests.
    """
    keys = [key] if isinstance(key, str) else list(key)
    indexed = "index" in els.columns
    payload = F.struct("open", "close", *[c for c in columns if c not in ("open", "close")])
    pages = [page_tokens_of().alias("toks")] if inner_html or not indexed else []
    pages += [F.get(F.collect_list("index"), F.lit(0)).alias("index")] if indexed else []
    grouped = els.groupBy(*keys).agg(*pages, F.collect_list(F.when(keep, payload)).alias("xs"))

    def fill(x: Column) -> Column:
        parts = [x[c].alias(c) for c in columns]
        if text and indexed:
            parts.append(H.indexed_text(F.col("index"), x["open"], x["close"]).alias("text"))
        elif text:
            parts.append(H.span_text(F.col("toks"), x["open"], x["close"]).alias("text"))
        if inner_html:
            parts.append(H.span_html(F.col("toks"), x["open"], x["close"]).alias("inner_html"))
        return F.struct(*parts)

    return grouped.select(*keys, F.inline(F.transform("xs", fill)))


def element_attributes(els: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per attribute of every element, first of repeated names only."""
    pairs = els.select(
        key, "open", "tag",
        F.posexplode(F.arrays_zip("attr_names", "attr_values")).alias("i", "kv"),
        "attr_names",
    )
    first = F.array_position(F.col("attr_names"), F.col("kv.attr_names")) == F.col("i") + 1
    return pairs.where(first).select(
        key, "open", "tag",
        F.col("kv.attr_names").alias("name"),
        F.col("kv.attr_values").alias("value"),
    )
