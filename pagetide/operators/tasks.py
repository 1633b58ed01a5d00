"""Batches of selector tasks over pages: extract, search, analyse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.operators.elements import attach_content, elements
from pagetide.operators.selectors import match, needs_tree

KINDS = ("extract", "search", "analyze")


@dataclass(frozen=True)
class Task:
    id: str
    kind: str
    selectors: Sequence[str]
    priority: int = 0


def _owners(tasks: Sequence[Task], kind: str) -> list[tuple[int, str, int, str]]:
    return [
        (t_no, t.id, s_no, s)
        for t_no, t in enumerate(tasks)
        if t.kind == kind
        for s_no, s in enumerate(t.selectors)
    ]


def _owner_column(owners):
    return F.array(*[
        F.struct(F.lit(t).alias("task_id"), F.lit(n).alias("selector_no"), F.lit(s).alias("selector"))
        for _, t, n, s in owners
    ])


def _task_rows(pages, owners, key, inner_html):
    sels = [s for *_, s in owners]
    els = match(elements(pages, key, tree=needs_tree(sels)), sels, key)
    cols = ["open", "tag", "attr_names", "attr_values", "hits"]
    rows = attach_content(els, F.size("hits") > 0, cols, key, inner_html=inner_html)
    hit = rows.withColumn("hit", F.explode("hits"))
    return hit.withColumn("o", F.get(_owner_column(owners), F.col("hit"))).select(
        key, "o.*", *[c for c in rows.columns if c not in (key, "hits")]
    )


def extract_tasks(pages: DataFrame, tasks: Sequence[Task], key: str = "page_id") -> DataFrame:
    """Every match of every selector with text, markup and attributes."""
    return _task_rows(pages, _owners(tasks, "extract"), key, True)


def search_tasks(pages: DataFrame, tasks: Sequence[Task], key: str = "page_id") -> DataFrame:
    """Per selector with at least one hit: the count and the texts in order."""
    rows = _task_rows(pages, _owners(tasks, "search"), key, False)
    return (
        rows.groupBy(key, "task_id", "selector_no", "selector")
        .agg(
            F.count("*").alias("n"),
            F.sort_array(F.collect_list(F.struct("open", "text"))).alias("t"),
        )
        .select(key, "task_id", "selector_no", "selector", "n", F.col("t.text").alias("texts"))
    )


def analyse_tasks(pages: DataFrame, tasks: Sequence[Task], key: str = "page_id") -> DataFrame:
    """Per selector, zero hits included: count, mean text length, inner img and a."""
    owners = _owners(tasks, "analyze")
    sels = [s for *_, s in owners]
    els = match(elements(pages, key, tree=needs_tree(sels)), sels, key)
    after = Window.partitionBy(key).orderBy(F.desc("open")).rowsBetween(Window.unboundedPreceding, -1)
    for tag, name in (("img", "next_img"), ("a", "next_a")):
        nearest = F.last(F.when(F.col("tag") == tag, F.col("open")), True).over(after)
        els = els.withColumn(name, F.coalesce(nearest < F.col("close"), F.lit(False)))
    is_root = F.col("open") == 0
    rows = attach_content(
        els, is_root | (F.size("hits") > 0), ["open", "hits", "next_img", "next_a"], key
    )
    per_page = rows.groupBy(key).agg(*[
        F.struct(
            F.count_if(F.array_contains("hits", i)).alias("n"),
            F.coalesce(
                F.avg(F.when(F.array_contains("hits", i), F.length("text"))), F.lit(0.0)
            ).alias("mean_text"),
            F.coalesce(F.bool_or(F.when(F.array_contains("hits", i), F.col("next_img"))), F.lit(False)).alias("has_images"),
            F.coalesce(F.bool_or(F.when(F.array_contains("hits", i), F.col("next_a"))), F.lit(False)).alias("has_links"),
        ).alias(f"s{i}")
        for i in range(len(owners))
    ])
    return per_page.select(
        key,
        F.posexplode(F.array(*[F.col(f"s{i}") for i in range(len(owners))])).alias("i", "r"),
    ).select(key, F.get(_owner_column(owners), F.col("i")).alias("o"), "r").select(key, "o.*", "r.*")


def task_batch(pages: DataFrame, tasks: Sequence[Task], key: str = "page_id") -> DataFrame:
    """One outcome row per page and task, highest priority first.

    A task of unknown kind fails alone; the rest of the batch goes on.
    """
    ranked = sorted(tasks, key=lambda t: -t.priority)
    owners = [(i, s) for i, t in enumerate(ranked) if t.kind in KINDS for s in t.selectors]
    sels = [s for _, s in owners]
    els = match(elements(pages, key, tree=needs_tree(sels)), sels, key)
    counts = els.groupBy(key).agg(*[
        F.sum(
            sum(
                (F.array_contains("hits", j).cast("long") for j, (o, _) in enumerate(owners) if o == i),
                F.lit(0).cast("long"),
            )
        ).alias(f"n{i}")
        for i in range(len(ranked))
    ])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("batch_order"), F.lit(t.id).alias("task_id"), F.lit(t.kind).alias("kind"),
            F.lit(t.kind in KINDS).alias("success"),
            F.lit(None if t.kind in KINDS else f"Unknown task type: {t.kind}").cast("string").alias("error"),
            F.when(F.lit(t.kind in KINDS), F.col(f"n{i}")).alias("matches"),
        )
        for i, t in enumerate(ranked)
    ])
    return counts.select(key, F.inline(rows))
