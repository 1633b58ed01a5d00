"""Selector matching on element tables.

A selector is compiled on the driver into Column predicates. Descendant and
child steps become running windows over a page's elements in document order,
shared by all selectors of a call, so no pairs of elements are ever formed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H

_COMPOUND = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]"""
)


@dataclass
class _Step:
    child: bool
    tests: list[tuple] = field(default_factory=list)


def _split_list(selector: str) -> list[str]:
    return [s.strip() for s in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector)]


def _steps(selector: str) -> list[_Step]:
    """Steps of one complex selector, leftmost first."""
    steps, i, child = [_Step(False)], 0, False
    text = re.sub(r"\s*>\s*", ">", selector.strip())
    while i < len(text):
        if text[i] in " \t\n>":
            child = text[i] == ">"
            while i < len(text) and text[i].isspace():
                i += 1
            i += 1 if child else 0
            steps.append(_Step(child))
            continue
        found = _COMPOUND.match(text, i)
        if not found or found.end() == i:
            raise ValueError(f"unsupported selector: {selector!r}")
        steps[-1].tests.append(found.groupdict())
        i = found.end()
    if any(not s.tests for s in steps):
        raise ValueError(f"unsupported selector: {selector!r}")
    return steps


def is_supported(selector: str) -> bool:
    """Whether a selector can be read; blank ones can, and match nothing."""
    try:
        for alternative in _split_list(selector) if selector.strip() else ():
            _steps(alternative)
    except ValueError:
        return False
    return True


def _predicate(step: _Step) -> Column:
    def one(test: dict) -> Column:
        if test["tag"]:
            return F.lit(True) if test["tag"] == "*" else F.col("tag") == test["tag"].lower()
        if test["id"]:
            return F.coalesce(F.col("_a_id") == test["id"], F.lit(False))
        if test["cls"]:
            return F.coalesce(F.array_contains("_classes", test["cls"]), F.lit(False))
        name, op, val = test["attr"].lower(), test["op"], test["val"]
        if not op:
            return F.array_contains("attr_names", name)
        val = val[1:-1] if val[0] in "\"'" else val
        have = F.col(f"_a_{name}")
        hit = {
            "=": lambda: have == val,
            "*=": lambda: have.contains(val) & F.lit(val != ""),
            "^=": lambda: have.startswith(val) & F.lit(val != ""),
            "$=": lambda: have.endswith(val) & F.lit(val != ""),
            "~=": lambda: F.array_contains(F.split(have, r"\s+"), val),
            "|=": lambda: (have == val) | have.startswith(val + "-"),
        }[op]()
        return F.coalesce(hit, F.lit(False))

    on_element = F.col("open") > 0
    return reduce(lambda a, b: a & b, (one(t) for t in step.tests), on_element)


def _with_used_attributes(els: DataFrame, tests: list[dict]) -> DataFrame:
    """Look each needed attribute up once, whatever the number of selectors."""
    names = {t["attr"].lower() for t in tests if t["attr"] and t["op"]}
    names |= {"id"} if any(t["id"] for t in tests) else set()
    out = {f"_a_{n}": H.attr(n) for n in sorted(names)}
    if any(t["cls"] for t in tests):
        out["_classes"] = F.split(H.attr("class"), r"\s+")
    return els.withColumns(out) if out else els


def _descend(els: DataFrame, keys: list[str], flags: dict[str, str]) -> DataFrame:
    """For each flag column, is some proper ancestor flagged?"""
    before = Window.partitionBy(*keys).orderBy("open").rowsBetween(Window.unboundedPreceding, -1)
    return els.withColumns({
        out: F.coalesce(
            F.max(F.when(F.col(flag), F.col("close"))).over(before) > F.col("open"), F.lit(False)
        )
        for flag, out in flags.items()
    })


def _step_down(els: DataFrame, keys: list[str], flags: dict[str, str]) -> DataFrame:
    """For each flag column, is the parent flagged? Needs ``parent``."""
    cols = els.columns
    roles = els.select(
        *cols,
        F.explode(F.array(F.col("open"), F.coalesce("parent", F.lit(-1)))).alias("family"),
    )
    as_parent = F.col("family") == F.col("open")
    kin = Window.partitionBy(*keys, "family")
    out = roles.withColumns({
        out: F.coalesce(F.max(F.when(as_parent & F.col(flag), True)).over(kin), F.lit(False))
        for flag, out in flags.items()
    })
    return out.where(~as_parent).drop("family")


def needs_tree(selectors: Sequence[str]) -> bool:
    return any(
        s.child for sel in selectors if sel for alt in _split_list(sel) for s in _steps(alt)
    )


def match(
    els: DataFrame,
    selectors: Sequence[str],
    key: str | Sequence[str] = "page_id",
    into: str = "hits",
) -> DataFrame:
    """Add an array column with the indexes of the selectors an element matches.

    Blank selectors keep their index and match nothing.
    """
    return match_all(els, {into: selectors}, key)


def _step_key(step: _Step) -> tuple:
    return step.child, tuple(tuple(t.items()) for t in step.tests)


def match_all(
    els: DataFrame, jobs: Mapping[str, Sequence[str]], key: str | Sequence[str] = "page_id"
) -> DataFrame:
    """Match the selectors of several jobs at once; each job's hits go to a column of its name.

    All selectors form one automaton: a state is a distinct beginning of a selector, whatever jobs
    and selectors share it. A state's flag is computed once per element, from the element's own test
    and the flag of the state before it on an ancestor (one running window per step for all states).
    """
    keys = [key] if isinstance(key, str) else list(key)
    base = [c for c in els.columns if c not in jobs]
    states: list[dict[tuple, _Step]] = []  # per depth: the beginning -> its last step
    accepted: dict[str, dict[int, list[tuple]]] = {}
    for name, selectors in jobs.items():
        ranks = accepted.setdefault(name, {})
        for rank, selector in enumerate(selectors):
            for alternative in _split_list(selector) if selector and selector.strip() else ():
                steps = _steps(alternative)
                path = tuple(map(_step_key, steps))
                for depth, step in enumerate(steps):
                    if len(states) <= depth:
                        states.append({})
                    states[depth].setdefault(path[:depth + 1], step)
                ranks.setdefault(rank, []).append(path)
    number = {path: i for i, path in enumerate(p for level in states for p in level)}
    els = _with_used_attributes(els, [t for level in states for step in level.values() for t in step.tests])
    for depth, level in enumerate(states):
        before = {
            child: sorted({number[p[:-1]] for p, step in level.items() if step.child == child}) for child in (True, False)
        } if depth else {}
        if before.get(False):
            els = _descend(els, keys, {f"_m{i}": f"_under{i}" for i in before[False]})
        if before.get(True):
            els = _step_down(els, keys, {f"_m{i}": f"_child{i}" for i in before[True]})
        els = els.withColumns({
            f"_m{number[path]}": _predicate(step) & F.col(f"_{'child' if step.child else 'under'}{number[path[:-1]]}") if depth else _predicate(step)
            for path, step in level.items()
        })
    none = F.array().cast("array<int>")

    def found(ranks: dict[int, list[tuple]]) -> Column:
        hits = [
            F.when(reduce(lambda x, y: x | y, [F.col(f"_m{number[p]}") for p in paths]), F.lit(rank))
            for rank, paths in sorted(ranks.items())
        ]
        return F.array_compact(F.array(*hits)) if hits else none

    return els.select(*base, *[found(ranks).alias(name) for name, ranks in accepted.items()])


def in_rank(rank: int, hits: str = "hits") -> Column:
    return F.array_contains(F.col(hits), rank)


def selector_hits(
    els: DataFrame, selectors: Sequence[str], key: str = "page_id"
) -> DataFrame:
    """One row per (element, matching selector)."""
    names = F.array(*[F.lit(s) for s in selectors])
    return (
        match(els, selectors, key)
        .withColumn("rank", F.explode("hits"))
        .withColumn("selector", F.element_at(names, F.col("rank") + 1))
        .drop("hits")
    )


def first_match(
    els: DataFrame,
    selectors: Sequence[str],
    key: str = "page_id",
    max_attempts: int = 10,
) -> DataFrame:
    """First element of the first selector that matches, one row per page.

    Attempts are counted by position, so a blank selector uses one. A page
    without a match has level -1 and an element count of 0.
    """
    tried = list(selectors)[:max_attempts]
    found = match(els, tried, key)
    stats = found.groupBy(key).agg(
        *[F.count_if(in_rank(r)).alias(f"n{r}") for r in range(len(tried))],
        *[
            F.min(F.when(in_rank(r), F.struct("open", "close", "tag"))).alias(f"e{r}")
            for r in range(len(tried))
        ],
    )
    pick = F.coalesce(
        *[
            F.when(
                F.col(f"n{r}") > 0,
                F.struct(
                    F.lit(s).alias("selector"), F.lit(r).alias("level"),
                    F.col(f"n{r}").alias("n"), F.col(f"e{r}").alias("el"),
                ),
            )
            for r, s in enumerate(tried)
        ],
        F.lit(None),
    )
    return stats.select(key, pick.alias("hit")).select(
        key,
        F.coalesce("hit.selector", F.lit("")).alias("selector"),
        F.coalesce("hit.level", F.lit(-1)).alias("fallback_level"),
        F.coalesce("hit.n", F.lit(0)).alias("element_count"),
        F.col("hit.el.open").alias("open"),
        F.col("hit.el.close").alias("close"),
        F.col("hit.el.tag").alias("tag"),
    )
