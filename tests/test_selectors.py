"""Selector grammar and first match with fallback."""

import pytest
from pyspark.sql import functions as F

from pagetide.operators import elements as E
from pagetide.operators import selectors as S

PAGE = """<html><body><div class="grid main" id="g"><a class="card x" href="/news/patch-1"><h2>One</h2></a>
<a class="card" href="https://o.example/2"><span><div>Two</div></span></a></div>
<div role="main"><section><a data-k="v w">Three</a></section></div></body></html>"""

CASES = {
    "a": ["One", "\n".join(["Two"]), "Three"],
    ".card": ["One", "Two"],
    "a.card.x": ["One"],
    "#g a": ["One", "Two"],
    ".grid > a": ["One", "Two"],
    "body > a": [],
    "div a": ["One", "Two", "Three"],
    "div > section > a": ["Three"],
    'a[href*="patch"]': ["One"],
    'a[href^="https"]': ["Two"],
    'a[href$="2"]': ["Two"],
    "[href]": ["One", "Two"],
    '[data-k~="w"]': ["Three"],
    'div[role="main"] a, h2': ["One", "Three"],
    "span div": ["Two"],
    "h2, h3": ["One"],
    "": [],
}


def test_selectors(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    sels = list(CASES)
    els = S.match(E.elements(df, tree=True), sels)
    rows = E.attach_content(els, F.size("hits") > 0, ["open", "hits"]).orderBy("open").collect()
    for rank, sel in enumerate(sels):
        assert [r.text.strip() for r in rows if rank in r.hits] == CASES[sel], sel


def test_unsupported_selector_is_an_error():
    with pytest.raises(ValueError):
        S._steps("a:hover")


def test_first_match_counts_attempts_by_index(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>")], "page_id long, html string")
    els = E.elements(df, tree=True)
    rows = {r.page_id: r for r in S.first_match(els, ["nav", "", ".card", "a"]).collect()}
    assert (rows[1].selector, rows[1].fallback_level, rows[1].element_count) == (".card", 2, 2)
    assert (rows[2].selector, rows[2].fallback_level, rows[2].element_count) == ("", -1, 0)
    capped = {r.page_id: r.fallback_level for r in S.first_match(els, ["nav", "", ".card"], max_attempts=2).collect()}
    assert capped == {1: -1, 2: -1}
