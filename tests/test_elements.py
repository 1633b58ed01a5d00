"""Tokens, element spans, tree, text and attributes."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import elements as E

VOID = {"br", "img", "hr", "meta"}
IMPLIED = {"p", "li"}


class Stack(HTMLParser):
    """Plain stack parser for well-formed pages with optional p and li ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.n = [], [], 0

    def _add(self, tag):
        self.found.append({"tag": tag, "depth": len(self.stack), "text": "", "parent": self.stack[-1] if self.stack else None})
        return len(self.found) - 1

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED and self.stack and self.found[self.stack[-1]]["tag"] == tag:
            self.stack.pop()
        at = self._add(tag)
        if tag not in VOID:
            self.stack.append(at)

    def handle_endtag(self, tag):
        while self.stack:
            if self.found[self.stack.pop()]["tag"] == tag:
                break

    def handle_data(self, data):
        for at in self.stack:
            self.found[at]["text"] += data


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["div", "section", "ul", "p", "b", "a", "br", "text", "img"])
        if kind == "text" or depth > 5:
            out.append(rng.choice(["x &amp; y", "word ", "&lt;q&gt;", "é "]))
        elif kind in VOID:
            out.append(f'<{kind} alt="a>b">' if kind == "img" else f"<{kind}>")
        elif kind == "ul":
            items = "".join(f"<li>{random_page(rng, depth + 2)}" for _ in range(rng.randint(1, 3)))
            out.append(f"<ul>{items}</ul>")
        elif kind == "p":
            out.append("<div>" + "".join(f"<p>t{i}<b>b</b>" for i in range(rng.randint(1, 3))) + "</div>")
        else:
            out.append(f'<{kind} class="c{rng.randint(1, 3)}">{random_page(rng, depth + 1)}</{kind}>')
    return "".join(out)


def element_rows(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string")
    els = E.with_tree(E.element_spans(df))
    rows = E.attach_content(els, F.col("open") > 0, ["open", "close", "tag", "depth", "parent"]).collect()
    out = {p: [] for p, _ in pages}
    for r in sorted(rows, key=lambda r: (r.page_id, r.open)):
        out[r.page_id].append(r)
    return out


def test_random_pages_match_a_stack_parser(spark):
    rng = random.Random(7)
    pages = [(i, f"<html><body>{random_page(rng)}</body></html>") for i in range(150)]
    got = element_rows(spark, pages)
    for page_id, html in pages:
        parser = Stack()
        parser.feed(html)
        rows = got[page_id]
        at = {r.open: i for i, r in enumerate(rows)}
        assert [(r.tag, r.depth, r.text) for r in rows] == [
            (f["tag"], f["depth"], f["text"]) for f in parser.found
        ], html
        assert [at.get(r.parent) for r in rows] == [f["parent"] for f in parser.found], html


def test_broken_pages_keep_nesting(spark):
    rng = random.Random(11)
    tags = ["div", "p", "li", "ul", "b", "a", "table", "tr", "td", "span"]
    pages = [
        (i, "".join(rng.choice([f"<{t}>", f"</{t}>", "x"]) for t in rng.choices(tags, k=40))) for i in range(150)
    ]
    for rows in element_rows(spark, pages).values():
        for i, a in enumerate(rows):
            assert a.close >= a.open
            for b in rows[i + 1:]:
                assert not (a.open < b.open < a.close < b.close), "spans overlap"


def test_nested_lists_tables_and_quotes(spark):
    html = (
        "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>one <b>two<p>three"
        "<table><tr><td>1<td>2<tr><td>3</table><img alt='x>y'><!-- <i> --><script>'</p>'</script>"
    )
    rows = element_rows(spark, [(1, html)])[1]
    text = [(r.tag, r.text) for r in rows]
    assert text[:5] == [("ul", "abcd"), ("li", "abc"), ("ul", "bc"), ("li", "b"), ("li", "c")]
    assert ("tr", "12") in text and ("tr", "3") in text and ("td", "2") in text
    assert ("p", "one two") in text and ("b", "two") in text
    assert ("script", "") in text and "i" not in [t for t, _ in text]


def test_closed_link_ends_open_paragraph(spark):
    rows = element_rows(spark, [(1, "<div><a><p>x<b>y</a><a>z</a></div>")])[1]
    assert [(r.tag, r.text) for r in rows] == [("div", "xyz"), ("a", "xy"), ("p", "xy"), ("b", "y"), ("a", "z")]


def test_pages_without_elements_keep_a_root_row(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a < b")], "page_id long, html string")
    rows = E.attach_content(E.element_spans(df), F.lit(True), ["open", "tag"]).collect()
    assert sorted((r.page_id, r.tag, r.text) for r in rows) == [
        (1, "#document", ""), (2, "#document", ""), (3, "#document", "a < b"),
    ]


def test_references_decode_once(spark):
    text = "a &amp;lt; &lt;i&gt; &#12497;&#x30D1; &copy; &unknown; &#0; &"
    got = spark.range(1).select(H.decode_entities(F.lit(text)).alias("t")).first().t
    assert got == "a &lt; <i> パパ © &unknown; � &"


def test_attributes_first_of_repeated_names(spark):
    tag = """<a HREF="/x?a=1&amp;b=2" title='q"r' data-n=7 href="/late" hidden>"""
    df = spark.createDataFrame([(1, f"{tag}t</a>")], "page_id long, html string")
    rows = E.element_attributes(E.elements(df)).collect()
    assert {r.name: r.value for r in rows} == {
        "href": "/x?a=1&b=2", "title": 'q"r', "data-n": "7", "hidden": "",
    }
    el = E.elements(df).where("tag = 'a'").select(
        H.attribute_map(F.col("attr_names"), F.col("attr_values")).alias("m"), H.attr("href").alias("h"), H.attr("no").alias("n")
    ).first()
    assert el.m["href"] == "/x?a=1&b=2" and el.h == "/x?a=1&b=2" and el.n is None


def test_one_shuffle_for_the_whole_element_model(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = E.elements(df, tree=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "Python" not in plan and "Join" not in plan


def test_tasks_follow_the_plain_size_of_the_html(spark):
    """Markup that repeats itself packs well, yet the windows hold it in full."""
    html = "<ul>" + "<li class='a'>item</li>" * 1000 + "</ul>"
    pages = spark.range(800).select(F.col("id").alias("page_id"), F.lit(html).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(None, "<p>x</p>"), (7, None)], "page_id long, html string"))
    assert E.page_tasks(pages) == -(-(800 * (len(html) + 100) + 8 + 200) // E.TASK_BYTES) == 5
    spans = E.element_spans(pages).where("open = 0").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(spans) == 5 and sum(r.n for r in spans) == 801 and max(r.n for r in spans) < 250
    assert E.page_tasks(pages.where("false")) == E.page_tasks(pages.limit(1)) == 2


def test_a_task_that_reads_much_html_spreads_it_before_it_is_dealt_by_key(spark, monkeypatch):
    """Beyond DIRECT_TASKS a writing task holds its rows: all HTML of a row group, if nothing spreads them first."""
    monkeypatch.setattr(E, "TASK_BYTES", 2000)
    monkeypatch.setattr(E, "HELD_BYTES", 4000)
    monkeypatch.setattr(E, "DIRECT_TASKS", 20)
    pages = spark.range(300).selectExpr("if(id % 50 = 49, null, id % 290) AS page_id", "concat('<p>', repeat('x', id), '</p>') AS html")
    few, many = pages.coalesce(1), pages.repartition(40)
    assert E.page_tasks(few) == E.page_tasks(many) > E.DIRECT_TASKS

    def exchanges(rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning(page_id"), plan.count("Exchange hashpartitioning(_dealt")

    spread = E.spread_pages(few)
    assert exchanges(spread) == (1, 1) and exchanges(E.spread_pages(many)) == (1, 0)
    assert spread.columns == ["page_id", "html"] and sorted(map(str, spread.collect())) == sorted(map(str, few.collect()))
    assert spread.rdd.getNumPartitions() == E.page_tasks(few)
    read = E.spread_rows(few, 20).groupBy(F.spark_partition_id()).agg(F.sum(F.length("html")).alias("n")).collect()
    assert len(read) == 20 and max(r.n for r in read) < 8000 < sum(r.n for r in read) / 5
    spans = [sorted(map(str, E.element_spans(p).drop("toks").collect())) for p in (few, many)]
    assert spans[0] == spans[1] and len(spans[0]) == 2 * 286
