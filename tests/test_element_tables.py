"""Stored element tables, repeated page keys and the text index."""

import time
import uuid

from pyspark.sql import functions as F

from pagetide.operators import elements as E
from pagetide.operators import selectors
from pagetide.sources import element_tables

PAGE = "page_id long, html string"


def headings(els, key="page_id"):
    rows = E.attach_content(selectors.match(els, ["h1", "div > p"], key), F.size("hits") > 0, ["open", "tag"], key)
    return sorted((r.page_id, r.tag, r.text) for r in rows.collect())


def depths(els):
    return [(r.tag, r.depth) for r in els.where("open > 0").orderBy("open").collect()]


def test_a_second_fetch_replaces_the_page_and_never_mixes(spark, tmp_path):
    name, path = f"els_{uuid.uuid4().hex}", str(tmp_path / "els")
    first = [(i, f"<div><h1>A{i}</h1><p>x &amp; y</p></div>") for i in range(40)] + [(90, None), (91, ""), (None, "<h1>no id</h1>")]
    element_tables.write_elements(spark.createDataFrame(first, PAGE), name, path, buckets=4)
    files = len(list((tmp_path / "els").glob("*.parquet")))
    assert files <= 4  # a file per bucket
    second = [(i, first[i][1]) for i in range(38)] + [(38, "<!-- new -->" + first[38][1]), (39, "<body><div><div><p>B</p></div></div>"), (50, "<h1>C</h1>"), (90, "<p>late</p>")]
    assert element_tables.refresh(spark.createDataFrame(second, PAGE), name, buckets=4) == 1
    # Only the changed pages were parsed: a comment is no change.
    assert {r.page_id for r in spark.table(name).where("fetch = 1").collect()} == {39, 50, 90}
    want = [(i, t, x) for i in range(39) for t, x in (("h1", f"A{i}"), ("p", "x & y"))] + [(39, "p", "B"), (50, "h1", "C"), (None, "h1", "no id")]
    assert headings(element_tables.read_elements(spark, name).where("page_id is not null")) == sorted(w for w in want if w[0] is not None)
    parsed = E.elements(spark.createDataFrame([second[39]], PAGE), tree=True)
    assert depths(element_tables.read_elements(spark, name).where("page_id = 39")) == depths(parsed) and len(depths(parsed)) == 4
    assert element_tables.refresh(spark.createDataFrame(second, PAGE), name, buckets=4) == 2
    assert spark.table(name).where("fetch = 2").count() == 0
    roots = spark.table(name).where("open = 0").groupBy("page_id", "fetch").count()
    assert roots.where("count > 1").count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_page_queries_over_the_table_need_no_exchange(spark, tmp_path):
    name = f"els_{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(i, f"<main><nav><a href='/x{i}'>l</a></nav><h1>T{i}</h1></main>") for i in range(30)], PAGE)
    element_tables.write_elements(pages, name, str(tmp_path / "els"), buckets=4)
    els = element_tables.read_elements(spark, name)
    queries = {
        "texts": E.attach_content(selectors.match(els, ["main > h1", "nav a"]), F.size("hits") > 0, ["open"]),
        "first": selectors.first_match(els, ["main .card", "nav > a"]),
        "attributes": E.element_attributes(els),
    }
    for label, df in queries.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, label
        assert df.count(), label
    spark.sql(f"DROP TABLE {name}")


def test_rows_that_repeat_a_key_are_one_page(spark):
    pages = spark.createDataFrame([(1, "<div><h1>A</h1></div>"), (1, "<div><h1>B</h1></div>"), (1, None), (2, "<h1>C</h1>")], PAGE)
    els = E.elements(pages, tree=True)
    assert headings(els) == [(1, "h1", "B"), (2, "h1", "C")]
    assert depths(els.where("page_id = 1")) == depths(E.elements(pages.where("html like '%B%'"), tree=True))
    fetched = pages.where("html is not null").withColumn("fetch", F.xxhash64("html"))
    both = E.elements(fetched, ["page_id", "fetch"], tree=True)
    assert headings(both, ["page_id", "fetch"]) == [(1, "h1", "A"), (1, "h1", "B"), (2, "h1", "C")]


def texts(els):
    return sorted((r.page_id, r.open, r.tag, r.text) for r in E.attach_content(els, F.lit(True), ["open", "tag"]).collect())


def test_index_gives_the_same_texts_as_the_tokens(spark):
    bodies = [
        "<p>é &lt;b&gt; <b>日本 &amp; \U0001f600</b> tail<p>next<li>a<li>b &unknown; &#65;", "a < b <3 <!doctype x> & c", "", None, "   ", "text only &nbsp;",
        "<div>" * 30 + "deep" + "</div>" * 20, "<br>x<img src=a>y", "<script>no</script>yes<style>no</style>", "</p></p>x<p>",
    ]
    pages = spark.createDataFrame(list(enumerate(bodies)), PAGE)
    assert texts(E.element_spans(pages, index=True)) == texts(E.element_spans(pages))


def test_texts_of_deep_pages_are_quick(spark):
    def page(n):  # n nested elements with a word each: spans overlap n deep
        return spark.createDataFrame([(1, "<div>" * n + "".join(f"w{i}</div>" for i in range(n)))], PAGE)

    def took(n):
        els = E.element_spans(page(n), index=True)
        rows = E.attach_content(els, F.col("open") > 0, ["open"]).select(F.length("text").alias("n"))
        start = time.perf_counter()
        total = rows.agg(F.sum("n")).first()[0]
        return total, time.perf_counter() - start

    took(10)
    lengths = [len(f"w{i}") for i in range(3000)]
    small, large = took(1500), took(3000)
    assert large[0] == sum(n * (3000 - i) for i, n in enumerate(lengths))  # word i lies in all but i elements
    assert large[1] < 6 * small[1] + 2


def test_jobs_share_one_matching(spark):
    pages = spark.createDataFrame([
        (i, f"<main><article class='c{i % 3}'><h2>V 1.{i}</h2><a href='/patch/{i}'>x</a><p><b>t</b></p></article><p><b>u</b></p></main>") for i in range(9)
    ], PAGE)
    els = E.elements(pages, tree=True)
    jobs = {"a": ["main article h2", "main > article > a", "", "p b, h2"], "b": [".c1 p", "main article h2", "main p > b"], "none": ["", " "]}
    together = selectors.match_all(els, jobs)
    assert [c for c in together.columns if c in jobs] == list(jobs)
    for name, sels in jobs.items():
        alone = {(r.page_id, r.open): r.hits for r in selectors.match(els, sels).collect()}
        assert {(r.page_id, r.open): r[name] for r in together.collect()} == alone
        assert name == "none" or any(alone.values())


def test_releases_of_one_pass_equal_those_of_two(spark):
    from pagetide.operators import extract

    card = extract.CardSelectors(container=("article",), title=("h2",), url=("a",), image=("img",))
    base, when = "https://example.com", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    pages = spark.createDataFrame([
        (1, "<article><h2>Patch 1.2 notes</h2><a href='/p/1'>go</a><img src='/i.png'></article><main>" + "text " * 40 + "<img src='/hero.png'></main>"),
        (2, "<article><h2>Patch 1.3 notes</h2><a href='/p/2'>go</a></article><main>short</main>"), (3, "<p>no card</p>"), (4, None),
    ], PAGE)
    args = {"content": ("main", "body"), "heroes": (("main img", 9),)}
    once = extract.page_releases(pages, base, when, card, **args)
    twice = extract.release_records(extract.listing_cards(pages, base, when, card), extract.detail_pages(pages, **args), when, base)
    assert once.columns == twice.columns and sorted(once.collect()) == sorted(twice.collect()) and once.count() == 2
    plan = extract.page_releases(pages, base, when, card, **args)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    fetched = pages.withColumn("fetch", F.lit(1)).unionByName(pages.where("page_id = 2").select("page_id", F.replace("html", F.lit("1.3"), F.lit("1.4")).alias("html"), F.lit(2).alias("fetch")))
    both = extract.page_releases(fetched, base, when, card, key=["page_id", "fetch"], **args)
    assert {(r.page_id, r.fetch, r.version) for r in both.where("page_id = 2").collect()} == {(2, 1, "1.3"), (2, 2, "1.4")}


def test_parse_log_and_observed_counts_agree(spark):
    from pyspark.sql import Observation

    from pagetide.operators import extract, metrics

    card = extract.CardSelectors(container=("section::before", ".none", "article"), title=("h1", "h2"), url=("a",), image=("img",))
    good = "<article><h2>Patch 1.{0} notes</h2><a href='/p/{0}'>go</a></article>"
    pages = spark.createDataFrame([(i, good.format(i)) for i in range(5)] + [(10, "<p>none</p>"), (11, "<article>no title</article>"), (12, "<article><h2>Patch 2.1</h2></article>"), (13, None)], PAGE)
    when, seen = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), Observation("parses")
    cards = extract.listing_cards(pages, "https://example.com", when, card, log=True)
    extract.observe_parses(cards, seen).write.format("noop").mode("overwrite").save()
    log = extract.parse_log(cards)
    counts = {r.operation: (r.total, r.successful, r.failed) for r in metrics.operation_metrics(log).collect()}
    assert counts == {"container": (9, 7, 2), "title": (7, 6, 1), "url": (6, 5, 1), "image": (5, 0, 5)}
    assert {o: (seen.get[f"{o}_total"], seen.get[f"{o}_successful"]) for o in counts} == {o: c[:2] for o, c in counts.items()}
    rows = {(r.page_id, r.operation): r for r in log.collect()}
    assert rows[1, "container"].attempts == 3 and rows[1, "container"].fallback and rows[1, "title"].selector == "h2"
    assert rows[13, "container"].attempts == 3 and rows[13, "container"].error == "container_not_found"
    tried = extract.selector_log(cards)
    assert {r.outcome for r in tried.where("selector = 'section::before'").collect()} == {"error"}
    rates = {r.selector: r.success_rate for r in metrics.selector_rates(tried).collect()}
    assert rates["section::before"] == 0 and rates["article"] == 1 and ".none" not in rates  # a miss is not recorded
    try:
        extract.listing_cards(pages, "https://example.com", when, card).count()
    except ValueError:
        pass
    else:
        raise AssertionError("without a log an unreadable selector is an error")
