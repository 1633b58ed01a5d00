"""Golden rows: titles, versions, URLs, image checks, cards, details."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagetide.functions import text as X
from pagetide.functions import titles as N
from pagetide.functions import urls as U
from pagetide.operators import checks, content, edits, extract, patterns, tasks

BASE = "https://www.example.com"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,expected", [
    ("パッチノート 14.1", "パッチノート 14.1"), ("Patch Notes 14.2", "パッチノート 14.2"),
    ("アップデート 14.3", "パッチノート 14.3"), ("Update 14.4", "パッチノート 14.4"),
    ("パッチ14.1ノート", "パッチノート 14.1"), ("PATCH　14.2.3", "パッチノート 14.2.3"), ("パッチ5ノート", None),
])
def test_titles(spark, text, expected):
    assert one(spark, N.release_title(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("パッチノート 14.1", "14.1"), ("Patch 14.2.1", "14.2.1"), ("v14.3", "14.3"), ("1.2 then 3.4.5", "3.4.5"),
    ("No version here", "2024.02.03"),
])
def test_versions(spark, text, expected):
    assert one(spark, N.release_version(F.lit(text), F.lit(datetime.datetime(2024, 2, 3)))) == expected


def test_backlog(spark):
    assert one(spark, N.version_backlog(F.lit("25.3"), 5)) == ["25.3", "25.2", "25.1"]
    assert one(spark, N.version_backlog(F.lit("25.0"), 5)) == ["25.0"]
    assert one(spark, N.version_backlog(F.lit("25"), 5)) == []


@pytest.mark.parametrize("url,expected", [
    ("https://a.example/x", "https://a.example/x"), ("//a.example/x", "https://a.example/x"),
    ("/x", BASE + "/x"), ("x", BASE + "/x"), ("", ""), (None, ""),
])
def test_normalised_urls(spark, url, expected):
    assert one(spark, U.normalise_url(F.lit(url).cast("string"), BASE)) == expected


STRICT = U.ImagePolicy(strict=True, formats=("jpg", "png"))
SVG = 'data:image/svg+xml,<svg xmlns="http://www.w3.org/2000/svg"/>'


@pytest.mark.parametrize("url,policy,reason,protocol,fmt", [
    ("https://example.com/image.jpg", U.DEFAULT_POLICY, None, "https:", "jpg"),
    ("http://example.com/image.png", U.DEFAULT_POLICY, None, "http:", "png"),
    ("data:image/png;base64," + "a" * 200, U.DEFAULT_POLICY, None, "data:", "png"),
    ("", U.DEFAULT_POLICY, "empty_or_invalid_input", "unknown", None),
    (None, U.DEFAULT_POLICY, "empty_or_invalid_input", "unknown", None),
    ("http://example.com/image.jpg", U.ImagePolicy(protocols=("https:",)), "unsupported_protocol", "http:", None),
    ("invalid-url-format", U.DEFAULT_POLICY, "invalid_url_format", "unknown", None),
    ("ht!tp://invalid", U.DEFAULT_POLICY, "invalid_url_format", "unknown", None),
    ("http://", U.DEFAULT_POLICY, "invalid_url_format", "http:", None),
    (SVG, U.DEFAULT_POLICY, "empty_svg_data_url", "data:", None),
    ("data:image/png;base64,abc", U.DEFAULT_POLICY, "data_url_too_short", "data:", None),
    ("data:image/png;" + "x" * 100 + "base64,abc", U.DEFAULT_POLICY, "invalid_base64_data", "data:", None),
    ("https://example.com/" + "a" * 200 + ".jpg", U.ImagePolicy(max_url=100), "url_too_long", "https:", None),
    ("https://example.com/image.tiff", STRICT, "unsupported_format", "https:", None),
    ("https://example.com/image.tiff", U.DEFAULT_POLICY, None, "https:", None),
    ("ftp://example.com/image.jpg", U.DEFAULT_POLICY, "unsupported_protocol", "unknown", None),
    ("/images/photo.jpg", U.DEFAULT_POLICY, "unsupported_protocol", "relative", None),
    ("//cdn.example.com/a.webp", U.DEFAULT_POLICY, None, "protocol-relative", "webp"),
])
def test_image_checks(spark, url, policy, reason, protocol, fmt):
    got = one(spark, U.check_image(F.lit(url).cast("string"), policy))
    assert (got.reason, got.protocol, got.format, got.is_valid) == (reason, protocol, fmt, reason is None)
    assert (got.recommendations is not None) == (reason == "unsupported_format")


def test_custom_rules_run_by_priority(spark):
    fail = lambda u: F.lit(False)
    policy = U.ImagePolicy(rules=(U.Rule("low", fail, "", 1), U.Rule("high", fail, "", 9), U.Rule("odd", lambda u: F.lit(None).cast("boolean"), "", 99)))
    assert one(spark, U.reject_reason(F.lit("https://e.com/a.jpg"), policy)) == "custom_rule_high"


def test_validation_metrics(spark):
    df = spark.createDataFrame([("https://e.com/a.jpg",), ("invalid",), ("https://e.com/b.png",)], "url string")
    checked = checks.validate_urls(df)
    assert tuple(checks.validation_totals(checked).first()) == (3, 2, 1)
    dist = {(r.dimension, r.value): r.n for r in checks.validation_distributions(checked).collect()}
    assert dist == {
        ("reason", "invalid_url_format"): 1, ("protocol", "https:"): 2, ("protocol", "unknown"): 1,
        ("format", "jpg"): 1, ("format", "png"): 1,
    }


def page(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def as_of():
    return F.lit(datetime.datetime(2024, 2, 3))


def test_listing_cards(spark):
    card = (
        '<div class="sc-4d29e6fd-0"><a class="action" href="/ja/news/patch-14-{0}">'
        '<div class="sc-6fae0810-0">パッチ14.{0}ノート</div><img src="{1}"></a></div>'
    )
    rows = extract.listing_cards(
        page(
            spark,
            "<body>" + card.format(1, "https://i.example/t1.jpg") + card.format(2, "https://i.example/t2.jpg") + "</body>",
            card.format(1, "data:image/svg+xml,<svg/>"),
            "<html><body>No container</body></html>",
            "<article>no title <a href='/patch-1'>x</a></article>",
            "<article><h1>Patch 1.2</h1></article>",
            "<article><h1>Patch 1.2</h1></article><a href='/other'>o</a><a href='/patch-9'>p</a><img src='https://e.com/news.png'>",
            "<article>Patch 3.4 <a href='x'>y</a></article>",
        ),
        BASE, as_of(),
    ).orderBy("page_id").collect()
    assert [r.status for r in rows] == [
        "ok", "ok", "container_not_found", "title_not_found", "url_not_found", "ok", "ok",
    ]
    assert (rows[0].title, rows[0].version, rows[0].url_selector) == ("パッチノート 14.1", "14.1", "container-href")
    assert rows[0].normalised_url == BASE + "/ja/news/patch-14-1" and rows[0].image_url == "https://i.example/t1.jpg"
    assert rows[1].image_url is None
    assert (rows[5].url, rows[5].url_selector, rows[5].image_url) == ("/patch-9", "document-fallback", "https://e.com/news.png")
    assert (rows[6].title_selector, rows[6].url_selector) == ("container-text", "a")


def test_empty_src_blocks_data_src(spark):
    html = "<article><h1>Patch 1.2</h1><a href='/a'>a</a><img src='' data-src='https://e.com/a.png'></article>"
    row = extract.listing_cards(page(spark, html), BASE, as_of()).first()
    assert row.image_url is None


def test_detail_pages(spark):
    rows = extract.detail_pages(page(
        spark,
        "<main><h1>T</h1><article><p>short</p><img src='https://e.com/a_1920x1080.jpg'></article></main>",
        "<main>" + "a" * 100 + "</main>", "<main>  " + "a" * 50 + " \n　 " + "b" * 50 + " </main>",
        "<main>x</main><article>" + "y" * 60 + "</article><article>" + "z" * 60 + "</article>",
    )).orderBy("page_id").collect()
    assert rows[0].content is None and rows[0].image_url == "https://e.com/a_1920x1080.jpg"
    assert rows[1].content is None and rows[2].content == "a" * 50 + " " + "b" * 50
    assert (rows[3].content_selector, rows[3].content) == ("article", "y" * 60 + "z" * 60)


def test_text_statistics(spark):
    t = "The cat sat. Was it  happy? Yes!  ..."
    got = spark.range(1).select(
        X.word_count(F.lit(t)).alias("w"), X.sentence_count(F.lit(t)).alias("s"),
        X.syllable_count(F.lit("Go at noon")).alias("y"), X.syllable_count(F.lit("...")).alias("y0"),
        X.language_tag(F.lit("パッチ notes")).alias("ja"), X.language_tag(F.lit(" 　")).alias("none"),
        X.keywords(F.lit("Beta it's alpha, beta alpha gamma café cafe")).alias("k"),
        X.readability(F.lit(0), F.lit(0), F.lit(1)).alias("r0"),
    ).first()
    assert (got.w, got.s, got.y, got.y0, got.ja, got.none, got.r0) == (8, 3, 2, 1, "ja", "unknown", 0.0)
    assert [(k.word, k.n) for k in got.k] == [("beta", 2), ("alpha", 2), ("gamma", 1), ("cafe", 1)]


def test_publish_date_order(spark):
    rows = content.page_metadata(page(
        spark,
        "<time datetime='2024-01-05'>x</time><meta name='publish_date' content='January 6, 2024'>",
        "<i class='date'>nonsense</i>", "<meta name='description' content=''><h1>Only <b>h1</b></h1>",
        "<time datetime='2024-01-05T10:00:00+09:00'>x</time>", "<b class='date'>Fri, 5 Jan 2024 10:00:00 GMT</b>",
    )).withColumn("ms", F.unix_millis("publish_date")).orderBy("page_id").collect()
    utc = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert [r.ms for r in rows] == [utc(2024, 1, 6), None, None, utc(2024, 1, 5, 1), utc(2024, 1, 5, 10)]
    assert rows[2].title == "Only h1" and rows[2].description is None


def test_outline(spark):
    html = "<section id='s'></section><article class='c d'></article><div role='main'></div><h2> A </h2><h3> </h3><i class='person'></i>"
    rows = content.page_outline(page(spark, html)).collect()
    assert sorted((r.kind, r.pos, r.value) for r in rows) == [
        ("entity", 0, ""), ("section", 0, "s"), ("section", 1, "c d"), ("section", 2, "unnamed"), ("topic", 0, "A"),
    ]


@pytest.mark.parametrize("edit,expected", [
    (edits.Edit("remove", "b"), "<div id=\"d\"><p>x<p>z</div>"),
    (edits.Edit("replace", "b", "<i>n</i>"), "<div id=\"d\"><p>x<i>n</i><p>z</div>"),
    (edits.Edit("replace", "b"), "<div id=\"d\"><p>x<b>y</b><p>z</div>"),
    (edits.Edit("add", "div", "E"), "<div id=\"d\"><p>x<b>y</b><p>zE</div>"),
    (edits.Edit("add", "div", "E", position="prepend"), "<div id=\"d\">E<p>x<b>y</b><p>z</div>"),
    (edits.Edit("add", "b", "E", position="before"), "<div id=\"d\"><p>xE<b>y</b><p>z</div>"),
    (edits.Edit("add", "b", "E", position="after"), "<div id=\"d\"><p>x<b>y</b>E<p>z</div>"),
    (edits.Edit("modify", "div", "a<c", {"id": "n", "k": 'q"'}), "<div id=\"n\" k=\"q&quot;\">a&lt;c</div>"),
    (edits.Edit("modify", "div", attributes={"k": "v"}), "<div id=\"d\" k=\"v\"><p>x<b>y</b><p>z</div>"),
    (edits.Edit("remove", "nav"), "<div id=\"d\"><p>x<b>y</b><p>z</div>"),
    (edits.Edit("remove", "div"), ""),
])
def test_edits(spark, edit, expected):
    html = '<div id="d"><p>x<b>y</b><p>z</div>'
    assert edits.edit_pages(page(spark, html), [edit]).first().html == expected


def test_edits_see_earlier_edits(spark):
    ops = [edits.Edit("add", "p", "<i>n</i>"), edits.Edit("modify", "i", "m"), edits.Edit("remove", "b")]
    assert edits.edit_pages(page(spark, "<p><b>x</b></p>"), ops).first().html == "<p><i>m</i></p>"


def test_tasks_and_patterns(spark):
    pages = page(spark, "<ul><li>one<li><a href='#'>two</a></ul>", "<p></p>")
    todo = [tasks.Task("s", "search", ["li", "img"]), tasks.Task("a", "analyze", ["li", "img"], 5), tasks.Task("x", "nope", ["p"], 9)]
    found = tasks.search_tasks(pages, todo).collect()
    assert [(r.page_id, r.selector, r.n, r.texts) for r in found] == [(0, "li", 2, ["one", "two"])]
    stats = {(r.page_id, r.selector): (r.n, r.mean_text, r.has_links) for r in tasks.analyse_tasks(pages, todo).collect()}
    assert stats[0, "li"] == (2, 3.0, True) and stats[1, "img"] == (0, 0.0, False)
    batch = tasks.task_batch(pages.where("page_id = 0"), todo).orderBy("batch_order").collect()
    assert [(r.task_id, r.success) for r in batch] == [("x", False), ("a", True), ("s", True)]
    hits = patterns.pattern_hits(pages, [patterns.Pattern("p", ["li", "ul li"], regex="o")]).collect()
    assert len(hits) == 4  # an element found by two selectors counts twice
    assert patterns.xpath_hits(pages, "//p").count() == 0 and patterns.xpath_hits(pages, "//a").count() == 1


def test_chunks_lose_cut_tags(spark):
    pages = page(spark, "<p>aaaa</p><p>bb</p>")
    rows = patterns.chunk_hits(pages, ["p"], size=12).orderBy("chunk", "open").collect()
    assert [(r.chunk, r.position, r.text) for r in rows] == [(0, 0, "aaaa")]


def test_limits_are_parameters(spark):
    from pagetide.operators import notices, responses

    row = spark.createDataFrame([("1", "u", "s" * 30, ["a"], ["x", "y", "z"], None, None, "m", None)], "version string, url string, summary string, key_changes array<string>, new_features array<string>, important_bug_fixes array<string>, skin_content array<string>, model string, generated_at timestamp_ntz")
    fields = row.select(notices.notice_fields(list_items=2, field_chars=10).alias("f")).first().f
    values = [f.value for f in fields]
    assert values[2] == "s" * 10 + "..." and values[4] == "1. x\n\n2. y"
    assert row.select(notices.notice_fields(list_items=None).alias("f")).first().f[4].value == "1. x\n\n2. y\n\n3. z"
    raw = spark.createDataFrame([("no json at all",)], "response string")
    assert responses.parse_responses(raw, "m", F.lit(None).cast("timestamp_ntz"), fallback_chars=4).first().summary == "no j..."


def test_edits_may_cut_the_plan(spark):
    from pagetide.operators import edits

    pages = spark.createDataFrame([(1, "<p>a</p><b>b</b><i>c</i><u>d</u>")], "page_id long, html string")
    jobs, seen = [edits.Edit("remove", t) for t in ("p", "b", "i")], []
    whole = edits.edit_pages(pages, jobs).first().html
    cut = edits.edit_pages(pages, jobs, cut=lambda df: seen.append(1) or spark.createDataFrame(df.collect(), df.schema), cut_every=1).first().html
    assert whole == cut == "<u>d</u>" and len(seen) == 2
