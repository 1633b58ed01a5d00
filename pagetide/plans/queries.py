"""Registered queries: each is a callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import dataclasses
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions import html as H
from pagetide.functions import masking as M
from pagetide.functions import text as X
from pagetide.functions import titles as N
from pagetide.functions import urls as U
from pagetide.operators import checks, content, edits, extract, metrics, notices
from pagetide.operators import elements as E
from pagetide.operators import patterns as P
from pagetide.operators import profile as R
from pagetide.operators import responses, selectors, state, tasks
from pagetide.plans import inputs as I
from pagetide.session import checkpoint_dir
from pagetide.sources import element_tables, stores
from pagetide.sources.versions import VersionedTable
from pagetide.streaming import jobs
from pagetide.streaming.keyed import open_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BASE_URL = "https://www.example.com"
PRODUCT = "Release notices"
MODEL = "summary-model"
AS_OF = "2024-01-31 00:00:00"
NAV_CARD = extract.CardSelectors(
    container=("main .card", "body"), title=("h2", "h1"), url=("p a", "nav a"), image=("img",)
)
LIST_CARD = extract.CardSelectors(
    container=(".missing", "section.grid > .card", "div section[class~=grid]"),
    title=(".title", "h3", "p"),
    url=("", 'a[href*="patch"]', "a.go", "a"),
    image=('img[src*="patch"]', "img.hero", "img"),
)
LIST_HEROES = (
    ('img[src*="1920x1080"]', 100), ("section img", 60), ('aside img[src*="news"]', 50), ("img", 90),
)
EDITS = (
    edits.Edit("remove", "nav, .ad, script, style"),
    edits.Edit("modify", "article", attributes={"data-clean": "1"}),
)
TASKS = (
    tasks.Task("t1", "extract", ("nav li", "h1"), 1),
    tasks.Task("t2", "search", ("article p", "b", "table"), 5),
    tasks.Task("t3", "analyze", ("nav", "article", "img", "li"), 3),
    tasks.Task("t4", "unknown", ("p",), 9),
)
PATTERNS = (
    P.Pattern("link", ("nav a", "li a"), priority=1),
    P.Pattern("lead", ("article p",), regex=r"(?i)the\b", priority=9),
    P.Pattern("heading", ("h1",), keep=lambda: F.length("text") > 60, value=lambda: F.upper("text"), priority=5),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def ms(column: str):
    return F.unix_millis(F.col(column))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster; local only in local mode."""
    shared = checkpoint_dir(spark)
    if shared:
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor sees")
    return tempfile.mkdtemp(prefix=f"{name}-")


def _pages(spark, sf):
    return stores.read_pages(spark, f"{sf}/pages.parquet")


def _listings(spark, sf):
    columns = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return I.derive(spark, sf, I.LISTINGS, part=I.dealt_rows(table(spark, sf, "part").select(*columns)))


# ---- tokens and elements --------------------------------------------------


@query
def page_scan(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.length("html").alias("n_chars"))


@query
def page_tokens(spark, sf):
    return E.page_tokens(_pages(spark, sf)).select("page_id", "pos", "kind", "tag", "token")


@query
def page_elements(spark, sf):
    els = E.with_tree(E.element_spans(_pages(spark, sf)))
    return els.where("open > 0").select("page_id", "open", "close", "tag", "depth", "parent")


@query
def listing_elements(spark, sf):
    els = E.with_tree(E.element_spans(_listings(spark, sf)))
    return els.where("open > 0").select("page_id", "open", "close", "tag", "depth", "parent")


@query
def element_attributes(spark, sf):
    return E.element_attributes(E.open_tags(_listings(spark, sf)))


@query
def element_text(spark, sf):
    els = E.element_spans(_pages(spark, sf), index=True)
    return E.attach_content(els, F.col("open") > 0, ["open", "tag"])


@query
def selector_hits(spark, sf):
    els = E.elements(_pages(spark, sf), tree=True)
    sels = ["nav > ul > li", "ul a", "article > p > b", 'a[href^="/t"]', "h1, footer", "p > a"]
    return selectors.selector_hits(els, sels).select("page_id", "open", "tag", "rank", "selector")


@query
def first_match(spark, sf):
    els = E.elements(_pages(spark, sf), tree=True)
    sels = ["main .card", "", 'nav a[href^="/e"]', "div > article", "article b"]
    return selectors.first_match(els, sels)


@query
def page_first_card(spark, sf):
    cards = extract.listing_cards(
        _pages(spark, sf), BASE_URL, as_of(), NAV_CARD, title_of=lambda t: F.nullif(X.trim_space(t), F.lit(""))
    )
    return cards.select(
        "page_id", "status", "container_selector", "title", "title_selector", "url", "url_selector",
        "normalised_url", "version",
    )


def _element_table(spark, sf):
    """Pages parsed into a bucketed table, then a second crawl in which every third page has another markup."""
    name = f"elements_{uuid.uuid4().hex}"
    element_tables.write_elements(_pages(spark, sf), name, work_folder(spark, "elements"), buckets=16)
    again = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<main><h1>Next "), F.col("page_id").cast("string"), F.lit(" &amp; on</h1><p>a<b>b</b></p></main>"))).otherwise(F.col("html"))
    element_tables.refresh(_pages(spark, sf).withColumn("html", again), name, buckets=16)
    return element_tables.read_elements(spark, name)


@query
def table_elements(spark, sf):
    """Elements of the newest fetch of every page, from the stored table."""
    return _element_table(spark, sf).where("open > 0").select("page_id", "open", "close", "tag", "depth", "parent")


@query
def table_texts(spark, sf):
    """Headings, paragraphs and bold text of the stored table, by selector and text index."""
    els = selectors.match(_element_table(spark, sf), ["h1", "p", "p > b"])
    return E.attach_content(els, F.size("hits") > 0, ["open", "tag"])


@query
def nav_links(spark, sf):
    els = selectors.match(E.elements(_pages(spark, sf)), ["nav a"])
    rows = E.attach_content(els, F.size("hits") > 0, ["open", "attr_names", "attr_values"])
    href = H.attr("href")
    return rows.select(
        "page_id", "open", "text", href.alias("href"), U.normalise_url(href, BASE_URL).alias("url")
    )


@query
def heading_titles(spark, sf):
    els = selectors.match(E.element_spans(_pages(spark, sf)).withColumns(
        {"attr_names": F.array().cast("array<string>"), "attr_values": F.array().cast("array<string>")}
    ), ["h1, h2, h3, title"])
    rows = E.attach_content(els, F.size("hits") > 0, ["open", "tag"])
    return rows.select("page_id", "open", "tag", X.trim_space(F.col("text")).alias("title"))


# ---- cards and details ----------------------------------------------------


def _cards(spark, sf):
    return extract.listing_cards(_listings(spark, sf), BASE_URL, as_of(), LIST_CARD)


@query
def listing_cards(spark, sf):
    return _cards(spark, sf).drop("title_selector", "url_selector", "image_url")


@query
def card_titles(spark, sf):
    return _cards(spark, sf).select("page_id", "title", "title_selector")


@query
def card_urls(spark, sf):
    return _cards(spark, sf).select("page_id", "url", "url_selector", "normalised_url")


@query
def image_urls(spark, sf):
    return _cards(spark, sf).select("page_id", "image_url")


@query
def card_rejects(spark, sf):
    return _cards(spark, sf).where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))


@query
def release_titles(spark, sf):
    text = F.concat_ws(
        " ", F.col("p_type"),
        F.when(F.col("p_partkey") % 3 == 0, "PATCH  NOTE").when(F.col("p_partkey") % 3 == 1, "パッチ").otherwise("Updates"),
        F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 25).cast("string")),
    )
    return table(spark, sf, "part").select(
        "p_partkey", text.alias("text"), N.release_title(text).alias("title")
    )


@query
def release_versions(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", N.release_version(F.col("text"), as_of()).alias("version")
    )


@query
def normalised_urls(spark, sf):
    rows = I.derive(spark, sf, I.ADDRESSES)
    return rows.select("id", U.normalise_url(F.col("url"), BASE_URL).alias("normalised"))


@query
def release_backlog(spark, sf):
    rows = I.derive(spark, sf, I.ADDRESSES)
    return rows.select("id", F.explode(N.version_backlog(F.col("version"), 5)).alias("version"))


@query
def page_content(spark, sf):
    return extract.detail_pages(_pages(spark, sf)).select("page_id", "content_selector", "content")


@query
def hero_images(spark, sf):
    return extract.detail_pages(_listings(spark, sf), heroes=LIST_HEROES).select(
        "page_id", "image_selector", "image_url"
    )


@query
def release_records(spark, sf):
    return extract.page_releases(
        _listings(spark, sf), BASE_URL, as_of(), LIST_CARD, content=("main", "section", "body"), heroes=LIST_HEROES)


# ---- patterns, chunks, tasks, edits ---------------------------------------


def _shown_attributes():
    return F.array_join(F.zip_with("attr_names", "attr_values", lambda n, v: F.concat(n, F.lit("="), F.coalesce(v, F.lit("")))), ";")


@query
def xpath_hits(spark, sf):
    rows = P.xpath_hits(_listings(spark, sf), "//*[@class]")
    return rows.select(
        "page_id", "open", "tag", "text", "inner_html", _shown_attributes().alias("attributes"),
        H.attr("class").alias("class"),
    )


@query
def pattern_hits(spark, sf):
    rows = P.pattern_hits(_pages(spark, sf), PATTERNS)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query
def match_confidence(spark, sf):
    rows = P.pattern_hits(_listings(spark, sf), [P.Pattern("any", ("[class], [id], b",))])
    return rows.select("page_id", "open", "tag", F.round("confidence", 6).alias("confidence"))


@query
def element_positions(spark, sf):
    return P.element_positions(E.with_tree(E.element_spans(_pages(spark, sf))))


@query
def chunk_hits(spark, sf):
    rows = P.chunk_hits(_pages(spark, sf), ["li", "p", "h1, h2"], size=1500)
    return rows.select("page_id", "chunk", "position", "selector", "open", "tag", "text", "inner_html", _shown_attributes().alias("attributes"))


@query
def page_edits(spark, sf):
    return edits.edit_pages(_pages(spark, sf), EDITS)


@query
def task_extract(spark, sf):
    rows = tasks.extract_tasks(_pages(spark, sf), TASKS)
    return rows.select("page_id", "task_id", "selector", "open", "tag", "text", "inner_html", _shown_attributes().alias("attributes"))


@query
def task_search(spark, sf):
    rows = tasks.search_tasks(_pages(spark, sf), TASKS)
    return rows.withColumn("texts", F.array_join("texts", "|"))


@query
def task_analyse(spark, sf):
    rows = tasks.analyse_tasks(_pages(spark, sf), TASKS)
    return rows.withColumn("mean_text", F.round("mean_text", 6))


@query
def task_batch(spark, sf):
    return tasks.task_batch(_pages(spark, sf), TASKS)


# ---- URL checks -----------------------------------------------------------


def _links(spark, sf):
    pages = _pages(spark, sf)
    els = E.open_tags(pages)
    hrefs = els.where("tag = 'a'").select("page_id", H.attr("href").alias("url")).where("url is not null")
    return pages.select("page_id", "url").unionByName(hrefs)


def _addresses(spark, sf):
    return I.derive(spark, sf, I.ADDRESSES)


@query
def link_validation(spark, sf):
    checked = checks.validate_urls(_links(spark, sf))
    return checked.groupBy("url", "is_valid", "reason", "protocol", "format", "size").agg(F.count("*").alias("n"))


@query
def image_validation(spark, sf):
    strict = U.ImagePolicy(
        strict=True,
        rules=(
            U.Rule("no_query", lambda u: ~u.contains("?"), "query", 1),
            U.Rule("short", lambda u: F.length(u) < 150, "long", 5),
            U.Rule("maybe", lambda u: F.lit(None).cast("boolean"), "", 9),
        ),
    )
    checked = checks.validate_urls(_addresses(spark, sf), policy=strict)
    return checked.select(
        "id", "is_valid", "reason", "protocol", "format", "size",
        F.array_join("recommendations", "; ").alias("recommendations"), "message",
    )


@query
def validation_totals(spark, sf):
    return checks.validation_totals(checks.validate_urls(_addresses(spark, sf)))


@query
def url_distributions(spark, sf):
    return checks.validation_distributions(checks.validate_urls(_addresses(spark, sf)))


@query
def url_protocols(spark, sf):
    return _addresses(spark, sf).select(
        "id", U.url_protocol(F.col("url")).alias("protocol"), U.reported_protocol(F.col("url")).alias("reported"),
        U.image_format(F.col("url")).alias("format"),
    )


@query
def image_keys(spark, sf):
    return _addresses(spark, sf).select(
        "id", U.image_file_key(F.col("url"), F.col("version")).alias("file_key")
    )


@query
def webhook_filter(spark, sf):
    url = F.concat(
        F.when(F.col("s_suppkey") % 3 == 0, "https://discord.com").otherwise("https://discordapp.com"),
        F.lit("/api/webhooks/"), F.col("s_suppkey").cast("string"), F.lit("/"),
        F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("#"), F.lit("-"))).otherwise(F.col("s_name")),
    )
    return table(spark, sf, "supplier").select(
        "s_suppkey", url.alias("url"), U.is_webhook_url(url).alias("ok")
    )


# ---- text -----------------------------------------------------------------


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query
def text_counts(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", X.word_count(t).alias("words"), F.length(t).alias("characters"),
        X.sentence_count(t).alias("sentences"),
    )


@query
def keywords(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(X.keywords(F.col("text"))).alias("rank", "k"))
    return rows.select("doc_id", "rank", F.col("k.word").alias("word"), F.col("k.n").alias("n"))


@query
def readability(spark, sf):
    t = F.col("text")
    counted = _docs(spark, sf).select(
        "doc_id", X.word_count(t).alias("w"), X.sentence_count(t).alias("s"), X.syllable_count(t).alias("y")
    )
    score = X.readability(F.col("w"), F.col("s"), F.col("y"))
    return counted.select("doc_id", F.round(score, 6).alias("score"))


@query
def syllables(spark, sf):
    return _docs(spark, sf).select("doc_id", X.syllable_count(F.col("text")).alias("syllables"))


@query
def language_tag(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.repeat(F.lit("パッチ漢字"), F.length("text") / 20)))
    t = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n")).otherwise(F.coalesce(mixed, "text"))
    return _docs(spark, sf).select("doc_id", X.language_tag(t).alias("language"))


# ---- page content ---------------------------------------------------------


@query
def page_metadata(spark, sf):
    rows = content.page_metadata(_pages(spark, sf))
    return rows.select("page_id", "title", "description", "author")


def _dated_pages(spark, sf):
    """Detail pages made from orders: five places and layouts for the date."""
    d = F.col("o_orderdate")
    layouts = (
        ("yyyy-MM-dd'T'HH:mm:ss'Z'", '<meta property="article:published_time" content="%s">'),
        ("MMMM d, yyyy", '<meta name="publish_date" content="%s">'),
        ("yyyy-MM-dd", '<time datetime="%s">then</time>'),
        ("MMM d, yyyy", '<i class="publish-date">%s</i>'),
        ("'soon' yyyy", '<b class="date">%s</b><b class="date">2001-01-01</b>'),
    )
    head = F.lit("")
    for i, (layout, markup) in enumerate(layouts):
        made = F.format_string(markup, F.date_format(d, layout))
        head = F.when(F.col("o_orderkey") % len(layouts) == i, made).otherwise(head)
    html = F.concat(F.lit("<html><body><p>x</p>"), head, F.lit("</body></html>"))
    orders = I.dealt_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


@query
def publish_dates(spark, sf):
    rows = content.page_metadata(_dated_pages(spark, sf))
    return rows.select("page_id", ms("publish_date").alias("published_ms"))


@query
def page_outline(spark, sf):
    return content.page_outline(_listings(spark, sf)).unionByName(content.page_outline(_pages(spark, sf)))


@query
def content_profile(spark, sf):
    rows = content.content_profile(_pages(spark, sf), readability=True, language=True)
    return rows.select(
        "page_id", "word_count", "character_count", "paragraph_count", "heading_count", "link_count",
        "image_count", "title", F.array_join("keywords", " ").alias("keywords"),
        F.array_join("sections", "|").alias("sections"), F.array_join("topics", "|").alias("topics"),
        F.round("readability", 6).alias("readability"), "language",
    )


# ---- structure ------------------------------------------------------------


@query
def page_structure(spark, sf):
    return R.page_structure(E.elements(_listings(spark, sf), tree=True), grid=".grid")


@query
def page_classes(spark, sf):
    return R.available_classes(E.open_tags(_listings(spark, sf)))


@query
def page_links(spark, sf):
    rows = R.link_elements(E.elements(_listings(spark, sf), tree=True))
    return rows.withColumn("classes", F.array_join("classes", " "))


@query
def page_images(spark, sf):
    rows = R.image_elements(E.open_tags(_listings(spark, sf)))
    return rows.withColumn("classes", F.array_join("classes", " "))


@query
def page_depth(spark, sf):
    return R.structure_depth(E.with_tree(E.element_spans(_pages(spark, sf))))


@query
def unique_selectors(spark, sf):
    return R.unique_selectors(E.open_tags(_listings(spark, sf)))


@query
def grid_containers(spark, sf):
    rows = R.grid_containers(E.elements(_listings(spark, sf), tree=True), ".grid")
    return rows.withColumn("classes", F.array_join("classes", " "))


@query
def element_analysis(spark, sf):
    rows = R.element_analysis(E.elements(_listings(spark, sf)), ["a.card img", "span", ".hero"])
    return rows.select(
        "page_id", "element_count", "tag", F.array_join("classes", " ").alias("classes"),
        F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attributes"),
        "text", "href", "is_valid",
    )


@query
def element_children(spark, sf):
    rows = R.element_children(E.elements(_listings(spark, sf), tree=True), ["section.grid", "section"])
    return rows.withColumn("classes", F.array_join("classes", " "))


@query
def image_sizes(spark, sf):
    rows = R.image_analysis(R.image_elements(E.open_tags(_listings(spark, sf))))
    return rows.withColumn("mean_size", F.round("mean_size", 6))


@query
def image_formats(spark, sf):
    return R.image_formats(R.image_elements(E.open_tags(_listings(spark, sf))))


# ---- state ----------------------------------------------------------------


def _snapshots(spark, sf):
    return I.derive(spark, sf, I.SNAPSHOTS)


def _state(spark, sf):
    return I.derive(spark, sf, I.STATE)


def _records(spark, sf):
    return I.derive(spark, sf, I.RECORDS)


@query
def new_releases(spark, sf):
    return state.new_releases(_snapshots(spark, sf), _state(spark, sf)).select(
        "source", "snap_id", "version", "url"
    )


@query
def change_feed(spark, sf):
    bucket = F.date_trunc("month", F.col("ts"))
    return state.change_feed(_snapshots(spark, sf), ["source"], bucket, ["ts", "snap_id"])


@query
def event_changes(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return state.change_feed(
        events, ["user_id"], F.to_date("ts"), ["ts", "event_id"], ["event_type"]
    ).select("user_id", "event_id", "event_type")


@query
def state_merge(spark, sf):
    sent = _snapshots(spark, sf).select(
        "source", "version", "title", "url", F.col("ts").alias("published_at"), F.col("ts").alias("sent_at")
    )
    return state.merge_state(_state(spark, sf), sent)


@query
def state_repair(spark, sf):
    return state.repair_state(_state(spark, sf), as_of()).select("source", "total", "last_notification")


@query
def stored_releases(spark, sf):
    return state.readable_releases(_records(spark, sf))


def _wanted(spark, sf):
    rows = _snapshots(spark, sf).select(
        F.concat_ws(".", (F.col("snap_id") % 50 + 1).cast("string"), (F.col("source") % 40).cast("string")).alias("version"),
        "snap_id", F.concat(F.lit("/news/"), F.col("source").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("content"), F.lit("https://img.example.com/list.png").alias("image_url"),
    )
    return rows


def _scraped(spark, sf):
    return table(spark, sf, "customer").select(
        F.concat(F.lit("/news/"), F.col("c_custkey").cast("string")).alias("url"),
        F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("content"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://img.example.com/c"), F.col("c_custkey").cast("string"), F.lit(".gif"))).alias("image_url"),
    )


@query
def has_details(spark, sf):
    return state.with_details(_wanted(spark, sf), _records(spark, sf)).select("snap_id", "version")


@query
def enrichment(spark, sf):
    return state.enrich(_wanted(spark, sf), _records(spark, sf), _scraped(spark, sf))


@query
def image_choice(spark, sf):
    part = _records(spark, sf)
    inventory = table(spark, sf, "supplier").select(
        F.concat(F.lit("patch_"), (F.col("s_suppkey") % 50 + 1).cast("string"), F.lit("."), (F.col("s_suppkey") % 25).cast("string"), F.lit(".jpg")).alias("file_key")
    )
    return state.choose_image(part, inventory).select("url", "version", "image_kind", "image")


@query
def fresh_cache(spark, sf):
    return state.fresh_rows(table(spark, sf, "events"), "ts", as_of()).select("event_id")


@query
def retention(spark, sf):
    rows = state.with_retention(_records(spark, sf), "published_at", F.to_timestamp_ntz(F.lit("2024-06-30 00:00:00")))
    return rows.select("url", "published_at", "action")


@query
def alert_routing(spark, sf):
    return state.route_errors(I.derive(spark, sf, I.ERRORS)).select("event_id", "code", "label", "alert")


@query
def run_stats(spark, sf):
    return state.run_stats(I.derive(spark, sf, I.RUNS))


# ---- stores, exports, notices ---------------------------------------------


@query
def store_roundtrip(spark, sf):
    path = work_folder(spark, "store")
    saved = as_of()
    rows = _records(spark, sf)
    stores.write_releases(rows, path, saved, BASE_URL)
    back = stores.read_store(spark, path)
    return back.select(
        "version", F.col("version_key").cast("string").alias("version_key"), "title", "url", "content",
        F.col("metadata.source_url").alias("source_url"),
    )


@query
def record_roundtrip(spark, sf):
    """Records written as JSON and read back, with the strict reader."""
    path = work_folder(spark, "records")
    rows = _records(spark, sf).select("version", "title", "url", "published_at", "content", "image_url", F.lit(None).cast("string").alias("local_image_path"))
    stores.write_records(rows, path)
    missing = stores.read_records(spark, path + "-missing", stores.RELEASE_SCHEMA)
    return stores.read_records(spark, path, stores.RELEASE_SCHEMA).unionByName(missing).select("version", "title", "url", "published_at", "content", "image_url")


@query
def record_quarantine(spark, sf):
    """A drop of records of which some are cut off, of another type or without url: good ones by url, bad ones by reason."""
    path = work_folder(spark, "drop")
    line = F.when(F.col("page_id") % 11 == 5, F.expr("left(line, length(line) - 3)")).when(
        F.col("page_id") % 13 == 6, F.expr("replace(line, '\"size\":', '\"size\":\"x\",\"was\":')")).otherwise(F.col("line"))
    rows = _pages(spark, sf).select("page_id", "url", F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("version"), F.lit("t").alias("title"))
    rows.withColumn("line", F.to_json(F.struct("version", "title", F.when(F.col("page_id") % 7 != 3, F.col("url")).alias("url"), F.length("url").alias("size")))).select(line.alias("value")).write.text(path)
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("version", "title", "url")), T.StructField("size", T.LongType())])
    good = stores.ingest_records(spark, path, schema, path + "-quarantine", ["url"])
    bad = VersionedTable(spark, path + "-quarantine", "record_id").read()
    return good.select("version", F.lit("good").alias("state"), "size").unionByName(
        bad.select(F.regexp_extract("line", '"version":"([^"]*)"', 1).alias("version"), F.col("reason").alias("state"), F.lit(None).cast("long").alias("size")))


@query
def stored_summaries(spark, sf):
    """Two writes of summaries, the second over a part of the keys, and the store as it was between them."""
    path = work_folder(spark, "summaries")
    rows = table(spark, sf, "events").select(
        F.concat((F.col("user_id") % 200).cast("string"), F.lit("/"), F.col("event_type")).alias("version"),
        F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("summary"), F.col("ts").alias("generated_at"))
    middle = F.col("generated_at") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    stores.write_summaries(rows.where(middle), path, "2024-01-15")
    stores.write_summaries(rows.where(~middle), path, "2024-01-31")
    first = stores.read_store(spark, path, as_of="2024-01-20").select("version_key", F.col("summary").alias("before"))
    return stores.read_store(spark, path).join(first, "version_key", "full").select(F.col("version_key").cast("string").alias("version_key"), "summary", "before")


@query
def state_snapshots(spark, sf):
    """The state of every user after each of three weeks, saved as snapshots and read as of each; the first one restored."""
    path, events = work_folder(spark, "snapshots"), table(spark, sf, "events")
    weeks = ["2024-01-08", "2024-01-15", "2024-01-22"]
    for week in weeks:
        own = events.where(F.col("ts") < F.to_timestamp_ntz(F.lit(week)))
        own = own.groupBy(F.col("user_id").alias("source")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("version"), F.count(F.lit(1)).alias("total"))
        stores.snapshot_state(own, path, week)
    read = [stores.state_as_of(spark, path, week).withColumn("as_of", F.lit(week)) for week in weeks]
    read.append(stores.restore_state(spark, path, weeks[0]).withColumn("as_of", F.lit("restored")))
    return functools.reduce(DataFrame.unionByName, read).select("as_of", "source", "version", "total")


@query
def session_export(spark, sf):
    return stores.session_rows(I.derive(spark, sf, I.OPERATIONS))


@query
def session_report(spark, sf):
    address = F.when(F.col("session_id") % 3 > 0, F.concat(F.lit("/s?a=1&b="), F.col("session_id").cast("string")))
    return stores.session_report(I.derive(spark, sf, I.OPERATIONS).withColumn("url", address))


@query
def prompts(spark, sf):
    rows = _docs(spark, sf).select(
        "doc_id", F.concat(F.lit("1."), F.col("doc_id").cast("string")).alias("version"),
        F.col("source").alias("title"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
    )
    return notices.prompts(rows).select("doc_id", "prompt")


def _responses(spark, sf):
    return I.derive(spark, sf, I.RESPONSES)


def _summaries(spark, sf):
    return responses.parse_responses(_responses(spark, sf), MODEL, as_of())


@query
def parsed_responses(spark, sf):
    joined = {
        c: F.coalesce(F.array_join(c, "|"), F.lit("<null>"))
        for c in ("key_changes", "new_features", "important_bug_fixes", "skin_content")
    }
    return _summaries(spark, sf).withColumns(joined).drop("response", "generated_at")


@query
def response_fallbacks(spark, sf):
    return _summaries(spark, sf).where("is_fallback").select("response_id", "summary")


def _notice_rows(spark, sf):
    rid = F.col("response_id")
    return _summaries(spark, sf).select(
        rid.alias("source"),
        F.concat(F.lit("14."), (rid % 30).cast("string")).alias("version"),
        F.concat(F.lit("Patch 14."), (rid % 30).cast("string")).alias("title"),
        F.concat(F.lit("https://www.example.com/n/"), rid.cast("string")).alias("url"),
        as_of().alias("published_at"),
        F.when(rid % 3 == 0, "https://img.example.com/a.jpg").when(rid % 3 == 1, "").alias("image_url"),
        F.when(rid % 4 == 0, "images/x.jpg").alias("local_image_path"),
        F.when(rid % 6 != 0, F.col("summary")).alias("summary"),
        "key_changes", "new_features", "important_bug_fixes", "skin_content", "generated_at", "model",
    )


@query
def embed_fields(spark, sf):
    rows = _notice_rows(spark, sf).select("source", F.posexplode(notices.notice_fields()).alias("pos", "f"))
    return rows.select("source", "pos", "f.name", "f.value", "f.inline")


@query
def embeds(spark, sf):
    rows = _notice_rows(spark, sf).select("source", notices.notice_embed(PRODUCT).alias("e"))
    return rows.select(
        "source", "e.title", "e.url", "e.color", F.col("e.timestamp").alias("stamp"),
        F.col("e.footer.text").alias("footer"), F.array_join(
            F.transform("e.fields", lambda f: F.concat_ws("=", f["name"], f["value"], f["inline"].cast("string"))), "|").alias("fields"),
        F.col("e.image.url").alias("image"),
    )


@query
def outbox(spark, sf):
    return notices.outbox(_notice_rows(spark, sf), PRODUCT)


@query
def error_alerts(spark, sf):
    routed = state.route_errors(I.derive(spark, sf, I.ERRORS)).where("alert")
    return notices.error_alerts(routed, PRODUCT, as_of()).select("event_id", "payload")


# ---- masking --------------------------------------------------------------


def _texts(spark, sf):
    docs = _docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    made = I.derive(spark, sf, I.MESSAGES).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), "text")
    return docs.unionByName(made)


@query
def masked_text(spark, sf):
    return _texts(spark, sf).select("id", M.mask_text(F.col("text")).alias("masked"))


@query
def masked_ids(spark, sf):
    only_ids = M.MaskOptions(api_keys=False, webhooks=False, personal=False, ids=True)
    return _texts(spark, sf).select("id", M.mask_text(F.col("text"), only_ids).alias("masked"))


@query
def masked_length(spark, sf):
    return _texts(spark, sf).select(
        "id", M.mask_text(F.col("text"), M.MaskOptions(keep_length=True)).alias("masked")
    )


@query
def masked_records(spark, sf):
    rows = I.derive(spark, sf, I.MESSAGES).select(
        "id",
        F.struct(
            F.col("text").alias("note"), F.col("id").alias("apiKey"), F.array("text").alias("lines"),
            F.create_map(F.lit("author"), F.col("text"), F.lit("text"), F.col("text")).alias("extra"),
        ).alias("r"),
    )
    masked = M.mask_value(F.col("r"), rows.schema["r"].dataType)
    out = rows.select("id", masked.alias("r"))
    return out.select(
        "id", "r.note", F.col("r.apiKey").alias("api_key"), F.col("r.lines")[0].alias("line"),
        F.col("r.extra")["author"].alias("author"), F.col("r.extra")["text"].alias("text"),
    )


@query
def masked_errors(spark, sf):
    return _texts(spark, sf).select("id", M.sanitise_error(F.col("text")).alias("message"))


@query
def settings_audit(spark, sf):
    rows = I.derive(spark, sf, I.SETTINGS)
    return rows.select("owner", F.explode(M.setting_issues(F.col("key"), F.col("value"))).alias("issue"))


# ---- operation metrics ----------------------------------------------------


def _operations(spark, sf):
    return I.derive(spark, sf, I.OPERATIONS)


def _logged_cards(spark, sf):
    """Cards with the log of their extraction; the first container selector cannot be read."""
    broken = dataclasses.replace(LIST_CARD, container=("section::before", *LIST_CARD.container))
    return extract.listing_cards(_listings(spark, sf), BASE_URL, as_of(), broken, log=True)


@query
def parse_log(spark, sf):
    return extract.parse_log(_logged_cards(spark, sf))


@query
def operation_metrics(spark, sf):
    """Counts by field over the log of the card extraction, and by type over the recorded operations."""
    recorded = _operations(spark, sf).select(F.col("type").alias("operation"), (F.col("error") == "").alias("success"))
    return metrics.operation_metrics(extract.parse_log(_logged_cards(spark, sf)).select("operation", "success").unionByName(recorded))


@query
def selector_rates(spark, sf):
    """Rates over the selectors that the card extraction tried, and over recorded ones."""
    recorded = I.derive(spark, sf, I.SELECTOR_LOG).select("selector", "outcome")
    rates = metrics.selector_rates(extract.selector_log(_logged_cards(spark, sf)).select("selector", "outcome").unionByName(recorded))
    return rates.withColumn("success_rate", F.round("success_rate", 6))


@query
def session_metrics(spark, sf):
    rows = metrics.session_metrics(_operations(spark, sf))
    return rows.withColumn("mean_duration", F.round("mean_duration", 6))


@query
def session_cap(spark, sf):
    sessions = metrics.session_metrics(_operations(spark, sf))
    return metrics.cap_sessions(sessions).select("session_id", "started")


@query
def session_expiry(spark, sf):
    days = _operations(spark, sf).groupBy("session_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started"))
    now = F.to_timestamp_ntz(F.lit("2024-01-15 00:20:00"))
    return metrics.live_sessions(days, now).select("session_id", "started")


@query
def rolling_hour(spark, sf):
    # The requests of all users share one quota per event type here.
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return metrics.rolling_counts(events, "event_type").select("event_id", "event_type", "in_window", "allowed")


# ---- streams --------------------------------------------------------------


def _run(spark, start) -> str:
    root = work_folder(spark, "stream")
    start(f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


@query
def stream_first_card(spark, sf):
    pages = jobs.file_stream(spark, f"{sf}/pages.parquet")
    job = lambda rows: extract.listing_cards(
        rows, BASE_URL, as_of(), NAV_CARD, title_of=lambda t: F.nullif(X.trim_space(t), F.lit(""))
    )
    out = _run(spark, lambda o, c: jobs.run_per_batch(pages, job, o, c))
    return spark.read.parquet(out).select("page_id", "status", "title", "url")


@query
def stream_changes(spark, sf):
    events = jobs.file_stream(spark, f"{sf}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    out = _run(spark, lambda o, c: jobs.run_change_feed(
        events, "user_id", F.to_date("ts"), ["ts", "event_id"], ["event_type"], o, c
    ))
    return spark.read.parquet(out).select("user_id", "event_id", "event_type")


@query
def stream_state(spark, sf):
    events = jobs.file_stream(spark, f"{sf}/events.parquet")
    sent = events.select(
        F.col("user_id").alias("source"), F.col("event_type").alias("version"), F.col("props").alias("title"),
        F.lit("/e").alias("url"), F.col("ts").alias("published_at"), F.col("ts").alias("sent_at"),
    )
    initial = I.derive(spark, sf, I.STATE)
    out = _run(spark, lambda o, c: jobs.run_state_merge(sent, initial, o, c))
    return VersionedTable(spark, out, "source").read().select("source", "version", "last_notification", "total")


def _clocked(spark, sf):
    return jobs.file_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_rates(spark, sf):
    windows = jobs.request_windows(_clocked(spark, sf), "event_type", slide=None)
    out = _run(spark, lambda o, c: jobs.write_updates(windows, o, c))
    return jobs.latest(spark, out, ["event_type", "window_start"]).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query
def stream_sliding_rates(spark, sf):
    windows = jobs.request_windows(_clocked(spark, sf), "event_type", slide="30 minutes")
    out = _run(spark, lambda o, c: jobs.write_updates(windows, o, c))
    return jobs.latest(spark, out, ["event_type", "window_start"]).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query
def stream_late(spark, sf):
    """The later half of the log arrives first; the earlier half is too late and goes to the ledger."""
    events, root = table(spark, sf, "events"), work_folder(spark, "stream")
    middle = F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    for drop in (middle, ~middle):
        events.where(drop).write.mode("append").parquet(f"{root}/drops")
        stream = jobs.file_stream(spark, f"{root}/drops", per_trigger=1_000_000).withColumn("ts", F.col("ts").cast("timestamp"))  # a drop is a batch
        jobs.run_late_ledger(stream, "event_type", f"{root}/out", f"{root}/late", f"{root}/checkpoint").awaitTermination()
    counted = jobs.counted_windows(spark, f"{root}/out").select("event_type", "window_start", "n", F.lit(0).alias("n_late"))
    late = spark.read.parquet(f"{root}/late").groupBy("event_type", "window_start").agg(
        F.count(F.lit(1)).alias("n_late"), F.max("delay_ms").alias("longest_delay_ms"))
    both = counted.unionByName(late.withColumn("n", F.lit(0)), allowMissingColumns=True)
    return both.groupBy("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late"), F.max("longest_delay_ms").alias("longest_delay_ms"))


@query
def stream_sessions(spark, sf):
    """Sessions that ended, and those the state still holds."""
    ops, root = _clocked(spark, sf).withColumn("error", F.when(F.col("event_type") == "error", "x")), work_folder(spark, "stream")
    jobs.run_sessions(ops, "user_id", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{root}/out").drop("batch").unionByName(open_sessions(spark, f"{root}/checkpoint"))
    return rows.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "total_operations", "failed", "late")


@query
def stream_dedup(spark, sf):
    rows = jobs.first_seen(_clocked(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], lateness="60 days")
    out = _run(spark, lambda o, c: jobs.write_stream(rows, o, c))
    return spark.read.parquet(out).select("user_id", "event_type")
