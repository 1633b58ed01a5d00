"""Release cards, detail content and hero images from pages.

Selectors are parameters throughout. One pass over the element table matches
every selector of a call; candidates then meet in one row per page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import text as X
from pagetide.functions import titles as N
from pagetide.functions import urls as U
from pagetide.operators.elements import elements, page_tokens_of
from pagetide.operators.selectors import in_rank, is_supported, match, match_all, needs_tree

# ---- fixed values ---------------------------------------------------------
CONTAINER_SELECTORS = (
    ".sc-4d29e6fd-0 .action",
    ".sc-9565c853-0.action",
    ".sc-4d29e6fd-0 > a",
    '[data-testid="patch-note-card"]',
    "article",
)
TITLE_SELECTORS = (
    ".sc-6fae0810-0",
    "span div",
    ".sc-d4b4173b-0",
    '[data-testid="patch-note-title"]',
    "h1",
    "h2",
    "h3",
)
URL_SELECTORS = (
    "",
    'a[href*="patch"]',
    'a[href*="news"]',
    '[data-testid="patch-note-link"]',
    "a",
)
IMAGE_SELECTORS = (
    ".sc-d237f54f-0 img",
    'img[src*="patch"]',
    '[data-testid="patch-note-image"]',
    "img",
)
CONTENT_SELECTORS = (
    "main",
    "article",
    '[role="main"]',
    ".article-content",
    ".patch-content",
    '[data-testid="patch-content"]',
    ".content-wrapper",
    ".article-body",
    ".content",
)
HERO_PATTERNS = (
    ('img[src*="1920x1080"]', 100),
    ('img[src*="1600x"]', 90),
    ('img[src*="1920x"]', 90),
    (".hero-image img", 80),
    (".patch-hero img", 80),
    (".banner-image img", 80),
    ('[data-testid="patch-hero-image"]', 70),
    ('article img[src*="patch"]', 60),
    ('main img[src*="splash"]', 60),
    ('.content img[src*="banner"]', 50),
)
MAX_ATTEMPTS = 10
MIN_CONTENT = 100
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CardSelectors:
    container: Sequence[str] = CONTAINER_SELECTORS
    title: Sequence[str] = TITLE_SELECTORS
    url: Sequence[str] = URL_SELECTORS
    image: Sequence[str] = IMAGE_SELECTORS

    @property
    def all(self) -> list[str]:
        return [*self.container, *self.title, *self.url, *self.image]


def _first_some(candidates: Column, test) -> Column:
    """First entry whose ``value`` is set, after mapping (candidate, index)."""
    mapped = F.transform(candidates, test)
    return F.get(F.filter(mapped, lambda c: c["value"].isNotNull()), F.lit(0))


def image_source(names: Column | None = None, values: Column | None = None) -> Column:
    """``src``, else ``data-src``; an empty ``src`` does not fall through."""
    return F.coalesce(H.attr("src", names, values), H.attr("data-src", names, values))


def _card_parts(
    els: DataFrame, keys: list[str], sel: CardSelectors, policy: U.ImagePolicy, hits: str, max_attempts: int | None
) -> tuple[DataFrame, list[Column]]:
    """Elements with what a card needs, and the aggregates that collect a page's candidates."""
    at_title = len(sel.container)
    at_url = at_title + len(sel.title)
    at_image = at_url + len(sel.url)
    page = Window.partitionBy(*keys)
    box_rank = F.array_min(F.filter(hits, lambda r: r < min(at_title, max_attempts or at_title)))
    box = F.min(
        F.when(
            box_rank.isNotNull(),
            F.struct(box_rank.alias("rank"), "open", "close", "tag", H.attr("href").alias("href")),
        )
    ).over(page)
    els = els.withColumn("box", box)
    inside = (F.col("open") > F.col("box.open")) & (F.col("open") < F.col("box.close"))

    def firsts(start: int, count: int, within: bool, *payload: Column) -> Column:
        cond = F.col("inside") if within else F.lit(True)
        return F.array(*[
            F.min(F.when(cond & in_rank(start + i, hits), F.struct("open", *payload))) for i in range(count)
        ])

    is_image = F.exists(hits, lambda r: r >= at_image)
    els = els.withColumns({
        "inside": F.coalesce(inside, F.lit(False)),
        "href": H.attr("href"),
        "src": F.when(is_image, image_source()),
    })
    els = els.withColumn("good", F.when(is_image, (F.col("src") != "") & U.is_valid_image(F.col("src"), policy)))
    link = (F.col("href").alias("v"),)
    picture = (F.col("src").alias("v"), F.col("good").alias("good"))
    return els, [
        F.first("box").alias("box"),
        firsts(at_title, len(sel.title), True, F.col("close")).alias("titles"),
        firsts(at_url, len(sel.url), True, *link).alias("urls_in"),
        firsts(at_url, len(sel.url), False, *link).alias("urls_doc"),
        firsts(at_image, len(sel.image), True, *picture).alias("images_in"),
        firsts(at_image, len(sel.image), False, *picture).alias("images_doc"),
    ]


def _log_entry(operation: str, names: Sequence[str], rank: Column, asked: Column) -> Column:
    """What one field of one page took: the names in the order they are tried, and which one gave the value."""
    last = F.coalesce(rank, F.lit(len(names) - 1))
    every = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(n).alias("selector"), F.lit(not is_supported(n)).alias("bad")) for i, n in enumerate(names)
    ])
    tried = F.transform(
        F.filter(every, lambda x: (x["i"] <= last) & (F.trim(x["selector"]) != "")),
        lambda x: F.struct(x["selector"].alias("selector"), F.when(x["bad"], "error").when(x["i"] == rank, "hit").otherwise("miss").alias("outcome")),
    )
    return F.when(asked, F.struct(
        F.lit(operation).alias("operation"), rank.isNotNull().alias("success"), F.get(F.array(*map(F.lit, names)), rank).alias("selector"),
        F.coalesce(rank > 0, F.lit(False)).alias("fallback"), (last + 1).alias("attempts"), tried.alias("tried"),
    ))


def _parse_log(sel: CardSelectors, max_attempts: int | None, title: Column, url: Column) -> Column:
    """Log entries of a page: a field is looked for once those before it were found."""
    boxed = F.col("box").isNotNull()
    n_title, n_url, n_image = len(sel.title), len(sel.url), len(sel.image)
    title_rank = F.when(F.col("t.value").isNotNull(), F.col("t.rank")).when(F.col("t_all").isNotNull(), n_title)
    url_rank = F.when(F.col("u_box").isNotNull(), 0).when(F.col("u.value").isNotNull(), F.col("u.rank") + 1).when(F.col("u_doc.value").isNotNull(), n_url + 1)
    image_rank = F.when(F.col("i.value").isNotNull(), F.col("i.rank")).when(F.col("i_doc.value").isNotNull(), n_image)
    return F.array_compact(F.array(
        _log_entry("container", sel.container[:max_attempts], F.col("box.rank"), F.lit(True)),
        _log_entry("title", [*sel.title, "container-text"], title_rank, boxed),
        _log_entry("url", ["container-href", *sel.url, "document-fallback"], url_rank, boxed & title.isNotNull()),
        _log_entry("image", [*sel.image, "document-fallback"], image_rank, boxed & title.isNotNull() & url.isNotNull()),
    ))


def _card_columns(
    grouped: DataFrame, sel: CardSelectors, base_url: str, as_of: Column, title_of, keep: Sequence[str],
    log: bool = False, max_attempts: int | None = None,
) -> DataFrame:
    """Status, title, addresses and version of each page's card, and the log of how they were found."""

    def pick_title(c: Column, i: Column) -> Column:
        words = H.span_text(F.col("toks"), c["open"], c["close"])
        return F.struct(i.alias("rank"), F.when(c.isNotNull(), H.bind(words, title_of)).alias("value"))

    def pick(ok) -> object:
        return lambda c, i: F.struct(
            i.alias("rank"), F.when((c["v"] != "") & ok(c), c["v"]).alias("value")
        )

    none = F.lit(None).cast("string")
    relevant = lambda c: c["v"].contains("patch") | c["v"].contains("news")
    everything = H.span_text(F.col("toks"), F.col("box.open"), F.col("box.close"))
    names = F.array(*[F.lit(s) for s in sel.title]), F.array(*[F.lit(s) for s in sel.url])
    found = grouped.withColumn("t", _first_some(F.col("titles"), pick_title)).select(
        *keep,
        F.col("box"),
        "t",
        # The whole container's text is built only where no selector gave a title.
        F.when(F.col("t.value").isNull() & F.col("box").isNotNull(), H.bind(everything, title_of)).alias("t_all"),
        F.when((F.col("box.tag") == "a") & (F.col("box.href") != ""), F.col("box.href")).alias("u_box"),
        _first_some(F.col("urls_in"), pick(lambda c: F.lit(True))).alias("u"),
        _first_some(F.col("urls_doc"), pick(lambda c: c["v"].contains("patch"))).alias("u_doc"),
        _first_some(F.col("images_in"), pick(lambda c: c["good"])).alias("i"),
        _first_some(F.col("images_doc"), pick(lambda c: c["good"] & relevant(c))).alias("i_doc"),
    )
    title = F.coalesce("t.value", "t_all")
    url = F.coalesce("u_box", "u.value", "u_doc.value")
    status = (
        F.when(F.col("box").isNull(), "container_not_found")
        .when(title.isNull(), "title_not_found")
        .when(url.isNull(), "url_not_found")
        .otherwise("ok")
    )
    return found.select(
        *keep,
        status.alias("status"),
        F.get(F.array(*[F.lit(s) for s in sel.container]), F.col("box.rank")).alias("container_selector"),
        F.when(F.col("box").isNotNull(), title).alias("title"),
        F.when(F.col("t.value").isNotNull(), F.get(names[0], F.col("t.rank")))
        .when(F.col("box").isNotNull() & F.col("t_all").isNotNull(), "container-text")
        .alias("title_selector"),
        F.when(F.col("box").isNotNull(), url).alias("url"),
        F.when(F.col("box").isNull(), none)
        .when(F.col("u_box").isNotNull(), "container-href")
        .when(F.col("u.value").isNotNull(), F.get(names[1], F.col("u.rank")))
        .when(F.col("u_doc.value").isNotNull(), "document-fallback")
        .alias("url_selector"),
        F.when(F.col("box").isNotNull() & url.isNotNull(), U.normalise_url(url, base_url)).alias("normalised_url"),
        F.when(F.col("box").isNotNull(), F.coalesce("i.value", "i_doc.value")).alias("image_url"),
        F.when(F.col("box").isNotNull() & title.isNotNull(), N.release_version(title, as_of)).alias("version"),
        *([_parse_log(sel, max_attempts, title, url).alias("parse_log")] if log else []),
    )


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generated row, below which Spark moves no filter.

    It puts a filter under every explode, and moves that below plain projections, where the log would be
    worked out once more, its title anew for every place that names it.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def parse_log(cards: DataFrame, key: str | Sequence[str] = "page_id") -> DataFrame:
    """One row per page and field of cards made with ``log``: operation, success, selector, fallback, attempts, error."""
    keys = _key_list(key)
    rows = _settled(cards.select(*keys, "parse_log")).select(*keys, F.inline("parse_log")).drop("tried")
    return rows.withColumn("error", F.when(~F.col("success"), F.concat("operation", F.lit("_not_found"))))


def selector_log(cards: DataFrame, key: str | Sequence[str] = "page_id") -> DataFrame:
    """One row per selector that was tried: operation, selector and outcome (hit, miss, or error if it cannot be read)."""
    keys = _key_list(key)
    rows = _settled(cards.select(*keys, "parse_log")).select(*keys, F.explode("parse_log").alias("l"))
    return rows.select(*keys, F.col("l.operation").alias("operation"), F.inline("l.tried"))


def observe_parses(cards: DataFrame, observation: Observation, operations: Sequence[str] = ("container", "title", "url", "image")) -> DataFrame:
    """The cards, with counts of tried and found fields taken while they are written: ``<operation>_total`` and ``_successful``."""

    def has(operation: str, found: bool) -> Column:
        return F.exists("parse_log", lambda x: (x["operation"] == operation) & (x["success"] | F.lit(not found)))

    return cards.observe(observation, *[
        F.count_if(has(o, found)).alias(f"{o}_{label}") for o in operations for found, label in ((False, "total"), (True, "successful"))
    ])


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def listing_cards(
    pages: DataFrame,
    base_url: str,
    as_of: Column,
    selectors: CardSelectors = CardSelectors(),
    policy: U.ImagePolicy = U.DEFAULT_POLICY,
    title_of=N.release_title,
    key: str | Sequence[str] = "page_id",
    max_attempts: int | None = MAX_ATTEMPTS,
    log: bool = False,
) -> DataFrame:
    """Latest card of every page, or the reason why there is none.

    ``status`` is ok, container_not_found, title_not_found or url_not_found.
    ``title_of`` turns the text of a candidate into a title or null. Only the first
    ``max_attempts`` container selectors are tried; None tries all. ``log`` adds the
    column ``parse_log``; selectors that cannot be read are then skipped and logged
    as errors, without it they raise.
    """
    keys, sel = _key_list(key), selectors
    asked = [s if is_supported(s) else "" for s in sel.all] if log else sel.all
    els = match(elements(pages, keys, tree=needs_tree(asked)), asked, keys)
    els, candidates = _card_parts(els, keys, sel, policy, "hits", max_attempts)
    grouped = els.groupBy(*keys).agg(page_tokens_of().alias("toks"), *candidates)
    return _card_columns(grouped, sel, base_url, as_of, title_of, keys, log, max_attempts)


def _ranked(heroes: Sequence[tuple[str, int]]) -> list[str]:
    return [s for s, _ in sorted(heroes, key=lambda h: -h[1])]


def _detail_parts(content: Sequence[str], policy: U.ImagePolicy, hits: str) -> list[Column]:
    """Aggregates that collect a page's main text spans and its best image."""
    src = image_source()
    hero_rank = F.array_min(F.filter(hits, lambda r: r >= len(content)))
    usable = hero_rank.isNotNull() & (src != "") & U.is_valid_image(src, policy)
    body_hits = F.filter(hits, lambda r: r < len(content))
    return [
        F.collect_list(
            F.when(F.size(body_hits) > 0, F.struct("open", "close", body_hits.alias("ranks")))
        ).alias("xs"),
        F.min(F.when(usable, F.struct(hero_rank.alias("r"), "open", src.alias("v")))).alias("hero"),
    ]


def _detail_columns(content: Sequence[str], heroes: Sequence[tuple[str, int]], min_content: int) -> dict[str, Column]:
    """Main text and image of a page from its collected parts."""

    def body(rank: Column) -> Column:
        spans = F.sort_array(F.filter("xs", lambda x: F.array_contains(x["ranks"], rank)))
        joined = F.array_join(
            F.transform(spans, lambda x: H.span_text(F.col("toks"), x["open"], x["close"])), ""
        )
        return X.collapse_space(joined)

    bodies = F.transform(F.sequence(F.lit(0), F.lit(len(content) - 1)), body)
    kept = F.filter(
        F.transform(bodies, lambda b, i: F.struct(i.alias("rank"), b.alias("text"))),
        lambda c: F.length(c["text"]) > min_content,
    )
    names = F.array(*[F.lit(s) for s in content])
    return {
        "c": F.get(kept, F.lit(0)),
        "content_selector": F.get(names, F.col("c.rank")),
        "content": F.col("c.text"),
        "hero_selector": F.get(F.array(*[F.lit(s) for s in _ranked(heroes)]), F.col("hero.r") - len(content)),
        "hero_url": F.col("hero.v"),
    }


def detail_pages(
    pages: DataFrame,
    content: Sequence[str] = CONTENT_SELECTORS,
    heroes: Sequence[tuple[str, int]] = HERO_PATTERNS,
    policy: U.ImagePolicy = U.DEFAULT_POLICY,
    key: str | Sequence[str] = "page_id",
    min_content: int = MIN_CONTENT,
) -> DataFrame:
    """Main text (first selector giving more than ``min_content`` characters) and hero image."""
    keys, sels = _key_list(key), [*content, *_ranked(heroes)]
    els = match(elements(pages, keys, tree=needs_tree(sels)), sels, keys)
    grouped = els.groupBy(*keys).agg(page_tokens_of().alias("toks"), *_detail_parts(content, policy, "hits"))
    made = _detail_columns(content, heroes, min_content)
    return grouped.withColumn("c", made["c"]).select(
        *keys, made["content_selector"].alias("content_selector"), made["content"].alias("content"),
        made["hero_selector"].alias("image_selector"), made["hero_url"].alias("image_url"),
    )


def _merged(rows: DataFrame, keys: list[str], as_of: Column, base_url: str) -> DataFrame:
    """Records of the pages with a card: the detail image wins, empty values drop out."""
    empty = F.lit("")
    image = F.coalesce(F.nullif("d_image", empty), F.nullif("image_url", empty))
    return rows.where("status = 'ok'").select(
        *keys, "version", "title", F.col("normalised_url").alias("url"),
        F.nullif("d_content", empty).alias("content"),
        F.when(image.isNotNull(), U.normalise_url(image, base_url)).alias("image_url"),
        as_of.alias("published_at"),
    )


def page_releases(
    pages: DataFrame,
    base_url: str,
    as_of: Column,
    selectors: CardSelectors = CardSelectors(),
    content: Sequence[str] = CONTENT_SELECTORS,
    heroes: Sequence[tuple[str, int]] = HERO_PATTERNS,
    policy: U.ImagePolicy = U.DEFAULT_POLICY,
    title_of=N.release_title,
    key: str | Sequence[str] = "page_id",
    max_attempts: int | None = MAX_ATTEMPTS,
    min_content: int = MIN_CONTENT,
) -> DataFrame:
    """Release records of pages that hold card and details themselves.

    Equals ``release_records`` of ``listing_cards`` and ``detail_pages`` of the same pages, but parses each page once:
    the selectors of both jobs are matched together and both are collected in one grouping, with one exchange.
    """
    keys, sel, sels = _key_list(key), selectors, [*content, *_ranked(heroes)]
    els = elements(pages, keys, tree=needs_tree([*sel.all, *sels]))
    els = match_all(els, {"card_hits": sel.all, "detail_hits": sels}, keys)
    els, candidates = _card_parts(els, keys, sel, policy, "card_hits", max_attempts)
    grouped = els.groupBy(*keys).agg(page_tokens_of().alias("toks"), *candidates, *_detail_parts(content, policy, "detail_hits"))
    made = _detail_columns(content, heroes, min_content)
    grouped = grouped.withColumn("c", made["c"]).withColumns({"d_content": made["content"], "d_image": made["hero_url"]})
    return _merged(_card_columns(grouped, sel, base_url, as_of, title_of, [*keys, "d_content", "d_image"]), keys, as_of, base_url)


def release_records(
    cards: DataFrame, details: DataFrame, as_of: Column, base_url: str, on: str = "page_id"
) -> DataFrame:
    """Merge cards with the details of their own pages, by ``on``."""
    d = details.select(on, F.col("content").alias("d_content"), F.col("image_url").alias("d_image"))
    return _merged(cards.join(d, on, "left"), [on], as_of, base_url)
