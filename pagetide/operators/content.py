"""Content analysis of pages: metadata, dates, outline, full profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions import text as X
from pagetide.operators.elements import elements, page_tokens_of
from pagetide.operators.selectors import in_rank, match, needs_tree

# ---- fixed values ---------------------------------------------------------
DATE_SELECTORS = (
    'meta[property="article:published_time"]',
    'meta[name="publish_date"]',
    "time[datetime]",
    ".publish-date",
    ".date",
)
SECTION_SELECTOR = 'section, article, div[role="main"]'
TOPIC_SELECTOR = "h1, h2, h3"
ENTITY_SELECTOR = "[data-entity], .entity, .person, .organization"
HEADING_SELECTOR = "h1, h2, h3, h4, h5, h6"
# Date layouts that are tried in order; a layout without a zone means UTC.
ZONED = (
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]xx",
    "d MMM yyyy HH:mm:ss z",
)
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? "
PLAIN = (
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS]",
    "yyyy-MM-dd HH:mm[:ss]",
    "yyyy/M/d",
    "M/d/yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
)
# ---------------------------------------------------------------------------


def parse_date(text: Column) -> Column:
    """Instant of a written date, null when no layout fits."""
    clean = F.regexp_replace(X.trim_space(text), WEEKDAY, "")
    tries = [F.try_to_timestamp(clean, F.lit(f)) for f in ZONED]
    tries += [
        F.try_to_timestamp(F.concat(clean, F.lit(" Z")), F.lit(f + " X")) for f in PLAIN
    ]
    return F.coalesce(*tries)


def _text(span: Column) -> Column:
    return H.span_text(F.col("toks"), span["open"], span["close"])


def _texts(name: str) -> Column:
    return F.transform(name, _text)


def content_profile(
    pages: DataFrame,
    metadata: bool = True,
    keywords: bool = True,
    structure: bool = True,
    readability: bool = False,
    language: bool = False,
    dates: Sequence[str] = DATE_SELECTORS,
    key: str = "page_id",
) -> DataFrame:
    """Counts of every page plus the parts asked for by the flags."""
    sels = [
        "body", "p", HEADING_SELECTOR, "a[href]", "img", "title", "h1",
        'meta[name="description"]', 'meta[name="author"]',
        SECTION_SELECTOR, TOPIC_SELECTOR, ENTITY_SELECTOR, *dates,
    ]
    els = match(elements(pages, key, tree=needs_tree(sels)), sels, key)
    span = F.struct("open", "close")
    label = F.coalesce(H.attr("id"), H.attr("class"), F.lit("unnamed"))
    stamp = F.coalesce(H.attr("content"), H.attr("datetime"))

    def listed(rank: int, value: Column = span) -> Column:
        return F.sort_array(F.collect_list(F.when(in_rank(rank), value)))

    parts: dict[str, Column] = {
        "bodies": listed(0),
        "paragraph_count": F.count_if(in_rank(1)),
        "heading_count": F.count_if(in_rank(2)),
        "link_count": F.count_if(in_rank(3)),
        "image_count": F.count_if(in_rank(4)),
    }
    if metadata:
        parts |= {
            "titles": listed(5),
            "h1": F.min(F.when(in_rank(6), span)),
            "description": F.min(F.when(in_rank(7), F.struct("open", H.attr("content").alias("v")))),
            "author": F.min(F.when(in_rank(8), F.struct("open", H.attr("content").alias("v")))),
            "stamps": F.array(*[
                F.min(F.when(in_rank(12 + i), F.struct("open", "close", stamp.alias("v"))))
                for i in range(len(dates))
            ]),
        }
    if structure:
        parts |= {
            "section_rows": listed(9, F.struct("open", label.alias("v"))),
            "topic_rows": listed(10),
            "entity_rows": listed(11),
        }
    page = els.groupBy(key).agg(
        page_tokens_of().alias("toks"),
        *[c.alias(n) for n, c in parts.items()],
    )
    body = page.withColumn("body_text", F.array_join(_texts("bodies"), ""))
    text = F.col("body_text")
    body = body.withColumn("word_count", X.word_count(text))
    if readability:
        body = body.withColumns({"_sentences": X.sentence_count(text), "_syllables": X.syllable_count(text)})
    out = [
        F.col(key),
        F.col("word_count"),
        F.length(text).alias("character_count"),
        F.col("paragraph_count"), F.col("heading_count"), F.col("link_count"), F.col("image_count"),
    ]
    if metadata:
        title = F.array_join(_texts("titles"), "")
        h1 = F.coalesce(_text(F.col("h1")), F.lit(""))
        parsed = F.transform(
            "stamps", lambda s: F.when(s.isNotNull(), parse_date(F.coalesce(s["v"], _text(s))))
        )
        out += [
            F.when(title != "", title).otherwise(h1).alias("title"),
            F.nullif(F.col("description.v"), F.lit("")).alias("description"),
            F.nullif(F.col("author.v"), F.lit("")).alias("author"),
            F.get(F.array_compact(parsed), F.lit(0)).alias("publish_date"),
        ]
    if keywords:
        out.append(X.keywords(text).getField("word").alias("keywords"))
    if structure:
        trimmed = lambda n: F.transform(n, lambda s: X.trim_space(_text(s)))
        out += [
            F.col("section_rows.v").alias("sections"),
            F.filter(trimmed("topic_rows"), lambda t: t != "").alias("topics"),
            trimmed("entity_rows").alias("entities"),
        ]
    if readability:
        out.append(
            X.readability(F.col("word_count"), F.col("_sentences"), F.col("_syllables")).alias("readability")
        )
    if language:
        out.append(X.language_tag(text).alias("language"))
    return body.select(*out)


def page_metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, description, author and publish date of every page."""
    return content_profile(pages, keywords=False, structure=False, key=key).select(
        key, "title", "description", "author", "publish_date"
    )


def page_outline(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Sections, topics and marked entities as (kind, position, value) rows."""
    lists = content_profile(pages, metadata=False, keywords=False, key=key)

    def tagged(kind: str, name: str) -> Column:
        return F.transform(
            name, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), v.alias("value"))
        )

    rows = F.concat(tagged("section", "sections"), tagged("topic", "topics"), tagged("entity", "entities"))
    return lists.select(key, F.inline(rows))
