"""Notification records, error alerts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
FIELD_CHARS = 1021
LIST_ITEMS = 3
COLOUR_WITH_SUMMARY, COLOUR_PLAIN, COLOUR_ERROR = 0x00FF99, 0x0099FF, 0xFF0000
VERSION_FIELD = "📋 バージョン"
LINK_FIELD = "🔗 リンク"
LINK_TEXT = "パッチノートを読む"
SUMMARY_FIELD = "📝 AI要約"
CHANGES_FIELD = "🎯 主要な変更点"
LIST_FIELDS = {
    "new_features": "✨ 新機能",
    "important_bug_fixes": "🔧 重要なバグ修正",
    "skin_content": "🎨 スキン・コンテンツ",
}
MODEL_FIELD = "🤖 要約生成"
SUMMARY_FOOTER = " | AI要約付き"
ERROR_FOOTER = " - Error"
RELEASE_CONTENT = "🎮 **新しいパッチノートが公開されました！**"
ERROR_CONTENT = "🚨 **システムアラート**"
ERROR_TITLE = "❌ システムエラー"
ERROR_PREFIX = "エラーが発生しました: "
CONTEXT_FIELD = "📍 コンテキスト"
# ---------------------------------------------------------------------------

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def truncate(text: Column, limit: int = FIELD_CHARS) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def numbered(items: Column, limit: int | None = None, chars: int = FIELD_CHARS) -> Column:
    """``1. item`` lines with a blank line between them, truncated."""
    shown = items if limit is None else F.slice(items, 1, limit)
    lines = F.transform(
        shown, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)
    )
    return truncate(F.array_join(lines, "\n\n"), chars)


def _entry(name: str, value: Column, inline: bool) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))


def notice_fields(list_items: int | None = LIST_ITEMS, field_chars: int = FIELD_CHARS) -> Column:
    """Field list of a release row (version, url and the summary columns).

    Texts are cut behind ``field_chars``; the optional lists show ``list_items`` entries, None all.
    """
    has = F.col("summary").isNotNull()
    filled = lambda c: has & (F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0)
    link = F.concat(F.lit(f"[{LINK_TEXT}]("), F.col("url"), F.lit(")"))
    stamp = F.concat_ws(
        " | ", F.col("model"), F.date_format("generated_at", "yyyy/M/d H:mm:ss")
    )
    parts = [
        _entry(VERSION_FIELD, F.col("version"), True),
        _entry(LINK_FIELD, link, True),
        F.when(has & (F.col("summary") != ""), _entry(SUMMARY_FIELD, truncate(F.col("summary"), field_chars), False)),
        F.when(filled("key_changes"), _entry(CHANGES_FIELD, numbered(F.col("key_changes"), None, field_chars), False)),
    ]
    parts += [
        F.when(filled(c), _entry(name, numbered(F.col(c), list_items, field_chars), False))
        for c, name in LIST_FIELDS.items()
    ]
    parts.append(F.when(has, _entry(MODEL_FIELD, stamp, True)))
    return F.array_compact(F.array(*parts))


def notice_embed(product: str, list_items: int | None = LIST_ITEMS, field_chars: int = FIELD_CHARS) -> Column:
    """Embed struct of a release row; a null summary means there is none.

    Uses title, url, version, published_at, image_url, local_image_path and the
    summary columns. ``product`` is the footer text.
    """
    has = F.col("summary").isNotNull()
    attached = F.concat(F.lit("attachment://patch_"), F.col("version"), F.lit(".jpg"))
    image = F.when(F.col("local_image_path") != "", attached).otherwise(
        F.nullif(F.col("image_url"), F.lit(""))
    )
    footer = F.when(has, product + SUMMARY_FOOTER).otherwise(product)
    return F.struct(
        F.col("title"), F.col("url"),
        F.when(has, COLOUR_WITH_SUMMARY).otherwise(COLOUR_PLAIN).alias("color"),
        F.date_format("published_at", _ISO).alias("timestamp"),
        F.struct(footer.alias("text")).alias("footer"),
        notice_fields(list_items, field_chars).alias("fields"),
        F.when(image.isNotNull(), F.struct(image.alias("url"))).alias("image"),
    )


def outbox(releases: DataFrame, product: str, key: str = "source") -> DataFrame:
    """One payload per release, ready to be delivered by an outside sender."""
    payload = F.to_json(
        F.struct(F.lit(RELEASE_CONTENT).alias("content"), F.array(notice_embed(product)).alias("embeds"))
    )
    return releases.select(key, "version", payload.alias("payload"))


def error_alerts(errors: DataFrame, product: str, as_of: Column) -> DataFrame:
    """Add the payload of each alert; uses message and (nullable) context."""
    context = F.when(F.col("context") != "", F.array(_entry(CONTEXT_FIELD, F.col("context"), False)))
    embed = F.struct(
        F.lit(ERROR_TITLE).alias("title"),
        F.concat(F.lit(ERROR_PREFIX), F.col("message")).alias("description"),
        F.lit(COLOUR_ERROR).alias("color"),
        F.date_format(as_of, _ISO).alias("timestamp"),
        F.struct(F.lit(product + ERROR_FOOTER).alias("text")).alias("footer"),
        context.alias("fields"),
    )
    payload = F.to_json(F.struct(F.lit(ERROR_CONTENT).alias("content"), F.array(embed).alias("embeds")))
    return errors.withColumn("payload", payload)


def prompts(releases: DataFrame) -> DataFrame:
    """Prompt text of every release that has content."""
    text = F.format_string(
        "Summarise release %s as JSON with summary, keyChanges, newFeatures, "
        "importantBugFixes and skinContent.\nTitle: %s\nURL: %s\n\n%s",
        "version", "title", "url", "content",
    )
    return releases.where("content <> ''").withColumn("prompt", text)
