"""Model responses to summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
FENCE = r"```json\n([\s\S]*?)\n```"
LISTS = {
    "key_changes": "keyChanges",
    "new_features": "newFeatures",
    "important_bug_fixes": "importantBugFixes",
    "skin_content": "skinContent",
}
FALLBACK_CHARS = 500
FALLBACK_CHANGE = "詳細は元のパッチノートをご確認ください"
# ---------------------------------------------------------------------------


def response_json(response: Column) -> Column:
    """Body of the first fenced block, else the whole response."""
    body = F.regexp_extract(response, FENCE, 1)
    return F.when(body != "", body).otherwise(response)


def _string(parsed: Column, path: str) -> Column:
    value = F.try_variant_get(parsed, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string"))


def _strings(parsed: Column, path: str) -> Column:
    items = F.try_variant_get(parsed, path, "array<variant>")
    text = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(text, lambda x: F.try_variant_get(x, "$", "string")), none)


def parse_responses(
    rows: DataFrame, model: str, as_of: Column, response: str = "response", fallback_chars: int = FALLBACK_CHARS
) -> DataFrame:
    """Add the summary fields of each response.

    A response that is not JSON becomes a fallback summary: its first
    ``fallback_chars`` characters, one fixed change and null (not empty)
    optional lists.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(response_json(F.col(response))))
    good = F.col("_v").isNotNull() & ~F.coalesce(F.is_variant_null("_v"), F.lit(False))
    short = F.concat(F.substring(F.col(response), 1, fallback_chars), F.lit("..."))
    out = {
        "is_fallback": ~good,
        "summary": F.when(good, F.coalesce(_string(F.col("_v"), "$.summary"), F.lit(""))).otherwise(short),
    }
    for name, field in LISTS.items():
        items = F.when(good, _strings(F.col("_v"), f"$.{field}"))
        if name == "key_changes":
            items = items.otherwise(F.array(F.lit(FALLBACK_CHANGE)))
        out[name] = items
    out |= {"generated_at": as_of, "model": F.lit(model)}
    return parsed.withColumns(out).drop("_v")
