"""Release titles and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
TITLE_PREFIX = "パッチノート "
TITLE_PATTERNS = (
    r"(?i)パッチノート\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
    r"(?i)パッチ\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
    r"(?i)patch\s*notes?\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
    r"(?i)patch\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
    r"(?i)アップデート\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
    r"(?i)update\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)",
)
# ---------------------------------------------------------------------------


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def release_title(
    text: Column, patterns: Sequence[str] = TITLE_PATTERNS, prefix: str = TITLE_PREFIX
) -> Column:
    """Normalised title of the first pattern that matches, else null."""
    spaced = [p.replace(r"\s", r"[\s\x{a0}\x{3000}]") for p in patterns]
    found = [F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(0)) for p in spaced]
    return F.concat(F.lit(prefix), F.coalesce(*found))


def release_version(title: Column, as_of: Column) -> Column:
    """Three-part number, else two-part number, else the date of ``as_of``."""
    return F.coalesce(
        _first(title, r"([0-9]+\.[0-9]+\.[0-9]+)"),
        _first(title, r"([0-9]+\.[0-9]+)"),
        F.date_format(as_of, "yyyy.MM.dd"),
    )


def version_backlog(version: Column, count: int | Column) -> Column:
    """The version and its previous minors, newest first, never below minor 1."""
    parts = F.split(version, r"\.")
    major = F.regexp_extract(F.get(parts, F.lit(0)), "^[0-9]+", 0).try_cast("int")
    minor = F.regexp_extract(F.get(parts, F.lit(1)), "^[0-9]+", 0).try_cast("int")
    n = F.lit(count) if isinstance(count, int) else count
    last = F.greatest(F.least(minor, F.lit(1)), minor - n + 1)
    made = F.transform(
        F.sequence(minor, last), lambda m: F.concat_ws(".", major.cast("string"), m.cast("string"))
    )
    none = F.array().cast("array<string>")
    return F.when(minor.isNotNull() & major.isNotNull() & (n > 0), made).otherwise(none)
