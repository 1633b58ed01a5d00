"""URL rules: normalising, image checks with reason codes, file keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
PROTOCOLS = ("http:", "https:", "data:")
FORMATS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "ico")
FILE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp")
EMPTY_SVG = 'data:image/svg+xml,<svg xmlns="http://www.w3.org/2000/svg"/>'
WEBHOOK = r"^https://discord\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+\z"
EXTENSION = r"\.([a-zA-Z0-9]+)(?:[?#]|\z)"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*:)"
HOST_SCHEME = r"(?i)^(?:https?|wss?|ftp):"
HOST = (
    r"(?i)^(?:https?|wss?|ftp):[/\\]*(?:[^/\\?#@]*@)?"
    r"(?:\[[0-9a-f:.]+\]|[^\s/\\?#@:<>^|%\[\]]+)(?::[0-9]*)?(?:[/\\?#]|\z)"
)
#: Message of a failed check; {n} is the URL's length, {protocol} and {format} are its own.
MESSAGES = {
    "empty_or_invalid_input": "URL is empty or not a string",
    "url_too_long": "URL exceeds maximum length of {max_url}",
    "invalid_url_format": "Invalid URL format",
    "unsupported_protocol": "Protocol '{protocol}' is not allowed. Allowed: {protocols}",
    "empty_svg_data_url": "Empty SVG data URL detected",
    "data_url_too_short": "Data URL too short ({n} < {min_data_url})",
    "invalid_base64_data": "Invalid or empty base64 data",
    "unsupported_format": "Image format '{format}' is not supported",
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A caller's check; ``test`` gives false to reject, null counts as pass."""

    name: str
    test: Callable[[Column], Column]
    message: str = ""
    priority: int = 0


@dataclass(frozen=True)
class ImagePolicy:
    protocols: Sequence[str] = PROTOCOLS
    formats: Sequence[str] = FORMATS
    min_data_url: int = 100
    max_url: int = 2000
    strict: bool = False
    rules: Sequence[Rule] = field(default_factory=tuple)


DEFAULT_POLICY = ImagePolicy()


def normalise_url(url: Column, base: str) -> Column:
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(url.startswith("http://") | url.startswith("https://"), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(F.lit(base), url))
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


def url_protocol(url: Column) -> Column:
    """Protocol the checks use; ``relative`` for a path, null when unparsable."""
    parsed = F.nullif(F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit(""))
    return (
        F.when(url.startswith("data:"), "data:")
        .when(url.rlike(HOST_SCHEME), F.when(url.rlike(HOST), parsed))
        .when(parsed.isNotNull(), parsed)
        .when(url.startswith("//"), "https:")
        .when(url.startswith("/"), "relative")
    )


def reported_protocol(url: Column) -> Column:
    """Protocol as shown in results; by prefix only."""
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown")
        .when(url.startswith("data:"), "data:")
        .when(url.startswith("http://"), "http:")
        .when(url.startswith("https://"), "https:")
        .when(url.startswith("//"), "protocol-relative")
        .when(url.startswith("/"), "relative")
        .otherwise("unknown")
    )


def image_format(url: Column) -> Column:
    data = F.regexp_extract(url, r"data:image/([^;,]+)", 1)
    plain = F.regexp_extract(url, EXTENSION, 1)
    return F.nullif(F.lower(F.when(url.startswith("data:image/"), data).otherwise(plain)), F.lit(""))


def reject_reason(url: Column, policy: ImagePolicy = DEFAULT_POLICY) -> Column:
    """First failed check of an image URL, null when it is valid."""
    proto, fmt = url_protocol(url), image_format(url)
    base64 = F.get(F.split(url, "base64,"), F.lit(1))
    out = (
        F.when(F.coalesce(url, F.lit("")) == "", "empty_or_invalid_input")
        .when(F.length(url) > policy.max_url, "url_too_long")
        .when(proto.isNull(), "invalid_url_format")
        .when((proto == "relative") | ~proto.isin(*policy.protocols), "unsupported_protocol")
        .when(url.startswith(EMPTY_SVG), "empty_svg_data_url")
        .when(url.startswith("data:") & (F.length(url) < policy.min_data_url), "data_url_too_short")
        .when(
            url.startswith("data:image/")
            & url.contains("base64,")
            & (F.length(F.coalesce(base64, F.lit(""))) < 10),
            "invalid_base64_data",
        )
    )
    if policy.strict:
        out = out.when(fmt.isNotNull() & ~fmt.isin(*policy.formats), "unsupported_format")
    for rule in sorted(policy.rules, key=lambda r: -r.priority):
        out = out.when(~rule.test(url), f"custom_rule_{rule.name}")
    return out


def is_valid_image(url: Column, policy: ImagePolicy = DEFAULT_POLICY) -> Column:
    return reject_reason(url, policy).isNull()


def reject_message(url: Column, reason: Column, policy: ImagePolicy = DEFAULT_POLICY) -> Column:
    """Message that goes with a reject reason: a fixed text with the URL's values, or the custom rule's own."""
    own = {"n": F.length(url).cast("string"), "protocol": url_protocol(url), "format": image_format(url)}
    fixed = {"max_url": policy.max_url, "min_data_url": policy.min_data_url, "protocols": ", ".join(policy.protocols)}
    out = F.when(F.lit(False), F.lit(""))
    for name, text in MESSAGES.items():
        parts = [own[p] if p in own else F.lit(str(fixed.get(p, p))) for p in re.split(r"[{}]", text) if p]
        out = out.when(reason == name, F.concat(*parts))
    for rule in policy.rules:
        out = out.when(reason == f"custom_rule_{rule.name}", F.lit(rule.message))
    return out


def check_image(url: Column, policy: ImagePolicy = DEFAULT_POLICY) -> Column:
    """Struct (is_valid, reason, protocol, format, size, recommendations, message)."""
    reason, fmt = reject_reason(url, policy), image_format(url)
    advice = F.array(
        F.lit("Consider using supported formats: " + ", ".join(policy.formats)),
        F.lit("Verify the image format is correct"),
    )
    return F.struct(
        reason.isNull().alias("is_valid"),
        reason.alias("reason"),
        reported_protocol(url).alias("protocol"),
        F.when(reason.isNull() & fmt.isin(*policy.formats), fmt).alias("format"),
        F.length(F.coalesce(url, F.lit(""))).alias("size"),
        F.when(reason == "unsupported_format", advice).alias("recommendations"),
        reject_message(url, reason, policy).alias("message"),
    )


def version_key(version: Column) -> Column:
    return F.regexp_replace(version, "[^a-zA-Z0-9.-]", "_")


def image_extension(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))
    return F.when(ext.isin(*FILE_EXTENSIONS), ext).otherwise("jpg")


def image_file_key(url: Column, version: Column) -> Column:
    return F.concat(F.lit("patch_"), version_key(version), F.lit("."), image_extension(url))


def is_webhook_url(url: Column) -> Column:
    return F.coalesce(url.rlike(WEBHOOK), F.lit(False))
