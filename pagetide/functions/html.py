"""Column functions over raw HTML: cleaning, tokens, attributes, text."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# Comments go; bodies of script and style are emptied, their tags stay.
COMMENT_OR_RAW = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|(<script\b[^>]*>).*?(</script\s*>|\z)"
    r"|(<style\b[^>]*>).*?(</style\s*>|\z)"
)
# Quote-aware tag, declaration, stray "<", or a run of text. The possessive
# loop keeps Java's matcher iterative on tags with very many attributes.
TOKEN = (
    r"""</?[A-Za-z](?:[^>"']+|"[^"]*"|'[^']*')*+>"""
    r"""|<[!?/][^>]*>|<[^<]*|[^<]+"""
)
TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
NOT_TEXT = r"^<[A-Za-z/!?]"
ATTRIBUTE = (
    r"""([A-Za-z_:@][A-Za-z0-9_:.-]*)"""
    r"""(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
)
VOID = (
    "area base br col embed hr img input link meta source track wbr"
).split()
IMPLIED = "p li dt dd option tr td th".split()
INLINE = "b code em font i small strong u".split()
# Inline tags that wrap whole blocks: like a block when closed, inline when not.
WRAPPER = "a span".split()
REFERENCE = "&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
# Common named references; the others come from the standard table of the HTML
# specification, which Python's library holds.
ENTITIES = {
    "amp": "&",
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "times": "×", "deg": "°",
    "euro": "€", "pound": "£", "yen": "¥", "sect": "§",
}
# ---------------------------------------------------------------------------


_STANDARD = json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";")})


def clean_html(html: Column) -> Column:
    """Drop comments and empty script and style bodies in one left-to-right pass."""
    return F.regexp_replace(html, F.lit(COMMENT_OR_RAW), F.lit("$1$2$3$4"))


def html_tokens(html: Column) -> Column:
    """Ordered array of tags and text runs of a page."""
    return F.regexp_extract_all(clean_html(F.coalesce(html, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    """True for a text run; an unfinished tag or a declaration is not text."""
    return ~token.startswith("<") | ~token.rlike(NOT_TEXT)


def token_kind(token: Column) -> Column:
    """1 for an opening tag, -1 for a closing tag, 0 otherwise."""
    return (
        F.when(token.rlike(r"^<[A-Za-z]") & token.endswith(">"), 1)
        .when(token.rlike(r"^</[A-Za-z]") & token.endswith(">"), -1)
        .otherwise(0)
    )


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, TAG_NAME, 1))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _numeric_reference(ref: Column) -> Column:
    """Character of ``&#n;`` or ``&#xh;``; null for any other reference."""
    body = F.regexp_extract(ref, r"^&#([xX]?[0-9A-Fa-f]+);", 1)
    hexa = F.lower(F.substring(body, 1, 1)) == "x"
    digits = F.regexp_replace(body, "^[xX]?0*", "")
    code = F.when(F.length(digits) > 8, 0x110000).when(hexa, F.conv(digits, 16, 10)).otherwise(F.concat(F.lit("0"), digits)).try_cast("long")
    code = F.when(body != "", F.coalesce(code, F.lit(0)))
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(known, code).when(code.isNotNull(), 0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Decode character references in one pass; unknown ones stay as written."""
    pairs = ", ".join(f"'&{n};', '\\u{ord(c):04x}'" for n, c in ENTITIES.items())
    known = F.expr(f"map({pairs})")
    rest = F.from_json(F.lit(_STANDARD), "map<string,string>")  # folded to a literal once per plan
    pieces, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.zip_with(
        pieces,
        found,
        lambda piece, ref: F.concat(
            piece,
            F.coalesce(F.try_element_at(known, ref), _numeric_reference(ref), F.try_element_at(rest, ref), ref, F.lit("")),
        ),
    )
    return F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text)


def span_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens strictly between positions ``start`` and ``end`` (1-based)."""
    # Looked up one by one: inside a lambda, slice() would copy the whole array.
    low, high = start, F.least(end - 2, F.size(tokens) - 1)
    inner = F.transform(F.sequence(low, high), lambda i: F.get(tokens, i))
    return F.when(high >= low, inner).otherwise(F.array().cast("array<string>"))


def span_text(tokens: Column, start: Column, end: Column) -> Column:
    """Concatenated, decoded text of a span; no separators between runs."""
    inner = F.filter(span_tokens(tokens, start, end), is_text)
    return F.array_join(F.transform(inner, decode_entities), "")


def indexed_text(index: Column, start: Column, end: Column) -> Column:
    """Text of a span from a page's text index (``text`` in UTF-8, ``ends`` of each token's text in it)."""

    def upto(pos: Column) -> Column:
        return F.coalesce(F.get(index["ends"], F.least(pos, F.size(index["ends"])) - 1), F.lit(0))

    low = upto(start)
    return F.substr(index["text"], low + 1, F.greatest(upto(end - 1) - low, F.lit(0))).cast("string")


def span_html(tokens: Column, start: Column, end: Column) -> Column:
    """Inner markup of a span as written in the page."""
    return F.array_join(span_tokens(tokens, start, end), "")


def _attribute_area(token: Column) -> Column:
    # A slash right behind a bare value belongs to the value.
    return F.regexp_replace(token, r"""^<[A-Za-z][A-Za-z0-9:-]*|(?:(?<=[\s"'])/)?>$""", "")


def attribute_names(token: Column) -> Column:
    names = F.regexp_extract_all(_attribute_area(token), F.lit(ATTRIBUTE), F.lit(1))
    return F.transform(names, F.lower)


def attribute_values(token: Column) -> Column:
    """Values in written order: outer quotes off, references decoded."""
    raw = F.regexp_extract_all(_attribute_area(token), F.lit(ATTRIBUTE), F.lit(2))

    def clean(v: Column) -> Column:
        quoted = v.startswith('"') | v.startswith("'")
        return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    return F.transform(F.transform(raw, clean), decode_entities)


def attribute_map(names: Column, values: Column) -> Column:
    """Attributes as a map; a repeated name keeps its first value."""
    first = F.filter(
        F.sequence(F.lit(1), F.size(names)),
        lambda i: F.array_position(names, F.element_at(names, i.cast("int"))) == i,
    )
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return (
        F.when(F.size(names) == 0, F.map_from_arrays(names, values))
        .when(unique, F.map_from_arrays(names, values))
        .otherwise(
            F.map_from_arrays(
                F.transform(first, lambda i: F.element_at(names, i.cast("int"))),
                F.transform(first, lambda i: F.element_at(values, i.cast("int"))),
            )
        )
    )


def attr(name: str, names: Column | None = None, values: Column | None = None) -> Column:
    """Value of one attribute of an element row, null when it is absent."""
    names = F.col("attr_names") if names is None else names
    values = F.col("attr_values") if values is None else values
    at = F.array_position(names, F.lit(name)).cast("int")
    return F.element_at(values, F.when(at > 0, at))


def class_list(names: Column | None = None, values: Column | None = None) -> Column:
    """Classes in written order, split on plain spaces, blanks dropped."""
    return F.filter(
        F.split(F.coalesce(attr("class", names, values), F.lit("")), " "), lambda c: c != ""
    )
