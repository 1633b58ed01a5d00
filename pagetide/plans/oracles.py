"""SQL checks of the registered queries, for an independent SQL engine.

The element tables are rebuilt here with containment joins over one page at a
time, a different route from the running windows of the Spark jobs. The joins
are fine for a check on small tables only.
"""

from __future__ import annotations

from pagetide.plans import inputs as I

ORACLES: dict[str, str] = {}

BASE = "https://www.example.com"
END = 2147483647
CLEAN = (
    r"(?is)<!--.*?(?:-->|\z)|(<script\b[^>]*>).*?(</script\s*>|\z)|(<style\b[^>]*>).*?(</style\s*>|\z)"
)
TOKEN = r"""</?[A-Za-z](?:[^>"'']+|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|<[^<]*|[^<]+"""
LISTINGS = I.as_sql(I.LISTINGS)
ADDRESSES = I.as_sql(I.ADDRESSES)

# ---- fixed values, written out anew so that the checks can disagree -------
SP = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
KANA_KANJI = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9faf}]"
VERSION_FIELD, LINK_FIELD, LINK_TEXT = "📋 バージョン", "🔗 リンク", "パッチノートを読む"
SUMMARY_FIELD, CHANGES_FIELD, MODEL_FIELD = "📝 AI要約", "🎯 主要な変更点", "🤖 要約生成"
LIST_FIELDS = {"new_features": "✨ 新機能", "important_bug_fixes": "🔧 重要なバグ修正", "skin_content": "🎨 スキン・コンテンツ"}
RELEASE_CONTENT = "🎮 **新しいパッチノートが公開されました！**"
ERROR_CONTENT, ERROR_TITLE = "🚨 **システムアラート**", "❌ システムエラー"
ERROR_PREFIX, CONTEXT_FIELD = "エラーが発生しました: ", "📍 コンテキスト"
API_KEY_MASK, WEBHOOK_MASK, PERSONAL_MASK = "[API_KEY_MASKED]", "[WEBHOOK_MASKED]", "[PERSONAL_INFO_MASKED]"
WEBHOOK_URL = r"https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"
KEY_RULES = (r"AIza[0-9A-Za-z_-]{35}", r"sk-[a-zA-Z0-9]{48}", r"Bot\s+[A-Za-z0-9._-]{59}")
SENSITIVE_WORDS = (
    "password", "token", "key", "secret", "auth", "credential", "api_key", "apikey", "webhook", "discord_webhook",
    "access_token", "refresh_token", "private", "confidential", "sensitive",
)
# ---------------------------------------------------------------------------


def decode(text: str) -> str:
    for ref, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{ref}', '{char}')"
    return text


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '\A[{SP}]+|[{SP}]+\z', '', 'g')"


def text_of(row: str, toks: str = "toks") -> str:
    inner = f"{toks}[{row}.open + 1:least({row}.close, {END - 1}) - 1]"
    joined = f"coalesce(array_to_string([t for t in {inner} if t[1] <> '<' OR NOT regexp_matches(t, '^<[A-Za-z/!?]')], ''), '')"
    return decode(joined)


def html_of(row: str, toks: str = "toks") -> str:
    return f"coalesce(array_to_string({toks}[{row}.open + 1:least({row}.close, {END - 1}) - 1], ''), '')"


def attr(name: str, token: str = "token") -> str:
    """Attribute value; the pages of the checks write them quoted."""
    return decode(
        f"""nullif(regexp_extract({token}, '(?i)\\s{name}="([^"]*)"', 1), '')"""
    )


def has_attr(name: str, token: str = "token") -> str:
    return f"""regexp_matches({token}, '(?i)\\s{name}="')"""


def attr_or_empty(name: str, token: str = "token") -> str:
    """Attribute value that keeps an empty string; null when absent."""
    value = decode(f"""regexp_extract({token}, '(?i)\\s{name}="([^"]*)"', 1)""")
    return f"CASE WHEN {has_attr(name, token)} THEN {value} END"


def attributes(token: str = "token", ordered: bool = False) -> str:
    """All attributes of a token as name=value, in the order written or by name."""
    value = decode("regexp_extract(a, '\"([^\"]*)\"', 1)")
    pairs = f"""list_transform(regexp_extract_all({token}, '[A-Za-z-]+="[^"]*"', 0), lambda a: lower(regexp_extract(a, '^([A-Za-z-]+)=', 1)) || '=' || {value})"""
    return f"array_to_string({f'list_sort({pairs})' if ordered else pairs}, ';')"


def has_class(name: str, token: str = "token") -> str:
    return f"""regexp_matches({token}, '(?i)\\sclass="([^"]*\\s)?{name}(\\s[^"]*)?"')"""


def tokens_cte(source: str) -> str:
    return rf"""
docs AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '{CLEAN}', '\1\2\3\4', 'g'), '{TOKEN}', 0) AS toks
  FROM ({source}) AS src
),
tokens AS (
  SELECT page_id, pos, token,
    CASE WHEN regexp_matches(token, '^<[A-Za-z]') AND token[-1] = '>' THEN 1
         WHEN regexp_matches(token, '^</[A-Za-z]') AND token[-1] = '>' THEN -1 ELSE 0 END AS kind,
    lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag
  FROM (SELECT page_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM docs) AS u
)"""


def elements_cte(source: str) -> str:
    """Element table by containment joins: page_id, open, close, tag, token, depth, parent."""
    return tokens_cte(source) + rf""",
tags AS (
  SELECT *, CASE
    WHEN tag IN ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') THEN 'void'
    WHEN tag IN ('p','li','dt','dd','option','tr','td','th') THEN 'implied'
    WHEN tag IN ('b','code','em','font','i','small','strong','u') THEN 'inline'
    WHEN tag IN ('a', 'span') THEN 'wrapper'
    ELSE 'block' END AS cls
  FROM tokens WHERE kind <> 0
),
levels AS (
  SELECT *, sum(kind) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) - CASE WHEN kind = 1 THEN 1 ELSE 0 END AS lvl
  FROM tags
),
pairs AS (
  SELECT o.page_id, o.pos AS open, min(c.pos) AS close, o.tag, o.cls, o.token
  FROM levels o LEFT JOIN levels c
    ON c.page_id = o.page_id AND c.tag = o.tag AND c.lvl = o.lvl AND c.kind = -1 AND c.pos > o.pos
  WHERE o.kind = 1 GROUP BY ALL
),
blocks AS (SELECT * FROM pairs WHERE cls IN ('block', 'wrapper') AND close IS NOT NULL),
scoped AS (
  SELECT t.page_id, t.pos, t.kind, t.tag, t.cls, t.token,
    coalesce(max(b.open), 0) AS sopen, coalesce(max_by(b.close, b.open), {END}) AS sclose
  FROM tags t LEFT JOIN blocks b ON b.page_id = t.page_id AND b.open < t.pos AND t.pos < b.close
  GROUP BY ALL
),
ends AS (
  SELECT page_id, open, close, tag, token, cls FROM blocks
  UNION ALL
  SELECT p.page_id, p.open, s.sclose, p.tag, p.token, p.cls FROM pairs p JOIN scoped s ON s.page_id = p.page_id AND s.pos = p.open
  WHERE p.cls = 'block' AND p.close IS NULL
  UNION ALL
  SELECT o.page_id, o.pos, coalesce(min(n.pos), o.sclose), o.tag, o.token, o.cls
  FROM scoped o LEFT JOIN scoped n ON n.page_id = o.page_id AND n.tag = o.tag AND n.sopen = o.sopen AND n.pos > o.pos
  WHERE o.cls = 'implied' AND o.kind = 1 GROUP BY o.page_id, o.pos, o.sclose, o.tag, o.token, o.cls
  UNION ALL
  SELECT page_id, open, close, tag, token, cls FROM pairs WHERE cls = 'inline' AND close IS NOT NULL
),
spans AS (
  SELECT page_id, open, close, tag, token FROM ends
  UNION ALL
  SELECT page_id, pos, pos, tag, token FROM tags WHERE cls = 'void' AND kind = 1
  UNION ALL
  SELECT p.page_id, p.open, coalesce(max_by(e.close, e.open), {END}), p.tag, p.token
  FROM pairs p LEFT JOIN ends e ON e.page_id = p.page_id AND e.open < p.open AND p.open < e.close
  WHERE p.cls IN ('inline', 'wrapper') AND p.close IS NULL GROUP BY p.page_id, p.open, p.tag, p.token
),
els AS (
  SELECT a.page_id, a.open, a.close, a.tag, a.token, count(b.open) AS depth, coalesce(max(b.open), 0) AS parent
  FROM spans a LEFT JOIN spans b ON b.page_id = a.page_id AND b.open < a.open AND a.open < b.close
  GROUP BY ALL
)"""


PAGES = "SELECT page_id, html FROM pages"
ON_PAGES = "WITH " + elements_cte(PAGES)
ON_LISTINGS = "WITH " + elements_cte(LISTINGS)

# ---- tokens and elements --------------------------------------------------

ORACLES["page_scan"] = "SELECT page_id, url, length(html) AS n_chars FROM pages"
ORACLES["page_tokens"] = "WITH " + tokens_cte(PAGES) + """
SELECT page_id, pos, kind, CASE WHEN kind <> 0 THEN tag END AS tag, token FROM tokens"""
_ALL = "\nSELECT page_id, open, close, tag, depth, parent FROM els"
ORACLES["page_elements"] = ON_PAGES + _ALL
ORACLES["listing_elements"] = ON_LISTINGS + _ALL
ORACLES["element_attributes"] = ON_LISTINGS + f"""
SELECT page_id, open, tag, lower(regexp_extract(a, '^([A-Za-z-]+)=', 1)) AS name,
  {decode("regexp_extract(a, '\"([^\"]*)\"', 1)")} AS value
FROM (SELECT page_id, open, tag, unnest(regexp_extract_all(token, '[A-Za-z-]+="[^"]*"', 0)) AS a FROM els) AS x"""
ORACLES["element_text"] = ON_PAGES + f"""
SELECT e.page_id, e.open, e.tag, {text_of('e')} AS text FROM els e JOIN docs USING (page_id)"""

_CRAWLED = "WITH " + elements_cte(
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<main><h1>Next ' || page_id || ' &amp; on</h1><p>a<b>b</b></p></main>' ELSE html END AS html FROM pages"
)
ORACLES["table_elements"] = _CRAWLED + _ALL
ORACLES["table_texts"] = _CRAWLED + f"""
SELECT e.page_id, e.open, e.tag, {text_of('e')} AS text FROM els e JOIN docs USING (page_id)
WHERE e.tag IN ('h1', 'p') OR (e.tag = 'b' AND EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.open = e.parent AND x.tag = 'p'))"""

_UNDER = "EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.tag = '{0}' AND x.open < e.open AND e.open < x.close)"
_CHILD = "EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.open = e.parent AND x.tag = '{0}')"
under, child = _UNDER.format, _CHILD.format
_NAV_UL = "EXISTS (SELECT 1 FROM els x JOIN els y ON y.page_id = x.page_id AND y.open = x.parent AND y.tag = 'nav' WHERE x.page_id = e.page_id AND x.open = e.parent AND x.tag = 'ul')"
_ART_P = "EXISTS (SELECT 1 FROM els x JOIN els y ON y.page_id = x.page_id AND y.open = x.parent AND y.tag = 'article' WHERE x.page_id = e.page_id AND x.open = e.parent AND x.tag = 'p')"


def hits(*conditions: str, where: str = "") -> str:
    parts = [
        f"SELECT e.*, {i} AS rank FROM els e WHERE {c}" for i, c in enumerate(conditions) if c
    ]
    return ",\nhits AS (" + "\n  UNION ALL ".join(parts) + ")"


_SELS = ["nav > ul > li", "ul a", "article > p > b", 'a[href^="/t"]', "h1, footer", "p > a"]
_HREF = attr("href", "e.token")
ORACLES["selector_hits"] = ON_PAGES + hits(
    f"e.tag = 'li' AND {_NAV_UL}", f"e.tag = 'a' AND {under('ul')}", f"e.tag = 'b' AND {_ART_P}",
    f"e.tag = 'a' AND starts_with({_HREF}, '/t')", "e.tag IN ('h1', 'footer')", f"e.tag = 'a' AND {child('p')}",
) + "\nSELECT page_id, open, tag, rank, [" + ", ".join(f"'{s}'" for s in _SELS) + "][rank + 1] AS selector FROM hits"

_FIRST = ["main .card", "", 'nav a[href^="/e"]', "div > article", "article b"]
ORACLES["first_match"] = ON_PAGES + hits(
    "false", "", f"e.tag = 'a' AND {under('nav')} AND starts_with({_HREF}, '/e')",
    f"e.tag = 'article' AND {child('div')}", f"e.tag = 'b' AND {under('article')}",
) + """,
best AS (SELECT page_id, min(rank) AS rank FROM hits GROUP BY page_id)
SELECT d.page_id, coalesce([""" + ", ".join(f"'{s}'" for s in _FIRST) + """][b.rank + 1], '') AS selector,
  coalesce(b.rank, -1) AS fallback_level, count(h.open) AS element_count,
  min(h.open) AS open, min_by(h.close, h.open) AS close, min_by(h.tag, h.open) AS tag
FROM docs d LEFT JOIN best b USING (page_id) LEFT JOIN hits h ON h.page_id = d.page_id AND h.rank = b.rank
GROUP BY d.page_id, b.rank"""


def normal(url: str) -> str:
    return (
        f"CASE WHEN coalesce({url}, '') = '' THEN '' WHEN starts_with({url}, 'http://') OR starts_with({url}, 'https://') THEN {url} "
        f"WHEN starts_with({url}, '//') THEN 'https:' || {url} WHEN starts_with({url}, '/') THEN '{BASE}' || {url} "
        f"ELSE '{BASE}/' || {url} END"
    )


def version(title: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({title}, '([0-9]+\\.[0-9]+\\.[0-9]+)', 1), ''), "
        f"nullif(regexp_extract({title}, '([0-9]+\\.[0-9]+)', 1), ''), '2024.01.31')"
    )


ORACLES["page_first_card"] = ON_PAGES + f""",
box AS (SELECT page_id, min(open) AS open, min_by(close, open) AS close FROM els WHERE tag = 'body' GROUP BY page_id),
inner_els AS (SELECT e.* FROM els e JOIN box b USING (page_id) WHERE e.open > b.open AND e.open < b.close),
h AS (SELECT page_id, min(open) AS open, min_by(close, open) AS close FROM inner_els WHERE tag = 'h1' GROUP BY page_id),
h2 AS (SELECT page_id, min(open) AS open FROM inner_els WHERE tag = 'h2' GROUP BY page_id),
l AS (SELECT page_id, min(open) AS lopen, min_by({attr('href')}, open) AS href FROM inner_els e WHERE tag = 'a' AND {under('nav')} GROUP BY page_id),
pl AS (SELECT page_id, min(open) AS popen, min_by({attr('href')}, open) AS phref FROM inner_els e WHERE tag = 'a' AND {under('p')} GROUP BY page_id),
raw AS (
  SELECT d.page_id, box.open AS bopen, nullif({trim(text_of('h'))}, '') AS h1,
    nullif({trim(text_of('box'))}, '') AS whole, l.href, pl.phref
  FROM docs d LEFT JOIN box USING (page_id) LEFT JOIN h USING (page_id) LEFT JOIN l USING (page_id) LEFT JOIN pl USING (page_id)
),
card AS (SELECT *, coalesce(h1, whole) AS title, coalesce(phref, href) AS url FROM raw)
SELECT page_id,
  CASE WHEN bopen IS NULL THEN 'container_not_found' WHEN title IS NULL THEN 'title_not_found' WHEN url IS NULL THEN 'url_not_found' ELSE 'ok' END AS status,
  CASE WHEN bopen IS NOT NULL THEN 'body' END AS container_selector,
  title, CASE WHEN h1 IS NOT NULL THEN 'h1' WHEN whole IS NOT NULL THEN 'container-text' END AS title_selector,
  url, CASE WHEN phref IS NOT NULL THEN 'p a' WHEN href IS NOT NULL THEN 'nav a' END AS url_selector,
  CASE WHEN url IS NOT NULL THEN {normal('url')} END AS normalised_url,
  CASE WHEN title IS NOT NULL THEN {version('title')} END AS version
FROM card"""

ORACLES["nav_links"] = ON_PAGES + f"""
SELECT e.page_id, e.open, {text_of('e')} AS text, {_HREF} AS href, {normal(_HREF)} AS url
FROM els e JOIN docs USING (page_id) WHERE e.tag = 'a' AND {under('nav')}"""
ORACLES["heading_titles"] = ON_PAGES + f"""
SELECT e.page_id, e.open, e.tag, {trim(text_of('e'))} AS title
FROM els e JOIN docs USING (page_id) WHERE e.tag IN ('h1', 'h2', 'h3', 'title')"""

# ---- cards on listings ----------------------------------------------------


def release_title(text: str) -> str:
    tries = (
        "パッチノート", "パッチ", r"patch[\s\x{a0}\x{3000}]*notes?", "patch", "アップデート", "update",
    )
    found = ", ".join(
        rf"nullif(regexp_extract({text}, '(?i){t}[\s\x{{a0}}\x{{3000}}]*([0-9]+\.[0-9]+(?:\.[0-9]+)?)', 1), '')"
        for t in tries
    )
    return f"'パッチノート ' || coalesce({found})"


def protocol(url: str) -> str:
    scheme = f"nullif(lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1)), '')"
    host = (
        r"(?i)^(?:https?|wss?|ftp):[/\\]*(?:[^/\\?#@]*@)?"
        r"(?:\[[0-9a-f:.]+\]|[^\s/\\?#@:<>^|%\[\]]+)(?::[0-9]*)?(?:[/\\?#]|\z)"
    )
    return (
        f"CASE WHEN starts_with({url}, 'data:') THEN 'data:' "
        f"WHEN regexp_matches({url}, '(?i)^(?:https?|wss?|ftp):') THEN CASE WHEN regexp_matches({url}, '{host}') THEN {scheme} END "
        f"WHEN {scheme} IS NOT NULL THEN {scheme} WHEN starts_with({url}, '//') THEN 'https:' "
        f"WHEN starts_with({url}, '/') THEN 'relative' END"
    )


def reported(url: str) -> str:
    return (
        f"CASE WHEN coalesce({url}, '') = '' THEN 'unknown' WHEN starts_with({url}, 'data:') THEN 'data:' "
        f"WHEN starts_with({url}, 'http://') THEN 'http:' WHEN starts_with({url}, 'https://') THEN 'https:' "
        f"WHEN starts_with({url}, '//') THEN 'protocol-relative' WHEN starts_with({url}, '/') THEN 'relative' ELSE 'unknown' END"
    )


def image_format(url: str) -> str:
    return (
        f"nullif(lower(CASE WHEN starts_with({url}, 'data:image/') THEN regexp_extract({url}, 'data:image/([^;,]+)', 1) "
        rf"ELSE regexp_extract({url}, '\.([a-zA-Z0-9]+)(?:[?#]|\z)', 1) END), '')"
    )


FORMATS = "('jpg', 'jpeg', 'png', 'gif', 'webp', 'svg', 'bmp', 'ico')"


def reason(url: str, tail: str = "") -> str:
    return (
        f"CASE WHEN coalesce({url}, '') = '' THEN 'empty_or_invalid_input' WHEN length({url}) > 2000 THEN 'url_too_long' "
        f"WHEN ({protocol(url)}) IS NULL THEN 'invalid_url_format' "
        f"WHEN ({protocol(url)}) NOT IN ('http:', 'https:', 'data:') THEN 'unsupported_protocol' "
        f"WHEN starts_with({url}, 'data:image/svg+xml,<svg xmlns=\"http://www.w3.org/2000/svg\"/>') THEN 'empty_svg_data_url' "
        f"WHEN starts_with({url}, 'data:') AND length({url}) < 100 THEN 'data_url_too_short' "
        f"WHEN starts_with({url}, 'data:image/') AND contains({url}, 'base64,') AND length(split_part({url}, 'base64,', 2)) < 10 THEN 'invalid_base64_data' "
        f"{tail} END"
    )


_SRC = f"coalesce({attr_or_empty('src', 'e.token')}, {attr_or_empty('data-src', 'e.token')})"
_GRID = "EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.open = e.parent AND x.tag = 'section' AND " + has_class("grid", "x.token") + ")"
_DIV_GRID = f"e.tag = 'section' AND {has_class('grid', 'e.token')} AND {under('div')}"
_CARD = ON_LISTINGS + f""",
boxes AS (
  SELECT e.page_id, e.open, e.close, e.tag, e.token, 1 AS rank FROM els e WHERE {has_class('card', 'e.token')} AND {_GRID}
  UNION ALL SELECT e.page_id, e.open, e.close, e.tag, e.token, 2 FROM els e WHERE {_DIV_GRID}
),
box AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, open) = 1),
inner_els AS (SELECT e.* FROM els e JOIN box b USING (page_id) WHERE e.open > b.open AND e.open < b.close),
tcand AS (
  SELECT page_id, open, close, 0 AS rank FROM inner_els WHERE {has_class('title')}
  UNION ALL SELECT page_id, open, close, 1 FROM inner_els WHERE tag = 'h3'
  UNION ALL SELECT page_id, open, close, 2 FROM inner_els WHERE tag = 'p'
),
tfirst AS (SELECT * FROM tcand QUALIFY row_number() OVER (PARTITION BY page_id, rank ORDER BY open) = 1),
ttext AS (SELECT page_id, rank, {release_title(text_of('t'))} AS title FROM tfirst t JOIN docs USING (page_id)),
tpick AS (SELECT page_id, min_by(title, rank) AS title, min(rank) AS rank FROM ttext WHERE title IS NOT NULL GROUP BY page_id),
ucand AS (
  SELECT page_id, open, {attr('href')} AS v, 1 AS rank, 0 AS stage FROM inner_els WHERE tag = 'a' AND contains({attr('href')}, 'patch')
  UNION ALL SELECT page_id, open, {attr('href')}, 2, 0 FROM inner_els WHERE tag = 'a' AND {has_class('go')}
  UNION ALL SELECT page_id, open, {attr('href')}, 3, 0 FROM inner_els WHERE tag = 'a'
  UNION ALL SELECT page_id, open, {attr('href')}, 1, 1 FROM els WHERE tag = 'a' AND contains({attr('href')}, 'patch')
  UNION ALL SELECT page_id, open, {attr('href')}, 2, 1 FROM els WHERE tag = 'a' AND {has_class('go')}
  UNION ALL SELECT page_id, open, {attr('href')}, 3, 1 FROM els WHERE tag = 'a'
),
ufirst AS (SELECT * FROM ucand QUALIFY row_number() OVER (PARTITION BY page_id, stage, rank ORDER BY open) = 1),
upick AS (
  SELECT page_id, min_by(v, stage * 10 + rank) AS v, min(stage * 10 + rank) AS ord FROM ufirst
  WHERE v IS NOT NULL AND (stage = 0 OR contains(v, 'patch')) GROUP BY page_id
),
icand AS (
  SELECT e.page_id, e.open, {_SRC} AS v, 0 AS rank, 0 AS stage FROM inner_els e WHERE tag = 'img' AND contains({attr('src')}, 'patch')
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 1, 0 FROM inner_els e WHERE tag = 'img' AND {has_class('hero')}
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 2, 0 FROM inner_els e WHERE tag = 'img'
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 0, 1 FROM els e WHERE tag = 'img' AND contains({attr('src')}, 'patch')
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 1, 1 FROM els e WHERE tag = 'img' AND {has_class('hero')}
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 2, 1 FROM els e WHERE tag = 'img'
),
ifirst AS (SELECT * FROM icand QUALIFY row_number() OVER (PARTITION BY page_id, stage, rank ORDER BY open) = 1),
ipick AS (
  SELECT page_id, min_by(v, stage * 10 + rank) AS v, min(stage * 10 + rank) AS ord FROM ifirst
  WHERE v <> '' AND ({reason('v')}) IS NULL AND (stage = 0 OR contains(v, 'patch') OR contains(v, 'news')) GROUP BY page_id
),
raw AS (
  SELECT d.page_id, b.open IS NOT NULL AS boxed, b.rank AS brank, t.title AS t1, t.rank AS trank, {release_title(text_of('b', 'd.toks'))} AS t2,
    CASE WHEN b.tag = 'a' THEN {attr('href', 'b.token')} END AS u0, u.v AS u1, u.ord, i.v AS img, i.ord AS irank
  FROM docs d LEFT JOIN box b USING (page_id) LEFT JOIN tpick t USING (page_id) LEFT JOIN upick u USING (page_id) LEFT JOIN ipick i USING (page_id)
),
card AS (
  SELECT page_id, boxed, brank, trank, t1, CASE WHEN boxed THEN coalesce(t1, t2) END AS title,
    CASE WHEN boxed THEN coalesce(u0, u1) END AS url, u0, ord, irank, CASE WHEN boxed THEN img END AS image_url
  FROM raw
),
cards AS (
  SELECT page_id,
    CASE WHEN NOT boxed THEN 'container_not_found' WHEN title IS NULL THEN 'title_not_found' WHEN url IS NULL THEN 'url_not_found' ELSE 'ok' END AS status,
    CASE brank WHEN 1 THEN 'section.grid > .card' WHEN 2 THEN 'div section[class~=grid]' END AS container_selector,
    title, CASE WHEN NOT boxed THEN NULL WHEN t1 IS NOT NULL THEN ['.title', 'h3', 'p'][trank + 1] WHEN title IS NOT NULL THEN 'container-text' END AS title_selector,
    brank, trank, t1, u0, ord, irank, boxed, url, CASE WHEN NOT boxed THEN NULL WHEN u0 IS NOT NULL THEN 'container-href' WHEN ord < 10 THEN ['a[href*="patch"]', 'a.go', 'a'][ord] WHEN url IS NOT NULL THEN 'document-fallback' END AS url_selector,
    CASE WHEN url IS NOT NULL THEN {normal('url')} END AS normalised_url, image_url,
    CASE WHEN title IS NOT NULL THEN {version('title')} END AS version
  FROM card
)"""
ORACLES["listing_cards"] = _CARD + """
SELECT page_id, status, container_selector, title, url, normalised_url, version FROM cards"""
ORACLES["card_titles"] = _CARD + "\nSELECT page_id, title, title_selector FROM cards"
ORACLES["card_urls"] = _CARD + "\nSELECT page_id, url, url_selector, normalised_url FROM cards"
ORACLES["image_urls"] = _CARD + "\nSELECT page_id, image_url FROM cards"
ORACLES["card_rejects"] = _CARD + "\nSELECT status, count(*) AS n FROM cards WHERE status <> 'ok' GROUP BY status"

_TITLE_TEXT = """p_type || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'PATCH  NOTE' WHEN 1 THEN 'パッチ' ELSE 'Updates' END
  || ' ' || p_size || '.' || (p_partkey % 25)"""
ORACLES["release_titles"] = f"""
SELECT p_partkey, text, {release_title('text')} AS title FROM (SELECT p_partkey, {_TITLE_TEXT} AS text FROM part) AS t"""
ORACLES["release_versions"] = f"SELECT doc_id, {version('text')} AS version FROM documents"
ORACLES["normalised_urls"] = f"SELECT id, {normal('url')} AS normalised FROM ({ADDRESSES}) AS a"
ORACLES["release_backlog"] = f"""
SELECT id, major || '.' || m AS version FROM (
  SELECT id, major, unnest(generate_series(minor, greatest(least(minor, 1), minor - 4), -1)) AS m FROM (
    SELECT id, CAST(split_part(version, '.', 1) AS INTEGER) AS major,
      CAST(regexp_extract(split_part(version, '.', 2), '^[0-9]+') AS INTEGER) AS minor FROM ({ADDRESSES}) AS a
  ) AS b
) AS c"""

_BODY = rf"regexp_replace({trim('joined')}, '[{SP}]+', ' ', 'g')"
ORACLES["page_content"] = ON_PAGES + f""",
cand AS (
  SELECT page_id, 1 AS rank, string_agg({text_of('e')}, '' ORDER BY open) AS joined FROM els e JOIN docs USING (page_id)
  WHERE tag = 'article' GROUP BY page_id
),
good AS (SELECT page_id, {_BODY} AS content FROM cand WHERE length({_BODY}) > 100)
SELECT d.page_id, CASE WHEN g.content IS NOT NULL THEN 'article' END AS content_selector, g.content
FROM docs d LEFT JOIN good g USING (page_id)"""

_SECTION_IMG = f"e.tag = 'img' AND {under('section')}"
_HERO = f""",
heroes AS (
  SELECT e.page_id, e.open, {_SRC} AS v, 0 AS rank FROM els e WHERE tag = 'img' AND contains({attr('src', 'e.token')}, '1920x1080')
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 1 FROM els e WHERE tag = 'img'
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 2 FROM els e WHERE {_SECTION_IMG}
  UNION ALL SELECT e.page_id, e.open, {_SRC}, 3 FROM els e WHERE tag = 'img' AND {under('aside')} AND contains({attr('src', 'e.token')}, 'news')
),
hero AS (
  SELECT * FROM heroes WHERE v <> '' AND ({reason('v')}) IS NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, open) = 1
)"""
ORACLES["hero_images"] = ON_LISTINGS + _HERO + """
SELECT d.page_id, ['img[src*="1920x1080"]', 'img', 'section img', 'aside img[src*="news"]'][h.rank + 1] AS image_selector, h.v AS image_url
FROM docs d LEFT JOIN hero h USING (page_id)"""
ORACLES["release_records"] = _CARD + _HERO + f""",
bodies AS (
  SELECT page_id, CASE tag WHEN 'section' THEN 1 ELSE 2 END AS rank, string_agg({text_of('e')}, '' ORDER BY open) AS joined
  FROM els e JOIN docs USING (page_id) WHERE tag IN ('section', 'body') GROUP BY page_id, tag
),
body AS (SELECT page_id, min_by({_BODY}, rank) AS content FROM bodies WHERE length({_BODY}) > 100 GROUP BY page_id)
SELECT c.page_id, c.version, c.title, c.normalised_url AS url, b.content,
  CASE WHEN coalesce(h.v, c.image_url) IS NOT NULL THEN {normal('coalesce(h.v, c.image_url)')} END AS image_url,
  TIMESTAMP '2024-01-31 00:00:00' AS published_at
FROM cards c LEFT JOIN hero h USING (page_id) LEFT JOIN body b USING (page_id) WHERE c.status = 'ok'"""

# ---- patterns, chunks, tasks ----------------------------------------------

ORACLES["xpath_hits"] = ON_LISTINGS + f"""
SELECT e.page_id, e.open, e.tag, {text_of('e')} AS text, {html_of('e')} AS inner_html,
  {attributes('e.token')} AS attributes, {attr_or_empty('class', 'e.token')} AS class
FROM els e JOIN docs USING (page_id) WHERE {has_attr('class', 'e.token')}"""


def confidence(text: str) -> str:
    return (
        f"round(least(1.0, CAST(0.5 AS DOUBLE) + CASE WHEN {attr('id', 'e.token')} <> '' THEN 0.3 ELSE 0 END "
        f"+ CASE WHEN {attr('class', 'e.token')} <> '' THEN 0.2 ELSE 0 END + CASE WHEN {trim(text)} <> '' THEN 0.1 ELSE 0 END), 6)"
    )


_PLACED = """
sib AS (SELECT *, CASE WHEN depth >= 1 THEN 10 * (row_number() OVER (PARTITION BY page_id, parent ORDER BY open) - 1) ELSE 0 END AS own FROM els),
placed AS (
  SELECT a.page_id, a.open, a.tag, CAST(sum(b.own) AS BIGINT) AS x, a.depth * 20 AS y
  FROM sib a JOIN sib b ON b.page_id = a.page_id AND (b.open = a.open OR (b.open < a.open AND a.open < b.close))
  GROUP BY a.page_id, a.open, a.tag, a.depth)"""
ORACLES["pattern_hits"] = ON_PAGES + f""",{_PLACED},
raw AS (SELECT e.*, {text_of('e')} AS text FROM els e JOIN docs USING (page_id)),
picked AS (
  SELECT *, 'lead' AS pattern, 0 AS pattern_order, 'article p' AS selector, text AS value FROM raw e
  WHERE tag = 'p' AND {under('article')} AND regexp_matches(text, '(?i)the\\b')
  UNION ALL SELECT *, 'heading', 1, 'h1', upper(text) FROM raw e WHERE tag = 'h1' AND length(text) > 60
  UNION ALL SELECT *, 'link', 2, 'nav a', text FROM raw e WHERE tag = 'a' AND {under('nav')}
  UNION ALL SELECT *, 'link', 2, 'li a', text FROM raw e WHERE tag = 'a' AND {under('li')}
)
SELECT e.page_id, pattern, pattern_order, selector, e.open, e.tag, value, {confidence('text')} AS confidence, x, y FROM picked e JOIN placed l ON l.page_id = e.page_id AND l.open = e.open"""
ORACLES["match_confidence"] = ON_LISTINGS + f"""
SELECT e.page_id, e.open, e.tag, {confidence(text_of('e'))} AS confidence FROM els e JOIN docs USING (page_id)
WHERE {has_attr('class', 'e.token')} OR {has_attr('id', 'e.token')} OR e.tag = 'b'"""
ORACLES["element_positions"] = ON_PAGES + f",{_PLACED} SELECT * FROM placed"
_CHUNKS = """SELECT page_id * 100000 + c AS page_id, substr(html, CAST(c * 1500 + 1 AS BIGINT), 1500) AS html
FROM (SELECT page_id, html, unnest(range(0, CAST(ceil(length(html) / 1500.0) AS BIGINT))) AS c FROM pages) AS z"""
ORACLES["chunk_hits"] = "WITH " + elements_cte(_CHUNKS) + f"""
SELECT page_id // 100000 AS page_id, page_id % 100000 AS chunk, (page_id % 100000) * 1500 AS position,
  CASE tag WHEN 'li' THEN 'li' WHEN 'p' THEN 'p' ELSE 'h1, h2' END AS selector, open, tag, {text_of('e')} AS text,
  {html_of('e')} AS inner_html, {attributes('e.token')} AS attributes
FROM els e JOIN docs USING (page_id) WHERE tag IN ('li', 'p', 'h1', 'h2')"""
ORACLES["page_edits"] = ON_PAGES + f""",
cut AS (SELECT page_id, open, close FROM els WHERE tag IN ('nav', 'script', 'style') OR {has_class('ad')})
SELECT d.page_id, coalesce(string_agg(regexp_replace(t.token, '^<article>$', '<article data-clean="1">'), '' ORDER BY t.pos), '') AS html
FROM docs d LEFT JOIN (SELECT * FROM tokens t WHERE NOT EXISTS (
  SELECT 1 FROM cut c WHERE c.page_id = t.page_id AND c.open <= t.pos AND t.pos <= c.close)) AS t USING (page_id) GROUP BY d.page_id"""
ORACLES["task_extract"] = ON_PAGES + f"""
SELECT e.page_id, 't1' AS task_id, CASE tag WHEN 'li' THEN 'nav li' ELSE 'h1' END AS selector, e.open, e.tag, {text_of('e')} AS text, {html_of('e')} AS inner_html,
  {attributes('e.token')} AS attributes
FROM els e JOIN docs USING (page_id) WHERE (tag = 'li' AND {under('nav')}) OR tag = 'h1'"""
ORACLES["task_search"] = ON_PAGES + f""",
found AS (
  SELECT e.page_id, CASE tag WHEN 'p' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS selector_no, open, {text_of('e')} AS text
  FROM els e JOIN docs USING (page_id) WHERE (tag = 'p' AND {under('article')}) OR tag IN ('b', 'table')
)
SELECT page_id, 't2' AS task_id, selector_no, ['article p', 'b', 'table'][selector_no + 1] AS selector, count(*) AS n,
  string_agg(text, '|' ORDER BY open) AS texts FROM found GROUP BY page_id, selector_no"""
ORACLES["task_analyse"] = ON_PAGES + f""",
sels AS (SELECT unnest([0, 1, 2, 3]) AS selector_no, unnest(['nav', 'article', 'img', 'li']) AS selector),
found AS (
  SELECT e.page_id, e.tag, length({text_of('e')}) AS n_chars,
    EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.tag = 'img' AND x.open > e.open AND x.open < e.close) AS img,
    EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.tag = 'a' AND x.open > e.open AND x.open < e.close) AS a
  FROM els e JOIN docs USING (page_id) WHERE tag IN ('nav', 'article', 'img', 'li')
)
SELECT d.page_id, 't3' AS task_id, s.selector_no, s.selector, count(f.tag) AS n, round(coalesce(avg(f.n_chars), 0), 6) AS mean_text,
  coalesce(bool_or(f.img), false) AS has_images, coalesce(bool_or(f.a), false) AS has_links
FROM docs d CROSS JOIN sels s LEFT JOIN found f ON f.page_id = d.page_id AND f.tag = s.selector
GROUP BY d.page_id, s.selector_no, s.selector"""
ORACLES["task_batch"] = ON_PAGES + f""",
n AS (
  SELECT page_id, count_if(tag = 'p' AND {under('article')}) + count_if(tag IN ('b', 'table')) AS t2,
    count_if(tag IN ('nav', 'article', 'img', 'li')) AS t3, count_if((tag = 'li' AND {under('nav')}) OR tag = 'h1') AS t1
  FROM els e GROUP BY page_id
)
SELECT page_id, unnest([0, 1, 2, 3]) AS batch_order, unnest(['t4', 't2', 't3', 't1']) AS task_id,
  unnest(['unknown', 'search', 'analyze', 'extract']) AS kind, unnest([false, true, true, true]) AS success,
  unnest(['Unknown task type: unknown', NULL, NULL, NULL]) AS error, unnest([NULL, t2, t3, t1]) AS matches FROM n"""

# ---- URL checks -----------------------------------------------------------


def checked(source: str, keep: str, tail: str = "") -> str:
    return f"""SELECT {keep}, url, r IS NULL AS is_valid, r AS reason, {reported('url')} AS protocol,
  CASE WHEN r IS NULL AND {image_format('url')} IN {FORMATS} THEN {image_format('url')} END AS format, length(coalesce(url, '')) AS size
FROM (SELECT *, {reason('url', tail)} AS r FROM ({source}) AS s) AS c"""


ORACLES["link_validation"] = ON_PAGES + f""",
links AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, {_HREF} FROM els e WHERE tag = 'a' AND {has_attr('href', 'e.token')}),
c AS ({checked('SELECT * FROM links', 'page_id')})
SELECT url, is_valid, reason, protocol, format, size, count(*) AS n FROM c GROUP BY ALL"""
_STRICT = (
    f"WHEN {image_format('url')} NOT IN {FORMATS} THEN 'unsupported_format' "
    "WHEN NOT length(url) < 150 THEN 'custom_rule_short' WHEN contains(url, '?') THEN 'custom_rule_no_query'"
)
ORACLES["image_validation"] = f"""WITH c AS ({checked(ADDRESSES, 'id', _STRICT)})
SELECT id, is_valid, reason, protocol, format, size, CASE WHEN reason = 'unsupported_format' THEN
  'Consider using supported formats: jpg, jpeg, png, gif, webp, svg, bmp, ico; Verify the image format is correct' END AS recommendations,
  CASE reason WHEN 'empty_or_invalid_input' THEN 'URL is empty or not a string' WHEN 'url_too_long' THEN 'URL exceeds maximum length of 2000'
    WHEN 'invalid_url_format' THEN 'Invalid URL format' WHEN 'unsupported_protocol' THEN 'Protocol ''' || ({protocol("url")}) || ''' is not allowed. Allowed: http:, https:, data:'
    WHEN 'empty_svg_data_url' THEN 'Empty SVG data URL detected' WHEN 'data_url_too_short' THEN 'Data URL too short (' || length(url) || ' < 100)'
    WHEN 'invalid_base64_data' THEN 'Invalid or empty base64 data' WHEN 'unsupported_format' THEN 'Image format ''' || {image_format("url")} || ''' is not supported'
    WHEN 'custom_rule_no_query' THEN 'query' WHEN 'custom_rule_short' THEN 'long' END AS message
FROM c"""
_CHECKED = f"WITH c AS ({checked(ADDRESSES, 'id')})"
ORACLES["validation_totals"] = _CHECKED + """
SELECT count(*) AS total, count_if(is_valid) AS valid, count_if(NOT is_valid) AS invalid FROM c"""
ORACLES["url_distributions"] = _CHECKED + """
SELECT 'reason' AS dimension, reason AS value, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'protocol', protocol, count(*) FROM c GROUP BY protocol
UNION ALL SELECT 'format', format, count(*) FROM c WHERE format IS NOT NULL GROUP BY format"""
ORACLES["url_protocols"] = f"""SELECT id, {protocol('url')} AS protocol, {reported('url')} AS reported, {image_format('url')} AS format FROM ({ADDRESSES}) AS a"""
ORACLES["image_keys"] = rf"""
SELECT id, 'patch_' || regexp_replace(version, '[^a-zA-Z0-9.-]', '_', 'g') || '.' || CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'webp') THEN ext ELSE 'jpg' END AS file_key
FROM (SELECT id, version, lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]\.([^./]*)\z', 1)) AS ext FROM ({ADDRESSES}) AS a) AS b"""
ORACLES["webhook_filter"] = r"""
SELECT s_suppkey, url, regexp_matches(url, '^https://discord\.com/api/webhooks/\d+/[\w-]+$') AS ok FROM (
  SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'https://discord.com' ELSE 'https://discordapp.com' END || '/api/webhooks/' || s_suppkey || '/' ||
    CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', '-') ELSE s_name END AS url FROM supplier) AS s"""

# ---- text -----------------------------------------------------------------

WORDS = rf"len(regexp_extract_all(text, '[^{SP}]+'))"
SENTENCES = rf"len([s for s in regexp_split_to_array(text, '[.!?]+') if regexp_matches(s, '[^{SP}]')])"
SYLLABLES = "greatest(1, len(regexp_extract_all(regexp_replace(lower(text), '[^a-z]', '', 'g'), '[aeiouy]+')))"
ORACLES["text_counts"] = f"SELECT doc_id, {WORDS} AS words, length(text) AS characters, {SENTENCES} AS sentences FROM documents"


def keyword_sql(source: str, key: str) -> str:
    return rf"""
words AS (
  SELECT {key}, w, i FROM (
    SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT {key}, [w for w in regexp_split_to_array(regexp_replace(lower(text), '[^\w{SP}]', '', 'g'), '[{SP}]+') if length(w) > 3] AS ws FROM {source}
    ) AS a
  ) AS b
),
ranked AS (
  SELECT {key}, w AS word, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(i)) - 1 AS rank FROM words GROUP BY {key}, w
),
top AS (SELECT * FROM ranked WHERE rank < 10)"""


ORACLES["keywords"] = "WITH " + keyword_sql("documents", "doc_id") + "\nSELECT doc_id, rank, word, n FROM top"


def ease(w: str, s: str, y: str) -> str:
    return (
        f"CASE WHEN {s} = 0 OR {w} = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * "
        f"(CAST({w} AS DOUBLE) / {s}) - CAST(84.6 AS DOUBLE) * (CAST({y} AS DOUBLE) / {w}))), 6) END"
    )


ORACLES["readability"] = f"""
SELECT doc_id, {ease('w', 's', 'y')} AS score FROM (SELECT doc_id, {WORDS} AS w, {SENTENCES} AS s, {SYLLABLES} AS y FROM documents) AS d"""
ORACLES["syllables"] = f"SELECT doc_id, {SYLLABLES} AS syllables FROM documents"
LANGUAGE = rf"""CASE WHEN length(regexp_replace(text, '[{SP}]', '', 'g')) = 0 THEN 'unknown'
  WHEN len(regexp_extract_all(text, '{KANA_KANJI}')) / length(regexp_replace(text, '[{SP}]', '', 'g')) > 0.1 THEN 'ja' ELSE 'en' END"""
ORACLES["language_tag"] = f"""
SELECT doc_id, {LANGUAGE} AS language FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(10) WHEN doc_id % 3 = 0 THEN text || repeat('パッチ漢字', CAST(floor(length(text) / 20) AS BIGINT)) ELSE text END AS text FROM documents) AS d"""

# ---- page content ---------------------------------------------------------

ORACLES["page_metadata"] = ON_PAGES + f""",
t AS (SELECT page_id, string_agg({text_of('e')}, '' ORDER BY open) AS title FROM els e JOIN docs USING (page_id) WHERE tag = 'title' GROUP BY page_id),
h AS (SELECT page_id, min_by({text_of('e')}, open) AS h1 FROM els e JOIN docs USING (page_id) WHERE tag = 'h1' GROUP BY page_id),
m AS (
  SELECT page_id, min_by({attr('content')}, open) FILTER ({attr('name')} = 'description') AS description,
    min_by({attr('content')}, open) FILTER ({attr('name')} = 'author') AS author FROM els WHERE tag = 'meta' GROUP BY page_id
)
SELECT d.page_id, CASE WHEN t.title <> '' THEN t.title ELSE coalesce(h.h1, '') END AS title, m.description, m.author
FROM docs d LEFT JOIN t USING (page_id) LEFT JOIN h USING (page_id) LEFT JOIN m USING (page_id)"""
ORACLES["publish_dates"] = """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 < 4 THEN epoch_ms(o_orderdate) END AS published_ms FROM orders"""
_OUTLINE = f"""
SELECT page_id, 'section' AS kind, row_number() OVER (PARTITION BY page_id ORDER BY open) - 1 AS pos,
  coalesce({attr_or_empty('id', 'token')}, {attr_or_empty('class', 'token')}, 'unnamed') AS value
FROM els WHERE tag IN ('section', 'article') OR (tag = 'div' AND {attr('role')} = 'main')
UNION ALL
SELECT page_id, 'topic', row_number() OVER (PARTITION BY page_id ORDER BY open) - 1, v
FROM (SELECT e.page_id, e.open, {trim(text_of('e'))} AS v FROM els e JOIN docs USING (page_id) WHERE tag IN ('h1', 'h2', 'h3')) AS x WHERE v <> ''"""
ORACLES["page_outline"] = f"({ON_PAGES}{_OUTLINE})\nUNION ALL\n({ON_LISTINGS}{_OUTLINE})"
ORACLES["content_profile"] = ON_PAGES + f""",
b AS (SELECT page_id, string_agg({text_of('e')}, '' ORDER BY open) AS text FROM els e JOIN docs USING (page_id) WHERE tag = 'body' GROUP BY page_id),
{keyword_sql('b', 'page_id')},
k AS (SELECT page_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM top GROUP BY page_id),
c AS (
  SELECT page_id, count_if(tag = 'p') AS paragraph_count, count_if(tag IN ('h1','h2','h3','h4','h5','h6')) AS heading_count,
    count_if(tag = 'a' AND {has_attr('href')}) AS link_count, count_if(tag = 'img') AS image_count FROM els GROUP BY page_id
),
t AS (SELECT page_id, string_agg({text_of('e')}, '' ORDER BY open) AS title FROM els e JOIN docs USING (page_id) WHERE tag = 'title' GROUP BY page_id),
h AS (SELECT page_id, string_agg({trim(text_of('e'))}, '|' ORDER BY open) AS topics FROM els e JOIN docs USING (page_id) WHERE tag IN ('h1', 'h2', 'h3') AND {trim(text_of('e'))} <> '' GROUP BY page_id),
s AS (SELECT page_id, string_agg('unnamed', '|') AS sections FROM els WHERE tag = 'article' GROUP BY page_id),
x AS (SELECT page_id, {WORDS} AS w, {SENTENCES} AS s, {SYLLABLES} AS y, length(text) AS n, {LANGUAGE} AS language FROM b)
SELECT d.page_id, x.w AS word_count, x.n AS character_count, paragraph_count, heading_count, link_count, image_count, t.title,
  coalesce(k.keywords, '') AS keywords, coalesce(s.sections, '') AS sections, coalesce(h.topics, '') AS topics, {ease('x.w', 'x.s', 'x.y')} AS readability, x.language
FROM docs d LEFT JOIN x USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN t USING (page_id) LEFT JOIN h USING (page_id)
LEFT JOIN s USING (page_id) LEFT JOIN k USING (page_id)"""

# ---- structure ------------------------------------------------------------

_CLASS_ROWS = f"""
SELECT page_id, open, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (
  SELECT page_id, open, [c for c in string_split({attr('class')}, ' ') if c <> ''] AS cs FROM els WHERE {has_attr('class')}) AS z"""
_DEPTH = """
depths AS (
  SELECT d.page_id, coalesce(max(e.depth - b.depth + 1), 0) AS structure_depth
  FROM docs d LEFT JOIN els b ON b.page_id = d.page_id AND b.tag = 'body' LEFT JOIN els e ON e.page_id = b.page_id AND e.open >= b.open AND e.open < b.close
  GROUP BY d.page_id
)"""
ORACLES["page_structure"] = ON_LISTINGS + f""",{_DEPTH},
cls AS (SELECT page_id, count(DISTINCT c) AS n FROM ({_CLASS_ROWS}) AS q GROUP BY page_id),
ids AS (SELECT page_id, count(DISTINCT {attr('id')}) AS n FROM els GROUP BY page_id)
SELECT e.page_id, count(*) AS total_elements, any_value(coalesce(cls.n, 0)) AS available_classes,
  count_if({has_class('grid', 'e.token')}) AS grid_containers, count_if(tag = 'img') AS image_elements,
  count_if(tag = 'a' AND {has_attr('href', 'e.token')}) AS link_elements, any_value(structure_depth) AS structure_depth,
  any_value(coalesce(cls.n, 0) + ids.n) AS unique_selectors
FROM els e JOIN depths USING (page_id) LEFT JOIN cls USING (page_id) LEFT JOIN ids USING (page_id) GROUP BY e.page_id"""
ORACLES["page_classes"] = ON_LISTINGS + f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(open * 1000 + i)) - 1 AS rank, c AS class_name
FROM ({_CLASS_ROWS}) AS q GROUP BY page_id, c QUALIFY rank < 50"""
ORACLES["page_depth"] = ON_PAGES + f",{_DEPTH}\nSELECT page_id, structure_depth FROM depths"
_CLASSES = f"coalesce(array_to_string([c for c in string_split({attr('class', 'e.token')}, ' ') if c <> ''], ' '), '')"
_KIDS = "(SELECT count(*) FROM els k WHERE k.page_id = e.page_id AND k.parent = e.open)"
ORACLES["page_links"] = ON_LISTINGS + f"""
SELECT e.page_id, e.open, {_CLASSES} AS classes, substr({text_of('e')}, 1, 100) AS text, {_KIDS} AS child_count,
  coalesce({attr('href', 'e.token')}, '') AS href, {attr('target', 'e.token')} AS target, {attr('rel', 'e.token')} AS rel,
  regexp_matches(coalesce({attr('href', 'e.token')}, ''), '^https?://') AS is_external
FROM els e JOIN docs USING (page_id) WHERE tag = 'a' AND {has_attr('href', 'e.token')}"""
_IMAGES = f"""
SELECT e.page_id, e.open, {_CLASSES} AS classes, coalesce({attr('alt', 'e.token')}, '') AS text, {attr('src', 'e.token')} AS src,
  {attr('data-src', 'e.token')} AS data_src, {attr('alt', 'e.token')} AS alt,
  nullif(lower(regexp_extract({_SRC}, '\\.([a-zA-Z0-9]+)(?:[?#]|\\z)', 1)), '') AS format, coalesce({_SRC} <> '', false) AS is_valid
FROM els e WHERE tag = 'img'"""
ORACLES["page_images"] = ON_LISTINGS + _IMAGES
ORACLES["unique_selectors"] = ON_LISTINGS + f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(o)) - 1 AS rank, s AS selector FROM (
  SELECT page_id, open AS o, '#' || {attr('id')} AS s FROM els WHERE {attr('id')} <> ''
  UNION ALL SELECT page_id, 1000000 + open * 1000 + i, '.' || c FROM ({_CLASS_ROWS}) AS q
) AS u GROUP BY page_id, s QUALIFY rank < 100"""
ORACLES["grid_containers"] = ON_LISTINGS + f"""
SELECT e.page_id, e.open, e.tag, {_CLASSES} AS classes, substr({text_of('e')}, 1, 100) AS text, {_KIDS} AS child_count
FROM els e JOIN docs USING (page_id) WHERE {has_class('grid', 'e.token')}"""
ORACLES["element_analysis"] = ON_LISTINGS + f""",
found AS (
  SELECT e.*, 0 AS rank FROM els e WHERE tag = 'img' AND EXISTS (SELECT 1 FROM els x WHERE x.page_id = e.page_id AND x.tag = 'a' AND {has_class('card', 'x.token')} AND x.open < e.open AND e.open < x.close)
  UNION ALL SELECT e.*, 1 FROM els e WHERE tag = 'span' UNION ALL SELECT e.*, 2 FROM els e WHERE {has_class('hero', 'e.token')}
),
e AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, open) = 1)
SELECT d.page_id, CASE WHEN e.open IS NULL THEN 0 ELSE 1 END AS element_count, coalesce(e.tag, 'none') AS tag, {_CLASSES} AS classes,
  coalesce({attributes('e.token', True)}, '') AS attributes, CASE WHEN e.open IS NULL THEN '' ELSE substr({text_of('e', 'd.toks')}, 1, 200) END AS text,
  {attr('href', 'e.token')} AS href, e.open IS NOT NULL AND {trim(text_of('e', 'd.toks'))} <> '' AS is_valid
FROM docs d LEFT JOIN e USING (page_id)"""
ORACLES["element_children"] = ON_LISTINGS + f""",
found AS (SELECT page_id, open, CASE WHEN {has_class('grid')} THEN 0 ELSE 1 END AS rank FROM els WHERE tag = 'section'),
best AS (SELECT page_id, min_by(open, rank * 100000 + open) AS at FROM found GROUP BY page_id)
SELECT e.page_id, e.open, e.tag, {_CLASSES} AS classes, substr({text_of('e')}, 1, 100) AS text, {_KIDS} AS child_count
FROM els e JOIN docs USING (page_id) JOIN best b ON b.page_id = e.page_id AND e.parent = b.at"""
ORACLES["image_sizes"] = f"""WITH i AS ({ON_LISTINGS}{_IMAGES})
SELECT page_id, count(*) AS total, count_if(is_valid) AS valid, count_if(NOT is_valid) AS invalid, coalesce(min(length(coalesce(src, data_src))), 0) AS min_size,
  coalesce(max(length(coalesce(src, data_src))), 0) AS max_size, round(coalesce(avg(length(coalesce(src, data_src))), 0), 6) AS mean_size FROM i GROUP BY page_id"""
ORACLES["image_formats"] = f"""WITH i AS ({ON_LISTINGS}{_IMAGES})
SELECT page_id, format, count(*) AS n FROM i WHERE format IS NOT NULL GROUP BY ALL"""

# ---- state ----------------------------------------------------------------

SNAPS, STATE, RECORDS = I.as_sql(I.SNAPSHOTS), I.as_sql(I.STATE), I.as_sql(I.RECORDS)
ORACLES["new_releases"] = f"""
SELECT n.source, n.snap_id, n.version, n.url FROM ({SNAPS}) AS n LEFT JOIN ({STATE}) AS s ON s.source = n.source
WHERE s.version IS NULL OR NOT (s.version = n.version AND s.url = n.url)"""
ORACLES["change_feed"] = f"""
SELECT source, snap_id, ts, version, url, title FROM (
  SELECT *, lag(version) OVER w AS pv, lag(url) OVER w AS pu, row_number() OVER w AS rn FROM ({SNAPS}) AS s
  WINDOW w AS (PARTITION BY source ORDER BY ts, snap_id)) AS t
WHERE rn = 1 OR version IS DISTINCT FROM pv OR url IS DISTINCT FROM pu"""
ORACLES["event_changes"] = """
SELECT user_id, event_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) AS t
WHERE p IS NULL OR p <> event_type"""
ORACLES["stream_changes"] = ORACLES["event_changes"]
ORACLES["state_merge"] = f"""WITH n AS (
  SELECT source, arg_max(version, (ts, version, url)) AS version, arg_max(title, (ts, version, url)) AS title,
    arg_max(url, (ts, version, url)) AS url, max(ts) AS ts, count(*) AS added FROM ({SNAPS}) AS s GROUP BY source),
st AS ({STATE})
SELECT coalesce(st.source, n.source) AS source, CASE WHEN n.source IS NULL THEN st.version ELSE n.version END AS version,
  CASE WHEN n.source IS NULL THEN st.title ELSE n.title END AS title, CASE WHEN n.source IS NULL THEN st.url ELSE n.url END AS url,
  coalesce(n.ts, st.published_at) AS published_at, coalesce(n.ts, st.last_notification) AS last_notification,
  coalesce(st.total, 0) + coalesce(n.added, 0) AS total
FROM st FULL JOIN n ON n.source = st.source"""
ORACLES["state_repair"] = f"""
SELECT source, greatest(total, 0) AS total, least(last_notification, TIMESTAMP '2024-01-31 00:00:00') AS last_notification FROM ({STATE}) AS s"""
_STORED = f"""
SELECT version, title, url, published_at, nullif(content, '') AS content, nullif(image_url, '') AS image_url, nullif(local_image_path, '') AS local_image_path
FROM ({RECORDS}) AS r WHERE version IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL AND published_at IS NOT NULL"""
ORACLES["stored_releases"] = _STORED
_WANTED = f"""SELECT (snap_id % 50 + 1) || '.' || (source % 40) AS version, snap_id, '/news/' || source AS url,
  CAST(NULL AS VARCHAR) AS content, 'https://img.example.com/list.png' AS image_url FROM ({SNAPS}) AS s"""
_KEY = "regexp_replace({0}, '[^a-zA-Z0-9.-]', '_', 'g')"
ORACLES["has_details"] = f"""
SELECT snap_id, version FROM ({_WANTED}) AS w WHERE {_KEY.format('version')} IN (
  SELECT {_KEY.format('version')} FROM ({_STORED}) AS s WHERE content IS NOT NULL)"""
ORACLES["enrichment"] = f"""WITH c AS (
  SELECT * FROM ({_STORED}) AS s WHERE content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_KEY.format('version')} ORDER BY published_at DESC, content DESC) = 1),
f AS (SELECT '/news/' || c_custkey AS url, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS content,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://img.example.com/c' || c_custkey || '.gif' END AS image_url FROM customer)
SELECT w.version, w.snap_id, w.url, CASE WHEN c.version IS NOT NULL THEN 'store' ELSE 'page' END AS details_from,
  CASE WHEN c.version IS NOT NULL THEN c.content ELSE nullif(f.content, '') END AS content,
  coalesce(CASE WHEN c.version IS NOT NULL THEN c.image_url ELSE nullif(f.image_url, '') END, w.image_url) AS image_url,
  c.local_image_path
FROM ({_WANTED}) AS w LEFT JOIN c ON {_KEY.format('c.version')} = {_KEY.format('w.version')} LEFT JOIN f ON f.url = w.url"""
ORACLES["image_choice"] = f"""WITH inv AS (SELECT DISTINCT 'patch_' || (s_suppkey % 50 + 1) || '.' || (s_suppkey % 25) || '.jpg' AS k FROM supplier),
r AS (SELECT *, 'patch_' || version || '.jpg' IN (SELECT k FROM inv) AND local_image_path <> '' AS loc FROM ({RECORDS}) AS q)
SELECT url, version, CASE WHEN loc THEN 'local' WHEN image_url <> '' THEN 'remote' ELSE 'none' END AS image_kind,
  CASE WHEN loc THEN local_image_path ELSE nullif(image_url, '') END AS image FROM r"""
ORACLES["fresh_cache"] = "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'"
ORACLES["retention"] = f"""
SELECT url, published_at, CASE WHEN published_at < TIMESTAMP '2024-04-01 00:00:00' THEN 'drop' ELSE 'keep' END AS action FROM ({RECORDS}) AS r"""
ERRORS = I.as_sql(I.ERRORS)
ORACLES["alert_routing"] = f"""
SELECT event_id, code, CASE code WHEN 'SCRAPING_ERROR' THEN 'スクレイピングエラー' WHEN 'NETWORK_ERROR' THEN 'ネットワークエラー'
  WHEN 'DISCORD_ERROR' THEN 'Discord通知エラー' ELSE 'アプリケーションエラー' END AS label, code IN ('SCRAPING_ERROR', 'DISCORD_ERROR') AS alert FROM ({ERRORS}) AS e"""
ORACLES["run_stats"] = """
SELECT user_id AS source, count_if(event_type <> 'error') AS total_executions, max(ts) FILTER (event_type <> 'error') AS last_execution,
  max(ts) FILTER (event_type <> 'error') + INTERVAL 90 MINUTE AS next_execution FROM events GROUP BY user_id"""

# ---- stores, exports, responses, notices ----------------------------------

_ONE = f"""SELECT *, version AS v FROM ({RECORDS}) AS r"""
ORACLES["store_roundtrip"] = f"""
SELECT v AS version, v AS version_key, title, url, content, '{BASE}' AS source_url FROM ({_ONE}) AS r
QUALIFY row_number() OVER (PARTITION BY v ORDER BY published_at DESC, url DESC) = 1"""
ORACLES["record_roundtrip"] = f"SELECT version, title, url, published_at, content, image_url FROM ({RECORDS}) AS r"
ORACLES["record_quarantine"] = """
SELECT 'v' || page_id AS version, CASE WHEN page_id % 11 = 5 OR page_id % 13 = 6 THEN 'malformed' WHEN page_id % 7 = 3 THEN 'missing url' ELSE 'good' END AS state,
  CASE WHEN page_id % 11 <> 5 AND page_id % 13 <> 6 AND page_id % 7 <> 3 THEN length(url) END AS size FROM pages"""
ORACLES["stored_summaries"] = """
WITH e AS (
  SELECT regexp_replace((user_id % 200) || '/' || event_type, '[^a-zA-Z0-9.-]', '_', 'g') AS version_key, event_type || '-' || event_id AS summary, ts FROM events),
a AS (SELECT version_key, arg_max(summary, (ts, summary)) AS summary FROM e WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT version_key, arg_max(summary, (ts, summary)) AS summary FROM e WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT version_key, coalesce(b.summary, a.summary) AS summary, a.summary AS before FROM a FULL JOIN b USING (version_key)"""
ORACLES["state_snapshots"] = """
SELECT as_of, user_id AS source, arg_max(event_type, (ts, event_id)) AS version, count(*) AS total
FROM events, (VALUES ('2024-01-08', TIMESTAMP '2024-01-08'), ('2024-01-15', TIMESTAMP '2024-01-15'), ('2024-01-22', TIMESTAMP '2024-01-22'), ('restored', TIMESTAMP '2024-01-08')) AS s(as_of, stop)
WHERE ts < stop GROUP BY as_of, user_id"""
OPS = I.as_sql(I.OPERATIONS)
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM {0}) % 1000 AS VARCHAR), 3, '0') || 'Z'"
ORACLES["session_export"] = f"""
SELECT session_id, op_id AS operation_id, type, {ISO.format('ts')} AS timestamp, coalesce(CAST(duration AS VARCHAR), '') AS duration, error = '' AS success, error FROM ({OPS}) AS o"""
ORACLES["session_report"] = f"""
SELECT session_id, 0 AS part, '' AS order_key, '<!doctype html><html lang="en"><meta charset="utf-8"><title>Session ' || session_id || '</title><h1>Session ' || session_id ||
  '</h1><dl><dt>Start</dt><dd>' || {ISO.format('min(ts)')} || '</dd><dt>Address</dt><dd>' || CASE WHEN session_id % 3 > 0 THEN '/s?a=1&amp;b=' || session_id ELSE 'none' END ||
  '</dd><dt>Length</dt><dd>' || (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 || ' ms</dd><dt>Operations</dt><dd>' || count(*) || ' in all, ' || count_if(error = '') || ' done, ' || count_if(error <> '') ||
  ' failed</dd><dt>Mean time</dt><dd>' || printf('%.2f', coalesce(avg(duration), 0)) || ' ms</dd></dl><table>' AS html FROM ({OPS}) AS o GROUP BY session_id
UNION ALL
SELECT session_id, 1, {ISO.format('ts')} || ' ' || lpad(CAST(op_id AS VARCHAR), 20, '0'),
  '<tr class="' || CASE WHEN error = '' THEN 'done' ELSE 'failed' END || '"><td>' || {ISO.format('ts')} || '</td><td>' || op_id || '</td><td>' || type || '</td><td>' || coalesce(CAST(duration AS VARCHAR), '0') ||
  ' ms</td><td>' || error || '</td></tr>' FROM ({OPS}) AS o
UNION ALL SELECT DISTINCT session_id, 2, '', '</table></html>' FROM ({OPS}) AS o"""
ORACLES["prompts"] = """
SELECT doc_id, 'Summarise release 1.' || doc_id || ' as JSON with summary, keyChanges, newFeatures, importantBugFixes and skinContent.' || chr(10) ||
  'Title: ' || source || chr(10) || 'URL: /d/' || doc_id || chr(10) || chr(10) || text AS prompt FROM documents WHERE text <> ''"""

RESPONSES = I.as_sql(I.RESPONSES)


def _list(field: str) -> str:
    return (
        f"CASE WHEN NOT good THEN NULL WHEN json_type(j, '$.{field}') = 'ARRAY' THEN "
        f"[json_extract_string(x, '$') for x in CAST(json_extract(j, '$.{field}') AS JSON[]) if json_type(x) = 'VARCHAR'] ELSE [] END"
    )


_PARSED = rf"""
raw AS (SELECT response_id, response, coalesce(nullif(regexp_extract(response, '```json\n([\s\S]*?)\n```', 1), ''), response) AS body FROM ({RESPONSES}) AS r),
checked AS (SELECT *, CASE WHEN json_valid(body) AND body <> 'null' THEN CAST(body AS JSON) END AS j, json_valid(body) AND body <> 'null' AS good FROM raw),
sums AS (
  SELECT response_id, response, NOT good AS is_fallback,
    CASE WHEN NOT good THEN substr(response, 1, 500) || '...' WHEN json_type(j, '$.summary') = 'VARCHAR' THEN json_extract_string(j, '$.summary') ELSE '' END AS summary,
    CASE WHEN NOT good THEN ['詳細は元のパッチノートをご確認ください'] ELSE {_list('keyChanges')} END AS key_changes,
    {_list('newFeatures')} AS new_features, {_list('importantBugFixes')} AS important_bug_fixes, {_list('skinContent')} AS skin_content
  FROM checked
)"""


def _shown(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '<null>' ELSE coalesce(array_to_string({name}, '|'), '') END AS {name}"


ORACLES["parsed_responses"] = f"""WITH {_PARSED}
SELECT response_id, is_fallback, summary, {_shown('key_changes')}, {_shown('new_features')}, {_shown('important_bug_fixes')}, {_shown('skin_content')}, 'summary-model' AS model FROM sums"""
ORACLES["response_fallbacks"] = f"WITH {_PARSED}\nSELECT response_id, summary FROM sums WHERE is_fallback"


def cut(text: str) -> str:
    return f"CASE WHEN length({text}) > 1021 THEN substr({text}, 1, 1021) || '...' ELSE {text} END"


def numbered(items: str) -> str:
    return cut(f"array_to_string([i || '. ' || ({items})[i] for i in range(1, len({items}) + 1)], chr(10) || chr(10))")


_NOTICES = _PARSED + """,
rows AS (
  SELECT response_id AS source, '14.' || (response_id % 30) AS version, 'https://www.example.com/n/' || response_id AS url,
    CASE response_id % 3 WHEN 0 THEN 'https://img.example.com/a.jpg' WHEN 1 THEN '' END AS image_url,
    response_id % 4 = 0 AS is_local, CASE WHEN response_id % 6 <> 0 THEN summary END AS summary,
    key_changes, new_features, important_bug_fixes, skin_content FROM sums
),
fields AS (
""" + f"""
  SELECT source, 0 AS slot, '{VERSION_FIELD}' AS name, version AS value, true AS inline FROM rows
  UNION ALL SELECT source, 1, '{LINK_FIELD}', '[{LINK_TEXT}](' || url || ')', true FROM rows
  UNION ALL SELECT source, 2, '{SUMMARY_FIELD}', {cut('summary')}, false FROM rows WHERE summary <> ''
  UNION ALL SELECT source, 3, '{CHANGES_FIELD}', {numbered('key_changes')}, false FROM rows WHERE summary IS NOT NULL AND len(key_changes) > 0
""" + "".join(
    f"  UNION ALL SELECT source, {4 + i}, '{name}', {numbered(c + '[1:3]')}, false FROM rows WHERE summary IS NOT NULL AND len({c}) > 0\n"
    for i, (c, name) in enumerate(LIST_FIELDS.items())
) + f"""
  UNION ALL SELECT source, 9, '{MODEL_FIELD}', 'summary-model | 2024/1/31 0:00:00', true FROM rows WHERE summary IS NOT NULL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS pos FROM fields)"""
ORACLES["embed_fields"] = f"WITH {_NOTICES}\nSELECT source, pos, name, value, inline FROM placed"
_IMAGE = "CASE WHEN is_local THEN 'attachment://patch_' || version || '.jpg' ELSE nullif(image_url, '') END"
ORACLES["embeds"] = f"""WITH {_NOTICES}
SELECT r.source, 'Patch ' || r.version AS title, r.url, CASE WHEN r.summary IS NULL THEN 39423 ELSE 65433 END AS color, '2024-01-31T00:00:00.000Z' AS stamp,
  'Release notices' || CASE WHEN r.summary IS NULL THEN '' ELSE ' | AI要約付き' END AS footer, string_agg(f.name || '=' || f.value || '=' || f.inline, '|' ORDER BY f.slot) AS fields, {_IMAGE.replace('version', 'r.version')} AS image
FROM rows r JOIN fields f USING (source) GROUP BY ALL"""


def js(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


ORACLES["outbox"] = f"""WITH {_NOTICES},
fs AS (SELECT source, string_agg('{{"name":' || {js('name')} || ',"value":' || {js('value')} || ',"inline":' || inline || '}}', ',' ORDER BY pos) AS body FROM placed GROUP BY source)
SELECT source, version, '{{"content":"{RELEASE_CONTENT}","embeds":[{{"title":"Patch ' || version || '","url":"' || url || '","color":' ||
  CASE WHEN summary IS NULL THEN 39423 ELSE 65433 END || ',"timestamp":"2024-01-31T00:00:00.000Z","footer":{{"text":"Release notices' ||
  CASE WHEN summary IS NULL THEN '' ELSE ' | AI要約付き' END || '"}},"fields":[' || body || ']' ||
  coalesce(',"image":{{"url":"' || ({_IMAGE}) || '"}}', '') || '}}]}}' AS payload
FROM rows JOIN fs USING (source)"""
ORACLES["error_alerts"] = f"""
SELECT event_id, '{{"content":"{ERROR_CONTENT}","embeds":[{{"title":"{ERROR_TITLE}","description":' || {js(f"'{ERROR_PREFIX}' || message")} ||
  ',"color":16711680,"timestamp":"2024-01-31T00:00:00.000Z","footer":{{"text":"Release notices - Error"}}' ||
  CASE WHEN context IS NULL THEN '' ELSE ',"fields":[{{"name":"{CONTEXT_FIELD}","value":"' || context || '","inline":false}}]' END || '}}]}}' AS payload
FROM ({ERRORS}) AS e WHERE code IN ('SCRAPING_ERROR', 'DISCORD_ERROR')"""

# ---- masking --------------------------------------------------------------

MESSAGES = I.as_sql(I.MESSAGES)
TEXTS = f"SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'm' || id, text FROM ({MESSAGES}) AS m"


def mask(text: str) -> str:
    for pattern, new in (
        (r"AIza[0-9A-Za-z_-]{35}", API_KEY_MASK), (r"sk-[a-zA-Z0-9]{48}", API_KEY_MASK),
        (r"Bot\s+[A-Za-z0-9._-]{59}", API_KEY_MASK), (WEBHOOK_URL, WEBHOOK_MASK),
        (r"\b([A-Za-z0-9._%+-]{1,2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", r"\1***@\2"),
        (r"\b\d{3}-\d{4}-\d{4}\b", PERSONAL_MASK), (r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b", PERSONAL_MASK),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


ORACLES["masked_text"] = f"SELECT id, {mask('text')} AS masked FROM ({TEXTS}) AS t"
ORACLES["masked_ids"] = rf"SELECT id, regexp_replace(text, '\b(\d{{4}})\d{{9,11}}(\d{{4}})\b', '\1***\2', 'g') AS masked FROM ({TEXTS}) AS t"


def starred(source: str, number: int, pattern: str) -> str:
    """One step of the mask that keeps lengths: pieces and stars, zipped."""
    return rf"""
s{number} AS (
  SELECT id, array_to_string([p[i] || coalesce(repeat('*', length(m[i])), '') for i in range(1, len(p) + 1)], '') AS text
  FROM (SELECT id, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM {source}) AS q
)"""


_EMAIL = rf"""e AS (SELECT id, regexp_replace(text, '\b([A-Za-z0-9._%+-]{{1,2}})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}})\b', '\1***@\2', 'g') AS text FROM s3)"""
ORACLES["masked_length"] = "WITH " + ",".join([
    f"t AS ({TEXTS})", starred("t", 0, KEY_RULES[0]), starred("s0", 1, KEY_RULES[1]), starred("s1", 2, KEY_RULES[2]),
    starred("s2", 3, WEBHOOK_URL), _EMAIL, starred("e", 4, r"\b\d{3}-\d{4}-\d{4}\b"), starred("s4", 5, r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b"),
]) + "\nSELECT id, text AS masked FROM s5"
ORACLES["masked_records"] = f"""
SELECT id, {mask('text')} AS note, '[MASKED]' AS api_key, {mask('text')} AS line, '[MASKED]' AS author, {mask('text')} AS text FROM ({MESSAGES}) AS m"""
ORACLES["masked_errors"] = rf"""
SELECT id, regexp_replace(regexp_replace({mask('text')}, '/Users/[^/]+', '/Users/[USER]', 'g'), '\\Users\\[^\\]+', '\\Users\\[USER]', 'g') AS message FROM ({TEXTS}) AS t"""
_SENSITIVE = "regexp_matches(lower(key), '" + "|".join(SENSITIVE_WORDS) + "')"
ORACLES["settings_audit"] = f"""WITH s AS ({I.as_sql(I.SETTINGS)})
SELECT owner, key || ' appears to be too short for security' AS issue FROM s WHERE {_SENSITIVE} AND length(value) < 32
UNION ALL SELECT owner, key || ' appears to be a test/demo key' FROM s WHERE {_SENSITIVE} AND regexp_matches(lower(value), 'test|demo')"""

# ---- operation metrics ----------------------------------------------------

_LOG = _CARD + """,
ranks AS (
  SELECT page_id, 'container' AS operation, brank + 1 AS rank, ['section::before', '.missing', 'section.grid > .card', 'div section[class~=grid]'] AS names FROM cards
  UNION ALL SELECT page_id, 'title', CASE WHEN t1 IS NOT NULL THEN trank WHEN title IS NOT NULL THEN 3 END, ['.title', 'h3', 'p', 'container-text'] FROM cards WHERE boxed
  UNION ALL SELECT page_id, 'url', CASE WHEN u0 IS NOT NULL THEN 0 WHEN ord < 10 THEN ord + 1 WHEN ord >= 10 THEN 5 END,
    ['container-href', '', 'a[href*="patch"]', 'a.go', 'a', 'document-fallback'] FROM cards WHERE boxed AND title IS NOT NULL
  UNION ALL SELECT page_id, 'image', CASE WHEN irank < 10 THEN irank WHEN irank >= 10 THEN 3 END, ['img[src*="patch"]', 'img.hero', 'img', 'document-fallback'] FROM cards WHERE status = 'ok'),
log AS (
  SELECT page_id, operation, rank IS NOT NULL AS success, names[rank + 1] AS selector, coalesce(rank > 0, false) AS fallback, coalesce(rank + 1, len(names)) AS attempts,
    CASE WHEN rank IS NULL THEN operation || '_not_found' END AS error, names FROM ranks),
tried AS (
  SELECT selector, CASE WHEN selector = 'section::before' THEN 'error' WHEN i = attempts AND success THEN 'hit' ELSE 'miss' END AS outcome
  FROM (SELECT success, attempts, unnest(names[1:attempts]) AS selector, unnest(range(1, attempts + 1)) AS i FROM log) AS x WHERE selector <> '')"""
ORACLES["parse_log"] = _LOG + " SELECT page_id, operation, success, selector, fallback, attempts, error FROM log"
ORACLES["operation_metrics"] = _LOG + f"""
SELECT operation, count(*) AS total, count_if(ok) AS successful, count_if(NOT ok) AS failed FROM (
  SELECT type AS operation, error = '' AS ok FROM ({OPS}) AS o UNION ALL SELECT operation, success FROM log) AS b GROUP BY operation"""
ORACLES["selector_rates"] = _LOG + f"""
SELECT selector, round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END), 6) AS success_rate
FROM (SELECT selector, outcome FROM ({I.as_sql(I.SELECTOR_LOG)}) AS l UNION ALL SELECT selector, outcome FROM tried) AS b WHERE outcome <> 'miss' GROUP BY selector"""
_SESSIONS = f"""SELECT session_id, count(*) AS total_operations, count_if(error = '') AS successful, count_if(error <> '') AS failed,
  round(avg(duration), 6) AS mean_duration, min(ts) AS started, max(ts) AS ended FROM ({OPS}) AS o GROUP BY session_id"""
ORACLES["session_metrics"] = _SESSIONS
ORACLES["session_cap"] = f"SELECT session_id, started FROM ({_SESSIONS}) AS s ORDER BY started DESC, session_id DESC LIMIT 10"
ORACLES["session_expiry"] = f"""
SELECT session_id, min(ts) AS started FROM ({OPS}) AS o GROUP BY session_id, CAST(ts AS DATE) HAVING min(ts) >= TIMESTAMP '2024-01-14 23:50:00'"""
ORACLES["rolling_hour"] = """
SELECT event_id, event_type, n AS in_window, n - 1 < 20 AS allowed FROM (
  SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) AS w"""

# ---- streams --------------------------------------------------------------

ORACLES["stream_first_card"] = f"SELECT page_id, status, title, url FROM ({ORACLES['page_first_card']}) AS c"
ORACLES["stream_state"] = f"""WITH n AS (
  SELECT user_id AS source, arg_max(event_type, (ts, event_type)) AS version, max(ts) AS ts, count(*) AS added FROM events GROUP BY user_id),
st AS ({STATE})
SELECT coalesce(st.source, n.source) AS source, CASE WHEN n.source IS NULL THEN st.version ELSE n.version END AS version,
  coalesce(n.ts, st.last_notification) AS last_notification, coalesce(st.total, 0) + coalesce(n.added, 0) AS total FROM st FULL JOIN n ON n.source = st.source"""
ORACLES["stream_rates"] = "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES["stream_late"] = """
WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS watermark FROM events)
SELECT event_type, date_trunc('hour', ts) AS window_start, count_if(ts >= TIMESTAMP '2024-01-16') AS n, count_if(ts < TIMESTAMP '2024-01-16') AS n_late,
  max(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN (epoch_us(watermark) - epoch_us(ts)) // 1000 END) AS longest_delay_ms
FROM events, w GROUP BY 1, 2"""
ORACLES["stream_sliding_rates"] = f"""
SELECT event_type, s AS window_start, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) AS w
GROUP BY ALL"""
ORACLES["stream_sessions"] = f"""
SELECT user_id, min(ts) AS started, count(*) AS total_operations, count_if(event_type = 'error') AS failed, FALSE AS late FROM (
  SELECT user_id, event_type, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (
    SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) AS a) AS b
GROUP BY user_id, sid"""
ORACLES["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"
