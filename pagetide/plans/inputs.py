"""Inputs the queries derive from the given tables.

The driver tables hold no release pages, requests or responses, so Spark makes
them row by row from the tables: the work of every query grows with its table.
The texts below are plain SQL that other engines read as well, so a check can
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetide.operators.elements import spread_rows

# One listing page per part: cards with every kind of title, link and image.
LISTINGS = """
SELECT p_partkey AS page_id,
  '<html><head><title>Notes ' || p_brand || '</title></head><body><div class="wrap">' ||
  CASE WHEN p_partkey % 7 = 3 THEN '<section class="none">' ELSE '<section class="grid list">' END ||
  CASE p_partkey % 6
    WHEN 0 THEN '<a class="card" href="/news/patch-' || p_size || '-notes">'
    WHEN 1 THEN '<div class="card"><a class="go" href="https://example.com/news/' || p_partkey || '?a=1&amp;b=2">'
    WHEN 2 THEN '<div class="card"><a class="go" href="">'
    WHEN 3 THEN '<a class="card" href="//cdn.example.com/patch/' || p_size || '">'
    WHEN 4 THEN '<a class="card" href="notes/' || p_size || '">'
    ELSE '<div class="card"><span id="s' || p_partkey || '">' END ||
  CASE p_partkey % 5
    WHEN 0 THEN '<h2 class="title">Patch Notes ' || p_size || '.' || (p_partkey % 24 + 1) || '</h2>'
    WHEN 1 THEN '<h2 class="title"> </h2><h3>update ' || p_size || '.1.' || (p_partkey % 9) || ' is out</h3>'
    WHEN 2 THEN '<h2 class="title">' || p_name || '</h2><p>patch' || p_size || '.5 ' || p_type
    WHEN 3 THEN '<h2 class="title">アップデート' || p_size || '.3</h2>'
    ELSE '<h2 class="title">' || p_type || '</h2>' END ||
  CASE p_partkey % 8
    WHEN 0 THEN '<img src="https://img.example.com/patch/' || p_partkey || '.jpg" alt="' || p_brand || '">'
    WHEN 1 THEN '<img data-src="https://img.example.com/n/' || p_partkey || '.PNG?w=1600x900">'
    WHEN 2 THEN '<img src="" data-src="https://img.example.com/x.png">'
    WHEN 3 THEN '<img src="data:image/svg+xml,<svg/>" alt="">'
    WHEN 4 THEN '<img src="/img/' || p_partkey || '.webp"><img class="hero" src="http://img.example.com/splash-1920x1080-' || p_partkey || '.gif">'
    WHEN 5 THEN '<img src="ftp://img.example.com/' || p_partkey || '.bmp">'
    ELSE '<b class="tag new">new' END ||
  CASE WHEN p_partkey % 6 IN (0, 3, 4) THEN '</a>' WHEN p_partkey % 6 = 5 THEN '</span></div>' ELSE '</a></div>' END ||
  '<a class="card" href="/news/patch-old">Patch 1.2</a></section></div>' ||
  '<aside><img src="https://img.example.com/news/' || p_size || '.jpeg"><a href="/patch-all">all</a></aside></body></html>' AS html
FROM {part}
"""

# Image and page addresses of every shape, one per part.
ADDRESSES = """
SELECT p_partkey AS id,
  CASE p_partkey % 16
    WHEN 0 THEN 'https://static.example.org/covers/' || p_size || '.jpg'
    WHEN 1 THEN 'http://static.example.org/a/' || p_partkey || '.PNG?w=1'
    WHEN 2 THEN 'data:image/png;base64,' || repeat('a', 60 + p_size * 2)
    WHEN 3 THEN ''
    WHEN 4 THEN 'no address at all ' || p_size
    WHEN 5 THEN '1http://broken.scheme/' || p_partkey
    WHEN 6 THEN 'data:image/svg+xml,<svg xmlns="http://www.w3.org/2000/svg"/>' || p_brand
    WHEN 7 THEN 'data:image/png;base64,abc'
    WHEN 8 THEN 'https://static.example.org/' || repeat('a', p_size * 50) || '.jpg'
    WHEN 9 THEN 'https://static.example.org/scan.tiff#' || p_size
    WHEN 10 THEN 'ftp://static.example.org/' || p_partkey || '.jpg'
    WHEN 11 THEN '/images/photo' || p_size || '.jpg'
    WHEN 12 THEN '//cdn.example.com/p' || p_size || '.webp'
    WHEN 13 THEN 'images/p' || p_size || '.gif'
    WHEN 14 THEN 'https://user@example.com:8080/dir.v2/file' || p_size
    ELSE 'data:image/gif;charset=utf-8;base64,' || CASE WHEN p_size % 2 = 0 THEN 'abc' ELSE repeat('Z', 90) END END AS url,
  p_size || '.' || (p_partkey % 25) || CASE WHEN p_partkey % 3 = 0 THEN ' beta/' || p_partkey % 10 ELSE '' END AS version
FROM {part}
"""

# One check of a release page per order; the customer is the watched source.
SNAPSHOTS = """
SELECT o_custkey AS source, o_orderkey AS snap_id, o_orderdate AS ts,
  '14.' || (1 + o_orderkey % 2) AS version,
  '/news/' || lower(substr(o_orderpriority, 1, 1)) AS url,
  'Patch 14.' || (1 + o_orderkey % 2) AS title
FROM {orders}
"""

# One stored state per customer, some broken on purpose.
STATE = """
SELECT c_custkey AS source,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE '14.' || (1 + c_custkey % 2) END AS version,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE '/news/' || (1 + c_custkey % 5) END AS url,
  'Patch of ' || c_name AS title,
  TIMESTAMP_NTZ '1998-01-01 00:00:00' AS published_at,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP_NTZ '2098-01-01 00:00:00' ELSE TIMESTAMP_NTZ '1997-06-01 00:00:00' END AS last_notification,
  CAST(floor(c_acctbal) AS BIGINT) AS total
FROM {customer}
"""

# Stored release records, one per part, with gaps.
RECORDS = """
SELECT p_size || '.' || (p_partkey % 25) AS version,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
  '/news/' || p_partkey AS url,
  TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_days AS published_at,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS content,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://img.example.com/' || p_partkey || '.jpg' END AS image_url,
  CASE WHEN p_partkey % 5 = 0 THEN 'images/' || p_partkey || '.jpg' END AS local_image_path
FROM {part}
"""

# Recorded operations and requests from the event log.
OPERATIONS = """
SELECT user_id AS session_id, event_id AS op_id,
  CASE event_type WHEN 'view' THEN 'page_structure' WHEN 'click' THEN 'patch_element'
    WHEN 'signup' THEN 'validation' WHEN 'purchase' THEN 'image_analysis' ELSE 'dom_query' END AS type,
  ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS duration,
  CASE WHEN event_type = 'error' THEN 'failed: ' || props ELSE '' END AS error
FROM {events}
"""

SELECTOR_LOG = """
SELECT 'sel-' || (user_id % 12) AS selector,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'miss' ELSE 'hit' END AS outcome
FROM {events}
"""

RUNS = """
SELECT user_id AS source, ts AS started, event_type <> 'error' AS ok FROM {events}
"""

ERRORS = """
SELECT event_id, user_id AS source,
  CASE user_id % 5 WHEN 0 THEN 'SCRAPING_ERROR' WHEN 1 THEN 'NETWORK_ERROR' WHEN 2 THEN 'DISCORD_ERROR'
    WHEN 3 THEN 'STATE_SAVE_ERROR' ELSE 'IMAGE_DOWNLOAD_ERROR' END AS code,
  'failed with ' || props AS message,
  CASE WHEN event_id % 2 = 0 THEN 'check ' || user_id END AS context
FROM {events} WHERE event_type = 'error'
"""

# Messages with one made-up secret of every kind, one per customer.
MESSAGES = """
SELECT c_custkey AS id,
  CASE c_custkey % 10
    WHEN 0 THEN 'key AIza' || substr(md5(c_name) || md5(c_mktsegment), 1, 35) || ' end'
    WHEN 1 THEN 'use sk-' || substr(md5(c_name) || md5(c_mktsegment), 1, 48) || ' and sk-short'
    WHEN 2 THEN 'Bot ' || substr(md5(c_name) || md5(c_mktsegment) || md5(c_name), 1, 59) || ', done'
    WHEN 3 THEN 'to https://discord.com/api/webhooks/' || c_custkey || '/' || md5(c_name) || ' now'
    WHEN 4 THEN 'mail ' || lower(c_mktsegment) || '.' || c_custkey || '@mail.example.com or a@b.co.'
    WHEN 5 THEN 'call 090-' || (1000 + c_custkey % 9000) || '-5678 or 1234 5678 9012 ' || (1000 + c_custkey % 9000)
    WHEN 6 THEN 'id ' || (100000000000000000 + c_custkey) || ' and 1234567890123456'
    WHEN 7 THEN 'at /Users/' || c_name || '/work/file.ts: failed'
    WHEN 8 THEN 'https://discordapp.com/api/webhooks/1/x-' || c_custkey || ' x@y.org 080-1111-' || (1000 + c_custkey % 9000)
    ELSE c_name || ' ' || c_mktsegment END AS text
FROM {customer}
"""

SETTINGS = """
SELECT c_custkey AS owner,
  CASE c_custkey % 6 WHEN 0 THEN 'api_key' WHEN 1 THEN 'webhookUrl' WHEN 2 THEN 'interval'
    WHEN 3 THEN 'AuthToken' WHEN 4 THEN 'author' ELSE 'level' END AS key,
  CASE c_custkey % 4 WHEN 0 THEN md5(c_name) WHEN 1 THEN 'Test-' || c_custkey WHEN 2 THEN 'demo' || md5(c_name)
    ELSE c_name END AS value
FROM {customer}
"""

# Model responses from the assistant turns: fenced, bare and broken ones.
RESPONSES = """
SELECT conv_id * 1000 + turn AS response_id,
  CASE (conv_id + turn) % 5
    WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'bye'
    WHEN 1 THEN body
    WHEN 2 THEN text
    WHEN 3 THEN '```json' || chr(10) || '{{"summary": 5, "keyChanges": "none", "newFeatures": []}}' || chr(10) || '```'
    ELSE 'null' END AS response
FROM (
  SELECT conv_id, turn, text,
    '{{"summary": "' || t || '", "keyChanges": ["' || substr(t, 1, 40) || '", ' || length(text) || ', "' ||
    substr(t, 5, 600) || '", null], "newFeatures": ["n1", "n2", "n3", "n4"], "importantBugFixes": {{"a": 1}}, ' ||
    '"skinContent": ["' || role || '"]}}' AS body
  FROM (SELECT *, regexp_replace(text, '[^A-Za-z0-9 .,]', ' '{g}) AS t FROM {conversations}) AS a
) AS b
"""


ROWS_PER_TASK = 20_000


def dealt_rows(rows: DataFrame) -> DataFrame:
    """The rows in tasks of some ten thousand: narrow rows of a small file may each become a page."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return spread_rows(rows, max(-(-n // ROWS_PER_TASK), min(cores, n // 1000), 1))


def derive(spark: SparkSession, sf_dir: str, sql: str, **tables: DataFrame) -> DataFrame:
    """Run one of the texts above over the parquet tables of ``sf_dir``."""
    names = ("part", "orders", "customer", "events", "conversations", "documents", "supplier")
    used = {
        n: tables.get(n) if tables.get(n) is not None else spark.read.parquet(f"{sf_dir}/{n}.parquet")
        for n in names
        if "{" + n + "}" in sql
    }
    text = sql.replace("make_days", "make_dt_interval(CAST(p_partkey % 200 AS INT))")
    return spark.sql(text.replace("{g}", ""), **used)


def as_sql(sql: str) -> str:
    """The same text for the SQL check, reading the tables by name."""
    text = sql.replace("make_days", "to_days(CAST(p_partkey % 200 AS INTEGER))")
    text = text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '").replace("{g}", ", 'g'")
    for n in ("part", "orders", "customer", "events", "conversations", "documents", "supplier"):
        text = text.replace("{" + n + "}", n)
    return text.replace("{{", "{").replace("}}", "}")
