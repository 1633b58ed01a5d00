"""SQL checks of the operators that SQL can express, for DuckDB; rules are written out anew here."""

from __future__ import annotations


def _mixing() -> str:
    rounds, prime, block = 12, 2147483647, 64
    number = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
    layers = []
    for i in range(1, rounds + 1):
        k, a, b = (number.format(f"skey || '|' || turn || '|{i}|{p}'") for p in "kab")
        layers.append(
            f"p{i} AS (SELECT skey, turn, n_blocks, j, CASE WHEN (((greatest(x, y) % {prime}) * ({a} % {prime - 1} + 1) + {b} % {prime}) % {prime} >> 15) & 1 = 1 "
            f"THEN y ELSE x END AS x FROM (SELECT *, ({k} % n_blocks + n_blocks - x) % n_blocks AS y FROM p{i - 1}))"
        )
    return f"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {number.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 4096 AS bucket FROM documents),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY bucket, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM rows),
sizes AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS size FROM rows GROUP BY skey),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight,
    2.0::DOUBLE * size AS cap FROM sizes),
ranked AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS pos FROM weighed),
levels AS (
  SELECT r.skey, r.pos, r.ratio, (1.5::DOUBLE * (SELECT sum(size) FROM sizes) - coalesce((SELECT sum(cap) FROM ranked b WHERE b.pos < r.pos), 0))
    / (SELECT sum(weight) FROM ranked b WHERE b.pos >= r.pos) AS level FROM ranked r),
first_open AS (SELECT min(pos) AS pos FROM levels WHERE ratio > level),
targets AS (
  SELECT r.skey, r.size, CASE WHEN f.pos IS NULL OR r.pos < f.pos THEN r.cap ELSE r.weight * (SELECT level FROM levels l WHERE l.pos = f.pos) END AS target,
    CAST(ceil(r.size / {block}.0) AS BIGINT) AS n_blocks
  FROM ranked r, first_open f),
counts AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(CAST(floor(target / size) AS BIGINT) * n_blocks
    + CAST(floor((target - floor(target / size) * size) / {block}.0 + 0.5) AS BIGINT), 2 * n_blocks) END AS n_slots FROM targets),
p0 AS (
  SELECT skey, j // n_blocks AS turn, n_blocks, j, j % n_blocks AS x
  FROM (SELECT skey, n_blocks, unnest(range(n_slots)) AS j FROM counts WHERE n_slots > 0)),
{', '.join(layers)},
takes AS (SELECT skey, x AS block, count(*) AS n FROM p{rounds} GROUP BY skey, x),
pieces AS (
  SELECT skey, doc_id, size, start, unnest(range(CAST(start // {block} AS BIGINT), CAST((start + size - 1) // {block} AS BIGINT) + 1)) AS block
  FROM placed WHERE size > 0),
taken AS (
  SELECT p.skey, p.start, p.size, sum((least((p.block + 1) * {block} - p.start, p.size) - greatest(p.block * {block} - p.start, 0)) * t.n) AS taken
  FROM pieces p JOIN takes t USING (skey, block) GROUP BY p.skey, p.start, p.size)
SELECT r.doc_id, r.size, t.size AS source_size, CAST(t.target AS DOUBLE) AS target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM placed r JOIN targets t USING (skey) LEFT JOIN taken k ON k.skey = r.skey AND k.start = r.start AND k.size = r.size"""


_ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
SECRETS = rf"""
WITH kinds(kind, name, least) AS (VALUES (0, 'assign', 6), (1, 'access', 20), (2, 'hex', 24), (3, 'token', 20)),
texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
cut AS (
  SELECT rid, 0 AS kind, regexp_extract_all(body, '{_ASSIGN}', 0) AS ms, regexp_extract_all(body, '{_ASSIGN}', 2) AS vs, regexp_split_to_array(body, '{_ASSIGN}') AS gs FROM texts
  UNION ALL SELECT rid, 1, regexp_extract_all(body, 'AKIA[A-Z0-9]+'), regexp_extract_all(body, 'AKIA[A-Z0-9]+'), regexp_split_to_array(body, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT rid, 2, regexp_extract_all(body, '[0-9a-f]+'), regexp_extract_all(body, '[0-9a-f]+'), regexp_split_to_array(body, '[0-9a-f]+') FROM texts
  UNION ALL SELECT rid, 3, regexp_extract_all(body, '[A-Za-z0-9+/_-]+'), regexp_extract_all(body, '[A-Za-z0-9+/_-]+'), regexp_split_to_array(body, '[A-Za-z0-9+/_-]+') FROM texts),
each AS (SELECT rid, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM cut),
spans AS (
  SELECT rid, kind, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop, length(m) AS n, v FROM each),
kept AS (
  SELECT s.rid, s.kind, k.name, s.stop - s.n AS start, s.stop, md5(s.v) AS hash,
    length(regexp_replace(s.v, '[^0-9A-Za-z+/_.=-]', '', 'g')) >= 0 AND list_unique(string_split(s.v, '')) >= 8
      AND NOT regexp_matches(lower(s.v), 'example|sample|placeholder|changeme|dummy|xxxx|test|1234567') AS random
  FROM spans s JOIN kinds k USING (kind)
  WHERE length(s.v) >= k.least AND (s.kind < 3 OR (regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[a-z]') AND regexp_matches(s.v, '[A-Z]')))),
live AS (
  SELECT hash FROM (SELECT DISTINCT k.hash, t.doc_id, t.source FROM kept k JOIN texts t USING (rid))
  GROUP BY hash HAVING count(*) <= 3 AND count(DISTINCT coalesce('s' || source, 'n')) = 1),
alive AS (SELECT DISTINCT rid, start, stop FROM kept WHERE random AND hash IN (SELECT hash FROM live)),
everything AS (SELECT rid, start, kind, stop, name FROM kept WHERE kind < 3 UNION ALL SELECT rid, start, 4, stop, 'live' FROM alive),
joined AS (SELECT rid, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans FROM everything GROUP BY rid),
base AS (
  SELECT rid, CAST(sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS BIGINT) AS c, count(*) AS n,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS spans FROM kept GROUP BY rid),
n_alive AS (SELECT rid, count(*) AS n FROM alive GROUP BY rid),
hits_alive AS (SELECT rid, count(*) AS n FROM kept WHERE random AND hash IN (SELECT hash FROM live) GROUP BY rid)
SELECT t.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.b, 0) AS n_access, coalesce(b.c, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(j.spans, '') AS spans, coalesce(a.n, 0) AS n_live, coalesce(b.n, 0) - coalesce(h.n, 0) AS n_other
FROM texts t LEFT JOIN base b USING (rid) LEFT JOIN joined j USING (rid) LEFT JOIN n_alive a USING (rid) LEFT JOIN hits_alive h USING (rid)"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM k WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM k LEFT JOIN f USING (payload_digest)"""



def _manifest(levels: int = 6, group_levels: int = 4) -> str:
    """Runs of 16 per level, for groups of at most 16 ** levels rows."""
    upper = "".join(map(chr, range(65, 91)))

    def shown(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(shown(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = (
        "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END), 4294967295)"
    )

    def runs(name: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, n, string_agg(h, '' ORDER BY pos) AS run FROM {name}n{k} GROUP BY tree, pos // 16, n)")
            out.append(f"{name}n{k + 1} AS MATERIALIZED (SELECT tree, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {name}r{k})")
        return out

    def paths(name: str, first: str, n: int, tree: str, pos: str, size: str, out: str) -> list[str]:
        steps, last = [], first
        for k in range(n):
            at = f"64 * (({pos} // {16 ** k}) % 16)"
            on = f"({size} + {16 ** k - 1}) // {16 ** k} > 1"
            steps.append(
                f"{out}{k} AS (SELECT p.* REPLACE (CASE WHEN {on} THEN sib || substr(run, 1, {at}) || substr(run, {at} + 65) ELSE sib END AS sib, "
                f"CASE WHEN {on} THEN sha256(substr(run, 1, {at}) || fold || substr(run, {at} + 65)) ELSE fold END AS fold) "
                f"FROM {last} p JOIN {name}r{k} r ON r.tree = p.{tree} AND r.pos = {pos} // {16 ** (k + 1)})")
            last = f"{out}{k}"
        return steps

    low = f"translate(text, '{upper}', '{upper.lower()}')"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS fold FROM documents)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, "
        "count(*) OVER (PARTITION BY tree) AS size, '' AS sib FROM d)",
        "an0 AS (SELECT tree, place AS pos, size AS n, leaf AS h FROM l)", *runs("a", levels),
        f"g AS MATERIALIZED (SELECT tree AS name, h AS subroot, 0 AS top, row_number() OVER (ORDER BY tree) - 1 AS gplace, count(*) OVER () AS gsize FROM an{levels})",
        "bn0 AS (SELECT top AS tree, gplace AS pos, gsize AS n, subroot AS h FROM g)", *runs("b", group_levels),
        *paths("a", "l", levels, "tree", "place", "size", "x"),
        f"m AS (SELECT p.*, g.* FROM x{levels - 1} p JOIN g ON g.name = p.tree)",
        *paths("b", "m", group_levels, "top", "gplace", "gsize", "y"),
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
FROM y{group_levels - 1}, bn{group_levels} t"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"e0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + entry) AS best "
            f"FROM p JOIN e{k} USING (part) GROUP BY vec_id, part)")
        if k < rounds:
            steps.append(
                f"s{k} AS (SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT part, best % {entries} AS entry, i, sum(x[i]) AS total, count(*) AS n "
                f"FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY part, best % {entries}, i) GROUP BY part, entry)")
            steps.append(f"e{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(s.c, o.c) AS c FROM e{k} o LEFT JOIN s{k} s ON s.part = o.part AND s.entry = o.entry)")
    return "WITH " + ",\n".join(steps) + f""",
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books"""


MIXING = _mixing()
MANIFEST = _manifest()
VECTOR_CODES = _vector_codes()
