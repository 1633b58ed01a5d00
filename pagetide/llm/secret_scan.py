"""Operator 10: secret scan with corpus-wide ownership. DataFrame functions only.

Candidates: the base kinds (assign, access, hex) and long mixed tokens. Their hashes are
counted over the corpus by distinct documents (repositories) and distinct sources (owners).
A value that several owners hold, or many documents of one, is a copied example; one that a
single owner keeps in few documents and that looks random is reported as ``live``.

Texts are scanned once; the hits are written to the shared folder, all later steps read
those. Documents without hits take no part in any shuffle. Counting is by (hash, owner,
document) first, so a value that a third of all rows hold is combined before it moves; the
join back is an equi-join that AQE can split.

Rows: null text counts as empty; null doc_id or source is a document or owner of its own;
repeated rows are one document and each returned; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import stored, table

#: kind -> (pattern, group of the value, shortest value). Runs are maximal, so a lower bound
#: inside a run's pattern finds the same runs as a filter behind it.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    ("token", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", 0, 20),
)
BASE_KINDS = 3
LIVE = "live"
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|dummy|xxxx|test|1234567"
MAX_DOCS = 3
MIN_DISTINCT_CHARS = 8


def hits(body: Column, number: int) -> Column:
    """Array of (start, end, kind, value) of one kind; offsets in code points.

    Gaps between matches and the matches themselves add up to the offsets.
    """
    kind, pattern, group, shortest = KINDS[number]
    rx = F.lit(pattern)
    zipped = F.arrays_zip(
        F.slice(F.split(body, pattern, -1), 1, 1_000_000_000).alias("gap"),
        F.regexp_extract_all(body, rx, F.lit(0)).alias("all"),
        F.regexp_extract_all(body, rx, F.lit(group)).alias("value"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(number).alias("kind"), x["value"].alias("value")))
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"),
            F.when(F.length(x["value"]) >= shortest, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    if kind == "token":
        v = "value"
        found = F.filter(found, lambda c: c[v].rlike("[0-9]") & c[v].rlike("[a-z]") & c[v].rlike("[A-Z]"))
    return F.when(body.rlike(pattern), found).otherwise(empty)


def secret_hits(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per document: doc_id, owner and all candidates with their value's hash and look; one pass over the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(owner).alias("owner"), F.array_sort(F.concat(*[hits(body, i) for i in range(len(KINDS))])).alias("hits"))
    return rows.select(
        "doc_id", "owner",
        F.transform("hits", lambda h: F.struct(
            h["start"].alias("start"), h["end"].alias("end"), h["kind"].alias("kind"), F.md5(h["value"]).alias("hash"),
            ((F.size(F.array_distinct(F.split(h["value"], ""))) >= MIN_DISTINCT_CHARS) & ~h["value"].rlike(PLACEHOLDER)).alias("random"),
        )).alias("hits"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct documents and distinct owners that hold it."""
    each = found.select("doc_id", "owner", F.explode("hits").alias("h")).select("h.hash", "doc_id", "owner").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_owners"))


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", max_docs: int = MAX_DOCS,
) -> DataFrame:
    """doc_id, owner, hits and the hashes of its live values, a row per document."""
    found = stored(secret_hits(docs, key, text, owner), "secrets")
    dirty = found.where(F.size("hits") > 0).withColumn("_key", F.xxhash64("doc_id", "owner", "hits"))
    live = ownership(found).where((F.col("n_owners") == 1) & (F.col("n_docs") <= max_docs)).select("hash")
    own = dirty.select("_key", F.explode("hits").alias("h")).where("h.random").select("_key", "h.hash")
    by_row = own.join(live, "hash").groupBy("_key").agg(F.collect_set("hash").alias("live"))  # one document's values
    none = F.array().cast("array<string>")
    return dirty.join(by_row, "_key", "left").select("doc_id", "owner", "hits", F.coalesce("live", none).alias("live")).unionByName(
        found.where(F.size("hits") == 0).select("doc_id", "owner", "hits", none.alias("live"))
    )


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


def hit_count(kind: int) -> Column:
    """Number of hits of one kind."""
    return F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("long")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, all spans and counts of copied and live values of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def shown(hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(
            h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"), F.element_at(names, h["kind"] + 1).alias("name")))

    base = F.filter("hits", lambda h: h["kind"] < BASE_KINDS)
    is_live = F.filter("hits", lambda h: h["random"] & F.array_contains("live", h["hash"]))
    live = F.array_distinct(F.transform(is_live, lambda h: F.struct(
        h["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), h["end"].alias("end"), F.lit(LIVE).alias("name"))))
    return found.select(
        "doc_id", *[hit_count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)],
        F.sha2(_joined(shown(base)), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(shown(base), live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size("hits") - F.size(is_live)).cast("long").alias("n_other"),
    )
