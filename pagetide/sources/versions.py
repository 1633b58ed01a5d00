"""Keyed tables with versions: upserts as small deltas, merge on read, as-of reads, restore, cleanup.

    <path>/data/<write>/bucket=<n>/   rows of one write, by bucket of the key's hash
    <path>/versions/<number>.json     a version: its stamp, batch and, per bucket, the writes to read

A write touches only its own keys: their rows go to a new folder, and one small file renamed into
place makes them part of the next version. Readers see whole versions only. Rows carry the number
of the version that wrote them, and the newest row of a key wins. ``compact`` folds the deltas of
a bucket into one folder, after which that bucket is read without a shuffle. ``clean`` removes old
versions and then whatever no version names, left-overs of failed writes too. A table has one
writer at a time; a second one fails when it tries to make a version that exists.

Keys may not be null, and a write holds one row per key. Spark does all reading, merging and
writing; the driver handles folder names, at most ``buckets`` times the writes since compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Folders a bucket may have before it is folded into one.
DELTAS = 8
#: Columns of stored rows: the version that wrote them, and whether it removed their key.
WRITTEN, GONE = "_version", "_gone"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- folders ----------------------------------------------------------
    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first."""
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json")]

    def version(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._at("versions", f"{number:012d}.json").toString(), wholetext=True).first()[0])

    def newest(self) -> dict | None:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else None

    def _commit(self, made: dict) -> int:
        final, draft = self._at("versions", f"{made['number']:012d}.json"), self._at("versions", f"_draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {made['number']} of {self.path} was made by another writer")
        return made["number"]

    def at(self, stamp: str) -> int | None:
        """Number of the last version stamped at or before a stamp."""
        return next((n for n in reversed(self.versions()) if (self.version(n)["stamp"] or "") <= stamp), None)

    # ---- reading ----------------------------------------------------------
    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(
        self, schema: T.StructType | None = None, version: int | None = None, as_of: str | None = None, buckets: Iterable[int] | None = None
    ) -> DataFrame:
        """Newest row per key, of the newest version, of a given one, or of the last one stamped at or before ``as_of``."""
        if as_of is not None:
            version = self.at(as_of) or 0
        made = self.newest() if version is None else self.version(version) if version else None
        if made is None:
            return self.spark.createDataFrame([], schema or f"{self.key} string")
        rows = self._rows(made, buckets).where(~F.col(GONE)).drop(WRITTEN, GONE)
        return rows if schema is None else rows.select(*[f.name for f in schema])

    def _rows(self, made: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        own = {b: w for b, w in made["buckets"].items() if buckets is None or int(b) in set(buckets)}
        schema = T.StructType.fromJson(made["schema"])

        def of(some: list[list[str]]) -> DataFrame:
            paths = [self._at("data", name).toString() for names in some for name in names]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

        folded = {b: [f"{w}/bucket={b}" for w in writes] for b, writes in own.items()}
        single, several = ([x for x in folded.values() if (len(x) < 2) == one] for one in (True, False))
        if not several:
            return of(single)
        values = [f.name for f in schema if f.name != self.key]
        merged = of(several).groupBy(self.key).agg(F.max_by(F.struct(*values), WRITTEN).alias("r")).select(self.key, "r.*")
        return of(single).unionByName(merged) if single else merged.select(*schema.names)

    # ---- writing ----------------------------------------------------------
    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        name = uuid.uuid4().hex
        target = self._at("data", name).toString()
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
        return name, [n.split("=")[1] for n in self._names("data", name) if n.startswith("bucket=")]

    def upsert(self, rows: DataFrame, stamp: str | None = None, batch: int | None = None, removed: DataFrame | None = None) -> int:
        """Add one delta with the rows' keys and make it the next version; its number. Keys in ``removed`` go.

        A batch that the table already holds is left alone, so a replay changes nothing.
        """
        made = self.newest()
        if made and batch is not None and made["batch"] is not None and batch <= made["batch"]:
            return made["number"]
        number = made["number"] + 1 if made else 1
        marked = rows.withColumn(GONE, F.lit(False))
        if removed is not None:
            marked = marked.unionByName(removed.select(self.key).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        name, touched = self._write(marked.withColumn(WRITTEN, F.lit(number).cast("long")))
        fields = {f.name: f.jsonValue() for f in (T.StructType.fromJson(made["schema"]) if made else [])}
        own = [T.StructField(GONE, T.BooleanType()), T.StructField(WRITTEN, T.LongType())]
        fields = {n: f for n, f in fields.items() if n not in (GONE, WRITTEN)}
        fields |= {f.name: f.jsonValue() | {"nullable": True} for f in [*rows.schema, *own]}
        buckets = {b: list(w) for b, w in made["buckets"].items()} if made else {}
        for b in touched:
            buckets.setdefault(b, []).append(name)
        return self._commit({
            "number": number, "stamp": stamp or (made and made["stamp"]), "batch": batch if batch is not None else made and made["batch"],
            "buckets": buckets, "schema": {"type": "struct", "fields": list(fields.values())},
        })

    def compact(self, deltas: int = DELTAS) -> int | None:
        """Fold each bucket of more than ``deltas`` folders into one; the new version, if any bucket had so many."""
        made = self.newest()
        many = [int(b) for b, w in made["buckets"].items() if len(w) > deltas] if made else []
        if not many:
            return None
        name, full = self._write(self._rows(made, many).where(~F.col(GONE)))
        left = {str(b): [name] if str(b) in full else [] for b in many}
        return self._commit(made | {"number": made["number"] + 1, "buckets": made["buckets"] | left})

    def restore(self, version: int, stamp: str | None = None) -> int:
        """Make the state of an older version the newest one."""
        made, old = self.newest(), self.version(version)
        return self._commit(old | {"number": made["number"] + 1, "stamp": stamp or made["stamp"], "batch": made["batch"]})

    def clean(self, keep: int = 1) -> int:
        """Keep the newest versions and remove what none of them names; the number of bucket folders removed."""
        numbers = self.versions()
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {f"{w}/bucket={b}" for made in kept for b, writes in made["buckets"].items() for w in writes}
        for n in numbers[:-keep]:
            self._files.delete(self._at("versions", f"{n:012d}.json"), False)
        for n in self._names("versions"):
            if n.startswith("_draft-"):
                self._files.delete(self._at("versions", n), False)
        gone = 0
        for write in self._names("data"):
            inside = [f"{write}/{b}" for b in self._names("data", write)]
            live = [x for x in inside if x in named]
            for old in inside if live else ():
                if old not in named and "/bucket=" in old:
                    self._files.delete(self._at("data", old), True)
            if not live:
                self._files.delete(self._at("data", write), True)
            gone += sum("/bucket=" in x and x not in named for x in inside)
        return gone


def touched_buckets(table: VersionedTable, rows: DataFrame) -> list[int]:
    """Buckets that hold the keys of some rows; at most as many numbers as the table has buckets."""
    return sorted(r[0] for r in rows.select(table.bucket().alias("b")).distinct().collect())
