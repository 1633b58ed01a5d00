"""Compare registered queries with their SQL checks on one data folder.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    if len(ours) != len(theirs):
        only = [r for r in ours if r not in set(theirs)][:2] if len(ours) < 50000 else []
        other = [r for r in theirs if r not in set(ours)][:2] if len(ours) < 50000 else []
        return f"{len(ours)} rows vs {len(theirs)}; only here {only}; only there {other}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {sorted(df.columns)}: {bad[0]}" if bad else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        if name not in oracles:
            print(f"{name}: no SQL check", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, queries[name], oracles[name], sf_dir)
        except Exception as err:  # report and go on with the next query
            problem = f"{type(err).__name__}: {str(err)[:700]}"
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else 'DIFF ' + problem[:1500]} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
