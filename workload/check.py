"""Run registered queries and their SQL side by side: ``python -m workload.check <sf dir> [names]``."""

from __future__ import annotations

import collections
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from workload.base import QUERIES, SQL
import workload.registry  # noqa: F401

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, sf, name) -> str:
    started = time.time()
    df = QUERIES[name](spark, sf)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in SQL:
        return f"rows {sum(mine.values()):>8}  {took:5.1f}s  (no SQL)"
    started = time.time()
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    sql_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} / {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    spark_kinds = dict(df.dtypes)
    odd = [
        f"{c}:{spark_kinds[c]}/{kinds[c]}"
        for c in columns
        if "HUGEINT" in kinds[c] or kinds[c] in ("INTEGER", "DECIMAL", "SMALLINT")
    ]
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        return (
            f"FAIL rows {sum(mine.values())} / {sum(theirs.values())}"
            f"\n   spark only {sum(a.values())}: {list(a)[:3]}\n   sql only {sum(b.values())}: {list(b)[:3]}"
        )
    empty = "  EMPTY" if not mine else ""
    return f"ok   {sum(mine.values()):>8}  {took:5.1f}s  sql {sql_took:.1f}s {'  types ' + ','.join(odd) if odd else ''}{empty}"


def main(argv: list[str]) -> int:
    sf, names = argv[0], argv[1:] or list(QUERIES)
    spark, con = session(), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            result = check(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            result = "FAIL " + "".join(traceback.format_exception_only(e))[:1500]
        bad += result.startswith("FAIL")
        print(f"{name:32} {result}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
