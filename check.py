"""Compare registered queries with their SQL in DuckDB: ``python check.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from catalog import ORACLES, QUERIES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, sf: str) -> str:
    df = QUERIES[name](spark, sf)
    got = canonical(df.columns, df.collect())
    if name not in ORACLES:
        return f"rows {len(got)}"
    relation = con.sql(ORACLES[name])
    want = canonical(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(relation.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    types = [(c, spark_types[c], str(t)) for c, t in zip(relation.columns, relation.types)]
    known = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [t for t in types if t[1] in known and known[t[1]] != t[2] and t[2] != '"NULL"']
    note = f"  types differ: {odd}" if odd else ""
    if got == want:
        return f"match {len(got)}{note}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"DIFFERENT {len(got)} vs {len(want)}: {wrong}{note}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    spark = session()
    bad = 0
    for name in QUERIES:
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, folder)
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        ok = verdict.startswith(("match", "rows")) and "types differ" not in verdict
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:36s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print(f"{bad} not ok")


if __name__ == "__main__":
    main()
