"""Compare queries with their SQL in DuckDB: python tests/check.py [sf] [key ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    """Bag equality of both results, compared inside DuckDB; doubles to nine significant digits."""
    start = time.time()
    mine = fn(spark, sf_dir).toArrow()
    middle = time.time()
    if sql is None:
        return mine.num_rows > 0, f"rows only: {mine.num_rows} rows, {middle - start:.1f}s"
    con.register("mine", mine)
    con.execute(f"create or replace temp table other as {sql}")
    n = con.execute("select count(*) from other").fetchall()[0][0]
    note = f"{mine.num_rows} rows, spark {middle - start:.1f}s, duckdb {time.time() - middle:.1f}s"
    types = {
        t: {r[0]: r[1] for r in con.execute(f"describe {t}").fetchall()} for t in ("mine", "other")
    }
    if sorted(types["mine"]) != sorted(types["other"]):
        return False, f"columns differ: {types}"
    floating = lambda c: any(types[t][c] in ("DOUBLE", "FLOAT") for t in types)
    shown = ", ".join(
        (f"format('{{:.9g}}', cast(\"{c}\" as double))" if floating(c) else f'cast("{c}" as varchar)') + f' as "{c}"'
        for c in sorted(types["mine"])
    )
    diffs = [
        con.execute(
            f"select * from (select {shown} from {a} except all select {shown} from {b}) limit 2"
        ).fetchall()
        for a, b in (("mine", "other"), ("other", "mine"))
    ]
    kinds = {c: (types["mine"][c], types["other"][c]) for c in types["mine"] if types["mine"][c] != types["other"][c]}
    note += f" types {kinds}" if kinds else ""
    if any(diffs) or n != mine.num_rows:
        return False, f"{note}; duckdb {n} rows; first differences {diffs}"
    return True, note


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = []
    for key, fn in queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        try:
            ok, note = compare(spark, con, fn, sqls.get(key), sf_dir)
        except Exception as e:  # report and go on to the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("OK  " if ok else "FAIL", key, note, flush=True)
        if not ok:
            bad.append(key)
    print("failed:", bad)


if __name__ == "__main__":
    main()
