"""Run registered queries beside their SQL: `python -m tests.compare [sf_dir] [name prefix ...]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from refledger.plans.registry import TABLES


def spark_session(shuffles: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("refledger-tests")
        .config("spark.sql.shuffle.partitions", str(shuffles))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, int):
        return float(value)
    return str(value)


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    due = _rows(columns, cur.fetchall())
    if got != due:
        return False, f"{sum(got.values())} and {sum(due.values())} rows; only spark {list((got - due).items())[:3]}; only sql {list((due - got).items())[:3]}"
    return True, f"{sum(got.values())} rows"


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark, con = spark_session(), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                n = df.count()
                ok, note = n > 0, f"{n} rows, no oracle"
        except Exception as e:  # noqa: BLE001 - a report of all queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
