"""Runs queries beside their SQL: python tests/verify.py [--sf DIR] [NAME_PREFIX ...]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).parents[1]))


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def normal(value):
    """A value that compares equal for both engines."""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def tables(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(df, con, sql: str) -> tuple[int, int, str]:
    """Rows of both sides, and what differs ('' if nothing)."""
    rows = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(rows), len(other), f"columns {sorted(df.columns)} and {sorted(names)}"
    at = [names.index(c) for c in sorted(names)]
    a = sorted(tuple(normal(r[c]) for c in sorted(names)) for r in rows)
    b = sorted(tuple(normal(r[i]) for i in at) for r in other)
    if a == b:
        return len(a), len(b), ""
    sa, sb = set(a), set(b)
    return len(a), len(b), f"only here {sorted(sa - sb)[:3]}; only in SQL {sorted(sb - sa)[:3]}"


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    import __spark_entry__ as e

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = tables(folder), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in sql:
                n, m, why = differences(f(spark, folder), con, sql[name])
            else:
                n, m, why = f(spark, folder).count(), -1, ""
        except Exception as x:  # noqa: BLE001
            n, m, why = -1, -1, f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(why)
        print(f"{'ok  ' if not why else 'FAIL'} {name} rows {n} sql {m} {time.time() - t:.1f} s {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
