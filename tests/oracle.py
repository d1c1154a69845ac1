"""Compare registered queries with their SQL oracle on the same parquet files.

Usage: python tests/oracle.py [name-prefix ...]; SF picks the table size.
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return "decimal", v
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(cols: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return [cols[i] for i in order], out


def compare(spark, con, name: str, sf_dir: str, fn, sql: str | None) -> str:
    """'' when equal, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    TIMES["plan"] = time.time() - start
    rows = [tuple(r) for r in df.collect()]
    TIMES["run"] = time.time() - start - TIMES["plan"]
    got = table(df.columns, rows)
    if sql is None:
        return "" if got[1] else "no rows"
    cur = con.execute(sql)
    want = table([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not got[1]:
        return "no rows"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, columns {got[0]}\n   got  {bad[0][0]}\n   want {bad[0][1]}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="harrow-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = f"/root/testdata/{os.environ.get('SF', 'sf0.01')}"
    spark, con = session(), connect(sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, sf, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(problem)
        kind = "oracle" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:6} {name:28} plan {TIMES.get('plan', 0):5.1f} run {TIMES.get('run', 0):5.1f} all {time.time() - t:5.1f}s {problem}", flush=True)
    print("failures:", bad)
