"""Run registered queries against their DuckDB SQL and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SECONDS: dict[str, tuple[float, float]] = {}


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, (float, decimal.Decimal)):
        return ("num", round(float(v), 6) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("time", v.isoformat())
    return ("str", str(v))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    found = cur.fetchall()
    SECONDS[name] = (t1 - t0, time.time() - t1)
    mine_cols, mine = bag(df.columns, rows)
    theirs_cols, theirs = bag([d[0] for d in cur.description], found)
    if mine_cols != theirs_cols:
        return f"columns {sorted(set(mine_cols) ^ set(theirs_cols))}"
    if mine != theirs:
        a, b = list((mine - theirs).items())[:2], list((theirs - mine).items())[:2]
        detail = ""
        if a and b:
            detail = str([(c, x, y) for c, x, y in zip(mine_cols, a[0][0], b[0][0]) if x != y][:4])
        return (f"{sum(mine.values())} vs {sum(theirs.values())} rows, {sum((mine - theirs).values())} differ; {detail}"
                f"\n   spark {str(a[:1])[:500]}\n   duck  {str(b[:1])[:500]}")
    return "" if sum(mine.values()) else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, name, fn, oracles[name], sf_dir) or "ok"
            else:
                result = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        spark_s, duck_s = SECONDS.get(name, (time.time() - t, 0.0))
        print(f"{spark_s:6.1f}s spark {duck_s:6.1f}s duck {name}: {result}", flush=True)
    print("bad:", bad)
