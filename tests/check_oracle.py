"""Compare every registered query with its SQL on one scale; run as a script with optional query names."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(v) if isinstance(v, float) else str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in data)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def type_difference(df, con, sql):
    """Columns whose type differs between the query and its SQL."""
    want = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    got = {c: KINDS.get(t, t) for c, t in df.dtypes}
    return ", ".join(f"{c}: {got[c]} vs {want.get(c)}" for c in sorted(got) if got[c] != want.get(c))


def compare(spark, con, sf, name, fn, sql):
    """Difference text, or an empty string when rows, columns and values agree."""
    df = fn(spark, sf)
    types = type_difference(df, con, sql)
    if types:
        return f"types {types}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; ours {only_got}; theirs {only_want}"
    return ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from sliceweave.session import build_session

    sf = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), oracle_sql()
    for name, fn in queries().items():
        if args and name not in args:
            continue
        t = time.time()
        if name in sqls:
            try:
                diff = compare(spark, con, sf, name, fn, sqls[name])
            except Exception as e:
                diff = f"{type(e).__name__}: {str(e)[:1500]}"
            print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - t:.1f}s {diff}", flush=True)
        else:
            print(f"rows {name} {fn(spark, sf).count()} {time.time() - t:.1f}s", flush=True)
