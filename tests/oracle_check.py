"""Compare registered queries with their DuckDB oracles: ``python tests/oracle_check.py [sf_dir] [name-part ...]``."""
import logging
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", float(f"{v:.9g}") + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return type(v).__name__, str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf):
    import duckdb
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql, verbose=True):
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    ts = time.time() - t
    if sql is None:
        return "rows", len(got), ts, 0.0
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    exp = rows_of(cols, cur.fetchall())
    td = time.time() - t
    if sorted(df.columns) != sorted(cols):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", len(got), ts, td
    if got != exp:
        bad = next(((a, b) for a, b in zip(got, exp) if a != b), None)
        return f"DIFF {len(got)} vs {len(exp)} rows; cols {sorted(cols)}; first {bad}", len(got), ts, td
    return "ok", len(got), ts, td


def main():
    import __spark_entry__ as E
    from flotsam.session import build_session
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(sf)
    logging.disable(logging.CRITICAL)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if args and not any(a in name for a in args):
            continue
        try:
            r = compare(spark, con, sf, name, fn, o.get(name))
        except Exception as e:  # report and go on
            r = (f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0, 0)
        bad += r[0] not in ("ok", "rows")
        print(f"{name:44s} {r[0]}  n={r[1]} spark={r[2]:.1f}s duck={r[3]:.1f}s", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
