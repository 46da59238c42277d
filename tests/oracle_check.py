"""Compare registered queries with their SQL oracles.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def sort_key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) else round(v, 4), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=sort_key)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    scols, srows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} != {dcols}"
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}"
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        a, b = bad[0]
        return f"{len(bad)} of {len(srows)} rows differ; {[(c, x, y) for c, x, y in zip(scols, a, b) if x != y]}"
    return None


def main() -> int:
    import __spark_entry__ as e
    from ledgerlark.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else f"FAIL {problem}"
            else:
                note = f"rows only: {df.count()}"
        except Exception as exc:  # report and go on with the next query
            note = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        failed += note.startswith("FAIL")
        print(f"RESULT {name:36s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"RESULT failed={failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
