"""Compare every query with its oracle on one data set, ignoring row order.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return float(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, sf_dir: str) -> str:
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    t1 = time.time()
    got = rows(df.columns, df.collect())
    print(f"[{t1 - t0:.1f} {time.time() - t1:.1f}]", end=" ")
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"FAIL rows {len(got)} != {len(want)}; only spark {list(a - b)[:3]}; only oracle {list(b - a)[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"FAIL values {len(bad)} of {len(got)}; columns {sorted(df.columns)}; first spark {bad[0][0]} oracle {bad[0][1]}"
    return f"ok {len(got)}"


def main() -> int:
    from vitalens.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    from vitalens.sources import tables as tb

    # The career documents feed most queries; build them once for this check.
    cvs = tb.cv_docs(spark, sf_dir).repartition(8).cache()
    tb.cv_docs = lambda *_: cvs
    failed = 0
    for name in entry.queries():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += not result.startswith(("ok", "rows-only"))
        print(f"{name:34s} {time.time() - t0:6.2f}s {result}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
