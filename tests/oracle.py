"""Run registered queries against their SQL twins in DuckDB and compare values, order-insensitive.

    python -m tests.oracle [name-substring ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or type(v).__name__ in ("NaTType", "NAType"):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return f"b{bool(v)}"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return "~" if math.isnan(v) else f"i{int(v)}" if float(v).is_integer() else f"f{float(v):.6g}"  # pandas has whole numbers with nulls as floats
    if isinstance(v, int) or type(v).__name__.startswith(("int", "uint")):
        return f"i{int(v)}"
    if type(v).__name__ in ("ndarray", "list", "tuple"):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"s{v}"


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def check(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.toPandas()
    dt = time.time() - t0
    if sql is None:
        return True, f"rows-only n={len(got)} {dt:.1f}s"
    t0 = time.time()
    want = con.execute(sql).df()
    dq = time.time() - t0
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
        return False, f"rows {len(a)} vs {len(b)}; cols {sorted(got.columns)}; spark-only {only_a}; sql-only {only_b}"
    return True, f"n={len(a)} spark {dt:.1f}s duckdb {dq:.1f}s" + ("   EMPTY" if not a else "")


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from litgraph.session import build_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls, bad = connect(sf), queries(), oracle_sql(), 0
    for name, fn in qs.items():
        if argv and not any(a in name for a in argv):
            continue
        try:
            ok, msg = check(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001 - reported per query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
