"""Compare registered queries with their check SQL on the same tables.

    python tools/check.py [--sf 0.001] [--only name,name] [--ops A] [--explain]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def kind(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                if math.isnan(v):
                    v = "NaN"
                elif v == 0:
                    v = 0.0
            vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=lambda t: tuple((kind(v) == "null", str(v)) for v in t))


def compare(name, sdf, con, sql):
    t0 = time.time()
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    stypes = dict(sdf.dtypes)
    if sql is None:
        return f"rows-only n={len(srows)}", len(srows) > 0
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = cur.fetchall()
    clock = f" [collect {t1 - t0:.1f}s sql {time.time() - t1:.1f}s]"
    if sorted(scols) != sorted(dcols):
        return f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}", False
    same = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
    }
    bad = [(c, stypes[c], dtypes[c]) for c in scols if same.get(stypes[c], "?") != dtypes[c]]
    a, b = normal(srows, scols), normal(drows, dcols)
    if len(a) != len(b):
        return f"row counts differ: spark={len(a)} duck={len(b)}", False
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    note = f"n={len(a)}{clock}"
    if not a:
        return "EMPTY", False
    if diff:
        return f"{note} values differ in {len(diff)} rows, first: {sorted(scols)} {diff[0]}", False
    if bad:
        return f"{note} types differ: {bad}", False
    return note, True


def main():
    import duckdb

    from pixelmill.plans import REGISTRY
    from pixelmill.session import local_session, ship_package

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("--only", default="")
    ap.add_argument("--ops", default="")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    ship_package(spark)
    con = duckdb.connect()
    con.execute("SET memory_limit='8GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    failed = []
    for name, q in REGISTRY.items():
        if args.only and name not in args.only.split(","):
            continue
        if args.ops and not any(
            o.startswith(tuple(args.ops.split(","))) for o in q.ops.replace(",", " ").split()
        ):
            continue
        t0 = time.time()
        try:
            sdf = q.run(spark, sf_dir)
            if args.explain:
                sdf.explain("formatted")
            note, ok = compare(name, sdf, con, q.sql)
        except Exception as e:
            note, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", False
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:6.2f}s {q.ops:10s} {name}: {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
