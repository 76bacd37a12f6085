"""Run queries and their SQL side by side: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def rows(columns, data):  # noqa: ANN001, ANN201
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, f, sql, sf_dir):  # noqa: ANN001, ANN201
    import duckdb

    df = f(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(mine[1])} rows, no SQL"
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    if mine == theirs:
        return True, f"{len(mine[1])} rows"
    diff = [r for r in mine[1] if r not in set(theirs[1])][:3], [r for r in theirs[1] if r not in set(mine[1])][:3]
    return False, f"{mine[0]} {theirs[0]} {len(mine[1])} {len(theirs[1])} {diff}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from postlode.session import build_session

    spark = build_session()
    q, s = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            ok, said = compare(spark, name, q[name], s.get(name), sys.argv[1])
        except Exception as x:  # noqa: BLE001
            ok, said = False, f"{type(x).__name__}: {str(x)[:600]}"
        bad += not ok
        print("ok " if ok else "BAD", name, f"{time.time() - t:.1f}s", said[:900], flush=True)
    print("bad:", bad)
