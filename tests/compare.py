"""Runs registered queries beside their SQL twins and reports differences.

Usage: python -m tests.compare [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("s", str(v))


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def compare(name, spark_df, con, sql):
    c1, r1 = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    c2, r2 = table_rows([d[0] for d in cur.description], cur.fetchall())
    if c1 != c2:
        return f"columns {c1} vs {c2}", len(r1)
    if len(r1) != len(r2):
        return f"rows {len(r1)} vs {len(r2)}; {r1[:1]} / {r2[:1]}", len(r1)
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)}/{len(r1)} differ: {[x for x in zip(c1, *bad[0]) if x[1] != x[2]][:4]}", len(r1)
    return None, len(r1)


def main(argv):
    from limnos.session import build_session
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, sf_dir)
            if n in oracles:
                err, rows = compare(n, df, con, oracles[n])
            else:
                rows, err = len(df.collect()), None
            note = "" if n in oracles else " (rows only)"
        except Exception as exc:  # noqa: BLE001
            err, rows, note = f"{type(exc).__name__}: {str(exc)[:700]}", -1, ""
        failed += err is not None
        print(f"{'FAIL' if err else 'ok  '} {n}{note} rows={rows} {time.time() - t:.1f}s {err or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
