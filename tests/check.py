"""Run registered queries against their oracle SQL, the way the driver does: columns sorted by name, rows sorted."""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0 if v else 0.0)
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(cell(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, int):
        return int(v)
    return str(v)


def canonical(columns, rows):
    pick = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in pick], sorted([tuple(cell(r[k]) for k in pick) for r in rows], key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    """Problem text, or None when both sides agree."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    con.execute(sql)
    want = canonical([d[0] for d in con.description], con.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows vs {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want[1])} rows differ, e.g.\n  spark {wrong[0][0]}\n  duck  {wrong[0][1]}"
    return None if got[1] else "no rows"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = importlib.import_module("__spark_entry__")
    from scanlake.session import get_session

    sf_dir = "/root/testdata/" + argv[0]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:34s} {time.time() - t0:6.2f}s{'' if oracle.get(name) else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:] or ["sf0.01"]) else 0)
