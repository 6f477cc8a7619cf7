"""Run registered queries on Spark and their oracle texts on DuckDB and compare all rows.

    python tools/check_queries.py [--sf DIR] [name-part ...]
"""
import argparse
import os
import sys
import threading
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from roadrisk.plans.bindings import BASE_TABLES
from roadrisk.plans.catalog import ORACLES, QUERIES


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"{type(v).__name__[:3]}:{v}"


def session(cores=os.environ.get("CORES", "8")):
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    limit = float(os.environ.get("LIMIT", "75"))
    bad = 0
    for name in QUERIES:
        if a.names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        t0 = time.time()
        alarm = threading.Timer(limit, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        alarm.start()
        try:
            df = QUERIES[name](spark, a.sf)
            cols = sorted(df.columns)
            got = sorted(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
            t1 = time.time()
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(ORACLES[name])
            ocols = sorted(rel.columns)
            order = [rel.columns.index(c) for c in ocols]
            want = sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
            t2 = time.time()
            ok = cols == ocols and got == want
            bad += not ok
            print(f"{'ok   ' if ok else 'BAD  '} {name}: {len(got)} rows {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
            if not ok:
                print("   columns", cols, ocols if cols != ocols else "same")
                gs, ws = set(got), set(want)
                print("   rows", len(got), len(want), "only spark", len(gs - ws), "only duck", len(ws - gs))
                for x in sorted(gs - ws)[:3]:
                    print("   S", x)
                for x in sorted(ws - gs)[:3]:
                    print("   D", x)
        except Exception as e:
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        finally:
            alarm.cancel()
    print("bad:", bad)


main()
