"""Run registered queries against their SQL statements (development tool)."""

import math
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores="8", **conf):
    b = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    return s


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int,)) or type(v).__name__.startswith("int"):
            return repr(round(float(v), 6) + 0.0)
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    rows = sorted(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None))
    return list(pdf.columns), rows


def compare(spark, con, fn, sql, sf):
    sdf = fn(spark, sf)
    a = sdf.toPandas()
    if sql is None:
        return f"rows={len(a)} (no sql)", True
    rel = con.sql(sql)
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    b = rel.df()
    ca, ra = canon(a)
    cb, rb = canon(b)
    note = ""
    for f in sdf.schema.fields:
        k, t = kinds.get(f.name), f.dataType.simpleString()
        want = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t)
        if k is not None and k != want:
            note += f" type {f.name}:{t}/{k}"
    if ca != cb:
        return f"COLUMNS {ca} {cb}", False
    if ra == rb:
        return f"ok rows={len(ra)}{note}", not note
    da, db = [r for r in ra if r not in set(rb)][:4], [r for r in rb if r not in set(ra)][:4]
    return f"DIFF {len(ra)}/{len(rb)}\n   cols {ca}\n   spark {da}\n   duck  {db}", False


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = next((a[5:] for a in sys.argv if a.startswith("--sf=")), "/root/testdata/sf0.01")
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = session(**({"spark__spanaccord__hotRows": "50"} if "--hot" in sys.argv else {}))
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = []
    for n, fn in qs.items():
        if args and not any(n.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            msg, ok = compare(spark, con, fn, sqls.get(n), sf)
        except Exception as x:  # noqa: BLE001
            msg, ok = "ERROR " + str(x)[:1500], False
        if not ok:
            bad.append(n)
        print(f"{n:32s} {time.time()-t:5.1f}s {msg}", flush=True)
    print(len(bad), "bad:", bad)
