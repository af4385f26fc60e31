"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry
from leadkin import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple("null" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark, sf_dir: str, name: str) -> str:
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    start = time.time()
    df = query(spark, sf_dir)
    got = df.toPandas()
    took = time.time() - start
    if not sql:
        return f"rows-only {len(got)} rows {took:.1f}s"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    start = time.time()
    want = con.execute(sql).df()
    duck_took = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} / {sorted(want.columns)}"
    kinds = {c: (got[c].dtype, want[c].dtype) for c in got.columns if got[c].dtype != want[c].dtype}
    a, b = canonical(got), canonical(want)
    if a != b:
        odd = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"FAIL rows {len(a)} / {len(b)} {sorted(got.columns)}\n   spark {odd[0]}\n   duck  {odd[1]} {kinds}"
    return f"ok {len(a)} rows {took:.1f}s (duckdb {duck_took:.1f}s) {kinds or ''}"


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = session.build(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            print(name, compare(spark, sf_dir, name), flush=True)
        except Exception as error:
            print(name, "ERROR", type(error).__name__, str(error)[:1500], flush=True)
