"""Runs a query in Spark and its SQL in DuckDB and tells how they differ. python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if not hasattr(v, "hour") else v.isoformat()
    return v if not isinstance(v, (list, tuple, dict)) else str(v)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if rows are equal, in any order, with columns matched by name."""
    import duckdb

    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only in Spark {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            said = compare(spark, queries[name], oracles[name], sys.argv[1]) if name in oracles else f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
