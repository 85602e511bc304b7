"""Run registered queries beside their SQL and compare: python tests/oracle.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir), con.sql(sql)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {names} and {sorted(want.columns)}"
    a = Counter(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    if a == b:
        return ""
    return f"rows {sum(a.values())} and {sum(b.values())}; only ours {list((a - b).items())[:3]}; only theirs {list((b - a).items())[:3]}; columns {names}"


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connection(sf_dir)
    bad = 0
    for name in sys.argv[2:] or sorted(oracles):
        began = time.time()
        try:
            if name in oracles:
                said = difference(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                said = ""
                rows = queries[name](spark, sf_dir).limit(4).collect()
                print(name, "no SQL", len(rows), str(rows[:2])[:300])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(said)
        print(name, "ok" if not said else f"DIFFERS {said}"[:1100], round(time.time() - began, 1), flush=True)
    print("bad:", bad)
