"""Compare registered queries with their DuckDB statements: python -m tests.compare SF [names]."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else a short description."""
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    expected = rel.fetchall()
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    actual = spark_df.select(*columns).collect()
    a = Counter(tuple(_value(v) for v in r) for r in actual)
    b = Counter(tuple(_value(v) for v in r) for r in expected)
    if a == b:
        return None
    return f"rows {len(actual)} vs {len(expected)}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(queries)
    bad = []
    for n in names:
        start = time.time()
        try:
            df = queries[n](spark, sf_dir)
            built = time.time() - start
            problem = difference(df, con, oracles[n]) if n in oracles else f"rows only: {df.count()}"
        except Exception as exc:
            problem = str(exc)[:700] + traceback.format_exc()[-300:]
        if problem and not problem.startswith("rows only"):
            bad.append(n)
        print(f"{n:28s} build {built:5.1f} total {time.time() - start:6.1f} {problem or 'ok'}"[:1500], flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main()
