"""Run queries on Spark and their SQL on DuckDB, and compare: names, rows, values.

    python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "item"):
        value = value.item()
    return f"{type(value).__name__}:{round(value, 6) if isinstance(value, float) else value}"


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    shown = "\n".join(f"  {side}: {str(row)[:700]}" for side, rows in (("spark", only_a), ("sql  ", only_b)) for row in rows[:2])
    return f"{len(a)} and {len(b)} rows, {len(only_a)} only in Spark, {len(only_b)} only in SQL\n{shown}"


def main(scale: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = f"/root/testdata/{scale}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    statements = entry.oracle_sql()
    for name in names or entry.queries():
        try:
            start = time.time()
            found = entry.queries()[name](spark, folder).toPandas()
            middle = time.time()
            if name not in statements:
                print(f"NONE  {name} {len(found)} rows {middle - start:.1f}s", flush=True)
                continue
            problem = difference(found, connect(folder).execute(statements[name]).fetchdf())
            took = f"{middle - start:.1f}s and {time.time() - middle:.1f}s"
            print(f"{'DIFF ' if problem else 'SAME '} {name} {len(found)} rows {took} {problem or ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name} {type(error).__name__} {str(error)[:500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
