"""Run registered queries beside their DuckDB counterparts and compare the rows.

Usage: python -m tests.compare SF_DIR [name-pattern ...]
"""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "tolist"):
        return cell(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, int):
        return ("i", v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = rows_of(spark_df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"row count {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: spark={bad[0][0]} duckdb={bad[0][1]} columns={sorted(names)}" if bad else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    sf_dir, patterns = argv[0], argv[1:] or [""]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if not any(re.search(p, name) for p in patterns):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                note = "same" if problem is None else "DIFF " + problem
            else:
                note = f"rows only: {len(df.collect())}"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem = note = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
