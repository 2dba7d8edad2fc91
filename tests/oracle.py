"""Compare registered queries with their SQL on given tables: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sample_movielens_ratings sample_movielens_ratings_raw "
    "iris_csv class_targets libsvm_entries libsvm_labels traj_frames doc_labels"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def expected(sf_dir: str, sql: str):
    db = duckdb.connect()
    for t in TABLES:
        at = Path(f"{sf_dir}/{t}.parquet")
        if at.exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at if at.is_file() else str(at) + '/*.parquet'}')")
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    return rows(names, got.fetchall())


def actual(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/blockframe-checkpoints").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or list(queries):
        began = time.time()
        try:
            got = actual(queries[name](spark, sf_dir))
            took = time.time() - began
            if name not in oracles:
                print(f"ROWS {name}: {len(got[1])} rows, {took:.1f} s", flush=True)
                continue
            want = expected(sf_dir, oracles[name])
            same = got == want
            print(("OK   " if same else "DIFF ") + f"{name}: {len(got[1])} rows, {took:.1f} s", flush=True)
            if not same:
                bad += 1
                a, b = set(map(repr, got[1])), set(map(repr, want[1]))
                print("   ", got[0], want[0], len(got[1]), len(want[1]), sorted(a - b)[:4], sorted(b - a)[:4], flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
