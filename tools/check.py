"""Run registered queries beside their SQL checks and report differences.

    python tools/check.py [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldmosaic import oracle, registry  # noqa: E402
from fieldmosaic.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def tables_of(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _comparable(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(columns=sorted(frame.columns))
    for name in frame.columns:
        if isinstance(frame[name].dtype, pd.Int64Dtype | pd.Int32Dtype):  # as toPandas gives integers, with nulls and without
            frame[name] = frame[name].astype("float64" if frame[name].isna().any() else frame[name].dtype.numpy_dtype)
        if frame[name].dtype == object or isinstance(frame[name].dtype, pd.StringDtype):
            frame[name] = frame[name].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return frame.sort_values(list(frame.columns), na_position="first", ignore_index=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when both hold the same rows with the same column names and exact values."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} and {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows"
    got, expected = _comparable(got), _comparable(expected)
    for name in got.columns:
        a, b = got[name], expected[name]
        if a.dtype.kind != b.dtype.kind and {a.dtype.kind, b.dtype.kind} - set("OTU"):
            return f"{name}: {a.dtype} and {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{name}: {int((~same).sum())} values, first {a[i]!r} and {b[i]!r}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("queries", nargs="*")
    args = parser.parse_args()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), **{"spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("OFF")
    connection, checks, bad = tables_of(args.sf), oracle.statements(), 0
    for name in args.queries or registry.QUERIES:
        start = time.time()
        try:
            got = registry.QUERIES[name](spark, args.sf).toPandas()
            took = time.time() - start
            result = "rows only"
            if name in checks:
                result = difference(got, connection.execute(checks[name]).df()) or "equal"
            bad += result not in ("rows only", "equal")
            print(f"{name:26s} {took:6.2f}s {len(got):7d} rows  {result}", flush=True)
        except Exception as error:  # a broken query must not hide the others
            bad += 1
            print(f"{name:26s} FAILED {type(error).__name__}: {str(error)[:500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
