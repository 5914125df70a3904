"""Run queries next to their SQL twins and report every difference.

    python tests/compare_oracle.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as comparable text tuples, columns by name, rows sorted."""

    def cell(value) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
            return "null"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        if isinstance(value, str):
            return value
        return f"{float(value):.9g}" if float(value) else "0"

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in ordered.astype(object).itertuples(index=False))


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {sorted(ours.columns)}: {wrong[0]}"
    return None


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    spark = build_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql, bad = oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ours = build(spark, folder).toPandas()
            spent = time.time() - start
            if name in sql:
                theirs = connection.execute(sql[name]).df()
                problem = difference(ours, theirs)
                kinds = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours if c in theirs and ours[c].dtype != theirs[c].dtype}
                note = f"types {kinds}" if kinds else ""
            else:
                problem, note = None, "no twin"
        except Exception as error:  # noqa: BLE001 - report and go on
            ours, spent, problem, note = [], time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(ours)} {spent:.1f}s {problem or ''} {note}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(where, sys.argv[2:]) else 0)
