"""Compare queries with their SQL on one scale: python -m workload.trial DIR [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb
import pandas as pd

from triptych.session import build_session
from triptych.sources.shared import run_folder
from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    rows = frame.map(lambda v: "NULL" if v is None or v is pd.NA else (
        f"{v:.9g}" if isinstance(v, float) else str(v)))
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark, con, sf_dir: str, name: str, queries=QUERIES, sql=ORACLE_SQL) -> tuple[str, int]:
    """'' or what differs, and the row count."""
    got = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    got_frame = pd.DataFrame(rows, columns=got.columns, dtype=object)
    if name not in sql:
        return "no SQL", len(rows)
    result = con.execute(sql[name])
    columns = [d[0] for d in result.description]
    want_frame = pd.DataFrame(result.fetchall(), columns=columns, dtype=object)
    if sorted(got.columns) != sorted(columns):
        return f"columns {got.columns} / {columns}", len(rows)
    if len(got_frame) != len(want_frame):
        return f"rows {len(got_frame)} / {len(want_frame)}", len(rows)
    left, right = canonical(got_frame), canonical(want_frame)
    if left.equals(right):
        return "", len(rows)
    at = (left != right).any(axis=1).idxmax()
    return f"row {at}: {left.loc[at].to_dict()} / {right.loc[at].to_dict()}"[:600], len(rows)


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("trial", "local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="trial-"))
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            with run_folder(spark):
                problem, rows = differences(spark, con, sf_dir, name)
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:500]}", -1
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} rows={rows} "
              f"{time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
