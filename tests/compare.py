"""Compare every query with its SQL oracle: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "embeddings")


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    def text(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "\0"
        if isinstance(value, bool) or str(type(value)) == "<class 'numpy.bool_'>":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(round(float(value), 6) + 0.0)
        return str(value)

    out = frame[sorted(frame.columns)].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def database(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    unlike = (a != b).any(axis=1)
    at = unlike.idxmax()
    return f"{unlike.sum()} of {len(a)} rows differ, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"[:600]


def main(directory: str, names: list[str]) -> int:
    from topicloom.plans import catalog, oracle
    from topicloom.runtime import session

    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                   "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(directory), oracle.oracles(), 0
    for name in names or list(catalog.QUERIES):
        start = time.time()
        try:
            got = catalog.QUERIES[name](spark, directory).toPandas()
            took = time.time() - start
            start = time.time()
            result = difference(got, con.execute(sqls[name]).df()) if name in sqls else f"no oracle, {len(got)} rows"
        except Exception as error:  # report and go on
            took, result = time.time() - start, f"ERROR {type(error).__name__}: {str(error)[:700]}"
        ok = result is None or result.startswith("no oracle")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:22s} {took:6.1f}s {time.time() - start:5.1f}s {len(got):8d} {result or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
