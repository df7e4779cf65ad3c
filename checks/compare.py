"""Run the queries and their SQL side by side: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.oracle import ORACLE  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from tastemesh.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True, na_position="last")


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both have the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{c}, {int((~same).sum())} rows, first {got.loc[i].to_dict()} and {want.loc[i].to_dict()}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            middle = time.time()
            verdict = difference(got, con.execute(ORACLE[name]).df()) if name in ORACLE else "no SQL"
            print(f"{name:26} {verdict or 'equal':8} {len(got):8} rows, {middle - start:6.2f} s, "
                  f"SQL {time.time() - middle:6.2f} s", flush=True)
        except Exception as e:  # noqa: BLE001
            verdict = str(e)[:600]
            print(f"{name:26} FAILED {verdict}", flush=True)
        failed += verdict is not None
    return failed


if __name__ == "__main__":
    sys.exit(main())
