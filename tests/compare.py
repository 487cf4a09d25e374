"""Run registered queries next to their SQL and compare the results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is not None, str(type(v)) if v is not None else "", v if v is not None else 0) for v in row))


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    frame = query(spark, sf_dir)
    mine = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = sorted_rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for left, right in zip(mine, theirs):
        if left != right:
            return f"{sorted(columns)}: {left} != {right}"[:1500]
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from resona.session import build_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        mark = "ok  "
        try:
            if name in sqls:
                outcome = compare(spark, con, query, sqls[name], sf)
                mark = "ok  " if outcome is None else "DIFF"
            else:
                mark, outcome = "rows", f"{query(spark, sf).count()}"
        except Exception as error:  # report and go on
            mark, outcome = "FAIL", f"ERROR {type(error).__name__}: {str(error)[:900]}"
        print(f"{mark} {name} {time.time() - began:.1f}s {outcome or ''}", flush=True)
