"""Run queries and their SQL side by side: ``python tests/compare.py DIR [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in data)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs in columns, types, number of rows or values; empty if nothing does."""
    out = []
    shape = [d[:2] for d in con.execute(f"DESCRIBE {sql}").fetchall()]
    expected = {name: kind for name, kind in shape}
    found = {name: TYPES.get(kind, kind) for name, kind in spark_df.dtypes}
    if expected != found:
        wrong = {k: (found.get(k), expected.get(k)) for k in {*expected, *found} if found.get(k) != expected.get(k)}
        out.append(f"columns (found, expected): {wrong}")
    if set(expected) != set(found):
        return out
    left = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = rows([n for n, _ in shape], con.execute(sql).fetchall())
    if len(left) != len(right):
        out.append(f"rows: {len(left)} found, {len(right)} expected")
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        out.append(f"values: {len(only_left)} only found, {len(only_right)} only expected")
        out += [f"  found    {str(r)[:400]}" for r in sorted(only_left)[:2]]
        out += [f"  expected {str(r)[:400]}" for r in sorted(only_right)[:2]]
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from weftbook.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = database(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = build(spark, sf_dir)
            problems = differences(found, con, sql[name]) if name in sql else [f"no SQL; {found.count()} rows"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.2f}s", flush=True)
        for line in problems:
            print("    " + line)
    print(f"{bad} with differences")
    return bad


if __name__ == "__main__":
    sys.exit(main())
