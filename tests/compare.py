"""Compares registered queries with their SQL on DuckDB: python tests/compare.py SF [names]."""

from __future__ import annotations

import datetime
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "NULL" if value != value else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return "NULL" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def compare(spark, con, folder, fn, sql):
    """None if both sides agree, else a short description of the difference."""
    df = fn(spark, folder)
    left = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(left)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    diff = {c: (t, types[c]) for c, t in df.dtypes if KINDS.get(t, t) != types[c]}
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ: {sorted(df.columns)}\n   {bad[0][0]}\n   {bad[0][1]}", len(left)
    return (f"types {diff}" if diff else None), len(left)


def main(sf: str, names: list[str]) -> int:
    from panelcast.session import drop_staged, local_session

    import __spark_entry__ as entry

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    failed = 0
    for n in chosen:
        start = time.time()
        try:
            if n in oracles:
                problem, rows = compare(spark, con, folder, queries[n], oracles[n])
            else:
                rows, problem = len(queries[n](spark, folder).collect()), None
        except Exception as e:  # report and go on
            problem, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += problem is not None
        tag = "FAIL" if problem else ("ok  " if n in oracles else "rows")
        drop_staged(spark)
        print(f"{tag} {n:32s} {rows:8d} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
