"""Compares catalogued queries with their SQL on DuckDB.

    python -m tests.oracle [sf0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def expected(db, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return names, types, rows_of(names, cursor.fetchall())


SAME = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def compare(df, db, sql: str) -> str | None:
    """None when equal, else what differs."""
    names, types, want = expected(db, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = dict(zip(names, types))
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if SAME.get(t) != kinds[c]}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; types {odd}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}; types {odd}"
    return f"types {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as entry
    from casario.session import build_session

    args = sys.argv[1:]
    scale = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if not a.startswith("sf")]
    folder = f"/root/testdata/{scale}"
    spark, db, sql = build_session(8), database(folder), entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        begin = time.perf_counter()
        try:
            df = run(spark, folder)
            note = compare(df, db, sql[name]) if name in sql else f"(rows only) {df.count()}"
        except Exception as e:  # report and go on to the next query
            note = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.perf_counter() - begin
        ok = note is None or note.startswith("(rows only)")
        failed += [] if ok else [name]
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.2f}s {note or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
