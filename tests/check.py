"""Runs registered queries beside their SQL and compares the results as sets of rows."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted("|".join(show(row[i]) for i in order) for row in rows)


def compare(df, sql: str, db, times: dict | None = None) -> str | None:
    """None if both give the same rows under the same column names, else what differs."""
    begun = time.time()
    expected = db.sql(sql)
    wanted = canonical(expected.columns, expected.fetchall())
    if times is not None:
        times["sql"] = time.time() - begun
    if sorted(df.columns) != sorted(expected.columns):
        return f"columns {sorted(df.columns)} / {sorted(expected.columns)}"
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(wanted):
        return f"rows {len(found)} / {len(wanted)}"
    different = [(a, b) for a, b in zip(found, wanted) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


def kinds(df, relation) -> list[str]:
    """Columns whose type differs in kind between both results."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(relation.columns, map(str, relation.types)))
    return [f"{c} {t}/{types[c]}" for c, t in df.dtypes if names.get(t, t) != types.get(c)]


if __name__ == "__main__":
    from session import local_session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, db = local_session(), database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(oracles)), "without query:", sorted(set(oracles) - set(queries)))
    failed = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun, times = time.time(), {}
        try:
            df = run(spark, folder)
            built = time.time()
            problem = compare(df, oracles[name], db, times)
            mixed = kinds(df, db.sql(oracles[name]))
            problem = problem or (f"types {mixed}" if mixed else None)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begun - times.get('sql', 0):.1f}s sql {times.get('sql', 0):.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
