"""Compare every query with its SQL: ``python tests/oracle_check.py <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from eventloom.session import local_session  # noqa: E402


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return db


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells, key=repr)


def differences(spark, db, name: str, sf_dir: str) -> str | None:
    """None when both engines give the same rows, else what differs."""
    df = queries()[name](spark, sf_dir)
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(oracle_sql()[name])
    want_names, want = table([c[0] for c in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{dict(zip(got_names, g))}\n   != {dict(zip(got_names, w))}"
    return None if got else "no rows"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or sorted(oracle_sql())
    spark, db = local_session("oracle-check", 8), connect(sf_dir)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = differences(spark, db, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        bad += problem is not None
        print(f"{name:26s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal; no SQL: {sorted(set(queries()) - set(oracle_sql()))}")


if __name__ == "__main__":
    main()
