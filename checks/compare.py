"""Run registered queries against DuckDB: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

from bazaarlens.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One spelling for equal values of both engines."""
    if isinstance(value, (Decimal, float)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    return value


def normal(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, sf_dir: str, name: str, check) -> tuple[bool, str]:
    start = time.time()
    df = check.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    note = f"{name}: {len(rows)} rows {spent:.1f}s"
    if check.sql is None:
        return True, note + " (no SQL)"
    start = time.time()
    result = con.execute(check.sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    note += f" sql {time.time() - start:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"{note} COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    mine, theirs = normal(df.columns, rows), normal(columns, expected)
    if mine == theirs:
        return True, note + " equal"
    only_mine = sorted(set(mine) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(mine))[:2]
    return False, f"{note} DIFFERS {len(mine)}/{len(theirs)}\n   {only_mine}\n   {only_theirs}"


def main(argv: list[str]) -> int:
    from checks.catalog import load

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    checks = load()
    names = [n for n in checks if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name, checks[name])
        except Exception as error:
            ok, note = False, f"{name}: ERROR {str(error)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + note[:1500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
