"""Runs registered queries and their SQL side by side and compares every value."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides have the same columns, types of value and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs_rows = cursor.fetchall()
    ours_names = spark_df.columns
    if sorted(names) != sorted(ours_names):
        return [f"columns: spark {sorted(ours_names)} sql {sorted(names)}"]
    order = sorted(names)
    ours = sorted(
        (tuple(_cell(r[c]) for c in order) for r in spark_df.collect()), key=_key
    )
    at = {n: i for i, n in enumerate(names)}
    theirs = sorted((tuple(_cell(r[at[c]]) for c in order) for r in theirs_rows), key=_key)
    problems = []
    if len(ours) != len(theirs):
        problems.append(f"rows: spark {len(ours)} sql {len(theirs)}")
    odd = [(x, y) for x, y in zip(ours, theirs) if _key(x) != _key(y)]
    for x, y in odd[:3]:
        cells = [(c, p, q) for c, p, q in zip(order, x, y) if _key((p,)) != _key((q,))]
        problems.append(f"{cells[:6]} in {x[:4]}")
    if odd:
        problems.append(f"{len(odd)} rows differ")
    return problems


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from nocturne.runtime import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            found = differences(df, con, oracles[name]) if name in oracles else []
            note = "" if name in oracles else f" rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            found, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s{note}", flush=True)
        for line in found:
            print("     ", line[:700], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
