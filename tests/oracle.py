"""Runs the registered queries next to their SQL and reports differences.

``python tests/oracle.py SF_DIR [name ...]``
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TIMES: list[float] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer():
        return repr(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark, con, sf_dir: str, checked) -> tuple[int, list[str]]:
    start = time.time()
    df = checked.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES.append(time.time() - start)
    if checked.sql is None:
        return len(got), []
    cur = con.execute(checked.sql)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        problems.append(
            f"rows {len(got)} != {len(want)}; only here {only_got}; only in SQL {only_want}"
        )
    return len(got), problems


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from coppice.plans import QUERIES
    from coppice.session import build

    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, checked in QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            n, problems = differences(spark, con, sf_dir, checked)
        except Exception:
            n, problems = -1, [traceback.format_exc(limit=4)[-1800:]]
        status = "ok" if not problems else "BAD"
        print(f"\n{status:4} {name:34} {n:8} rows {TIMES[-1] if TIMES else 0:6.1f} s of {time.time() - start:6.1f} s {'' if checked.sql else '(rows only)'}", flush=True)
        for p in problems:
            bad += 1
            print("     ", p[:2500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
