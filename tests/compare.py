"""Run registered queries on Spark and their SQL on DuckDB and compare rows."""

from __future__ import annotations

import importlib
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
entry = importlib.import_module("__spark_entry__")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(x):
    if isinstance(x, Decimal):
        return f"DEC{x}"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(cell(y) for y in x) + "]"
    return repr(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, name, folder):
    begun = time.time()
    got = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in got.collect()]
    seconds = time.time() - begun
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(rows)}", seconds, bool(rows)
    begun = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    seconds_sql = time.time() - begun
    (na, a), (nb, b) = table(got.columns, rows), table(names, want)
    if na != nb:
        return f"COLUMNS {na} {nb}", seconds, False
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        off = len(set(a) ^ set(b))
        return f"ROWS {len(a)} {len(b)} differing {off}\n   spark {diff and diff[0]}\n   sql   {diff and diff[1]}", seconds, False
    return f"equal {len(a)} rows (sql {seconds_sql:.1f}s)", seconds, True


def main():
    from reportlens.session import local_session
    folder, picks = sys.argv[1], sys.argv[2:]
    spark, con, bad = local_session(), duck(folder), []
    for name in entry.queries():
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in picks):
            continue
        try:
            said, seconds, ok = compare(spark, con, name, folder)
        except Exception as err:  # noqa: BLE001
            said, seconds, ok = f"ERROR {type(err).__name__} {str(err)[:1500]}", 0.0, False
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {seconds:6.1f}s  {said}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
