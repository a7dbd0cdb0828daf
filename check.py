"""Run registered queries next to their SQL on the same tables and compare them.

    python check.py [name-prefix ...]     (CHECK_SF_DIR, CHECK_CPUS)
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

from sluice.plans import all_queries, all_sql
from sluice.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value) if value != int(value) else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def main() -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(int(os.environ.get("CHECK_CPUS", "8")), "check")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = all_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = query(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in sql:
                print(f"rows  {name:28s} {len(got):8d} rows {took:6.2f}s")
                bad += not got
                continue
            rel = db.execute(sql[name])
            names = [c[0] for c in rel.description]
            kinds = [str(c[1]) for c in rel.description]
            want = rel.fetchall()
            if sorted(df.columns) != sorted(names):
                bad += 1
                print(f"BAD   {name:28s} columns {df.columns} / {names}")
                continue
            a, b = canonical(df.columns, got), canonical(names, want)
            if a == b:
                huge = [n for n, k in zip(names, kinds) if "HUGEINT" in k or "DECIMAL" in k]
                print(f"ok    {name:28s} {len(got):8d} rows {took:6.2f}s {'types ' + str(huge) if huge else ''}")
            else:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"BAD   {name:28s} {len(a)} / {len(b)} rows {sorted(names)}\n      {str(diff)[:900]}")
        except Exception as error:  # keep going: the report lists every query
            bad += 1
            print(f"FAIL  {name}: {str(error)[:700]}")
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
    print(f"{bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
