"""Runs registered queries against their DuckDB SQL and compares whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from parasol.sources.views import RAW_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", v + 0.0)
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_value(x) for x in v))
    return ("s", str(v))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def compare(spark_df, con, sql: str) -> tuple[bool, str, int]:
    names, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want_names, want = canonical(rel.columns, rel.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}", len(got)
    if len(got) != len(want):
        extra = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        return False, f"rows {len(got)} != {len(want)} e.g. {names} {extra}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        pair = sorted(a, key=repr)[:2], sorted(b, key=repr)[:2]
        return False, f"{len(a)} differing rows; {names}\n   spark {pair[0]}\n   duck  {pair[1]}", len(got)
    return True, "", len(got)


def main(prefixes: list[str], sf: str = "0.01") -> int:
    from __spark_entry__ import oracle_sql, queries
    from parasol.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracles, bad = oracle_sql(), []
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, why, n = compare(df, con, oracles[name])
            else:
                n = df.count()
                ok, why = n > 0, "no rows" if n == 0 else "rows only"
        except Exception as e:  # report and go on
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:900]}", -1
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:44s} {n:8d} rows {time.time() - started:6.1f}s {why}", flush=True)
    print(f"{len(bad)} bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    scale = args.pop(0)[3:] if args and args[0].startswith("sf=") else "0.01"
    sys.exit(main(args, scale))
