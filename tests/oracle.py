"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, name, fn, sql, connection):
    started = time.time()
    frame = fn(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    elapsed = time.time() - started
    if sql is None:
        return elapsed, len(got), "rows-only"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(names, cursor.fetchall())
    odd = [n for n, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k]
    if odd:
        return elapsed, len(got), f"SQL type of {odd}"
    if sorted(names) != sorted(frame.columns):
        return elapsed, len(got), f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else got[:3]
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else want[:3]
        return elapsed, len(got), f"MISMATCH {len(got)} vs {len(want)}\n  {sorted(names)}\n  spark {str(extra)[:900]}\n  sql   {str(missing)[:900]}"
    return elapsed, len(got), "ok"


def main() -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from spanledger.session import build_session

    folder = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    verbose = bool(wanted) and wanted[0] == "-v"
    wanted = wanted[1:] if verbose else wanted
    if wanted and wanted[0].startswith("/"):
        folder = wanted.pop(0)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n == w or n.startswith(w) for w in wanted)]
    spark = build_session()
    connection = connect(folder)
    bad = 0
    for name in names:
        try:
            elapsed, count, verdict = compare(spark, folder, name, queries[name], oracle.get(name), connection)
        except Exception as error:  # noqa: BLE001
            elapsed, count, verdict = 0.0, 0, f"ERROR {str(error).split("JVM stacktrace")[0][:500]}"
        if verdict not in ("ok", "rows-only"):
            bad += 1
        if verbose or verdict != "ok" or count == 0:
            print(f"{name:45s} {count:7d} {elapsed:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
