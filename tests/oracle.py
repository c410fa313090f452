"""Run registered queries beside their SQL and compare rows, as the acceptance check does."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() else value)
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, connection, folder, function, sql) -> str | None:
    frame = function(spark, folder)
    names = sorted(frame.columns)
    ours = Counter(tuple(plain(row[n]) for n in names) for row in frame.collect())
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    index = [columns.index(n) for n in names]
    theirs = Counter(tuple(plain(row[i]) for i in index) for row in result.fetchall())
    if ours != theirs:
        more, less = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {more}; only sql {less}"
    if not ours:
        return "empty"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from riskweave.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, connection, folder, function, oracles[name])
            else:
                rows = function(spark, folder).collect()
                problem = None if rows else "empty"
        except Exception as error:  # noqa: BLE001 - reported, and the next query is tried
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(queries)}, {len(oracles)} with SQL")


if __name__ == "__main__":
    main()
