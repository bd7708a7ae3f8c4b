"""Run registered queries against their DuckDB twins and compare as multisets."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    return value


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when equal, otherwise a short account of what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = multiset(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = multiset(names, rows)
    if got == want:
        return None
    only_spark, only_sql = got - want, want - got
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; {sorted(names)}\n"
        f"   spark only ({sum(only_spark.values())}): {list(only_spark)[:3]}\n"
        f"   sql only ({sum(only_sql.values())}): {list(only_sql)[:3]}"
    )


def main(folder: str, wanted: list[str]) -> None:
    import __spark_entry__ as entry
    from framelake.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            frame = query(spark, folder)
            if name in oracles:
                problem = difference(frame, connection, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {len(frame.collect())}"
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"ERROR {type(error).__name__} {str(error)[:700]}"
        bad += note.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - begun:6.1f}s {note}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
