"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [name ...]"""

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return {"bool": "bool", "int": "int", "float": "float", "str": "str"}.get(type(value).__name__, type(value).__name__)


def ordered(columns, data):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in places], sorted(
        (tuple(plain(row[i]) for i in places) for row in data), key=lambda r: [(v is not None, str(type(v)), v) for v in r]
    )


def differences(spark, con, name, folder, queries, oracles):
    """None if equal, else a short description."""
    df = queries[name](spark, folder)
    got_columns, got = ordered(df.columns, df.collect())
    relation = con.sql(oracles[name])
    want_columns, want = ordered(relation.columns, relation.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(got_columns, a, b) if x != y]
            return f"{a[:1]} ... " + "; ".join(f"{c}: {str(x)[:300]!r} != {str(y)[:300]!r}" for c, x, y in bad)[:1500]
        kinds = [(c, kind(x), kind(y)) for c, x, y in zip(got_columns, a, b) if x is not None and kind(x) != kind(y)]
        if kinds:
            return f"types {kinds}"
    return None


def main():
    from vacancia.session import build_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    names = [n for n in queries if not wanted or any(w == n or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = build_session(
        "compare", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(spark, con, name, folder, queries, oracles)
                n = ""
            else:
                problem, n = None, f"{len(queries[name](spark, folder).collect())} rows only"
        except Exception as error:  # report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
