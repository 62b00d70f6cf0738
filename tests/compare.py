"""Compare queries with their DuckDB twins: ``python tests/compare.py sf0.01 [names]``."""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(schema: dict[str, str]) -> dict[str, str]:
    short = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    return {k: short.get(v, v) for k, v in schema.items()}


def differences(spark, con, path: str, name: str, build, sql: str) -> list[str]:
    found = build(spark, path)
    columns, rows = table(found.columns, found.collect())
    twin = con.execute(sql)
    names = [d[0] for d in twin.description]
    types = kinds({d[0]: str(d[1]) for d in twin.description})
    want_columns, want = table(names, twin.fetchall())
    out = []
    if columns != want_columns:
        return [f"columns {columns} != {want_columns}"]
    mine = dict(found.dtypes)
    out += [f"type of {c}: {mine[c]} != {types[c]}" for c in columns if mine[c] != types[c]]
    if len(rows) != len(want):
        out.append(f"rows {len(rows)} != {len(want)}")
    if rows != want:
        extra, missing = list(set(rows) - set(want)), list(set(want) - set(rows))
        out.append(f"{len(extra)} extra, {len(missing)} missing, e.g. {sorted(extra)[:2]} / {sorted(missing)[:2]}")
    return out


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    path = f"/root/testdata/{sys.argv[1]}"
    con, built, twins = connect(path), queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or built:
        start = time.time()
        if name not in twins:
            print(f"  --  {name}: rows {built[name](spark, path).count()}")
            continue
        try:
            problems = differences(spark, con, path, name, built[name], twins[name])
        except Exception as error:
            problems = [str(error)[:400].replace("\n", " ")]
        bad += bool(problems)
        print(f"{'BAD' if problems else ' ok'} {name} {time.time() - start:.1f}s {' | '.join(problems)}", flush=True)
    print("failures:", bad)
