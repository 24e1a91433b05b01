"""Run registered queries against their SQL: ``python -m verification.compare [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .checks import CHECKS
from .tables import GIVEN, Tables


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if value != value else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, check in CHECKS.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            frame = check.run(Tables(spark, folder))
            mine = rows_of(frame.columns, frame.collect())
            took = time.time() - started
            if check.sql is None:
                print(f"rows  {name} {len(mine)} {took:.1f}s")
                continue
            started = time.time()
            cursor = con.execute(check.sql)
            columns = [d[0] for d in cursor.description]
            other = rows_of(columns, cursor.fetchall())
            duck = time.time() - started
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERROR {name} {str(error)[:1500]}")
            continue
        if sorted(frame.columns) != sorted(columns):
            bad += 1
            print(f"COLS  {name} {sorted(frame.columns)} {sorted(columns)}")
        elif mine == other and mine:
            print(f"ok    {name} {len(mine)} {took:.1f}s duck {duck:.1f}s")
        else:
            bad += 1
            print(f"DIFF  {name} {len(mine)} {len(other)}")
            a, b = set(mine) - set(other), set(other) - set(mine)
            for label, part in (("spark", a), ("duck ", b)):
                for row in sorted(part, key=repr)[:3]:
                    print(f"      {label} {row}")
            if not a and not b and mine:
                print("      same set, other multiplicity")
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    place = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(place, sys.argv[2:]) else 0)
