"""Run registered queries in Spark and their SQL in DuckDB, and compare names, kinds and values; without SQL, test a law.

    python -m tests.compare [--sf 0.01] [--time] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from larder.catalog import CHECKS, QUERIES
from larder.session import local_session
from larder.sources.tables import SCHEMAS
from tests.laws import LAWS

KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int32", "BIGINT": "int64", "HUGEINT": "huge", "DOUBLE": "float",
    "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool",
    "int": "int32", "bigint": "int64", "double": "float", "float": "float", "string": "str", "boolean": "bool",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.12g}"))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when the query equals its SQL, or its law holds; else what differs first."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in CHECKS:
        if name not in LAWS:
            return "neither SQL nor a law"
        return None if got and LAWS[name](got) else f"{LAWS[name].__name__} does not hold for {len(got)} rows"
    got = [tuple(r) for r in got]
    rel = con.sql(CHECKS[name])
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, (KINDS.get(str(t), str(t)) for t in rel.types)))
    for c, t in df.dtypes:
        k = KINDS.get(t, t)
        if k != kinds[c] and not (t.startswith(("array", "map", "struct"))):
            return f"type of {c}: {t} != {kinds[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(_rows(df.columns, got), _rows(rel.columns, want)):
        if a != b:
            return f"{sorted(df.columns)}\n   got  {a}\n   want {b}"
    return None


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("prefixes", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    names = [n for n in sorted(QUERIES) if not args.prefixes or any(n.startswith(p) for p in args.prefixes)]
    for name in names:
        t = time.time()
        try:
            diff = difference(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        n = "" if name in CHECKS else " (no SQL)"
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.1f}s{n}{' ' + diff if diff else ''}", flush=True)
    print(f"{len(names)} queries, {bad} differ", flush=True)


if __name__ == "__main__":
    main()
