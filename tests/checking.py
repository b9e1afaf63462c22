"""Compare a Spark result with its SQL oracle: column names, kinds of types, and rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(type_name: str) -> str:
    name = str(type_name).lower()
    if any(t in name for t in ("int", "long")):
        return "integer"
    if any(t in name for t in ("double", "float", "decimal")):
        return "decimal" if "decimal" in name else "double"
    if any(t in name for t in ("string", "varchar")):
        return "text"
    return name


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, as short lines; empty when the results agree."""
    found = con.execute(sql)
    expected_names = [c[0] for c in found.description]
    expected_kinds = {c[0]: kind(c[1]) for c in found.description}
    expected = rows_of(expected_names, found.fetchall())
    if sorted(df.columns) != sorted(expected_names):
        return [f"columns {sorted(df.columns)} against {sorted(expected_names)}"]
    out = [f"type of {n}: {t} against {expected_kinds[n]}" for n, t in df.dtypes if kind(t) != expected_kinds[n]]
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if actual != expected:
        out.append(f"{sum(actual.values())} rows against {sum(expected.values())}")
        out += [f"only in Spark: {str(r)[:300]}" for r in list((actual - expected).elements())[:3]]
        out += [f"only in SQL:   {str(r)[:300]}" for r in list((expected - actual).elements())[:3]]
    return out
