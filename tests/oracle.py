"""Runs registered queries beside their DuckDB equivalents and tells how they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def difference(spark, query, sql, sf_dir: str) -> str:
    """Empty if the query's rows equal the SQL's."""
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows and {len(theirs[1])}"
    odd = [(a, b) for a, b in zip(ours[1], theirs[1], strict=True) if a != b]
    return f"{len(odd)} of {len(ours[1])} rows, as {odd[0]}" if odd else ""
