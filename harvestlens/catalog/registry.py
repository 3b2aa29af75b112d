"""Query registration and the shared output shape of a query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DIGITS = 6
# Engines break rounding ties differently, so both sides add this part of the last digit before rounding.
NUDGE = 0.123456789
KINDS = {"s": "string", "i": "bigint", "b": "boolean", "d": "double"}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[["SparkSession", str], DataFrame]
    sql: str | None
    columns: tuple[tuple[str, str, int], ...] | None


QUERIES: dict[str, Query] = {}


def parse_columns(spec: str) -> tuple[tuple[str, str, int], ...]:
    """`name:kind` words; kind is s, i, b or d with optional decimals (d2)."""
    out = []
    for word in spec.split():
        name, kind = word.split(":")
        out.append((name, kind[0], int(kind[1:]) if len(kind) > 1 else DIGITS))
    return tuple(out)


def shaped(df: DataFrame, columns) -> DataFrame:
    """Settle names, types and decimals, so that both engines give the same text for the same value."""
    def one(name, kind, digits):
        c = F.col(name).cast(KINDS[kind])
        return (F.round(c + F.lit(NUDGE * 10.0**-digits), digits) if kind == "d" else c).alias(name)

    return df.select(*[one(*c) for c in columns])


def shaped_sql(sql: str, columns) -> str:
    def one(name, kind, digits):
        if kind == "d":
            r = f"round(CAST({name} AS DOUBLE) + CAST('{NUDGE * 10.0**-digits!r}' AS DOUBLE), {digits})"
            return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {name}"
        return f"CAST({name} AS {KINDS[kind].upper()}) AS {name}"

    return f"SELECT {', '.join(one(*c) for c in columns)} FROM ({sql}) AS result"


def query(name: str, columns: str | None = None, sql: str | None = None):
    """Register a function (base) -> DataFrame; `base` gives the derived tables of one data folder."""
    def keep(fn):
        from harvestlens.catalog.base import Base, with_tables

        cols = parse_columns(columns) if columns else None

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Base(spark, sf_dir))
            return shaped(df, cols) if cols else df

        text = shaped_sql(with_tables(sql), cols) if sql else None
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, text, cols)
        return fn

    return keep
