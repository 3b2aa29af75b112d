"""User-level entry points composed from operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame


def chosen(tables: Mapping[str, Callable[[], DataFrame]], only: Iterable[str] | None) -> dict[str, DataFrame]:
    """The named tables of a report; only these are planned."""
    return {name: make() for name, make in tables.items() if only is None or name in only}
