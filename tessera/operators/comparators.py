"""Comparators of indexes by name: how a column is turned into what it is ordered by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..errors import CatalogError

COMPARATORS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, key: Callable[[Column], Column]) -> None:
    """Make a comparator known; a name is given once."""
    if name.lower() in COMPARATORS:
        raise CatalogError(f"Comparator '{name}' exists already")
    COMPARATORS[name.lower()] = key


register("bytelex", lambda c: c.cast("string").cast("binary"))
register("utf8", lambda c: c.cast("string"))
register("int64", lambda c: c.cast("long"))
register("uint32", lambda c: c.cast("long"))
register("uint16", lambda c: c.cast("int"))


def comparator(name: str) -> Callable[[Column], Column]:
    if name.lower() not in COMPARATORS:
        raise CatalogError(f"Unknown comparator '{name}'", "Known: " + ", ".join(sorted(COMPARATORS)))
    return COMPARATORS[name.lower()]


def ordered(df: DataFrame, columns: list[str], name: str | None = None) -> DataFrame:
    """The rows in the order of an index on the columns."""
    key = comparator(name) if name else lambda c: c
    return df.orderBy(*[key(df[c]) for c in columns])
