"""Constraints as queries for the rows that violate them; checks stop at the first such row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, ForeignKeyViolation, UniqueViolation


def _not_null(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def duplicate_keys(df: DataFrame, keys: list[str], predicate: str | None = None) -> DataFrame:
    """keys, n: keys without NULLs that occur more than once among rows that the predicate holds for."""
    rows = df.filter(predicate) if predicate else df
    return rows.filter(_not_null(keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def existing_conflicts(batch: DataFrame, existing: DataFrame, keys: list[str], row_id: str | None = None, predicate: str | None = None) -> DataFrame:
    """Batch rows whose key an existing row has; a row does not conflict with itself (equal row_id)."""
    if predicate:
        batch, existing = batch.filter(predicate), existing.filter(predicate)
    have = existing.select(*[F.col(k).alias(f"__{k}") for k in keys], *([F.col(row_id).alias("__id")] if row_id else []))
    on = [batch[k] == have[f"__{k}"] for k in keys] + ([batch[row_id] != have["__id"]] if row_id else [])
    return batch.join(have, on, "left_semi")


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child rows whose key is not NULL and has no parent."""
    have = parent.select(*[F.col(p).alias(f"__{p}") for p in parent_keys])
    return child.filter(_not_null(keys)).join(have, [child[k] == have[f"__{p}"] for k, p in zip(keys, parent_keys)], "left_anti")


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(~_not_null(keys))


def _present(keys: DataFrame, rows: DataFrame, names: list[str], small: bool) -> DataFrame:
    """Which of the keys rows have.  Few keys go to the rows, which then are neither shuffled nor sorted."""
    held = rows.select(*[F.col(k).alias(n) for k, n in zip(names, keys.columns)])
    if small:
        return held.join(F.broadcast(keys), keys.columns)
    return keys.join(held, keys.columns, "left_semi")


def enforce(fresh: DataFrame, constraints: list[dict], lookup, rest: DataFrame | None = None, small: bool = False) -> None:
    """Foreign keys first, then unique ones, each in order of their ids.

    fresh: the rows to be checked; lookup(name) gives the rows of a referenced table; rest: the others of the table, if
    any, which are sound among themselves; small: whether the keys of fresh may be broadcast.
    """
    order = {"foreign_key": 0, "primary_key": 1, "unique": 1, "not_null": 2}
    for c in sorted(constraints, key=lambda c: (order[c["kind"]], c["id"])):
        if c["kind"] == "not_null":
            if not null_keys(fresh, c["columns"]).isEmpty():
                raise ConstraintViolation(f"Column '{c['columns'][0]}' must not be NULL.")
            continue
        asked = fresh.filter(c["predicate"]) if c.get("predicate") else fresh
        keys = asked.filter(_not_null(c["columns"])).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(c["columns"])])
        if c["kind"] == "foreign_key":
            keys = keys.distinct()
            there = _present(keys, lookup(c["parent"]), c["parent_columns"], small).distinct()
            if not keys.join(there, keys.columns, "left_anti").isEmpty():
                raise ForeignKeyViolation(c["name"])
            continue
        if c["kind"] == "primary_key" and not null_keys(fresh, c["columns"]).isEmpty():
            raise UniqueViolation(c["name"])
        if not duplicate_keys(fresh, c["columns"], c.get("predicate")).isEmpty():
            raise UniqueViolation(c["name"])
        if rest is None:
            continue
        others = rest.filter(c["predicate"]) if c.get("predicate") else rest
        if not _present(keys, others, c["columns"], small).isEmpty():
            raise UniqueViolation(c["name"])
