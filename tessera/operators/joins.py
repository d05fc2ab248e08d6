"""Join helpers: a correlated probe, greedy ordering, strategy hints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

#: Hints by strategy name.
STRATEGIES = {"broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge"}


def equi(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    return left.join(right.hint(STRATEGIES[strategy]) if strategy else right, on, how)


def theta(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """A join on any comparison.  Without an equality Spark compares all pairs, so one side should be small."""
    return left.join(right, condition)


def lateral(outer: DataFrame, inner: DataFrame, condition: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """For each outer row the inner rows that its values select; Catalyst turns equalities into an ordinary join."""
    return outer.join(inner, condition(outer, inner))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, from file sizes and column statistics; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def greedy(frames: dict[str, DataFrame], on: dict[frozenset, list[str]], sizes: dict[str, int] | None = None) -> DataFrame:
    """Join connected frames, the two smallest first; ``on`` has the columns by pair of names."""
    groups = [(sizes[n] if sizes else estimated_bytes(df), {n}, df) for n, df in frames.items()]
    while len(groups) > 1:
        pairs = [(a[0] + b[0], i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j and _columns(a[1], b[1], on)]
        if not pairs:
            raise ValueError("the frames are not connected")
        _, i, j = min(pairs)
        a, b = groups[i], groups[j]
        joined = (min(a[0], b[0]), a[1] | b[1], a[2].join(b[2], _columns(a[1], b[1], on)))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    return groups[0][2]


def _columns(a: set[str], b: set[str], on: dict[frozenset, list[str]]) -> list[str]:
    return sorted({c for x in a for y in b for c in on.get(frozenset((x, y)), [])})
