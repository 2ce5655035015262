"""Features as named column expressions with declared inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """One output column, the columns it needs, and how it is computed from them.

    ``build`` is called late because a column needs an active session.
    """

    name: str
    needs: tuple[str, ...]
    build: Callable[[], Column]


class MissingColumns(ValueError):
    """A feature needs columns that neither the table nor another feature provides."""


def renamed(name: str, source: str) -> Feature:
    return Feature(name, (source,), lambda: F.col(source))


def with_features(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Add the features in as few projections as their dependencies allow.

    A feature may read other features, whatever the order; one that carries the name of an
    input column replaces it, after everything that reads the input column.
    """
    pending = list(features)
    produced = {f.name for f in pending}
    while pending:
        waiting = {f.name for f in pending}
        have = set(df.columns)

        def is_ready(f: Feature) -> bool:
            return all(n in have and (n not in waiting or n == f.name) for n in f.needs)

        ready = [f for f in pending if is_ready(f)]
        if not ready:
            lacking = sorted({n for f in pending for n in f.needs} - have - produced)
            raise MissingColumns(
                f"cannot compute {[f.name for f in pending]}: missing columns {lacking}")
        df = df.withColumns({f.name: f.build() for f in ready})
        done = {f.name for f in ready}
        pending = [f for f in pending if f.name not in done]
    return df
