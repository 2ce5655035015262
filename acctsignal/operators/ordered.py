"""Neighbours, running sums and top-k in long ordered groups.

A plain window sends all rows of a key to one task. Here a long group is cut into
consecutive slices, windows run per (key, slice), and what crosses a slice border is taken
from a table with one row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

# Parts of a key that are cut on their own before the key is.
SALTS = 32
# Stretches that a key's values are counted in to find the k-th smallest.
BUCKETS = 65_536
# Width of the slices of a timeline: a week, so that ten years of one account are over 500 slices.
SLICE_SECONDS = 604_800
# The slice of rows without a time, which come first.
NO_TIME = -(1 << 62)


def time_slice(seconds: Column, width: int = SLICE_SECONDS) -> Column:
    """A number that rises with time, never NULL: the same for times within one stretch of ``width``."""
    return F.coalesce(F.floor(seconds / F.lit(width)).cast("bigint"), F.lit(NO_TIME))


def add_neighbour(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str],
                  value: Column, name: str, following: bool = False) -> DataFrame:
    """Add the ``value`` of the previous (or following) row in ``order`` within ``keys``.

    ``slice_col`` must not fall along ``order``. What crosses the border of a slice comes from a table of the last (first)
    row of each slice that has rows. The result is NULL where there is no such row; pass a struct to tell that
    from a NULL. Keys must not be NULL.
    """
    in_slice = Window.partitionBy(*keys, slice_col).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(slice_col)
    position, boxed = F.struct(*order), F.struct(value.alias("v"))
    shift = F.lead if following else F.lag
    border = (F.min_by if following else F.max_by)(boxed, position)
    carried = (
        df.groupBy(*keys, slice_col)
        .agg(border.alias("_border"))
        .select(*keys, slice_col, shift("_border").over(across).alias("_carried"))
    )
    return (
        df.withColumn("_near", shift(boxed).over(in_slice))
        .join(carried, [*keys, slice_col], "left")
        .withColumn(name, F.coalesce("_near", "_carried")["v"])
        .drop("_near", "_carried")
    )


def add_previous(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], name: str,
                 width: int = SLICE_SECONDS) -> DataFrame:
    """Add the struct ``name`` of the previous row's ``columns`` per ``key``; NULL in first rows.

    A ``lag`` per key and slice of ``width`` of the time ``order[0]``, and for each slice's first row the last row of
    the slice before that has any. Rows without a time come first; rows without a key are one key's.
    """
    # a struct is never NULL and equals itself also around a NULL
    keyed = df.withColumns({"_key": F.struct(F.col(key)), "_slice": time_slice(F.col(order[0]), width)})
    return add_neighbour(keyed, ["_key"], "_slice", order, F.struct(*columns), name).drop("_key", "_slice")


def add_running_sum(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str],
                    value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in ``order`` within ``keys``."""
    return add_running_sums(df, keys, slice_col, order, {name: value})


def add_running_sums(df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str],
                     values: dict[str, Column]) -> DataFrame:
    """Add, under each name, the sum of its value over the rows before this one in ``order`` within ``keys``."""
    before = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, slice_col)
        .agg(*[F.sum(value).alias(f"_total_{name}") for name, value in values.items()])
        .select(*keys, slice_col, *[F.sum(f"_total_{name}").over(across).alias(f"_carried_{name}") for name in values])
    )
    return (
        df.withColumns({f"_near_{name}": F.sum(value).over(before) for name, value in values.items()})
        .join(carried, [*keys, slice_col], "left")
        .withColumns({name: F.coalesce(f"_near_{name}", F.lit(0)) + F.coalesce(f"_carried_{name}", F.lit(0))
                      for name in values})
        .drop(*[f"{kind}_{name}" for name in values for kind in ("_near", "_carried")])
    )


def first_per_key(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The rows of every key's ``k`` smallest ``value``s, whole numbers >= 0 that are different within a key.

    Nothing is sorted. A key with more than ``k`` rows has its values counted in equal stretches; the stretch that
    holds the k-th smallest is cut again until it is one number, at most four times. That number is the key's limit. ``df`` is
    read in every step, so it should be a stored table. The steps' tables have a row per key with more than ``k`` rows.
    """
    state = materialize(
        df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        .where(F.col("_rows") > k)
        .select(*keys, "_low", F.expr("_high - _low + 1").alias("_span"), F.lit(k).cast("bigint").alias("_left")),
        "long-keys")
    if state.isEmpty():
        return df
    narrow = df.select(*keys, F.col(value).alias("_value"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    while not state.where("_span > 1").isEmpty():
        wide = state.withColumn("_width", F.expr(f"(_span - 1) div {BUCKETS} + 1"))
        counts = (
            narrow.join(wide, list(keys)).where("_value >= _low and _value - _low < _span")
            .groupBy(*keys, "_low", "_width", "_left", F.expr("(_value - _low) div _width").alias("_bucket")).count()
            .withColumn("_upto", F.sum("count").over(along))
        )
        state = materialize(
            counts.where("_upto >= _left and _upto - count < _left")
            .select(*keys, F.expr("_low + _bucket * _width").alias("_low"), F.col("_width").alias("_span"),
                    F.expr("_left - _upto + count").alias("_left")), "long-keys")
    limits = state.select(*keys, F.col("_low").alias("_limit"))
    return df.join(limits, list(keys), "left").where(
        F.col("_limit").isNull() | (F.col(value) <= F.col("_limit"))).select(df.columns)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, salts: int = SALTS) -> DataFrame:
    """The last ``k`` rows of every key along ``order``, NULL order values counting as oldest.

    For small ``k`` Spark cuts each input partition before the shuffle. Rows are cut per (key, salt) and then per key, so
    that a key in very many partitions is not one task's; ``salts=1`` saves the second shuffle where no key is.
    """
    newest_first = [F.col(c).desc_nulls_last() for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for groups in ([*keys, "_salt"], keys) if salts > 1 else (keys,):
        ranking = Window.partitionBy(*groups).orderBy(*newest_first)
        salted = salted.withColumn("_rank", F.row_number().over(ranking)).where(F.col("_rank") <= k).drop("_rank")
    return salted.drop("_salt")
