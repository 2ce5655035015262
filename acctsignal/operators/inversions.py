"""Inversions of sequences of any length, without an array or a task per sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.operators.ordered import SLICE_SECONDS, add_running_sum, add_running_sums, time_slice
from acctsignal.session import materialize

# Bits of a rank that are compared at a time.
DIGIT_BITS = 4
# Rows that one task deals out to the digits of their ranks.
ROWS_PER_TASK = 100_000


def count_inversions(df: DataFrame, key: str, order: Sequence[str], value: Column,
                     width: int = SLICE_SECONDS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``key, inversions``: pairs of a key's rows whose ``value`` falls along ``order``. Equal values are none.

    Values become ranks 0, 1, …, equal ones in the order of their rows. Two ranks differ first in some digit of
    ``DIGIT_BITS`` bits: they are an inversion if the earlier row has the larger digit. So a row goes once to each digit of
    its rank, into a group with the rows that have the same higher digits, and counts the ones before it with a larger one.
    Ranks and counts are running sums over slices of ``width`` in the value and in ``order[0]`` (both numbers, such as epoch
    seconds), so a long key is dealt out over many tasks: n rows make n log n, whatever their order. The number of
    partitions follows the number of rows, which are stored and counted first, as a shuffle sized by its bytes would
    have all digits of many rows in one task.

    Rows without a value are in no pair; rows without a key are left out.
    """
    rows = materialize(df.where(F.col(key).isNotNull()).select(key, *order, value.alias("_value")), "timelines")
    parts = rows.count() // rows_per_task + 1
    valued = rows.where("_value is not null").withColumn("_by_value", time_slice(F.col("_value"), width))
    dealt = valued.repartition(parts, key, "_by_value")
    ranked = materialize(add_running_sum(dealt, [key], "_by_value", ["_value", *order], F.lit(1), "_rank"), "ranks")
    sizes = ranked.groupBy(key).agg(
        F.ceil(F.length(F.bin(F.count("*") - 1)) / DIGIT_BITS).cast("int").alias("_digits"))

    def shifted(digits: Column) -> Column:
        return F.call_function("shiftright", F.col("_rank"), digits * DIGIT_BITS)

    by_digit = (
        ranked.repartition(parts, key, *order).join(sizes, key)
        .withColumn("_place", F.explode(F.sequence(F.lit(0), F.col("_digits") - 1)))
        .select(key, *order, "_value", "_place", shifted(F.col("_place") + 1).alias("_prefix"),
                (shifted(F.col("_place")) % (1 << DIGIT_BITS)).cast("int").alias("_digit"),
                time_slice(F.col(order[0]), width).alias("_at"))
        .repartition(parts, key, "_place", "_prefix", "_at")
    )
    above = {f"_above_{d}": (F.col("_digit") > d).cast("int") for d in range((1 << DIGIT_BITS) - 1)}
    counted = add_running_sums(by_digit, [key, "_place", "_prefix"], "_at", [*order, "_value"], above)
    # nothing is above the largest digit
    larger = F.coalesce(F.get(F.array(*above), F.col("_digit")), F.lit(0))
    found = counted.groupBy(key).agg(F.sum(larger).alias("inversions"))
    return (
        rows.select(key).distinct().join(found, key, "left")
        .select(key, F.coalesce("inversions", F.lit(0)).cast("bigint").alias("inversions"))
    )
