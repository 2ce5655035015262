"""Bought followers: long runs of followers whose accounts were made on one day.

Input: ``target``, ``position`` (rising in follow order; holes are allowed) and ``created_day``.
Lists are processed in chunks of positions, so one target's list is never in one task. Runs count list
entries: positions in results are numbered anew, 1, 2, … without holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.operators.ordered import add_neighbour, add_running_sum
from acctsignal.session import materialize

POSITIONS_PER_CHUNK = 1_000_000
# Runs with fewer than this many positions between end and start belong together.
MERGE_GAP = 5


def dense_positions(followers: DataFrame, chunk: int = POSITIONS_PER_CHUNK) -> DataFrame:
    """The list with entries numbered 1, 2, … in the order of their positions."""
    chunked = followers.select("target", "position", "created_day",
                               F.expr(f"position div {chunk}").alias("chunk"))
    counted = add_running_sum(chunked, ["target"], "chunk", ["position"], F.lit(1), "earlier")
    return counted.select("target", (F.col("earlier") + 1).alias("position"), "created_day")


def follower_runs(followers: DataFrame, chunk: int = POSITIONS_PER_CHUNK) -> DataFrame:
    """Run-length encoding: ``target, start_position, end_position, length, created_day``.

    An unknown creation day makes a run of its own.
    """
    own = F.expr(f"position div {chunk}")
    # the last position of a chunk also goes, as a guest, in front of the next chunk
    is_last = F.col("position") % chunk == chunk - 1
    chunked = dense_positions(followers, chunk).withColumn(
        "chunk", F.explode(F.when(is_last, F.array(own, own + 1)).otherwise(F.array(own))))
    in_chunk = Window.partitionBy("target", "chunk").orderBy("position")
    before = F.lag("created_day").over(in_chunk)
    flagged = (
        chunked.withColumn("is_start", F.coalesce(F.col("created_day") != before, F.lit(True)))
        .where(F.col("chunk") == own)
    )

    per_target = Window.partitionBy("target")
    # backwards, since a frame that ends at the last row would be computed anew for every row
    later = per_target.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        flagged.groupBy("target", "chunk")
        .agg(F.min(F.when(F.col("is_start"), F.col("position"))).alias("first_start"),
             F.max("position").alias("last_position"))
        .select("target", "chunk",
                F.last("first_start", ignorenulls=True).over(later).alias("later_start"),
                F.max("last_position").over(per_target).alias("list_length"))
    )
    return (
        flagged.where("is_start")
        .withColumn("next_start", F.lead("position").over(in_chunk))
        .join(borders, ["target", "chunk"])
        .withColumn("end_position",
                    F.coalesce("next_start", "later_start", F.col("list_length") + 1) - 1)
        .select("target", F.col("position").alias("start_position"), "end_position",
                (F.col("end_position") - F.col("position") + 1).alias("length"), "created_day")
    )


def run_thresholds(runs: DataFrame) -> DataFrame:
    """Per target, three standard deviations above the mean run length, rounded up.

    NULL for a target with a single run.
    """
    return runs.groupBy("target").agg(
        F.ceil(F.avg("length") + 3 * F.stddev_samp("length")).alias("threshold"))


def suspicious_runs(runs: DataFrame) -> DataFrame:
    """Runs longer than their target's threshold."""
    return runs.join(run_thresholds(runs), "target").where("length > threshold")


def with_gaps(suspicious: DataFrame, chunk: int = POSITIONS_PER_CHUNK) -> DataFrame:
    """Add ``gap``, the distance from the end of the suspicious run before."""
    chunked = suspicious.withColumn("chunk", F.expr(f"start_position div {chunk}"))
    linked = add_neighbour(chunked, ["target"], "chunk", ["start_position"],
                           F.col("end_position"), "previous_end")
    return linked.withColumn("gap", F.col("start_position") - F.col("previous_end")).drop("chunk")


def fake_follower_blocks(suspicious: DataFrame, merge_gap: int = MERGE_GAP,
                         chunk: int = POSITIONS_PER_CHUNK) -> DataFrame:
    """Merge suspicious runs with small gaps: ``target, start_position, end_position``."""
    last = suspicious.groupBy("target").agg(F.max("end_position").alias("last_end"))
    opening = (
        with_gaps(suspicious, chunk)
        .where(F.coalesce(F.col("gap") >= merge_gap, F.lit(True)))
        .withColumn("chunk", F.expr(f"start_position div {chunk}"))
    )
    # a block ends where the run before the next block's first run ends
    linked = add_neighbour(opening, ["target"], "chunk", ["start_position"],
                           F.col("previous_end"), "block_end", following=True)
    return linked.join(last, "target").select(
        "target", "start_position", F.coalesce("block_end", "last_end").alias("end_position"))


def find_fake_followers(followers: DataFrame, merge_gap: int = MERGE_GAP,
                        chunk: int = POSITIONS_PER_CHUNK) -> DataFrame:
    """Blocks of likely bought followers per target.

    Runs are read twice, for the threshold and for the filter, and suspicious runs three
    times, so both are staged.
    """
    runs = materialize(follower_runs(followers, chunk), "runs")
    suspicious = materialize(suspicious_runs(runs), "suspicious-runs")
    return fake_follower_blocks(suspicious, merge_gap, chunk)
