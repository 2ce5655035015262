"""Shards by jump consistent hashing: no table of shards, and a new shard takes only the rows it must."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

#: Multiplier of the published generator, and 2 to the 64th.
_MULTIPLIER = "2862933555777941757"
_RANGE = "18446744073709551616"


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The shard of an integer key out of ``shards``, and out of one more; a null key counts as 0.

    From its last shard b a key jumps to floor((b + 1) * 2^31 / (r + 1)), where r are the upper 31 bits of
    the key's next pseudo-random number, until it would leave the shards. The state is a 64-bit unsigned number, held as
    a decimal. The last jump inside the shards is the answer; if the next one hits the new shard, the key moves there.
    """
    wide = "decimal(20,0)"
    start = F.coalesce(key.cast("long"), F.lit(0)).cast(wide)
    unsigned = F.when(start < 0, start + F.lit(_RANGE).cast(wide)).otherwise(start).cast(wide)

    def step(state: Column, _: Column) -> Column:
        number = F.pmod(state["number"] * F.lit(_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"),
                        F.lit(_RANGE).cast("decimal(21,0)")).cast(wide)
        upper = F.floor(number / F.lit(1 << 33).cast("decimal(10,0)")).cast("double")
        to = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (upper + 1))).cast("long")
        moved = F.struct(number.alias("number"), state["next"].alias("last"), to.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    begin = F.struct(unsigned.alias("number"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("next"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, step)
    return end["last"].cast("int"), F.when(end["next"] == shards, F.lit(shards)).otherwise(end["last"]).cast("int")


def slots(rows: DataFrame, group: str, *order: str, name: str = "slot") -> DataFrame:
    """``rows`` with their positions in each group, from 0 without gaps, in the order of ``order``.

    Rows are dealt out by ranges of (group, order) and numbered within each range. A group may fill many ranges: what
    stands before a row is the number of rows of its group in the ranges before, from one row per range and group.
    Rows alike in all of ``order`` take neighbouring positions.
    """
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = materialize(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    ranges = numbered.groupBy(F.shiftright("_place", 33).alias("_part"), group).agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("_part", F.col(group).alias("_group"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    found = numbered.join(starts, (F.shiftright("_place", 33) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias(name))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's shard out of ``shards`` by its id alone, and its place there.

    ``size`` is the text's UTF-8 length plus 16 (a null text has length 0), ``text_crc32`` its checksum (0 if null).
    ``slot`` numbers a shard's rows by id, rows with one id by checksum and size. ``grown_shard`` is the shard when
    there is one more: the same, or the new one. A null id is placed as 0 and comes first.
    """
    shard, grown = jump_hash(F.col(key), shards)
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(data).cast("long") + 16).alias("size"),
                       F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"), shard.alias("shard"),
                       grown.alias("grown_shard"))
    placed = slots(materialize(rows, "shards"), "shard", "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot"), "grown_shard")
