"""Fixity audit of archived records: Merkle trees over offset ranges of two replicas, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.session import materialize

#: Bytes of an offset range, and ranges a file may have.
RANGE_BYTES = 1 << 16
FILE_RANGES = 1 << 20
#: A node covers 2 to this power nodes of the level below.
_BITS = 6


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a response record: header, empty line, body, two line ends. A null url or body counts as empty."""
    content = F.encode(F.coalesce(body, F.lit("")), "utf-8")
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                      F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(header, "utf-8"), content, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def archived(pages: DataFrame, per_file: int, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(record_id, file, offset, length, digest) of pages written one after the other, ``per_file`` ids to a file.

    Offsets add up in the order of ids within a file; rows that repeat an id are ordered by digest. Rows without an
    id are in file -1.
    """
    record = warc_record(F.col(url), F.col(body))
    rows = pages.select(F.col(key).cast("long").alias("record_id"), F.octet_length(record).cast("long").alias("length"),
                        F.sha2(record, 256).alias("digest"))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("record_id") / per_file).cast("long"), F.lit(-1).cast("long")))
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("record_id", "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def _place(file: Column, offset: Column) -> Column:
    return (file + 1) * FILE_RANGES + F.floor(offset / RANGE_BYTES).cast("long")


class MerkleTree:
    """Levels of hashes above the records of an archive, each a written table; level 0 has a node per offset range.

    A node's number is its place shifted right by ``_BITS`` for each level, so a file's ranges and then files follow in
    order. Its hash covers the numbers and hashes below it in their order, at most 64 but for level 0, which covers the
    records that start in ``RANGE_BYTES`` bytes.
    """

    def __init__(self, records: DataFrame, levels: int, name: str):
        self.records = materialize(records.withColumn("place", _place(F.col("file"), F.col("offset"))), f"{name}-records")
        entry = F.concat_ws(":", "offset", "length", "digest")
        nodes = self.records.groupBy(F.col("place").alias("node")).agg(
            F.collect_list(F.struct("offset", entry.alias("text"))).alias("below"))
        self.levels = [self._hashed(nodes, name)]
        for _ in range(levels):
            entry = F.concat_ws(":", "node", "hash")
            nodes = self.levels[-1].groupBy(F.shiftright("node", _BITS).alias("node")).agg(
                F.collect_list(F.struct(F.col("node").alias("offset"), entry.alias("text"))).alias("below"))
            self.levels.append(self._hashed(nodes, name))

    @staticmethod
    def _hashed(nodes: DataFrame, name: str) -> DataFrame:
        texts = F.transform(F.array_sort("below"), lambda b: b["text"])
        return materialize(nodes.select("node", F.sha2(F.array_join(texts, ","), 256).alias("hash")), f"{name}-level")


def _unmatched(records: DataFrame, other: DataFrame) -> DataFrame:
    """Records without an equal one (file, id, length and digest) in the other archive, wherever it lies there.

    Of equal records, as many stay as the other archive has fewer. ``nth`` numbers what stays of one id.
    """
    same = ["file", "record_id", "length", "digest"]
    matched = other.groupBy(same).agg(F.count("*").alias("there"))
    on = [records[c].eqNullSafe(matched[c]) for c in same]
    nth = F.row_number().over(Window.partitionBy(same).orderBy("offset"))
    left = (records.withColumn("nth", nth).join(matched, on, "left").where(F.col("nth") > F.coalesce("there", F.lit(0)))
            .select(*[records[c] for c in (*same, "offset")]))
    return left.withColumn("nth", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset", "digest")))


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, offset, record_id, length, digest, replica_digest, damage) of the records in which two archives differ.

    ``damage`` is changed, missing (in the replica) or extra. Both are tables as ``archived`` gives. Roots are compared
    first; only below nodes that differ are the next level's nodes compared, and records only in ranges that differ.
    There they are matched by id, so records that an inserted, lost or longer one has moved are no damage. Of records
    that repeat an id, equal ones are matched first, the rest in their order. ``offset`` and ``length`` are the original's,
    an extra record's its own. Equal archives, two empty ones too, give no row. Other columns are not read.
    """
    original, replica = (x.select("record_id", "file", "offset", "length", "digest") for x in (original, replica))
    places = original.select("file").union(replica.select("file")).agg(F.max("file")).first()[0]
    top = ((places if places is not None else 0) + 2) * FILE_RANGES
    levels = -(-top.bit_length() // _BITS)
    ours, theirs = MerkleTree(original, levels, "original"), MerkleTree(replica, levels, "replica")
    bad = None
    for a, b in zip(reversed(ours.levels), reversed(theirs.levels)):
        if bad is not None:
            a, b = (x.join(bad, F.shiftright(x["node"], _BITS) == bad["parent"], "left_semi") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "their_hash"), "node", "full")
        bad = materialize(both.where(~F.col("hash").eqNullSafe(F.col("their_hash"))).select(F.col("node").alias("parent")),
                          "differing")
    a, b = (materialize(t.records.join(bad, F.col("place") == F.col("parent"), "left_semi").drop("place"), "suspects")
            for t in (ours, theirs))
    lost, found = _unmatched(a, b), _unmatched(b, a)
    found = found.select(F.col("file").alias("their_file"), F.col("record_id").alias("their_id"), F.col("nth").alias("their_nth"),
                         F.col("offset").alias("their_offset"), F.col("length").alias("their_length"),
                         F.col("digest").alias("replica_digest"))
    on = ((F.col("file") == F.col("their_file")) & F.col("record_id").eqNullSafe(F.col("their_id"))
          & (F.col("nth") == F.col("their_nth")))
    damage = (F.when(F.col("their_file").isNull(), "missing").when(F.col("file").isNull(), "extra").otherwise("changed"))
    is_extra = F.col("file").isNull()

    def either(ours: str, theirs: str) -> Column:
        return F.when(is_extra, F.col(theirs)).otherwise(F.col(ours)).alias(ours)

    return lost.join(found, on, "full").select(
        either("file", "their_file"), either("offset", "their_offset"), either("record_id", "their_id"),
        either("length", "their_length"), "digest", "replica_digest", damage.alias("damage"))
