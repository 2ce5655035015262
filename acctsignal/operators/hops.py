"""Tables that grow by one folder per step of a graph walk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acctsignal.session import new_shared_path

# Rows of a bucketed table in one bucket, and the size from which buckets are worth their files.
ROWS_PER_BUCKET = 1_000_000


class HopTable:
    """Rows found per hop, written to the shared folder as ``hop=0``, ``hop=1``, …

    Reading a written table cuts the lineage of the walk, survives lost executors and tells
    the optimizer how large the table is.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark = spark
        self.path = new_shared_path(spark, name)
        self.schema = StructType.fromDDL(schema)
        self.with_hop = StructType.fromDDL(f"{schema}, hop int")
        self.hops = 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Write the next hop's rows and return them as read back."""
        folder = f"{self.path}/hop={self.hops}"
        rows.select(*self.schema.names).write.parquet(folder)
        self.hops += 1
        return self.spark.read.schema(self.schema).parquet(folder)

    def all(self) -> DataFrame:
        """Every row so far, with its ``hop``."""
        if not self.hops:
            return self.spark.createDataFrame([], self.with_hop)
        return self.spark.read.schema(self.with_hop).parquet(self.path)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """One bucket for a table that a task can read; else at least as many as a shuffle has partitions."""
    if rows <= ROWS_PER_BUCKET:
        return 1
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET))


class BucketTable:
    """A table in the shared folder, bucketed by its keys, that grows by one step's rows at a time.

    A join on the keys reads it as it lies: only the other side is shuffled. Its name in the session's catalog is its
    own; the files belong to the folder.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], buckets: int):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.name = f"acctsignal_{name}_{uuid.uuid4().hex}"
        self.path = new_shared_path(spark, name)

    def add(self, rows: DataFrame, step: int = 0) -> DataFrame:
        """Append ``rows`` and return them as read back."""
        (rows.withColumn("hop", F.lit(step)).repartition(self.buckets, *self.keys)
         .write.mode("append").partitionBy("hop").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
         .format("parquet").option("path", self.path).saveAsTable(self.name))
        return self.all().where(F.col("hop") == step).drop("hop")

    def all(self) -> DataFrame:
        """Every row, with the step it came in as ``hop``."""
        return self.spark.table(self.name)
