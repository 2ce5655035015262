"""Scans of the collected and labelled inputs.

Gzip files cannot be split, so the JSON readers take ``spread``: the number of partitions
to deal the parsed rows out to. Leave it out where there are files enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acctsignal import schemas


def _json(spark: SparkSession, path: str | list[str], schema: StructType,
          spread: int | None) -> DataFrame:
    df = spark.read.schema(schema).json(path).withColumn("file_name", F.input_file_name())
    return df.repartition(spread) if spread else df


def read_accounts(spark: SparkSession, path: str | list[str], spread: int | None = None) -> DataFrame:
    """Collected account records, with the file each came from."""
    return _json(spark, path, schemas.account(), spread)


def read_timelines(spark: SparkSession, path: str | list[str], spread: int | None = None) -> DataFrame:
    """Collected posts, nested per account."""
    return _json(spark, path, schemas.timeline(), spread)


def read_posts(spark: SparkSession, path: str | list[str], spread: int | None = None) -> DataFrame:
    """Single posts, one per line, as a stream dump holds them."""
    return _json(spark, path, schemas.post(), spread)


def read_training_accounts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled accounts: CSV with a header line in each file, columns found by name.

    Files are read by their headers, one read for all files with the same one. Finding a file's first line
    takes a pass over the lines; the files' names and headers come to the driver.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    files: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "at").alias("header")).collect():
        files.setdefault(row["header"], []).append(row["file"])
    tables = []
    for same in files.values():
        found = spark.read.option("header", True).option("enforceSchema", False).csv(same)
        tables.append(found.select(*[
            (F.col(f.name).try_cast(f.dataType) if f.name in found.columns
             else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schemas.training_account().fields
        ]))
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schemas.training_account())


def read_training_posts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled posts; text columns are binary."""
    return spark.read.parquet(path)


def read_featurized(spark: SparkSession, **paths: str) -> DataFrame:
    """Feature tables of several populations in one, named by ``population``."""
    tables = [spark.read.parquet(path).withColumn("population", F.lit(name))
              for name, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_followers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Follower lists: ``target, position, created_day``.

    The order is in ``position``: Spark keeps no line order across a file's splits.
    """
    rows = spark.read.option("header", True).schema(schemas.follower()).csv(path)
    return rows.select("target", "position", F.col("created_date").alias("created_day"))
