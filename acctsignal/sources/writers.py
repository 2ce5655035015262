"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_records(df: DataFrame, path: str) -> None:
    """Add gzip files with one JSON record per line to a folder."""
    df.write.mode("append").option("compression", "gzip").json(path)


def write_features(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the feature table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the exported node and edge tables under ``path``."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
