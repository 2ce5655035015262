"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SQL_CONF = {
    # results depend on it
    "spark.sql.session.timeZone": "UTC",
    # split a skewed join even if what follows must then shuffle again
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Whether a query's shuffle files are deleted when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app_name: str = "acctsignal", master: str | None = None,
              conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution.

    Object-store access goes through ``conf`` (``spark.hadoop.fs.s3a.*``); without
    keys there, the store's default credential provider chain applies.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.ansi.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


#: The folder that holds this package.
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def configure(spark: SparkSession) -> SparkSession:
    """Set the time zone and adaptive execution on a session made elsewhere.

    Python workers also look for this package where the driver found it; on a cluster without
    a shared folder for code, pass it with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local-mode session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="acctsignal-"))
    return context.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/acctsignal/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs, survives the loss of executors, and gives the
    optimizer exact sizes for its broadcast decisions in the next step. Nothing reads
    the write's shuffle files after it, so they go at once.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_lock = threading.Lock()
_writes: dict[str, int | str | None] = {"running": 0}


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries go while any thread writes; the last one sets the option back."""
    with _lock:
        if not _writes["running"]:
            _writes["before"] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        _writes["running"] += 1
    try:
        yield
    finally:
        with _lock:
            _writes["running"] -= 1
            if not _writes["running"]:
                if _writes["before"] is None:
                    spark.conf.unset(DROP_SHUFFLES)
                else:
                    spark.conf.set(DROP_SHUFFLES, _writes["before"])
