"""Accounts from an endless feed of posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from acctsignal import schemas
from acctsignal.functions import has_all_terms, post_time
from acctsignal.operators.ingest import account_summary
from acctsignal.operators.worklist import mentioned_accounts, unseen

SOURCE = "stream"


def read_post_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder that post files are added to, as a stream."""
    reader = spark.readStream.schema(schemas.post())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def tracked(posts: DataFrame, query: str | None = None) -> DataFrame:
    """Messages that are posts and, if given, hold every word of ``query``."""
    rows = posts.where("user is not null")
    return rows.where(has_all_terms(F.coalesce("text", F.lit("")), query)) if query else rows


def authors(posts: DataFrame, source: str = SOURCE) -> DataFrame:
    """The full account record of every post's author."""
    return posts.select("user.*").withColumn("_tbsource", F.lit(source))


def mentioned(posts: DataFrame, source: str = SOURCE) -> DataFrame:
    """Ids of accounts that posts reply to or mention."""
    return mentioned_accounts(posts, source)


def once(stream: DataFrame, key: str, event_time: str | None = None,
         forget_after: str | None = None) -> DataFrame:
    """Every key's first row.

    Exact, with state that grows with the number of keys; given ``event_time`` and
    ``forget_after``, state is bounded and a key may come again after that time.
    """
    if event_time and forget_after:
        return stream.withWatermark(event_time, forget_after).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def hydrated(ids: DataFrame, accounts: DataFrame) -> DataFrame:
    """Join a stream of distinct ``id, _tbsource`` with a static dump of accounts."""
    return ids.join(accounts.drop("_tbsource"), "id")


def _as_records(accounts: DataFrame, *more: str) -> DataFrame:
    """``id, record``: the fields of an account record that are there, as JSON."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.account().fields if f.name in accounts.columns]
    return accounts.where("id is not null").select(
        F.col("id").cast("bigint").alias("id"), F.to_json(F.struct(*fields)).alias("record"), *more)


_STORED = "id bigint, record string"


def first_sightings(sightings: DataFrame, forget_after: int | None = None) -> DataFrame:
    """``id, record`` of every account when it is first seen, from a stream of ``id, record, at, post``.

    An account's state is that it was seen, nothing more; of several sightings in its first batch the earliest
    post's counts. With ``forget_after`` seconds, an account that was not seen for so long is forgotten and
    may come again, which bounds the state; the stream then never ends by itself, as there is always a time to wait for. A batch's rows of one account are only compared, never collected.
    """
    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for batch in batches:
            if not state.exists and len(batch):
                row = min(zip(batch["at"], batch["post"], batch["record"]))
                best = row if best is None else min(best, row)
        if best is not None:
            yield pd.DataFrame({"id": [key[0]], "record": [best[2]]})
            state.update((True,))
        if forget_after:
            state.setTimeoutDuration(forget_after * 1000)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after else GroupStateTimeout.NoTimeout
    return sightings.groupBy("id").applyInPandasWithState(first, _STORED, "seen boolean", "append", timeout)


class AccountStore:
    """Accounts seen so far: gzip JSON records, and the work list as Parquet.

    Each micro-batch writes a folder of its own in both tables and replaces it when Spark
    repeats the batch, so a batch counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.records = f"{folder}/records"
        self.work = f"{folder}/work"
        self.fetched = f"{folder}/fetched"

    def _read(self, schema: StructType, read: Callable) -> DataFrame:
        """An empty table until the first batch is written."""
        try:
            return read(self.spark.read.schema(schema))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def work_list(self) -> DataFrame:
        schema = StructType([*schemas.work_item().fields, StructField("batch", LongType())])
        return self._read(schema, lambda r: r.parquet(self.work))

    def fetched_ids(self) -> DataFrame:
        return self._read(StructType.fromDDL("id bigint"), lambda r: r.parquet(self.fetched))

    def all_records(self) -> DataFrame:
        return self._read(schemas.account(), lambda r: r.json(self.records))

    def write(self, records: DataFrame, batch_id: int, found_date: Column | None = None) -> None:
        """Store a micro-batch's ``id, record``, accounts that no other batch has."""
        folder = f"{self.records}/batch={batch_id}"
        records.select("record").write.mode("overwrite").option("compression", "gzip").text(folder)
        written = self.spark.read.schema(schemas.account()).json(folder)
        account_summary(written, found_date).write.mode("overwrite").parquet(f"{self.work}/batch={batch_id}")

    def add(self, accounts: DataFrame, batch_id: int, found_date: Column | None = None) -> None:
        """Store those of ``accounts`` that no other batch has stored; of several records of one the smallest.

        For single loads: it reads the work list. A stream keeps what it has seen in its state.
        """
        earlier = self.work_list().where(F.col("batch") != batch_id)
        once = _as_records(accounts).groupBy("id").agg(F.min("record").alias("record"))
        self.write(unseen(once, earlier), batch_id, found_date)

    def check_not_lost(self, checkpoint: str) -> None:
        """An error if the stream has finished batches, but their folders are gone."""
        def lines(path: str) -> DataFrame | None:
            """None if there is no such folder."""
            try:
                return self.spark.read.text(path)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                return None

        commits = lines(f"{checkpoint}/commits")
        if commits is not None and not commits.isEmpty() and lines(self.records) is None:
            raise RuntimeError(f"{checkpoint} has finished batches, but {self.records} has none of them: restore the "
                               "folder, or start with a new checkpoint to collect all accounts again")

    def progress(self) -> DataFrame:
        """How many accounts are stored, and how many of them are fetched."""
        done = self.fetched_ids().distinct().withColumn("done", F.lit(1))
        return self.work_list().join(done, "id", "left").agg(
            F.count("*").alias("accounts"), F.count("done").alias("fetched"))

    def mark_fetched(self, ids: DataFrame) -> None:
        ids.select("id").write.mode("append").parquet(self.fetched)


def collect_accounts(posts: DataFrame, store: AccountStore, checkpoint: str,
                     known: DataFrame | None = None, query: str | None = None,
                     trigger: dict | None = None, forget_after: int | None = None) -> StreamingQuery:
    """Store the authors of a post stream and, found in ``known``, the accounts they mention.

    Which accounts were seen is the stream's state, see ``first_sightings``; nothing that is stored is read again.
    ``trigger`` are arguments of the stream's trigger, such as ``{"processingTime": "1 minute"}``; without it
    all that is there is processed and the stream ends. Progress reports of the query carry the number of posts under
    ``progress``. A checkpoint whose store is gone is an error, and so is ``forget_after`` without a ``trigger`` that goes on.
    """
    if forget_after and "processingTime" not in (trigger or {}):
        raise ValueError("forget_after needs a trigger with a processingTime")
    store.check_not_lost(checkpoint)
    seen = tracked(posts, query).observe("progress", F.count(F.lit(1)).alias("posts"))
    at = F.coalesce(F.unix_timestamp(post_time(F.col("created_at"))), F.lit(0)).alias("at")
    post = F.coalesce("id", F.lit(0)).cast("bigint").alias("post")
    found = _as_records(seen.select("user.*", F.lit(SOURCE).alias("_tbsource"), at, post), "at", "post")
    if known is not None:
        pointed = mentioned_accounts(seen.withColumns({"_at": at, "_post": post}), SOURCE, "_at", "_post").select(
            F.col("id_str").try_cast("bigint").alias("id"), "_tbsource", F.col("_at").alias("at"), F.col("_post").alias("post"))
        found = found.unionByName(_as_records(hydrated(pointed, known), "at", "post"))
    return (
        first_sightings(found, forget_after).writeStream.outputMode("append")
        .foreachBatch(lambda batch, batch_id: store.write(batch, batch_id))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream's rows as gzip JSON records, each exactly once."""
    return (
        stream.writeStream.format("json").option("path", path).option("compression", "gzip")
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
