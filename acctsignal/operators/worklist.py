"""The list of accounts to look at next, and how it is fed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsignal.operators.sampling import draw

# Defaults of the work list.
MIN_TWEETS = 10
BATCH = 100
IDS_PER_BLOCK = 100


def eligible(work: DataFrame, min_tweets: int = MIN_TWEETS, fetched: DataFrame | None = None) -> DataFrame:
    """Public English accounts with enough posts that were not fetched yet.

    ``fetched(id)`` is a table of done ids to which jobs append, instead of updating the flag.
    """
    rows = work.where(
        (F.col("protected") == F.lit(False)) & (F.col("language") == "en")
        & (F.col("fetched_tweets") == F.lit(False)) & (F.col("tweet_count") >= min_tweets))
    return rows if fetched is None else unseen(rows, fetched)


def next_work(work: DataFrame, limit: int = BATCH, min_tweets: int = MIN_TWEETS,
              fetched: DataFrame | None = None) -> DataFrame:
    """The ``limit`` eligible accounts found first."""
    return eligible(work, min_tweets, fetched).orderBy("found_date", "id").limit(limit)


def unseen(accounts: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Accounts that are not in ``known`` yet, which may name an account often."""
    return accounts.join(known.select(key).distinct(), key, "left_anti")


def hydrate(ids: DataFrame, accounts: DataFrame) -> DataFrame:
    """Full account records for ``ids(id, _tbsource)``, tagged with where the id came from.

    Repeated ids are looked up once; among several sources the first by name is kept.
    """
    wanted = ids.groupBy("id").agg(F.min("_tbsource").alias("_tbsource"))
    return accounts.drop("_tbsource").join(wanted, "id")


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Records from several sources in one table, tagged ``_tbsource`` with the source's name."""
    tagged = [df.withColumn("_tbsource", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def mentioned_ids(author: Column, reply_to: Column, mentions: Column) -> Column:
    """Ids a post points to: the reply's target first, then mentions; no author, no repeats."""
    every = F.concat(F.array(reply_to), F.coalesce(mentions, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda i: i.isNotNull() & (i != "") & (i != author)))


def mentioned_accounts(posts: DataFrame, source: str = "tweet", *more: str) -> DataFrame:
    """One row ``id_str, _tbsource`` and the columns ``more`` per account that a raw post points to."""
    ids = mentioned_ids(F.col("user.id_str"), F.col("in_reply_to_user_id_str"),
                        F.col("entities.user_mentions.id_str"))
    return posts.where("user is not null").select(
        F.explode(ids).alias("id_str"), F.lit(source).alias("_tbsource"), *more)


def sample_ids(spark: SparkSession, first: int, end: int, percentage: int = 100,
               seed: int = 26) -> DataFrame:
    """``percentage`` of every 100 consecutive ids in [first, end), without replacement.

    Every block is drawn within its own row, so nothing is shuffled. The draw ranks ids by
    a hash, which makes it repeatable.
    """
    if percentage >= 100:
        return spark.range(first, end)
    blocks = spark.range(first, end, IDS_PER_BLOCK)
    last = F.least(F.col("id") + IDS_PER_BLOCK, F.lit(end)) - 1
    drawn = F.slice(
        F.array_sort(F.transform(
            F.sequence(F.col("id"), last),
            lambda i: F.struct(draw(i, seed), i.alias("id")))),
        1, percentage)
    return blocks.select(F.explode(drawn).alias("draw")).select(F.col("draw.id"))
