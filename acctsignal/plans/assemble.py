"""The feature table: one row per account with its own and its posts' features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsignal.operators import posts as P
from acctsignal.operators.account import check_mode
from acctsignal.operators.ordered import SLICE_SECONDS

# Columns only one mode fills; the other has NULLs.
ONLY_TRAINING = {"avg_time_from_previous_tweet": "double"}
ONLY_UNKNOWN = {
    "num_languages": "bigint", "avg_retweet_id_distance": "double", "avg_time_to_retweet": "double",
    "avg_dist_from_previous_tweet": "double", "avg_retweet_ts_long": "double",
    "avg_time_to_reply": "double",
}


def post_aggregates(posts: DataFrame, mode: str = "unknown", compat: bool = False,
                    approx: bool = False, width: int = SLICE_SECONDS) -> list[DataFrame]:
    """Tables by ``user_id`` that together hold the post features.

    Whatever is a function of single posts is in one aggregate. The rest has steps of its
    own. All end up partitioned by ``user_id``, so joining them moves nothing.
    """
    unknown = check_mode(mode) == "unknown"
    posts = posts.where("user_id is not null")  # no account to join
    wide = [*P.total_tweets(), *P.retweet_share(), *P.oldest_tweet(), *P.average("reply_id_distance")]
    for entity in P.ENTITIES:
        wide += P.entity_totals(entity)
    gap, previous = P.mean_gaps(compat)
    wide.append(previous)
    if unknown:
        for column in ("retweet_id_distance", "time_to_retweet", "retweet_ts_long", "time_to_reply"):
            wide += P.average(column)
    else:
        wide.append(gap)
    distinct = {"unique_users_retweeted": "retweeted_status_id"}
    if unknown:
        distinct |= {"unique_accounts_retweeted": "retweeted_status_user_id",
                     "num_languages": "tweet_language"}
    counts = P.distinct_counts(approx, **distinct)
    if approx:  # sketches are ordinary aggregates
        tables = [posts.groupBy("user_id").agg(*wide, *counts)]
    else:
        tables = [posts.groupBy("user_id").agg(*wide), posts.groupBy("user_id").agg(*counts)]
    tables += [P.hours_tweeted(posts), P.duplicate_texts(posts)]
    if unknown:
        tables.append(P.mean_distance(posts, width))
    return tables


def assemble(accounts: DataFrame, posts: DataFrame, mode: str = "unknown", compat: bool = False,
             approx: bool = False, extra: list[Callable[[DataFrame], DataFrame]] | None = None,
             width: int = SLICE_SECONDS) -> DataFrame:
    """Left-join the account features with every post aggregate.

    ``extra`` are functions from the post table to a table by ``user_id``. Accounts without
    posts keep NULLs; an account without retweets has no distinct counts of them.
    """
    table = accounts
    for part in post_aggregates(posts, mode, compat, approx, width):
        table = table.join(part, "user_id", "left")
    for function in extra or []:
        table = table.join(function(posts), "user_id", "left")
    retweeting = F.col("num_retweets") > 0
    for name in ("unique_users_retweeted", "unique_accounts_retweeted"):
        if name in table.columns:
            table = table.withColumn(name, F.when(retweeting, F.col(name)))
    missing = {**(ONLY_TRAINING if mode == "unknown" else ONLY_UNKNOWN)}
    if mode == "training":
        missing["unique_accounts_retweeted"] = "bigint"
    return table.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()
                              if name not in table.columns})
