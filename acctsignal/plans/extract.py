"""The feature job: raw files in, feature table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from acctsignal.operators.account import account_features, check_mode
from acctsignal.operators.ingest import explode_posts, flatten_posts, normalize_training_posts
from acctsignal.operators.posts import post_features, reply_times_from_parents
from acctsignal.plans.assemble import assemble
from acctsignal.session import configure, materialize
from acctsignal.sources import (
    read_accounts,
    read_timelines,
    read_training_accounts,
    read_training_posts,
    write_features,
)

# What the aggregates read; staging writes only these.
POST_COLUMNS = {
    "training": [
        "user_id", "tweet_id", "tweet_ts_long", "tweet_date", "tweet_hour", "tweet_text",
        "retweeted_status_id", "in_reply_to_user_id", "reply_id_distance", "num_urls",
        "num_hashtags", "num_users_mentioned",
    ],
}
POST_COLUMNS["unknown"] = POST_COLUMNS["training"] + [
    "retweeted_status_user_id", "tweet_language", "retweet_id_distance", "time_to_retweet",
    "retweet_ts_long", "time_to_reply", "latitude", "longitude", "tweet_source",
]


def extract(spark: SparkSession, account_path: str, post_path: str, mode: str = "unknown",
            dump_time: Column | None = None, compat: bool = False, approx: bool = False,
            spread: int | None = None, reply_parents: bool = False) -> DataFrame:
    """Account and post features of every account.

    ``reply_parents`` looks up the time of a replied-to post among the posts themselves.

    The posts are parsed once and staged as narrow columns in the shared folder, since the
    aggregates read different columns of them.
    """
    configure(spark)
    if check_mode(mode) == "training":
        accounts = read_training_accounts(spark, account_path)
        posts = normalize_training_posts(read_training_posts(spark, post_path))
    else:
        accounts = read_accounts(spark, account_path, spread)
        posts = flatten_posts(explode_posts(read_timelines(spark, post_path, spread)))
        if reply_parents:
            posts = reply_times_from_parents(posts)
    staged = materialize(post_features(posts, mode).select(*POST_COLUMNS[mode]), "posts")
    return assemble(account_features(accounts, mode, dump_time), staged, mode, compat, approx)


def run(spark: SparkSession, account_path: str, post_path: str, destination: str, mode: str,
        **options) -> None:
    """``extract`` written to ``destination``."""
    write_features(extract(spark, account_path, post_path, mode, **options), destination)
