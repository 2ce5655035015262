"""From raw records to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.functions import post_time
from acctsignal.operators.ordered import SALTS, newest_per_key

# Posts that the collecting service shows of one account.
TIMELINE_LENGTH = 200

# The columns of the flat post table, and the post's field each comes from.
_TWEET = {
    "tweet_created_at": "created_at", "tweet_id": "id", "tweet_text": "text",
    "tweet_source": "source", "tweet_language": "lang", "tweet_retweet_count": "retweet_count",
    "tweet_favorite_count": "favorite_count", "coordinates": "coordinates.coordinates",
}
_KEPT = [
    "truncated", "in_reply_to_status_id", "in_reply_to_user_id", "in_reply_to_screen_name",
    "contributors", "place", "is_quote_status", "quoted_status_id", "entities",
    "possibly_sensitive", "extended_entities",
]
_USER = {
    "user_id": "id", "user_name": "name", "user_screen_name": "screen_name", "user_url": "url",
    "user_location": "location", "user_description": "description", "user_verified": "verified",
    "user_follower_count": "followers_count", "user_followers_count": "followers_count",
    "user_favorites_count": "favourites_count", "user_friends_count": "friends_count",
    "user_listed_count": "listed_count", "user_status_count": "statuses_count",
    "user_created_at": "created_at", "user_utc_offset": "utc_offset",
    "user_geo_enabled": "geo_enabled", "user_language": "lang",
    "user_profile_image_url_https": "profile_image_url_https",
}
_OTHER_STATUS = {
    "quoted_status_user_id": "quoted_status.user.id",
    "quoted_status_user_screen_name": "quoted_status.user.screen_name",
    "quoted_status_user_language": "quoted_status.user.lang",
    "quoted_status_tweet_created_at": "quoted_status.created_at",
    "retweeted_status_id": "retweeted_status.id",
    "retweeted_status_user_id": "retweeted_status.user.id",
    "retweeted_status_user_screen_name": "retweeted_status.user.screen_name",
    "retweeted_status_user_language": "retweeted_status.user.lang",
    "retweeted_status_tweet_created_at": "retweeted_status.created_at",
    "retweeeted_status_entities": "retweeted_status.entities",  # the published column name
    "replied_status_tweet_created_at": "in_reply_to_status.created_at",
}
# What the retweet graph needs of the original post.
_ORIGINAL = {
    "rt_text": "retweeted_status.text",
    "rt_retweet_count": "retweeted_status.retweet_count",
    "rt_favorite_count": "retweeted_status.favorite_count",
}


def explode_posts(timelines: DataFrame) -> DataFrame:
    """One row per post; accounts with no posts give none."""
    return timelines.select(F.explode("tweets").alias("post")).select("post.*")


def nest_posts(posts: DataFrame, account: list[str], post: list[str], order: list[str],
               limit: int | None = None) -> DataFrame:
    """One row per account with its posts as an array, newest first; the newest ``limit``, if given.

    ``account`` is the key and what else the record says of the account, taken from the
    newest post. A limit comes before the arrays are built, so none outgrows it; without one an
    array is as long as its account's list of posts.
    """
    key, *others = account
    newest = posts if limit is None else newest_per_key(posts, [key], order, limit, SALTS)
    at = F.struct(*order)
    entry = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *post])])
    return newest.groupBy(key).agg(
        *[F.max_by(c, at).alias(c) for c in others],
        F.reverse(F.array_sort(F.collect_list(entry))).alias("tweets"))


def flatten_posts(posts: DataFrame, with_original: bool = False) -> DataFrame:
    """The flat post table: 48 columns, and three more about the retweeted post on request."""
    paths = {**_TWEET, **{c: c for c in _KEPT}, **{k: f"user.{v}" for k, v in _USER.items()},
             **_OTHER_STATUS, **(_ORIGINAL if with_original else {})}
    return posts.select(*[F.col(path).alias(name) for name, path in paths.items()])


def normalize_training_posts(posts: DataFrame) -> DataFrame:
    """Labelled posts with the column names of the flat table and text instead of bytes."""
    complete = posts.where("created_at is not null and text is not null and source is not null")
    return (
        complete.withColumns({
            "user_id": F.col("user_id").try_cast("bigint"),
            "tweet_created_at": F.col("created_at").cast("string"),
            "tweet_text": F.col("text").cast("string"),
            "tweet_source": F.col("source").cast("string"),
        })
        .drop("created_at", "text", "source")
        .withColumnsRenamed({
            "id": "tweet_id",
            "retweet_count": "tweet_retweet_count",
            "favorite_count": "tweet_favorite_count",
            "num_mentions": "num_users_mentioned",
        })
    )


def account_summary(accounts: DataFrame, found_date: Column | None = None) -> DataFrame:
    """The work-list record of an account."""
    return accounts.select(
        "id", "id_str", "screen_name",
        post_time(F.col("created_at")).alias("created_date"),
        (F.current_timestamp() if found_date is None else found_date).alias("found_date"),
        F.lit(None).cast("timestamp").alias("fetched_tweets_date"),
        F.lit(False).alias("fetched_tweets"),
        "protected",
        F.col("statuses_count").alias("tweet_count"),
        F.col("_tbsource").alias("source"),
        F.col("lang").alias("language"),
    )
