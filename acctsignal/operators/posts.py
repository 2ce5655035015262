"""Post features: columns per post, and their aggregates per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.functions import great_circle_miles, post_time, rate
from acctsignal.operators.account import check_mode
from acctsignal.operators.features import Feature, renamed, with_features
from acctsignal.operators.ordered import SLICE_SECONDS, add_previous

ENTITIES = ("urls", "hashtags", "users_mentioned")

# ---- one post -----------------------------------------------------------------------------


def _difference(name: str, a: str, b: str) -> Feature:
    return Feature(name, (a, b), lambda: F.col(a) - F.col(b))


def _distance(name: str, a: str, b: str) -> Feature:
    return Feature(name, (a, b), lambda: F.abs(F.col(a) - F.col(b)))


def _clock(name: str, text: str) -> list[Feature]:
    return [
        Feature(name, (text,), lambda: post_time(F.col(text))),
        Feature(f"{name}_long", (name,), lambda: F.unix_timestamp(F.col(name))),
    ]


def _entity_count(name: str, field: str) -> Feature:
    return Feature(name, ("entities",), lambda: F.coalesce(F.size(F.col("entities")[field]), F.lit(0)))


POST_TIME = _clock("tweet_ts", "tweet_created_at")
CALENDAR = [
    Feature("tweet_hour", ("tweet_ts",), lambda: F.hour("tweet_ts")),
    Feature("tweet_date", ("tweet_ts",), lambda: F.to_date("tweet_ts")),
]
REPLY_ID_DISTANCE = _distance("reply_id_distance", "user_id", "in_reply_to_user_id")
RETWEET_ID_DISTANCE = _distance("retweet_id_distance", "user_id", "retweeted_status_user_id")
TIME_TO_RETWEET = _difference("time_to_retweet", "tweet_ts_long", "retweet_ts_long")
TIME_TO_REPLY = _difference("time_to_reply", "tweet_ts_long", "reply_ts_long")
COUNTERS = [
    renamed("num_favorites", "tweet_favorite_count"),
    renamed("num_retweets", "tweet_retweet_count"),
]
POSITION = [
    Feature("longitude", ("coordinates",), lambda: F.get("coordinates", F.lit(0))),
    Feature("latitude", ("coordinates",), lambda: F.get("coordinates", F.lit(1))),
]
ENTITY_COUNTS = [
    _entity_count("num_hashtags", "hashtags"),
    _entity_count("num_urls", "urls"),
    _entity_count("num_users_mentioned", "user_mentions"),
]
RETWEET_FLAG = Feature("is_retweet", ("retweeted_status_id",),
                       lambda: F.col("retweeted_status_id").isNotNull().cast("int"))
# Available, but in no default set.
RATIO_RETWEET_FAVORITES = Feature(
    "ratio_retweet_favorites", ("tweet_retweet_count", "tweet_favorite_count"),
    lambda: rate(F.col("tweet_retweet_count"), F.col("tweet_favorite_count")))

POST_FEATURES = {
    "training": [*POST_TIME, *CALENDAR, REPLY_ID_DISTANCE, *COUNTERS, RETWEET_FLAG],
    "unknown": [
        *POST_TIME, *CALENDAR, REPLY_ID_DISTANCE, *COUNTERS, RETWEET_FLAG, RETWEET_ID_DISTANCE,
        *_clock("reply_ts", "replied_status_tweet_created_at"), TIME_TO_REPLY,
        *_clock("retweet_ts", "retweeted_status_tweet_created_at"), TIME_TO_RETWEET,
        *ENTITY_COUNTS, *POSITION,
    ],
}


def post_features(posts: DataFrame, mode: str = "unknown") -> DataFrame:
    """Features that need only the post itself."""
    return with_features(posts, POST_FEATURES[check_mode(mode)])


def reply_times_from_parents(posts: DataFrame) -> DataFrame:
    """Fill ``replied_status_tweet_created_at`` from the parent post where it is in the data.

    Parents are unique on their side of the join, so adaptive execution can split the many
    replies to a popular one. Posts that are no replies get a key of their own, a negative
    one, so they do not all land where NULL hashes to.
    """
    parents = posts.groupBy(F.col("tweet_id").alias("_parent")).agg(
        F.min("tweet_created_at").alias("_parent_created_at"))
    return (
        posts.withColumn("_parent", F.coalesce("in_reply_to_status_id", -1 - F.col("tweet_id")))
        .join(parents, "_parent", "left")
        .withColumn("replied_status_tweet_created_at",
                    F.coalesce("replied_status_tweet_created_at", "_parent_created_at"))
        .drop("_parent", "_parent_created_at")
    )


# ---- a post and the one before it -----------------------------------------------------------

POST_ORDER = ["tweet_ts_long", "tweet_id"]


def sequence_features(posts: DataFrame, compat: bool = False, width: int = SLICE_SECONDS) -> DataFrame:
    """Time and distance since the account's previous post.

    The first post has none; ``compat`` gives it the epoch as its predecessor's time. A timeline is put in order in
    slices of ``width`` seconds.
    """
    linked = add_previous(posts, "user_id", POST_ORDER, ["tweet_ts_long", "latitude", "longitude"],
                          "_before", width)
    previous = F.col("_before.tweet_ts_long")
    if compat:
        previous = F.when(F.col("_before").isNull(), F.lit(0)).otherwise(previous)
    return (
        linked.withColumns({
            "previous_tweet_ts_long": previous.cast("bigint"),
            "previous_tweet_latitude": F.col("_before.latitude"),
            "previous_tweet_longitude": F.col("_before.longitude"),
        })
        .withColumns({
            "time_from_previous_tweet": F.col("tweet_ts_long") - F.col("previous_tweet_ts_long"),
            "dist_from_previous_tweet": great_circle_miles(
                F.col("previous_tweet_latitude"), F.col("previous_tweet_longitude"),
                F.col("latitude"), F.col("longitude")),
        })
        .drop("_before")
    )


# ---- per account ------------------------------------------------------------------------------

def total_tweets() -> list[Column]:
    return [F.count("*").alias("total_tweets")]


def average(column: str) -> list[Column]:
    return [F.avg(column).alias(f"avg_{column}")]


def retweet_share() -> list[Column]:
    is_retweet = F.col("retweeted_status_id").isNotNull().cast("int")
    return [F.sum(is_retweet).alias("num_retweets"), F.avg(is_retweet).alias("perc_retweets")]


def entity_totals(entity: str) -> list[Column]:
    number = F.col(f"num_{entity}")
    has = F.when(number > 0, 1).otherwise(0)
    return [
        F.sum(number).alias(f"num_tweets_{entity}"),
        F.avg(number).alias(f"avg_num_{entity}_in_tweets"),
        F.avg(has).alias(f"perc_tweets_has_{entity}"),
    ]


def oldest_tweet() -> list[Column]:
    return [F.min("tweet_ts_long").alias("oldest_ts_long")]


def mean_gaps(compat: bool = False) -> list[Column]:
    """Means of the time between neighbouring posts and of the earlier one's time.

    The gaps of a sequence add up to last − first, and every post but the last is some
    post's predecessor, so neither mean needs the posts in order: no sort, no window.
    """
    ts = F.col("tweet_ts_long")
    number, first, last = F.count(ts), F.min(ts), F.max(ts)
    earlier = (F.sum(ts.cast("decimal(20,0)")) - last).cast("double")  # exact, in whatever order
    gap = F.try_divide((last - first).cast("double"), number - 1)
    if compat:
        # the first post's gap is its whole time, unless undated posts precede it
        gap = F.when(number == F.count("*"), F.try_divide(last.cast("double"), number)).otherwise(gap)
        previous = F.coalesce(earlier, F.lit(0.0)) / F.greatest(number, F.lit(1))
    else:
        previous = F.try_divide(earlier, number - 1)
    return [gap.alias("avg_time_from_previous_tweet"), previous.alias("avg_previous_tweet_ts_long")]


def distinct_counts(approx: bool = False, **columns: str) -> list[Column]:
    """``name=column`` pairs to distinct counts, exact unless ``approx``."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return [count(F.col(column)).alias(name) for name, column in columns.items()]


def hours_tweeted(posts: DataFrame) -> DataFrame:
    """Mean over an account's days of the number of different hours with a post.

    A day's hours are one 24-bit mask, so the daily step is a plain aggregate.
    """
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("tweet_hour")))
    return (
        posts.groupBy("user_id", "tweet_date")
        .agg(F.coalesce(F.bit_count(mask), F.lit(0)).alias("hours"))
        .groupBy("user_id")
        .agg(F.avg("hours").alias("avg_distinct_hours_tweeted"))
    )


def duplicate_texts(posts: DataFrame) -> DataFrame:
    """How many texts an account posted more than once on one day, over all days and at most.

    Only posts that are neither retweets nor replies count. Texts are told apart by a 256-bit digest, so
    that texts aren't shuffled.
    """
    return (
        posts.where("retweeted_status_id is null and in_reply_to_user_id is null")
        .where("tweet_text is not null and tweet_date is not null")
        .groupBy("user_id", "tweet_date", F.sha2("tweet_text", 256).alias("text_digest")).count()
        .where("count > 1")
        .groupBy("user_id", "tweet_date").agg(F.count("*").alias("texts"))
        .groupBy("user_id")
        .agg(F.sum("texts").alias("duplicates"), F.max("texts").alias("max_daily_duplicates"))
    )


def mean_distance(posts: DataFrame, width: int = SLICE_SECONDS) -> DataFrame:
    """Mean miles between neighbouring geotagged posts."""
    narrow = posts.select("user_id", *POST_ORDER, "latitude", "longitude")
    return sequence_features(narrow, width=width).groupBy("user_id").agg(
        *average("dist_from_previous_tweet"))
