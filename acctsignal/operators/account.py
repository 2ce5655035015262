"""Account features: one row per account from its newest snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.functions import (
    digit_count,
    dump_date,
    entropy,
    flag,
    leading_digits,
    post_time,
    rate,
    table_time,
    trailing_digits,
)
from acctsignal.operators.features import Feature, renamed, with_features

MODES = ("unknown", "training")

# Rates that are 0.0 where they are undefined.
FILLED = ["favorite_rate", "tweet_rate", "ratio_followers_friends", "listed_rate"]


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def _age(later: str) -> Feature:
    return Feature("account_age_days", (later, "created_at_ts"),
                   lambda: F.abs(F.datediff(F.col(later), F.col("created_at_ts"))))


def _on(name: str, source: str, function) -> Feature:
    return Feature(name, (source,), lambda: function(F.col(source)))


def _rate(name: str, numerator: str, denominator: str) -> Feature:
    return Feature(name, (numerator, denominator),
                   lambda: rate(F.col(numerator), F.col(denominator)))


DUMP_TIME = _on("dump_ts", "file_name", dump_date)

CLOCK = {
    "unknown": [_on("created_at_ts", "created_at", post_time), _age("dump_ts")],
    "training": [
        _on("created_at_ts", "timestamp", table_time),
        _on("updated_at_ts", "updated", table_time),
        _age("updated_at_ts"),
    ],
}

FLAGS = [
    _on("is_default_profile", "default_profile", flag),
    _on("is_verified", "verified", flag),
    _on("is_geo_enabled", "geo_enabled", flag),
    _on("is_protected", "protected", flag),
]

COUNTS = [
    renamed("num_followers", "followers_count"),
    renamed("num_friends", "friends_count"),
    renamed("num_favorites", "favourites_count"),
    renamed("num_tweets", "statuses_count"),
]

RATES = [
    _rate("ratio_followers_friends", "followers_count", "friends_count"),
    _rate("favorite_rate", "favourites_count", "account_age_days"),
    _rate("tweet_rate", "statuses_count", "account_age_days"),
    _rate("listed_rate", "listed_count", "account_age_days"),
]

NAME = [
    _on("screen_name_entropy", "screen_name", entropy),
    _on("numbers_at_beginning_of_screen_name", "screen_name", leading_digits),
    _on("numbers_at_end_of_screen_name", "screen_name", trailing_digits),
]

# Available, but in no default set.
DIGITS_IN_NAME = _on("numbers_in_screen_name", "screen_name", digit_count)

IDENTITY = [renamed("user_id", "id"), renamed("lang", "lang"), renamed("screen_name", "screen_name")]

# The columns of the account part.
OUTPUT = [
    "user_id", "created_at_ts", "account_age_days", "lang", "screen_name", "is_default_profile",
    "is_verified", "is_geo_enabled", "num_followers", "num_friends", "num_favorites",
    "ratio_followers_friends", "screen_name_entropy", "numbers_at_beginning_of_screen_name",
    "numbers_at_end_of_screen_name", "favorite_rate", "num_tweets", "tweet_rate", "is_protected",
    "listed_rate",
]


def newest_snapshot(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row per key; ties fall to a hash of the row, not to chance."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    ranking = Window.partitionBy(key).orderBy(*newest_first, tie)
    return df.withColumn("_rank", F.row_number().over(ranking)).where("_rank = 1").drop("_rank")


def first_seen(df: DataFrame, key: str, found: str) -> DataFrame:
    """The first record of every key by the time it was found."""
    return newest_snapshot(df, key, F.col(found).asc_nulls_last())


def fill_rates(df: DataFrame) -> DataFrame:
    return df.na.fill(0.0, FILLED)


def account_features(accounts: DataFrame, mode: str = "unknown", dump_time: Column | None = None,
                     extra: list[Feature] | None = None) -> DataFrame:
    """The account part of the feature table.

    ``unknown`` reads collected profiles, whose snapshot time is in ``file_name`` unless
    ``dump_time`` is given; ``training`` reads labelled tables with ``timestamp``/``updated``.
    """
    check_mode(mode)
    output = list(OUTPUT)
    clock = list(CLOCK[mode])
    snapshot = "updated_at_ts"
    if mode == "unknown":
        snapshot = "dump_ts"
        output.insert(0, "dump_ts")
        clock.insert(0, DUMP_TIME if dump_time is None else Feature("dump_ts", (), lambda: dump_time))
    extra = extra or []
    dated = with_features(accounts, clock)
    features = [*IDENTITY, *FLAGS, *COUNTS, *NAME, *RATES, *extra]
    read = dict.fromkeys([snapshot, "created_at_ts", "account_age_days",
                          *[n for f in features for n in f.needs if n in dated.columns]])
    newest = newest_snapshot(dated.select(*read), "id", F.col(snapshot).desc_nulls_last())
    table = with_features(newest, features)
    return fill_rates(table.select(*output, *[f.name for f in extra]))


def repair_zero_age(features: DataFrame) -> DataFrame:
    """Age 0 becomes 1 and the two rates over the age are computed again."""
    age = F.when(F.col("account_age_days") == 0, 1).otherwise(F.col("account_age_days"))
    return features.withColumn("account_age_days", age).withColumns({
        "favorite_rate": rate(F.col("num_favorites"), F.col("account_age_days")),
        "tweet_rate": rate(F.col("num_tweets"), F.col("account_age_days")),
    })
