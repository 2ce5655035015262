import pytest
from pyspark.sql import functions as F

from acctsignal.operators import account as A
from acctsignal.operators import ingest as I
from acctsignal.operators import posts as P
from acctsignal.operators.features import Feature, MissingColumns, with_features
from acctsignal.plans.assemble import assemble
from acctsignal.schemas import account, post, timeline


def accounts(spark, *rows):
    base = {"id": 1, "screen_name": "a1", "created_at": "Wed Aug 01 13:08:45 +0000 2018", "lang": "en",
            "followers_count": 10, "friends_count": 0, "favourites_count": 8, "statuses_count": 4,
            "listed_count": 2, "file_name": "x.accounts-2018-08-05.json.gz"}
    schema = account().add("file_name", "string")
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in full], schema)


def test_account_features(spark):
    row = A.account_features(accounts(spark, {"verified": True})).first()
    assert (row.account_age_days, row.favorite_rate, row.tweet_rate, row.listed_rate) == (4, 2.0, 1.0, 0.5)
    assert row.ratio_followers_friends == 0.0  # no friends
    assert (row.is_verified, row.is_protected, row.screen_name_entropy) == (1, 0, 1.0)
    assert A.account_features(accounts(spark, {})).columns == ["dump_ts", *A.OUTPUT]


def test_unknown_dump_day_gives_zero_rates_unless_passed(spark):
    table = accounts(spark, {"file_name": "accounts.json.gz"})
    row = A.account_features(table).first()
    assert (row.account_age_days, row.tweet_rate) == (None, 0.0)
    given = A.account_features(table, dump_time=F.lit("2018-08-09").cast("timestamp")).first()
    assert (given.account_age_days, given.tweet_rate) == (8, 0.5)


def test_newest_snapshot_wins(spark):
    table = accounts(spark, {"statuses_count": 1}, {"statuses_count": 9, "file_name": "x.accounts-2018-08-07.json"},
                     {"id": 2}, {"id": 2, "file_name": "accounts.json"})
    rows = {r.user_id: r for r in A.account_features(table).collect()}
    assert len(rows) == 2
    assert rows[1].num_tweets == 9
    assert rows[2].dump_ts is not None


def test_extra_feature_and_mode_check(spark):
    row = A.account_features(accounts(spark, {"screen_name": "a12"}), extra=[A.DIGITS_IN_NAME]).first()
    assert row.numbers_in_screen_name == 2
    with pytest.raises(ValueError):
        A.account_features(accounts(spark, {}), "testing")


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumns, match="listed_count"):
        A.account_features(accounts(spark, {}).drop("listed_count"))


def test_features_in_any_order(spark):
    chain = [Feature("c", ("b",), lambda: F.col("b") + 1), Feature("b", ("a",), lambda: F.col("a") + 1),
             Feature("a", ("a",), lambda: F.col("a") * 10)]
    assert with_features(spark.range(1).selectExpr("1 as a"), chain).first().asDict() == {"a": 10, "b": 11, "c": 12}


def test_zero_age_repair(spark):
    df = spark.createDataFrame([(0, 6, 3), (2, 6, 3)], "account_age_days int, num_favorites bigint, num_tweets bigint")
    got = [(r.account_age_days, r.favorite_rate, r.tweet_rate) for r in A.repair_zero_age(df).collect()]
    assert got == [(1, 6.0, 3.0), (2, 3.0, 1.5)]


# ---- posts ---------------------------------------------------------------------------------

def raw_post(**values):
    return tuple(values.get(n) for n in post().names)


def test_explode_and_flatten(spark):
    user = tuple({"id": 5, "screen_name": "five"}.get(n) for n in post()["user"].dataType.names)
    entities = ([("x",)], None, [(9, "9")])
    full = raw_post(id=1, created_at="Wed Aug 01 13:08:45 +0000 2018", user=user, entities=entities,
                    coordinates=([7.0, 50.0],), text="hello", in_reply_to_user_id=2)
    broken = raw_post(id=2, created_at="yesterday", user=user, coordinates=([],))
    rows = spark.createDataFrame(
        [(5, "5", "five", [full, broken]), (6, "6", "six", []), (7, "7", "seven", None)], timeline())
    flat = I.flatten_posts(I.explode_posts(rows))
    assert len(flat.columns) == 48 and flat.count() == 2
    got = {r.tweet_id: r for r in P.post_features(flat).collect()}
    assert (got[1].tweet_hour, got[1].longitude, got[1].latitude, got[1].reply_id_distance) == (13, 7.0, 50.0, 3)
    assert (got[1].num_hashtags, got[1].num_urls, got[1].num_users_mentioned) == (1, 0, 1)
    assert (got[2].tweet_ts, got[2].longitude, got[2].num_urls, got[2].is_retweet) == (None, None, 0, 0)


def test_training_posts(spark):
    df = spark.createDataFrame(
        [(1, "5", bytearray(b"a"), bytearray(b"b"), bytearray("é".encode()), 3, 4, 1, 2, 3, None, None),
         (2, "x", bytearray(b"a"), bytearray(b"b"), bytearray(b"c"), 3, 4, 1, 2, 3, None, None),
         (3, "5", None, bytearray(b"b"), bytearray(b"c"), 3, 4, 1, 2, 3, None, None)],
        "id bigint, user_id string, created_at binary, text binary, source binary, retweet_count bigint, "
        "favorite_count bigint, num_mentions int, num_urls int, num_hashtags int, retweeted_status_id bigint, "
        "in_reply_to_user_id bigint")
    rows = {r.tweet_id: r for r in I.normalize_training_posts(df).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].user_id, rows[1].tweet_source, rows[1].num_users_mentioned) == (5, "é", 1)
    assert rows[2].user_id is None


def timeline_posts(spark, rows):
    columns = ("user_id bigint, tweet_id bigint, tweet_ts timestamp, tweet_text string, retweeted_status_id bigint, "
               "in_reply_to_user_id bigint")
    df = spark.createDataFrame(rows, "u bigint, t bigint, s string, x string, r bigint, p bigint").selectExpr(
        "u as user_id", "t as tweet_id", "cast(s as timestamp) as tweet_ts", "x as tweet_text",
        "r as retweeted_status_id", "p as in_reply_to_user_id")
    assert len(columns.split(",")) == len(df.columns)
    df = df.withColumns({
        "tweet_ts_long": F.unix_timestamp("tweet_ts"), "tweet_date": F.to_date("tweet_ts"),
        "tweet_hour": F.hour("tweet_ts"), **{f"num_{e}": F.lit(0) for e in P.ENTITIES},
        "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double"),
        **{c: F.lit(None).cast("bigint") for c in (
            "retweeted_status_user_id", "reply_id_distance", "retweet_id_distance", "time_to_retweet",
            "retweet_ts_long", "time_to_reply")},
        "tweet_language": F.lit("en"),
    })
    return df


ROWS = [
    (1, 1, "2018-08-01 10:00:00", "same", None, None), (1, 2, "2018-08-01 10:30:00", "same", None, None),
    (1, 3, "2018-08-01 11:00:00", "twin", None, None), (1, 4, "2018-08-01 12:00:00", "twin", None, None),
    (1, 5, "2018-08-02 10:00:00", "same", None, None), (1, 6, "2018-08-02 11:00:00", "same", None, None),
    (1, 7, "2018-08-02 12:00:00", "reply", None, 3), (1, 8, "2018-08-02 12:00:01", "reply", None, 3),
    (2, 9, "2018-08-02 10:00:00", "rt", 50, None), (2, 10, "2018-08-02 10:00:10", "rt", 50, None),
]


@pytest.mark.parametrize("mode", ["unknown", "training"])
def test_assembly(spark, mode):
    table = assemble(spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint"),
                     timeline_posts(spark, ROWS), mode)
    rows = {r.user_id: r for r in table.collect()}
    assert len(rows) == 3
    assert (rows[1].total_tweets, rows[1].duplicates, rows[1].max_daily_duplicates) == (8, 3, 2)
    assert rows[1].avg_distinct_hours_tweeted == 3.0
    assert (rows[1].unique_users_retweeted, rows[2].unique_users_retweeted) == (None, 1)
    assert (rows[2].perc_retweets, rows[2].duplicates) == (1.0, None)
    assert rows[3].total_tweets is None
    gap = rows[2].avg_time_from_previous_tweet
    assert gap == (10.0 if mode == "training" else None)


def test_both_modes_have_the_same_columns(spark):
    base = spark.createDataFrame([(1,)], "user_id bigint")
    tables = [assemble(base, timeline_posts(spark, ROWS), m) for m in A.MODES]
    assert sorted(tables[0].dtypes) == sorted(tables[1].dtypes)


def test_sketches_and_own_aggregates(spark):
    base = spark.createDataFrame([(2,)], "user_id bigint")
    row = assemble(base, timeline_posts(spark, ROWS), approx=True, extra=[
        lambda posts: posts.groupBy("user_id").agg(F.max("tweet_id").alias("last_id"))]).first()
    assert (row.unique_users_retweeted, row.last_id) == (1, 10)
