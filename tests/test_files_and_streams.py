import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from acctsignal import schemas, session, sources
from acctsignal.catalog import collect_queries
from acctsignal.catalog.raw import messages
from acctsignal.plans import extract as X
from acctsignal.streaming import collect as C


def test_append_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "records")
    for i in range(2):
        sources.append_records(spark.range(3).withColumn("run", F.lit(i)), path)
    assert spark.read.json(path).count() == 6
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "records").iterdir() if p.name.startswith("part"))


def test_training_mode_from_files(spark, tmp_path):
    (tmp_path / "accounts.csv").write_text(
        "screen_name,id,statuses_count,favourites_count,followers_count,friends_count,listed_count,protected,"
        "verified,geo_enabled,default_profile,lang,timestamp,updated\n"
        "bot1,1,10,20,30,0,5,,1,,1,en,2018-01-01 00:00:00,2018-01-11 10:00:00\n"
        "x,2,10,20,30,3,5,,,,,en,2018-01-01 00:00:00,bad\n")
    spark.createDataFrame(
        [(i, "1", bytearray(f"Wed Aug 01 13:0{i}:00 +0000 2018".encode()), bytearray(b"t"), bytearray(b"s"),
          1, 1, 1, 0, 2, None, None) for i in range(4)],
        "id bigint, user_id string, created_at binary, text binary, source binary, retweet_count bigint, "
        "favorite_count bigint, num_mentions int, num_urls int, num_hashtags int, retweeted_status_id bigint, "
        "in_reply_to_user_id bigint").write.parquet(str(tmp_path / "posts"))
    X.run(spark, str(tmp_path / "accounts.csv"), str(tmp_path / "posts"), str(tmp_path / "out"), "training")
    rows = {r.user_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows[1].account_age_days, rows[1].tweet_rate, rows[1].is_verified, rows[1].is_protected) == (10, 1.0, 1, 0)
    assert (rows[1].total_tweets, rows[1].avg_time_from_previous_tweet, rows[1].num_tweets_hashtags) == (4, 60.0, 8)
    assert (rows[2].account_age_days, rows[2].tweet_rate, rows[2].total_tweets) == (None, 0.0, None)
    assert "updated_at_ts" not in rows[1]


def test_follower_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("target,position,created_date\n1,1,2018-01-01\n1,2,\n")
    rows = sources.read_followers(spark, str(tmp_path / "f.csv")).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "2018-01-01"), (1, 2, None)]


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "s3a://bucket/tmp"}
    assert session.new_shared_path(Session(), "x").startswith("s3a://bucket/tmp/acctsignal/x-")


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    messages(spark, sf_dir).repartition(4).write.mode("overwrite").json(path)
    return path


def test_stream_equals_batch(spark, feed, tmp_path):
    store = C.AccountStore(spark, str(tmp_path / "store"))
    stream = C.read_post_stream(spark, feed, files_per_batch=1)
    query = C.collect_accounts(stream, store, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    batch = C.authors(C.tracked(sources.read_posts(spark, feed))).select("id").distinct()
    assert sum(p.observedMetrics["progress"].posts for p in query.recentProgress if p.observedMetrics) == (
        C.tracked(sources.read_posts(spark, feed)).count())
    work = store.work_list()
    assert len(list((tmp_path / "store" / "work").glob("batch=*"))) == 4
    assert work.count() == batch.count() == work.select("id").distinct().count()
    assert store.all_records().where("_tbsource = 'stream'").count() == batch.count()
    assert work.where("created_date is null or found_date is null").isEmpty()
    # nothing new, nothing stored
    C.collect_accounts(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.work_list().count() == batch.count()


def test_batches_remember_in_state_not_in_the_store(spark, feed, tmp_path):
    """A store emptied between two batches is not read: the accounts do not come again. A lost one is an error."""
    import shutil

    store, checkpoint = C.AccountStore(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    stream = C.read_post_stream(spark, feed)
    C.collect_accounts(stream, store, checkpoint, trigger={"once": True}).awaitTermination()
    first = store.work_list().count()
    assert first > 0
    extra = tmp_path / "more"
    messages_again = spark.read.schema(schemas.post()).json(feed)
    messages_again.write.json(str(extra))
    for part in extra.glob("part-*"):
        shutil.copy(part, f"{feed}/again-{part.name}")
    C.collect_accounts(stream, store, checkpoint).awaitTermination()
    assert store.work_list().count() == first
    shutil.move(store.records, str(tmp_path / "elsewhere"))
    with pytest.raises(RuntimeError, match="finished batches"):
        C.collect_accounts(stream, store, checkpoint)


def test_first_sighting_is_the_earliest(spark, tmp_path):
    rows = [(1, "late", 9, 5), (1, "early", 3, 7), (1, "early, smaller post", 3, 6), (2, "only", 1, 1)]
    schema = "id bigint, record string, at bigint, post bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    C.append_stream(C.first_sightings(source), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    expected = {1: "early, smaller post", 2: "only"}
    assert {r.id: r.record for r in spark.read.json(str(tmp_path / "out")).collect()} == expected


def test_forgotten_accounts_come_again(spark, tmp_path):
    schema = "id bigint, record string, at bigint, post bigint"
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    spark.createDataFrame([(1, "first", 1, 1), (2, "first", 1, 2)], schema).coalesce(1).write.json(folder)
    stream = C.first_sightings(spark.readStream.schema(schema).json(folder), forget_after=1)
    query = C.append_stream(stream, out, str(tmp_path / "checkpoint"), trigger={"processingTime": "1 second"})
    try:
        query.awaitTermination(20)
        spark.createDataFrame([(1, "again", 2, 3)], schema).coalesce(1).write.mode("append").json(folder)
        query.awaitTermination(15)
    finally:
        query.stop()
    assert sorted((r.id, r.record) for r in spark.read.json(out).collect()) == [(1, "again"), (1, "first"), (2, "first")]
    with pytest.raises(ValueError, match="trigger"):
        C.collect_accounts(None, C.AccountStore(spark, out), out, forget_after=5)


def test_repeated_batch_counts_once(spark, tmp_path):
    store = C.AccountStore(spark, str(tmp_path))
    accounts = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    for batch in (0, 0, 1):
        store.add(accounts, batch)
    assert sorted(r.id for r in store.work_list().collect()) == [1, 2]
    store.mark_fetched(spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in store.fetched_ids().collect()] == [1]


def test_empty_store(spark, tmp_path):
    store = C.AccountStore(spark, str(tmp_path / "none"))
    assert store.work_list().isEmpty() and store.fetched_ids().isEmpty() and store.all_records().isEmpty()


def test_keyword_and_non_posts(spark, feed):
    rows = sources.read_posts(spark, feed)
    assert C.tracked(rows).count() == rows.where("user is not null").count() < rows.count()
    assert C.tracked(rows, "T3").count() == rows.where("user is not null and text = 't3'").count() > 0


def test_bounded_state(spark, feed, tmp_path):
    posts = C.read_post_stream(spark, feed).selectExpr("user.id as id", "timestamp_seconds(1) as at")
    query = C.append_stream(C.once(posts.where("id is not null"), "id", "at", "1 hour"), str(tmp_path / "out"),
                            str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = spark.read.schema("id bigint").json(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() > 0


def test_post_schema_is_complete(spark):
    assert set(schemas.account().names) - {"_tbsource"} <= set(schemas.post()["user"].dataType.names)


def test_message_files_follow_the_posts(spark, tmp_path, monkeypatch):
    """More posts are more files, each one task's; the stream returns the same."""
    spark.range(300).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 40 as user_id", "'view' as event_type",
        """concat('{"k": ', id * 7 % 100, '}') as props""").write.parquet(f"{tmp_path}/events.parquet")
    few = E.queries()["stream_mentions"](spark, str(tmp_path)).collect()
    monkeypatch.setattr(collect_queries, "POSTS_PER_FILE", 30, raising=False)
    found = collect_queries._message_files(spark, str(tmp_path))
    path = found if isinstance(found, str) else found[0]
    lines = spark.read.text(path).groupBy(F.input_file_name()).count().collect()
    assert len(lines) == 11 and sum(r["count"] for r in lines) == 300
    assert sorted(E.queries()["stream_mentions"](spark, str(tmp_path)).collect()) == sorted(few)


@pytest.mark.parametrize("name", ["stream_accounts", "stream_hydration"])
def test_more_posts_are_more_files(spark, tmp_path, monkeypatch, name):
    """No task writes more message posts as their number grows; the query finds the same accounts."""
    spark.range(300).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 40 as user_id", "'view' as event_type",
        """concat('{"k": ', id * 7 % 100, '}') as props""").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(120).selectExpr(
        "id as c_custkey", "concat('c', id) as c_name", "id % 25 as c_nationkey", "'m' as c_mktsegment",
    ).write.parquet(f"{tmp_path}/customer.parquet")
    few = E.queries()[name](spark, str(tmp_path)).collect()
    paths = {}
    monkeypatch.setattr(collect_queries, "POSTS_PER_FILE", 30, raising=False)
    monkeypatch.setattr(collect_queries, "new_shared_path",
                        lambda spark, what: paths.setdefault(what, session.new_shared_path(spark, what)))
    many = E.queries()[name](spark, str(tmp_path)).collect()
    lines = spark.read.text(paths["messages"]).groupBy(F.input_file_name()).count().collect()
    assert len(lines) == 11 and sum(r["count"] for r in lines) == 300
    assert max(r["count"] for r in lines) < 300 / 5
    assert few and sorted(many) == sorted(few)
    if "store" in paths:
        assert spark.read.parquet(f"{paths['store']}/work").select("batch").distinct().count() == 2


@pytest.mark.parametrize("name", ["stream_accounts", "stream_hydration"])
@pytest.mark.parametrize("event_id", ["cast(null as bigint)", "7L", "if(id % 3 = 0, id, null)"])
def test_files_do_not_follow_the_ids(spark, tmp_path, monkeypatch, name, event_id):
    """Posts that share an id or have none are many tasks' as well."""
    spark.range(300).selectExpr(
        f"{event_id} as event_id", "timestamp_seconds(1700000000 + id * 60) as ts", "id % 40 as user_id",
        "'view' as event_type", """concat('{"k": ', id * 7 % 100, '}') as props""").write.parquet(
            f"{tmp_path}/events.parquet")
    spark.range(120).selectExpr(
        "id as c_custkey", "concat('c', id) as c_name", "id % 25 as c_nationkey", "'m' as c_mktsegment",
    ).write.parquet(f"{tmp_path}/customer.parquet")
    few = E.queries()[name](spark, str(tmp_path)).collect()
    paths = {}
    monkeypatch.setattr(collect_queries, "POSTS_PER_FILE", 30)
    monkeypatch.setattr(collect_queries, "new_shared_path",
                        lambda spark, what: paths.setdefault(what, session.new_shared_path(spark, what)))
    many = E.queries()[name](spark, str(tmp_path)).collect()
    lines = spark.read.text(paths["messages"]).groupBy(F.input_file_name()).count().collect()
    assert len(lines) == 11 and sum(r["count"] for r in lines) == 300
    assert max(r["count"] for r in lines) < 300 / 5
    assert sorted(many) == sorted(few)


# ---- plans -------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["assembled_features", "account_features", "retweet_bots", "follower_runs",
                                  "nest_explode", "stratified_ids", "classifier_metrics"])
def test_core_plans_stay_in_the_jvm(spark, sf_dir, name):
    text = plan(E.queries()[name](spark, sf_dir))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name, exchanges", [
    ("mean_gaps", 1), ("entity_features", 1),
    # posts once; the last rows of slices, and these per account
    ("tweet_distance", 3),
    # per account and salt, then per account
    ("last_timeline", 2), ("retweet_bots", 2), ("inversions", 2), ("stratified_ids", 0), ("account_flags", 0), ("hours_tweeted", 2),
])
def test_shuffles(spark, sf_dir, name, exchanges):
    assert plan(E.queries()[name](spark, sf_dir)).count("Exchange hashpartitioning") == exchanges


def test_timelines_are_cut_before_the_shuffle(spark, sf_dir):
    text = plan(E.queries()["retweet_bots"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 4


def test_only_read_columns_are_scanned(spark, sf_dir):
    assert "ReadSchema: struct<user_id:bigint>" in plan(E.queries()["total_tweets"](spark, sf_dir))
