"""Long keys are cut into slices; results must not change."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acctsignal.model.metrics import auc, score_slice
from acctsignal.operators import followers as R
from acctsignal.operators.inversions import count_inversions
from acctsignal.operators import ordered as O
from acctsignal.operators import posts as P


@pytest.fixture(scope="module")
def posts(spark):
    """A third of all posts are one account's, many of them in one second."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        user = 7 if i % 3 == 0 else rng.randrange(40)
        ts = None if rng.random() < 0.02 else 1000 if user == 7 and rng.random() < 0.4 else rng.randrange(5000)
        place = (rng.uniform(-80, 80), rng.uniform(-170, 170)) if rng.random() < 0.6 else (None, None)
        rows.append((user, i, ts, *place))
    return spark.createDataFrame(
        rows, "user_id bigint, tweet_id bigint, tweet_ts_long bigint, latitude double, longitude double").cache()


def with_copies(posts):
    """A third of the long account's posts again, and one post a hundred times."""
    one = posts.where("tweet_id = 300").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("n")
    return posts.union(posts.where("user_id = 7 and tweet_id % 2 = 0")).union(one)


def without_account(posts):
    """The long key is NULL."""
    return posts.withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))


def plain_previous(rows, compat):
    """(tweet_id, previous time, gap) of every post, account by account."""
    found = []
    for user in {r.user_id for r in rows}:
        own = sorted((r for r in rows if r.user_id == user), key=lambda r: (r.tweet_ts_long is not None, r.tweet_ts_long or 0, r.tweet_id))
        for i, r in enumerate(own):
            before = own[i - 1].tweet_ts_long if i else 0 if compat else None
            gap = None if before is None or r.tweet_ts_long is None else r.tweet_ts_long - before
            found.append((r.tweet_id, before, gap))
    return sorted(found, key=repr)


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("change", [lambda p: p, with_copies, without_account])
@pytest.mark.parametrize("width", [70, 604_800])
def test_previous_post(posts, compat, change, width):
    changed = change(posts)
    got = P.sequence_features(changed, compat, width).select(
        "tweet_id", "previous_tweet_ts_long", "time_from_previous_tweet").collect()
    assert sorted(map(tuple, got), key=repr) == plain_previous(changed.collect(), compat)


def test_previous_position_crosses_slices(posts):
    columns = ["tweet_id", "previous_tweet_latitude", "previous_tweet_longitude", "dist_from_previous_tweet"]
    one, many = (P.sequence_features(posts, width=w).select(columns).collect() for w in (10**9, 70))
    assert sorted(one, key=repr) == sorted(many, key=repr)


def test_mean_distance_with_copies(posts):
    copied = with_copies(posts)
    plain = {r[0]: r[1] for r in P.mean_distance(copied, width=10**9).collect()}
    cut = {r[0]: r[1] for r in P.mean_distance(copied, width=70).collect()}
    assert plain.keys() == cut.keys()
    for user, value in plain.items():
        assert cut[user] == (None if value is None else pytest.approx(value))


def test_a_long_timeline_is_in_many_tasks(spark, posts):
    """No window has all rows of an account, and planning runs no job."""
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    df = P.sequence_features(posts.drop("latitude").withColumn("latitude", F.lit(0.0)), width=70)
    text = df._jdf.queryExecution().toString()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    assert "SortMergeJoin" in text or "BroadcastHashJoin" in text
    sizes = posts.where("user_id = 7").groupBy(O.time_slice(F.col("tweet_ts_long"), 70)).count()
    assert sizes.count() > 40


@pytest.mark.parametrize("buckets", [4, 65_536])
@pytest.mark.parametrize("k", [1, 5, 30, 400, 25_000])
def test_first_per_key(posts, monkeypatch, buckets, k):
    monkeypatch.setattr(O, "BUCKETS", buckets)
    rows = posts.where("user_id is not null").withColumn("at", F.expr("tweet_id * tweet_id * 1000003"))
    got = O.first_per_key(rows, ["user_id"], "at", k)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("at"))
    expected = rows.withColumn("r", rank).where(F.col("r") <= k)
    assert got.columns == rows.columns
    assert sorted(r.tweet_id for r in got.collect()) == sorted(r.tweet_id for r in expected.collect())
    assert "Sort " not in got.drop("at")._jdf.queryExecution().optimizedPlan().toString()


def plain_inversions(rows, value):
    found = {}
    for user in {r.user_id for r in rows if r.user_id is not None}:
        own = sorted((r for r in rows if r.user_id == user),
                     key=lambda r: (r.tweet_ts_long is not None, r.tweet_ts_long or 0, r.tweet_id, value(r) is not None, value(r) or 0))
        values = [value(r) for r in own if value(r) is not None]
        found[user] = sum(a > b for i, a in enumerate(values) for b in values[i + 1:])
    return found


@pytest.mark.parametrize("width", [70, 604_800])
@pytest.mark.parametrize("change", [lambda p: p, with_copies, without_account])
def test_inversions_of_whole_timelines(posts, width, change):
    """One account has a third of all posts; equal values are no inversion, posts without one are in no pair."""
    rows = change(posts).withColumn("at", F.expr("case when tweet_id % 11 > 0 then (tweet_id * 7919) % 97 - 40 end"))
    got = {r.user_id: r.inversions for r in count_inversions(rows, "user_id", P.POST_ORDER, F.col("at"), width).collect()}
    assert got == plain_inversions(rows.collect(), lambda r: r.at)
    assert max(got.values()) > 400


def test_inversions_edge_cases(spark):
    schema = "user_id long, tweet_ts_long long, tweet_id long, at long"
    assert count_inversions(spark.createDataFrame([], schema), "user_id", P.POST_ORDER, F.col("at")).isEmpty()
    rows = [(1, 5, 1, 9), (2, 5, 1, 9), (2, 5, 2, 8), (3, None, 1, 9), (3, 1, 2, 8), (4, 1, 1, None), (None, 1, 1, 1), (None, 1, 2, 0),
            (5, 1, 1, -(1 << 40)), (5, 0, 1, 1 << 40)]
    found = count_inversions(spark.createDataFrame(rows, schema), "user_id", P.POST_ORDER, F.col("at"))
    assert {r.user_id: r.inversions for r in found.collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_inversions_are_dealt_out_by_rows(posts):
    """The partitions follow the number of rows, not what a shuffle makes of their bytes."""
    rows = posts.withColumn("at", F.expr("(tweet_id * 7919) % 97"))
    few = count_inversions(rows, "user_id", P.POST_ORDER, F.col("at"), 70)
    many = count_inversions(rows, "user_id", P.POST_ORDER, F.col("at"), 70, rows_per_task=40)
    text = many._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in text and ", 38" in text  # 1,500 rows
    assert sorted(few.collect()) == sorted(many.collect())
    assert {r.user_id: r.inversions for r in many.collect()} == plain_inversions(rows.collect(), lambda r: r.at)


def test_running_sum(posts):
    rows = posts.withColumn("slice", F.expr("tweet_id div 100"))
    got = O.add_running_sum(rows, ["user_id"], "slice", ["tweet_id"], F.lit(1), "n")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("tweet_id")) - 1
    wrong = got.withColumn("r", rank).where("n <> r")
    assert wrong.isEmpty()


def test_mean_gaps_need_no_order(posts):
    """The closed form against the means over ordered posts, undated posts included."""
    for compat in (False, True):
        closed = posts.groupBy("user_id").agg(*P.mean_gaps(compat)).orderBy("user_id").collect()
        ordered = P.sequence_features(posts, compat).groupBy("user_id").agg(
            F.avg("time_from_previous_tweet"), F.avg("previous_tweet_ts_long")).orderBy("user_id").collect()
        for a, b in zip(closed, ordered):
            assert a[0] == b[0]
            assert [a[1], a[2]] == [None if v is None else pytest.approx(v) for v in (b[1], b[2])]


def test_auc_over_slices(spark):
    rng = random.Random(5)
    rows = [(t, rng.randrange(2), rng.randrange(60) / 60) for t in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "task string, label int, score double")
    df = df.withColumn("score", F.when(F.col("score") < 0.2, F.pow("score", F.lit(9))).when(
        F.col("score") > 0.8, 1 - F.pow(1 - F.col("score"), F.lit(5))).otherwise(F.col("score")))
    rows = df.collect()
    assert df.select(score_slice(F.col("score"))).distinct().count() > 40
    got = {r[0]: r[1] for r in auc(df, ["task"]).collect()}
    for task in ("a", "b"):
        yes = [s for t, label, s in rows if t == task and label]
        no = [s for t, label, s in rows if t == task and not label]
        wins = sum((p > n) + 0.5 * (p == n) for p in yes for n in no)
        assert got[task] == pytest.approx(wins / len(yes) / len(no))


# ---- follower lists ------------------------------------------------------------------------

def brute_runs(days):
    runs = []
    for position, day in enumerate(days, 1):
        if runs and day is not None and runs[-1][3] == day:
            runs[-1][1] = position
        else:
            runs.append([position, position, 0, day])
    return [(s, e, e - s + 1, d) for s, e, _, d in runs]


def brute_blocks(runs, threshold, gap=5):
    blocks = []
    for start, end, length, _ in runs:
        if length > threshold:
            if blocks and start - blocks[-1][1] < gap:
                blocks[-1][1] = end
            else:
                blocks.append([start, end])
    return [tuple(b) for b in blocks]


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(9)
    result = {}
    for target in range(4):
        days = []
        while len(days) < 900:
            if rng.random() < 0.02:
                for _ in range(rng.randrange(1, 4)):
                    days += [rng.randrange(10_000, 20_000)] * rng.randrange(20, 120)
                    days += [rng.randrange(99) for _ in range(rng.randrange(5))]
            else:
                days.append(None if rng.random() < 0.05 else rng.randrange(30))
        result[target] = days
    result[9] = [5] * 700  # one run only: no threshold, no block
    return result


@pytest.mark.parametrize("chunk", [7, 50, 1_000_000])
def test_follower_blocks(spark, lists, chunk):
    rows = [(t, i, d) for t, days in lists.items() for i, d in enumerate(days, 1)]
    df = spark.createDataFrame(rows, "target bigint, position bigint, created_day bigint")
    runs = R.follower_runs(df, chunk).cache()
    thresholds = {r.target: r.threshold for r in R.run_thresholds(runs).collect()}
    blocks = R.find_fake_followers(df, chunk=chunk).collect()
    assert thresholds[9] is None
    for target, days in lists.items():
        expected = brute_runs(days)
        got = sorted((r.start_position, r.end_position, r.length, r.created_day)
                     for r in runs.where(F.col("target") == target).collect())
        assert got == expected
        assert sum(r[2] for r in got) == len(days)
        found = sorted((b.start_position, b.end_position) for b in blocks if b.target == target)
        limit = thresholds[target]
        assert found == ([] if limit is None else brute_blocks(expected, limit))
    assert any(b.target != 9 for b in blocks)


def test_whole_feature_table_with_long_accounts(spark, sf_dir):
    from acctsignal.catalog.post_queries import assembled, rounded_features

    plain = rounded_features(assembled(spark, sf_dir)).collect()
    cut = rounded_features(assembled(spark, sf_dir, width=20)).collect()
    assert sorted(plain, key=repr) == sorted(cut, key=repr)
