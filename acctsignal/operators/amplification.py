"""Retweet bots and the graph that links them.

Input: the flat post table with ``user_id, tweet_id, tweet_ts_long, retweeted_status_id,
retweet_ts_long, rt_retweet_count, rt_favorite_count, rt_text``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctsignal.functions import inversions
from acctsignal.operators.hops import HopTable
from acctsignal.operators.inversions import count_inversions
from acctsignal.operators.ordered import newest_per_key
from acctsignal.operators.posts import POST_ORDER
from acctsignal.session import materialize

# What counts as amplified, and as an account that amplifies.
MIN_RT_LIKE_RATIO = 5
MIN_RETWEETS = 50
MIN_RETWEET_SHARE = 0.9
MIN_AMPLIFIED_SHARE = 1 / 3
MIN_INVERSIONS = 100


def rt_like_ratio(retweets: Column, favorites: Column) -> Column:
    """Retweets per like; without likes, the retweets."""
    return F.when(favorites == 0, retweets.cast("double")).otherwise(
        F.try_divide(retweets.cast("double"), favorites.cast("double")))


def is_amplified() -> Column:
    ratio = rt_like_ratio(F.col("rt_retweet_count"), F.col("rt_favorite_count"))
    return (ratio >= MIN_RT_LIKE_RATIO) & (F.col("rt_retweet_count") >= MIN_RETWEETS)


def asks_for_shares(text: Column, compat: bool = False) -> Column:
    """The post itself begs for likes or, unless ``compat``, retweets."""
    lowered = F.lower(text)
    begs = lowered.contains("like")
    return begs if compat else begs | lowered.contains("retweet")


def timelines(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Every account's posts; the newest ``limit``, if given."""
    return posts if limit is None else newest_per_key(posts, ["user_id"], POST_ORDER, limit)


def is_worth_following(compat: bool = False) -> Column:
    """An amplified retweet whose text does not beg for it."""
    return (F.col("retweeted_status_id").isNotNull() & is_amplified()
            & ~asks_for_shares(F.col("rt_text"), compat))


def amplified_tweets(posts: DataFrame, compat: bool = False, limit: int | None = None) -> DataFrame:
    """Amplified retweets per account; ``priority`` 1 has the lowest retweet/like ratio.

    ``limit`` looks only at each account's newest posts, as many as a service may show.
    """
    ratio = rt_like_ratio(F.col("rt_retweet_count"), F.col("rt_favorite_count"))
    by_ratio = Window.partitionBy("user_id").orderBy("rt_like_ratio", "tweet_id")
    return (
        timelines(posts, limit).where(is_worth_following(compat))
        .withColumn("rt_like_ratio", ratio)
        .select("user_id", "tweet_id", "retweeted_status_id", "rt_like_ratio",
                F.row_number().over(by_ratio).alias("priority"))
    )


def original_time() -> Column:
    return F.coalesce("retweet_ts_long", "tweet_ts_long")


def _original_times() -> Column:
    """The original posts' times, from the oldest to the newest post of the timeline."""
    ordered = F.array_sort(F.collect_list(F.struct(*POST_ORDER, original_time().alias("at"))))
    return F.transform(ordered, lambda post: post["at"])


def timeline_inversions(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Per account, pairs of posts whose originals are in the opposite order.

    A timeline cut to its newest ``limit`` posts is short enough to be counted as an array; whole ones are counted bit
    by bit over many tasks.
    """
    if limit is None:
        return count_inversions(posts, "user_id", POST_ORDER, original_time())
    return (
        timelines(posts, limit).groupBy("user_id").agg(_original_times().alias("times"))
        .select("user_id", inversions(F.col("times")).cast("bigint").alias("inversions"))
    )


def _shares() -> list[Column]:
    is_retweet = F.col("retweeted_status_id").isNotNull()
    return [F.count("*").alias("posts"), F.count_if(is_retweet).alias("retweets"),
            F.count_if(is_retweet & is_amplified()).alias("amplified")]


def _tested(shares: DataFrame) -> DataFrame:
    """Whether the shares of retweets and of amplified ones are a bot's."""
    return shares.withColumns({
        "retweet_share": F.col("retweets") / F.col("posts"),
        "amplified_share": F.try_divide(F.col("amplified"), F.col("retweets")),
    }).withColumn("shares_pass", F.coalesce(
        (F.col("retweet_share") >= MIN_RETWEET_SHARE) & (F.col("amplified_share") >= MIN_AMPLIFIED_SHARE), F.lit(False)))


_BOT_COLUMNS = ["user_id", "posts", "retweets", "amplified", "retweet_share", "amplified_share", "inversions"]


def retweet_bots(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Accounts that mostly retweet, mostly amplified posts, in an unnatural order.

    The test was made for what the service shows of an account, its newest 200 posts: ``limit`` looks only at so many.
    Without it whole timelines are tested. The order is counted only where the cheap tests pass.
    """
    if limit is None:
        passing = _tested(posts.where("user_id is not null").groupBy("user_id").agg(*_shares())).where("shares_pass")
        orders = timeline_inversions(posts.join(passing.select("user_id"), "user_id", "left_semi"))
        scored = passing.join(orders, "user_id")
    else:
        scored = _tested(timelines(posts, limit).groupBy("user_id").agg(*_shares(), _original_times().alias("times")))
        scored = scored.withColumn("inversions", F.when(F.col("shares_pass"), inversions(F.col("times"))).cast("bigint"))
    return scored.where(F.col("inversions") >= MIN_INVERSIONS).select(*_BOT_COLUMNS)


def followed_statuses(posts: DataFrame, compat: bool = False, limit: int | None = None) -> DataFrame:
    """Distinct ``user_id, status_id`` of the amplified retweets in every account's timeline."""
    return (
        timelines(posts, limit).where(is_worth_following(compat))
        .select("user_id", F.col("retweeted_status_id").alias("status_id")).distinct()
    )


@dataclass(frozen=True)
class AmplificationGraph:
    """``accounts(user_id, hop)`` reached as bots, ``statuses(status_id, hop)`` seen on the way,
    ``edges(user_id, status_id, hop)`` from bot to status."""

    accounts: DataFrame
    statuses: DataFrame
    edges: DataFrame


def amplification_graph(posts: DataFrame, seed: int, max_hops: int | None = None,
                        compat: bool = False, limit: int | None = None) -> AmplificationGraph:
    """Walk from an account over its amplified retweets to the bots that share them.

    The bot test runs once for all accounts. A hop then joins tables of distinct pairs, and
    expands a status only the first time it is met, so no pair is joined twice. ``limit`` looks only at
    each account's newest posts.
    """
    spark = posts.sparkSession
    followed = materialize(followed_statuses(posts, compat, limit), "followed")
    bots = materialize(retweet_bots(posts, limit).select("user_id"), "bots")
    shared = materialize(
        posts.where("retweeted_status_id is not null")
        .select("user_id", F.col("retweeted_status_id").alias("status_id"))
        .join(bots, "user_id", "left_semi").distinct(), "shared-by-bots")

    reached = HopTable(spark, "reached", "user_id bigint")
    statuses = HopTable(spark, "statuses", "status_id bigint")
    edges = HopTable(spark, "amplification-edges", "user_id bigint, status_id bigint")
    frontier = reached.add(spark.createDataFrame([(seed,)], "user_id bigint"))
    hop = 0
    while max_hops is None or hop < max_hops:
        fresh = statuses.add(
            followed.join(frontier, "user_id", "left_semi").select("status_id").distinct()
            .join(statuses.all(), "status_id", "left_anti"))
        found = edges.add(shared.join(fresh, "status_id", "left_semi"))
        frontier = reached.add(
            found.select("user_id").distinct().join(reached.all(), "user_id", "left_anti"))
        hop += 1
        if frontier.isEmpty():
            break
    all_edges = edges.all()
    # the seed is a node only if it is found as a bot
    is_node = all_edges.select("user_id").distinct()
    return AmplificationGraph(
        reached.all().join(is_node, "user_id", "left_semi"), statuses.all(), all_edges)


def status_details(posts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Author and text of ``statuses(status_id)``, from the first post that retweeted each."""
    first = lambda c: F.min_by(c, F.struct(*POST_ORDER))
    return (
        posts.withColumnRenamed("retweeted_status_id", "status_id")
        .join(statuses.select("status_id"), "status_id", "left_semi")
        .groupBy("status_id")
        .agg(first("retweeted_status_user_id").alias("account_id"), first("rt_text").alias("text"))
    )


def reach_by_hop(graph: AmplificationGraph) -> DataFrame:
    """How many accounts each hop reached first."""
    return graph.accounts.groupBy("hop").agg(F.count("*").alias("accounts"))
