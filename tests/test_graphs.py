import random

import pytest
from pyspark.sql import functions as F

from acctsignal.operators import amplification as M
from acctsignal.operators import graph as G
from acctsignal.operators import worklist as W


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    return sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b})


@pytest.fixture(scope="module")
def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source_id bigint, target_id bigint").cache()


def crawl(pairs, root, degree, cap):
    """The walk with queues and sets."""
    distance, met, queue = {root: 0}, set(), [root]
    while queue:
        account = queue.pop(0)
        if distance[account] > degree:
            continue
        friends = sorted(b for a, b in pairs if a == account)[:cap]
        followers = sorted(a for a, b in pairs if b == account)[:cap]
        met |= {(account, b) for b in friends} | {(a, account) for a in followers}
        for other in friends + followers:
            if other not in distance:
                distance[other] = distance[account] + 1
                queue.append(other)
    return distance, met


@pytest.mark.parametrize("degree", [0, 1, 3])
@pytest.mark.parametrize("cap", [2, 1000])
@pytest.mark.parametrize("root_only", [False, True])
def test_ego_network(edges, pairs, degree, cap, root_only):
    if root_only and degree == 3:
        pytest.skip("one degree is enough here")
    distance, met = crawl(pairs, 5, degree, cap)
    if root_only:
        distance = {k: v for k, v in distance.items() if v <= 1}
        met = {e for e in met if e[0] in distance and e[1] in distance}
    network = G.ego_network(edges, 5, degree, cap, root_only)
    assert {r.id: r.distance for r in network.nodes.collect()} == distance
    assert sorted(tuple(r) for r in network.edges.collect()) == sorted(met)


def test_unknown_root_is_alone(edges):
    network = G.ego_network(edges, 999)
    assert [tuple(r) for r in network.nodes.collect()] == [(999, 0)]
    assert network.edges.isEmpty()


def test_first_seen(spark):
    seen = spark.createDataFrame([(1, 2, 9), (1, 2, 3), (2, 1, 5)], "source_id int, target_id int, created_date int")
    assert sorted(tuple(r) for r in G.unique_edges(seen).collect()) == [(1, 2, 3), (2, 1, 5)]
    nodes = spark.createDataFrame([(1, "new", 9), (1, "old", 3)], "id int, screen_name string, created_date int")
    assert [tuple(r) for r in G.unique_nodes(nodes).collect()] == [(1, "old", 3)]


def test_export_escapes_and_keeps_id_spaces_apart(spark):
    nodes = spark.createDataFrame([(1, '<a&"b">')], "id int, screen_name string").withColumn(
        "created_date", F.lit("2018-08-05 01:02:03").cast("timestamp"))
    account, status = (G.export_nodes(nodes, kind).first() for kind in ("account", "status"))
    assert account.id == "account-1" and status.id == "status-1"
    assert account.element == (
        '<node id="account-1" label="&lt;a&amp;&quot;b&quot;&gt;" start="2018-08-05T01:02:03"/>')
    edge = G.export_edges(spark.createDataFrame([(1, 2)], "a int, b int"), ("account", "a"), ("status", "b"),
                          start=None).first()
    assert edge.element == '<edge id="account-1&gt;status-2" source="account-1" target="status-2"/>'


@pytest.mark.parametrize("cap", [3, None])
@pytest.mark.parametrize("per_record", [2, 1000])
def test_adjacency_records(spark, edges, pairs, tmp_path, cap, per_record):
    accounts = spark.createDataFrame([(i, f"n{i}") for i in range(60)] + [(77, "alone")], "id bigint, screen_name string")
    crawled = spark.createDataFrame([(5,), (6,), (77,), (5,)], "id bigint")
    G.write_records(G.adjacency_records(edges, accounts, crawled, cap, per_record), str(tmp_path / "records"))
    records = G.read_records(spark, str(tmp_path / "records"), accounts)
    assert {r.id: r.screen_name for r in records.where("chunk = 0").collect()} == {5: "n5", 6: "n6", 77: "alone"}
    assert records.select("id", "chunk").distinct().count() == records.count()
    got = sorted((r.id, r.direction, r.other, r.profile.screen_name) for r in G.joined_records(records).collect())
    expected = []
    for account in (5, 6):
        expected += [(account, "friend", b, f"n{b}") for b in sorted(b for a, b in pairs if a == account)[:cap]]
        expected += [(account, "follower", a, f"n{a}") for a in sorted(a for a, b in pairs if b == account)[:cap]]
    assert got == sorted(expected)
    if per_record == 2 and not cap:
        assert records.count() > 4


@pytest.mark.parametrize("buckets, chunk", [(1, 1_000_000), (8, 3), (16, 1)])
def test_walk_over_chunked_hubs(edges, pairs, buckets, chunk):
    graph = G.Adjacency(edges, rows_per_chunk=chunk, buckets=buckets)
    for root, degree in ((5, 1), (9, 2)):
        distance, met = crawl(pairs, root, degree, 1000)
        network = G.ego_network(graph, root, degree)
        assert {r.id: r.distance for r in network.nodes.collect()} == distance
        assert sorted(tuple(r) for r in network.edges.collect()) == sorted(met)


def test_a_hop_shuffles_only_its_frontier(spark, edges):
    graph = G.Adjacency(edges, rows_per_chunk=3, buckets=8)
    frontier = spark.createDataFrame([(5,), (6,)], "id bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.of(frontier)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = plan.index("SortMergeJoin")
    table = plan[top:].split(":- ", 1)[1].split("+- Sort [id#")[0]
    assert "Bucketed: true" in plan and "acctsignal_adjacency" in table
    assert "Exchange" not in table


# ---- retweets ----------------------------------------------------------------------------------

SCHEMA = ("user_id bigint, tweet_id bigint, tweet_ts_long bigint, retweeted_status_id bigint, "
          "retweet_ts_long bigint, rt_retweet_count bigint, rt_favorite_count bigint, rt_text string")


def bot_posts(user, first_id, statuses, text="news", retweets=500, likes=3, count=40):
    """Retweets whose originals come in the reverse order."""
    return [(user, first_id + i, 10_000 + i, statuses[i % len(statuses)], 9_000 - i, retweets, likes, text)
            for i in range(count)]


def own_posts(user, first_id, count):
    return [(user, first_id + i, 20_000 + i, None, None, None, None, None) for i in range(count)]


def test_bot_test(spark):
    rows = [
        *bot_posts(1, 0, [100]),
        *bot_posts(2, 1000, [100]), *own_posts(2, 1500, 10),     # posts of its own
        *bot_posts(3, 2000, [100], retweets=49),                 # not amplified enough
        *bot_posts(4, 3000, [100], likes=101),                   # too many likes
        *bot_posts(5, 4000, [100], count=14),                    # 91 inversions
        *own_posts(6, 5000, 300),                                # no retweets
        *bot_posts(7, 6000, [100], retweets=50, likes=0),        # no likes at all
    ]
    got = {r.user_id: r for r in M.retweet_bots(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 7}
    assert (got[1].posts, got[1].retweets, got[1].amplified, got[1].inversions) == (40, 40, 40, 780)


def test_only_the_newest_200_count(spark):
    rows = [*own_posts(1, 0, 500), *[(u, i + 9000, t + 90_000, s, r, a, f, x)
                                      for u, i, t, s, r, a, f, x in bot_posts(1, 0, [100], count=200)]]
    posts = spark.createDataFrame(rows, SCHEMA)
    row = M.retweet_bots(posts, limit=200).first()
    assert (row.posts, row.retweets) == (200, 200)
    assert M.retweet_bots(posts).isEmpty()  # the whole timeline is no bot's


@pytest.mark.parametrize("limit", [None, 200])
def test_bot_test_of_whole_and_cut_timelines(spark, limit):
    rows = [*bot_posts(1, 0, [100]), *own_posts(2, 5000, 300), *bot_posts(3, 4000, [100], count=14)]
    row, = M.retweet_bots(spark.createDataFrame(rows, SCHEMA), limit).collect()
    assert (row.user_id, row.posts, row.retweets, row.amplified, row.inversions) == (1, 40, 40, 40, 780)


@pytest.fixture(scope="module")
def chain(spark):
    """Bots 1 → 2 → 3 linked over statuses; 4 shares a status but is no bot."""
    rows = [
        *bot_posts(1, 0, [100, 101]), *bot_posts(2, 1000, [101, 102]), *bot_posts(3, 2000, [102, 103]),
        *own_posts(4, 3000, 50), (4, 4000, 30_000, 101, 5, 500, 3, "news"),
        *bot_posts(9, 5000, [900]),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_amplification_graph(chain):
    graph = M.amplification_graph(chain, seed=1)
    assert {r.user_id: r.hop for r in graph.accounts.collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.status_id: r.hop for r in graph.statuses.collect()} == {100: 0, 101: 0, 102: 1, 103: 2}
    assert {(r.user_id, r.status_id) for r in graph.edges.collect()} == {
        (1, 100), (1, 101), (2, 101), (2, 102), (3, 102), (3, 103)}


def test_hop_limit_and_seed_that_is_no_bot(chain):
    assert {r.user_id for r in M.amplification_graph(chain, 1, max_hops=1).accounts.collect()} == {1, 2}
    assert {r.user_id for r in M.amplification_graph(chain, 4).accounts.collect()} == {1, 2, 3}
    assert M.amplification_graph(chain, 12345).edges.isEmpty()


def test_begging_posts(spark):
    df = spark.createDataFrame([("Please LIKE",), ("Retweet this",), ("news",)], "t string")
    got = [tuple(r) for r in df.select(M.asks_for_shares(F.col("t")), M.asks_for_shares(F.col("t"), True)).collect()]
    assert got == [(True, True), (True, False), (False, False)]


# ---- work list ---------------------------------------------------------------------------------

def test_unknown_flags_are_not_eligible(spark):
    rows = [(1, False, "en", False, 10), (2, None, "en", False, 10), (3, False, None, False, 10),
            (4, False, "en", None, 10), (5, False, "en", False, 9), (6, True, "en", False, 99)]
    df = spark.createDataFrame(rows, "id int, protected boolean, language string, fetched_tweets boolean, tweet_count int")
    assert [r.id for r in W.eligible(df).collect()] == [1]


def test_mentions_in_order_without_author_and_repeats(spark):
    df = spark.createDataFrame([("1", "2", ["3", "1", "2", "3", None, ""]), ("1", "1", None), ("1", None, ["4"])],
                               "author string, reply string, mentions array<string>")
    got = [r[0] for r in df.select(W.mentioned_ids(*[F.col(c) for c in df.columns])).collect()]
    assert got == [["2", "3"], [], ["4"]]


@pytest.mark.parametrize("first, end", [(0, 1000), (50, 333)])
def test_id_sample(spark, first, end):
    ids = [r.id for r in W.sample_ids(spark, first, end, 5).collect()]
    assert len(ids) == len(set(ids)) and all(first <= i < end for i in ids)
    blocks = [(i - first) // 100 for i in ids]
    assert all(blocks.count(b) == 5 for b in set(blocks)) and len(set(blocks)) == -(-(end - first) // 100)
    assert ids == [r.id for r in W.sample_ids(spark, first, end, 5).collect()]
    assert W.sample_ids(spark, first, end).count() == end - first

