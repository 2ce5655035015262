"""Queries on follower lists, retweet bots and follow graphs."""

from pyspark.sql import functions as F

from acctsignal.catalog.account_queries import rounded
from acctsignal.catalog.registry import query
from acctsignal.catalog.views import oracle_cte, table, view
from acctsignal.operators import amplification as M
from acctsignal.operators import followers as R
from acctsignal.operators import graph as G
from acctsignal.operators.ingest import TIMELINE_LENGTH
from acctsignal.session import materialize, new_shared_path

TWEETS = oracle_cte("tweets")
EDGES = oracle_cte("edges")
FOLLOWERS = oracle_cte("followers")

# ---- follower lists --------------------------------------------------------------------------

_RUNS = """
  flagged as (
    select *, coalesce(created_day <> lag(created_day) over (partition by target order by position), true) as is_start
    from followers),
  numbered as (
    select *, sum(is_start::int) over (partition by target order by position) as run from flagged),
  runs as (
    select target, min(position) as start_position, max(position) as end_position, count(*) as length,
      min(created_day) as created_day
    from numbered group by target, run),
  thresholds as (
    select target, ceil(avg(length) + 3 * stddev_samp(length))::bigint as threshold from runs group by target),
  suspicious as (
    select runs.*, threshold from runs join thresholds using (target) where length > threshold),
  gaps as (
    select *, start_position - lag(end_position) over (partition by target order by start_position) as gap
    from suspicious),
  blocks as (
    select target, min(start_position) as start_position, max(end_position) as end_position from (
      select *, sum(coalesce(gap >= 5, true)::int) over (partition by target order by start_position) as block
      from gaps) group by target, block)"""


def _runs(spark, sf_dir):
    return R.follower_runs(view(spark, sf_dir, "followers"))


@query(f"{FOLLOWERS}, {_RUNS} select target, start_position, end_position, length, created_day from runs")
def follower_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


_HOLES = _RUNS.replace("from followers)", """from (
      select target, created_day, row_number() over (partition by target order by position) as position
      from followers where position % 17 <> 0))""")


@query(f"{FOLLOWERS}, {_HOLES} select target, start_position, end_position, length, created_day from runs")
def follower_runs_with_gaps(spark, sf_dir):
    """Lists that have lost every 17th entry: runs count the entries that are left."""
    left = view(spark, sf_dir, "followers").where("position % 17 <> 0")
    return R.follower_runs(left, 1000)


@query(f"{FOLLOWERS}, {_RUNS} select target, threshold from thresholds")
def run_thresholds(spark, sf_dir):
    return R.run_thresholds(_runs(spark, sf_dir))


@query(f"{FOLLOWERS}, {_RUNS} select target, start_position, end_position, length, threshold from suspicious")
def suspicious_runs(spark, sf_dir):
    return R.suspicious_runs(materialize(_runs(spark, sf_dir), "runs")).select(
        "target", "start_position", "end_position", "length", "threshold")


@query(f"{FOLLOWERS}, {_RUNS} select target, start_position, gap from gaps")
def run_gaps(spark, sf_dir):
    suspicious = materialize(R.suspicious_runs(materialize(_runs(spark, sf_dir), "runs")), "suspicious")
    return R.with_gaps(suspicious).select("target", "start_position", "gap")


@query(f"{FOLLOWERS}, {_RUNS} select target, start_position, end_position from blocks")
def fake_follower_blocks(spark, sf_dir):
    return R.find_fake_followers(view(spark, sf_dir, "followers"))


# ---- retweets ----------------------------------------------------------------------------------

_TIMELINES = """
  timelines as (
    select * from (
      select *, row_number() over (partition by user_id order by tweet_ts_long desc, tweet_id desc) as age from tweets)
    where age <= 200),
  scored as (
    select *, coalesce(retweet_ts_long, tweet_ts_long) as original_ts,
      case when rt_favorite_count = 0 then rt_retweet_count::double
           else rt_retweet_count::double / rt_favorite_count end as rt_like_ratio
    from timelines),
  flagged as (
    select *, retweeted_status_id is not null and rt_like_ratio >= 5 and rt_retweet_count >= 50 as is_amplified
    from scored),
  inverted as (
    select a.user_id, count(b.user_id) as inversions from flagged a
    left join flagged b on a.user_id = b.user_id and a.age > b.age and a.original_ts > b.original_ts
    group by a.user_id),
  shares as (
    select user_id, count(*) as posts, count(retweeted_status_id) as retweets,
      sum(coalesce(is_amplified, false)::int)::bigint as amplified from flagged group by user_id),
  bots as (
    select user_id, posts, retweets, amplified, retweets::double / posts as retweet_share,
      amplified::double / retweets as amplified_share, inversions
    from shares join inverted using (user_id)
    where retweets > 0 and retweets::double / posts >= 0.9 and amplified::double / retweets >= 1.0 / 3
      and inversions >= 100)"""


@query(f"""{TWEETS}, {_TIMELINES}
select user_id, tweet_id, retweeted_status_id, round(rt_like_ratio, 6) as rt_like_ratio,
  row_number() over (partition by user_id order by rt_like_ratio, tweet_id)::int as priority
from flagged where is_amplified and lower(rt_text) not like '%like%' and lower(rt_text) not like '%retweet%'""")
def amplified_tweets(spark, sf_dir):
    rows = M.amplified_tweets(view(spark, sf_dir, "tweets"), limit=TIMELINE_LENGTH)
    return rounded(rows, "rt_like_ratio")


_LONG = oracle_cte("long_tweets").replace("long_tweets as", "tweets as")
_WHOLE = _TIMELINES.replace("where age <= 200", "")
_AMPLIFIED_SQL = """select user_id, tweet_id, retweeted_status_id, round(rt_like_ratio, 6) as rt_like_ratio,
  row_number() over (partition by user_id order by rt_like_ratio, tweet_id)::int as priority
from flagged where is_amplified and lower(rt_text) not like '%like%' and lower(rt_text) not like '%retweet%'"""
_BOT_SQL = """select user_id, posts, retweets, amplified,
  round(retweet_share, 6) as retweet_share, round(amplified_share, 6) as amplified_share, inversions from bots"""


@query(f"{_LONG}, {_TIMELINES} {_AMPLIFIED_SQL}")
def amplified_tweets_newest(spark, sf_dir):
    """Accounts with more posts than the service shows: the newest 200 only."""
    rows = M.amplified_tweets(view(spark, sf_dir, "long_tweets"), limit=TIMELINE_LENGTH)
    return rounded(rows, "rt_like_ratio")


@query(f"{_LONG}, {_WHOLE} {_AMPLIFIED_SQL}")
def amplified_tweets_all(spark, sf_dir):
    return rounded(M.amplified_tweets(view(spark, sf_dir, "long_tweets")), "rt_like_ratio")


@query(f"{TWEETS}, {_TIMELINES} select user_id, inversions from inverted")
def inversions(spark, sf_dir):
    return M.timeline_inversions(view(spark, sf_dir, "tweets"), TIMELINE_LENGTH)


@query(f"{_LONG}, {_WHOLE} select user_id, inversions from inverted")
def inversions_all(spark, sf_dir):
    """Whole timelines of few accounts with many posts each."""
    return M.timeline_inversions(view(spark, sf_dir, "long_tweets"))


@query(f"{TWEETS}, {_TIMELINES} {_BOT_SQL}")
def retweet_bots(spark, sf_dir):
    rows = M.retweet_bots(view(spark, sf_dir, "tweets"), TIMELINE_LENGTH)
    return rounded(rows, "retweet_share", "amplified_share")


@query(f"{_LONG}, {_TIMELINES} {_BOT_SQL}")
def retweet_bots_newest(spark, sf_dir):
    rows = M.retweet_bots(view(spark, sf_dir, "long_tweets"), TIMELINE_LENGTH)
    return rounded(rows, "retweet_share", "amplified_share")


@query(f"{_LONG}, {_WHOLE} {_BOT_SQL}")
def retweet_bots_all(spark, sf_dir):
    return rounded(M.retweet_bots(view(spark, sf_dir, "long_tweets")), "retweet_share", "amplified_share")


# A walk from account 0; the recursion meets account/status pairs, first hops are taken after it.
_WALK = """
  worth as (
    select distinct user_id, retweeted_status_id as status_id from flagged
    where is_amplified and lower(rt_text) not like '%like%'),
  shared as (
    select distinct user_id, retweeted_status_id as status_id from tweets
    where retweeted_status_id is not null and user_id in (select user_id from bots)),
  walk(user_id, hop) as (
    select 0::bigint, 0
    union
    select s.user_id, w.hop + 1 from walk w
    join worth a on a.user_id = w.user_id join shared s on s.status_id = a.status_id
    where w.hop < 12),
  first_hop as (select user_id, min(hop) as hop from walk group by user_id),
  met as (
    select a.status_id, min(hop) as hop from first_hop join worth a using (user_id) group by a.status_id)"""

_RECURSIVE = TWEETS.replace("with ", "with recursive ", 1)


def _walk(spark, sf_dir):
    return M.amplification_graph(view(spark, sf_dir, "tweets"), seed=0, compat=True, limit=TIMELINE_LENGTH)


@query(f"""{_RECURSIVE}, {_TIMELINES}, {_WALK}
select s.user_id, s.status_id, met.hop::int as hop from met join shared s using (status_id)""")
def amplification_edges(spark, sf_dir):
    return _walk(spark, sf_dir).edges


@query(f"""{_LONG.replace("with ", "with recursive ", 1)}, {_WHOLE}, {_WALK}
select s.user_id, s.status_id, met.hop::int as hop from met join shared s using (status_id)""")
def amplification_edges_all(spark, sf_dir):
    """The walk over whole timelines."""
    return M.amplification_graph(view(spark, sf_dir, "long_tweets"), seed=0, compat=True).edges


@query(f"{_RECURSIVE}, {_TIMELINES}, {_WALK} select status_id, hop::int as hop from met")
def amplification_statuses(spark, sf_dir):
    return _walk(spark, sf_dir).statuses


@query(f"""{_RECURSIVE}, {_TIMELINES}, {_WALK}
select status_id, min(retweeted_status_user_id) as account_id, min(rt_text) as text
from met join tweets on retweeted_status_id = status_id group by status_id""")
def amplification_status_details(spark, sf_dir):
    return M.status_details(view(spark, sf_dir, "tweets"), _walk(spark, sf_dir).statuses)


@query(f"""{_RECURSIVE}, {_TIMELINES}, {_WALK}
select hop::int as hop, count(*) as accounts from first_hop
where user_id in (select s.user_id from shared s join met using (status_id)) group by hop""")
def amplification_reach(spark, sf_dir):
    return M.reach_by_hop(_walk(spark, sf_dir))


@query(f"""{_RECURSIVE}, {_TIMELINES}, {_WALK},
  pairs as (select distinct s.user_id, s.status_id from met join shared s using (status_id))
select 'status-' || status_id as id, 'status' as kind, 's' || status_id as label from met
union all select distinct 'account-' || user_id, 'account', 'a' || user_id from pairs""")
def amplification_export(spark, sf_dir):
    """Statuses, then accounts, in one node table."""
    graph = _walk(spark, sf_dir)
    at = F.lit("2018-08-05").cast("timestamp").alias("created_date")
    statuses = graph.statuses.select("status_id", F.expr("concat('s', status_id) as name"), at)
    accounts = graph.accounts.select("user_id", F.expr("concat('a', user_id) as name"), at)
    nodes = G.export_nodes(statuses, "status", key="status_id", label="name").unionByName(
        G.export_nodes(accounts, "account", key="user_id", label="name"))
    return nodes.select("id", "kind", "label")


# ---- follow graph ------------------------------------------------------------------------------

_ROOT, _DEGREE = 7, 1
_CAP = 20


def _ego_sql(cap, degree=_DEGREE):
    return f"""
  both_ways as (
    select source_id as id, 'friend' as direction, target_id as other from edges
    union all select target_id, 'follower', source_id from edges),
  connections as (
    select * from (
      select *, row_number() over (partition by id, direction order by other) as r from both_ways)
    where r <= {cap}),
  walk(id, distance) as (
    select {_ROOT}::bigint, 0
    union
    select c.other, w.distance + 1 from walk w join connections c on c.id = w.id where w.distance <= {degree}),
  nodes as (select id, min(distance)::int as distance from walk group by id),
  met as (
    select distinct case when direction = 'friend' then c.id else other end as source_id,
      case when direction = 'friend' then other else c.id end as target_id
    from connections c join nodes n on c.id = n.id and n.distance <= {degree})"""


_EDGES_RECURSIVE = EDGES.replace("with ", "with recursive ", 1)


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(25000, 0)} select id, distance from nodes")
def ego_network(spark, sf_dir):
    return G.ego_network(view(spark, sf_dir, "edges"), _ROOT, degree=0, max_connections=G.MAX_CONNECTIONS).nodes


_ALL = 1 << 40
_WALKED = """select id as a, null::bigint as b, distance from nodes
union all select source_id, target_id, null from met"""
_INNER = """where source_id in (select id from nodes where distance <= 1)
  and target_id in (select id from nodes where distance <= 1)"""


def _walked(network):
    """Nodes and edges in one table."""
    return network.nodes.selectExpr("id as a", "cast(null as bigint) as b", "distance").unionByName(
        network.edges.selectExpr("source_id as a", "target_id as b", "cast(null as int) as distance"))


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_ALL, 1)} {_WALKED}")
def ego_network_degree_1(spark, sf_dir):
    """All connections, no cap."""
    return _walked(G.ego_network(view(spark, sf_dir, "edges"), _ROOT, degree=1))


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_ALL, 2)} {_WALKED}")
def ego_network_degree_2(spark, sf_dir):
    return _walked(G.ego_network(view(spark, sf_dir, "edges"), _ROOT, degree=2))


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_CAP)} select source_id, target_id from met")
def ego_network_capped(spark, sf_dir):
    return G.ego_network(view(spark, sf_dir, "edges"), _ROOT, _DEGREE, max_connections=_CAP).edges


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_ALL, 1)} select source_id, target_id from met {_INNER}")
def root_connections(spark, sf_dir):
    return G.ego_network(view(spark, sf_dir, "edges"), _ROOT, 1, root_only=True).edges


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_ALL, 2)} select source_id, target_id from met {_INNER}")
def root_connections_degree_2(spark, sf_dir):
    return G.ego_network(view(spark, sf_dir, "edges"), _ROOT, 2, root_only=True).edges


@query(f"{_EDGES_RECURSIVE}, {_ego_sql(_CAP)} select source_id, target_id from met {_INNER}")
def root_connections_capped(spark, sf_dir):
    return G.ego_network(view(spark, sf_dir, "edges"), _ROOT, _DEGREE, max_connections=_CAP, root_only=True).edges


@query(f"""{EDGES} select id, direction, other from (
  select *, row_number() over (partition by id, direction order by other) as r from (
    select source_id as id, 'friend' as direction, target_id as other from edges
    union all select target_id, 'follower', source_id from edges)) where r <= {_CAP}""")
def capped_connections(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    everyone = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return G.connections(edges, everyone, _CAP)


_NAMED = oracle_cte("accounts", "edges")


_PROFILE = ["id", "screen_name", "lang", "followers_count", "friends_count", "favourites_count", "statuses_count",
            "listed_count", "protected", "verified", "age_days"]


@query(f"""{_NAMED},
  ends as (
    select source_id as id, 'friend' as direction, target_id as other from edges
    union all select target_id, 'follower', source_id from edges)
select e.id as account, direction, {', '.join(f'a.{c} as {c}' for c in _PROFILE)}
from ends e join accounts a on a.id = e.other join accounts o on o.id = e.id
union all select id, 'none', {', '.join(_PROFILE)} from accounts""")
def adjacency_records(spark, sf_dir):
    """Records of all accounts, in several chunks, written as gzip JSON, read back and put together; and their heads."""
    accounts = view(spark, sf_dir, "accounts").select(*_PROFILE)
    path = new_shared_path(spark, "adjacency-records")
    edges = materialize(view(spark, sf_dir, "edges"), "edges")
    G.write_records(G.adjacency_records(edges, accounts, accounts.select("id"), per_record=20), path)
    records = G.read_records(spark, path, accounts)
    rows = G.joined_records(records).select(F.col("id").alias("account"), "direction", "profile.*")
    heads = records.where("chunk = 0").select(F.col("id").alias("account"), F.lit("none").alias("direction"), *_PROFILE)
    return rows.unionByName(heads)


@query(f"""{EDGES}, ends as (
    select source_id as id, 'friend' as direction, target_id as other from edges
    union all select target_id, 'follower', source_id from edges),
  ranked as (select *, row_number() over (partition by id % 3, direction order by id * 1000 + other) as r from ends)
select (id % 3)::bigint as id, direction, id * 1000 + other as other from ranked where r <= 25000""")
def capped_connections_of_hubs(spark, sf_dir):
    """The first 25,000 connections of three accounts that have them all."""
    ends = G.both_ways(view(spark, sf_dir, "edges")).selectExpr("id % 3 as id", "direction", "id * 1000 + other as other")
    return G.capped(materialize(ends, "hubs"), G.MAX_CONNECTIONS)


def _escaped(text):
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""{_NAMED}, ends as (
  select id, min(seen) as seen from (
    select source_id as id, created_date as seen from edges union all select target_id, created_date from edges)
  group by id)
select 'account-' || id as id, 'account' as kind, screen_name as label,
  strftime(seen, '%Y-%m-%dT%H:%M:%S') as start,
  '<node id="account-' || id || '" label="' || {_escaped('screen_name')} || '" start="'
    || strftime(seen, '%Y-%m-%dT%H:%M:%S') || '"/>' as element
from ends join accounts using (id)""")
def graph_export_nodes(spark, sf_dir):
    nodes = G.nodes_of(view(spark, sf_dir, "edges"), view(spark, sf_dir, "accounts"))
    return G.export_nodes(nodes, "account")


@query("""select user_id as id, arg_min(event_type, event_id) as screen_name, min(event_id) as created_date
from events group by user_id""")
def unique_nodes(spark, sf_dir):
    """Event types stand for the names an account was seen under, event ids for the time."""
    return G.unique_nodes(table(spark, sf_dir, "events").selectExpr(
        "user_id as id", "event_type as screen_name", "event_id as created_date"))


@query(f"""{_NAMED}
select 'account-' || source_id || '>account-' || target_id as id, 'account-' || source_id as source,
  'account-' || target_id as target, strftime(created_date, '%Y-%m-%dT%H:%M:%S') as start,
  '<edge id="account-' || source_id || '&gt;account-' || target_id || '" source="account-' || source_id
    || '" target="account-' || target_id || '" start="' || strftime(created_date, '%Y-%m-%dT%H:%M:%S')
    || '"/>' as element
from edges""")
def graph_export_edges(spark, sf_dir):
    edges = G.unique_edges(view(spark, sf_dir, "edges"))
    return G.export_edges(edges, ("account", "source_id"), ("account", "target_id"))


@query(f"""{_NAMED} select source_id, target_id, s.screen_name as source_name, t.screen_name as target_name
from edges join accounts s on s.id = source_id join accounts t on t.id = target_id""")
def named_edges(spark, sf_dir):
    return G.named_edges(view(spark, sf_dir, "edges"), view(spark, sf_dir, "accounts")).select(
        "source_id", "target_id", "source_name", "target_name")


@query("""select s as source_id, t as target_id, min(o_orderdate) as created_date
from (select o_custkey % 200 as s, o_orderkey % 300 as t, o_orderdate from orders) group by s, t""")
def unique_edges(spark, sf_dir):
    sightings = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 200 as source_id", "o_orderkey % 300 as target_id", "o_orderdate as created_date")
    return G.unique_edges(sightings)
