"""Accounts, posts, followers and edges derived from the benchmark tables.

The same SQL text serves Spark and the checking database; the few spellings that differ are
the placeholders of ``DIALECT``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsignal.operators.ordered import add_running_sum
from acctsignal.session import configure

DIALECT = {
    "spark": {"S": "string", "T": "unix_seconds(cast(ts as timestamp))"},
    "oracle": {"S": "varchar", "T": "cast(floor(epoch(ts)) as bigint)"},
}

ACCOUNTS = """
select c_custkey as id,
  case when c_custkey % 3 = 0 then concat(cast(c_custkey % 1000 as {S}), c_mktsegment)
       else c_name end as screen_name,
  case when c_nationkey % 4 = 0 then null when c_nationkey % 2 = 0 then 'en' else 'fr' end as lang,
  c_custkey*37 % 5000 as followers_count, c_custkey*11 % 40 as friends_count,
  c_custkey*17 % 3000 as favourites_count, c_custkey*23 % 4000 as statuses_count,
  c_custkey % 25 as listed_count, c_custkey % 10 = 0 as protected,
  case when c_custkey % 50 = 0 then null else c_custkey % 7 = 0 end as verified,
  c_custkey % 1200 as age_days
from customer
"""

TWEETS = """
select *,
  case when retweeted_status_id is null and k % 5 = 1 then (user_id*7+k) % 150 end as in_reply_to_user_id,
  retweeted_status_id % 150 as retweeted_status_user_id,
  case when retweeted_status_id is not null then tweet_ts_long
    - case when user_id % 30 = 20 then 0 else (k*357119) % 8640000 end end as retweet_ts_long,
  retweeted_status_id*7 % 400 as rt_retweet_count,
  case when retweeted_status_id >= 250 then 300 else retweeted_status_id % 12 end as rt_favorite_count,
  case when retweeted_status_id % 9 = 0 then 'Please LIKE this'
       when retweeted_status_id is not null then 'plain text' end as rt_text,
  case when k % 4 = 0 then cast(k - 50 as double) end as latitude,
  case when k % 4 = 0 then cast((k*7) % 360 - 180 as double) end as longitude,
  k % 4 as num_hashtags, k % 3 as num_urls, k % 2 as num_users_mentioned,
  concat('t', cast(k % 8 as {S})) as tweet_text
from (
  select event_id as tweet_id, user_id, ts as tweet_ts, {T} as tweet_ts_long,
    event_type as tweet_source, k,
    case when k < case when user_id % 10 = 0 then 95 else 30 end then k + 50*(user_id % 7) end
      as retweeted_status_id
  from (select *, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from events) a) b
"""

# Few accounts with many posts each.
LONG_TWEETS = TWEETS.replace("event_id as tweet_id, user_id,", "event_id as tweet_id, user_id % 10 as user_id,")

FOLLOWERS = """
select target, row_number() over (partition by target order by event_id) as position,
  case when m < 60 then -1 - b*2 when m between 75 and 129 then -2 - b*2
       else (event_id*13) % 701 end as created_day
from (select event_id, user_id % 5 as target, event_id % 1000 as m,
        (event_id - event_id % 1000) as b from events) a
"""

EDGES = """
select s as source_id, t as target_id, min(o_orderdate) as created_date
from (select o_custkey % 200 as s, (o_orderkey*31) % 200 as t, o_orderdate from orders) a
where s <> t group by s, t
"""

_BASE = {"accounts": (ACCOUNTS, "customer"), "tweets": (TWEETS, "events"), "long_tweets": (LONG_TWEETS, "events"),
         "followers": (FOLLOWERS, "events"), "edges": (EDGES, "orders")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _follower_lists(events: DataFrame) -> DataFrame:
    """``FOLLOWERS`` with the positions counted in slices: it has few targets, each long."""
    rows = events.selectExpr(
        "event_id", "user_id % 5 as target", "event_id % 1000 as m",
        "event_id - event_id % 1000 as b", "event_id div 1000000 as slice")
    counted = add_running_sum(rows, ["target"], "slice", ["event_id"], F.lit(1), "earlier")
    return counted.selectExpr(
        "target", "earlier + 1 as position",
        """case when m < 60 then -1 - b*2 when m between 75 and 129 then -2 - b*2
                else (event_id*13) % 701 end as created_day""")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "followers":
        return _follower_lists(table(spark, sf_dir, "events"))
    text, base = _BASE[name]
    text = text.format(**DIALECT["spark"]).replace(f"from {base}", f"from {{{base}}}")
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def oracle_cte(*names: str) -> str:
    """``with`` clause of the views for the checking database."""
    parts = [f"{n} as ({_BASE[n][0].format(**DIALECT['oracle'])})" for n in names]
    return "with " + ", ".join(parts)
