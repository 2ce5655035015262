"""Queries on posts and the assembled feature table."""

from pyspark.sql import functions as F

from acctsignal.catalog.account_queries import _ENTROPY_SQL, ACCOUNT_SQL, all_account_features, rounded
from acctsignal.catalog.registry import query
from acctsignal.catalog.views import oracle_cte, table, view
from acctsignal.operators import posts as P
from acctsignal.operators.features import with_features
from acctsignal.operators.ingest import TIMELINE_LENGTH
from acctsignal.operators.ordered import SALTS, newest_per_key
from acctsignal.plans.assemble import assemble

TWEETS = oracle_cte("tweets")
_BOTH = oracle_cte("accounts", "tweets")

# Ends a query's `with` clause with every post and the one before it.
LINKED = """
  linked as (
    select *, lag(tweet_ts_long) over w as previous_ts, lag(latitude) over w as previous_lat,
      lag(longitude) over w as previous_lon, row_number() over w as nth
    from tweets window w as (partition by user_id order by tweet_ts_long, tweet_id)),
  distances as (
    select *, case when latitude is not null and previous_lat is not null then
      2 * 6371.009 / 1.609344 * asin(sqrt(least(1.0,
        pow(sin(radians(latitude - previous_lat) / 2), 2) + cos(radians(previous_lat))
        * cos(radians(latitude)) * pow(sin(radians(longitude - previous_lon) / 2), 2)))) end as miles
    from linked)"""


def posts_with_columns(spark, sf_dir):
    """The post view with every column the aggregates read."""
    posts = view(spark, sf_dir, "tweets").withColumns({
        "tweet_language": F.expr("concat('l', cast(k % 3 as string))"),
        "reply_ts_long": F.expr("tweet_ts_long - case when in_reply_to_user_id is not null then k * 60 end"),
    })
    return with_features(posts, [*P.CALENDAR, P.REPLY_ID_DISTANCE, P.RETWEET_ID_DISTANCE,
                                 P.TIME_TO_RETWEET, P.TIME_TO_REPLY])


@query(f"""{TWEETS}, {LINKED}
select tweet_id, user_id, previous_ts as previous_tweet_ts_long, tweet_ts_long - previous_ts as time_from_previous_tweet,
  tweet_ts_long - retweet_ts_long as time_to_retweet,
  hour(tweet_ts)::int as tweet_hour, tweet_ts::date as tweet_date from linked""")
def tweet_time_features(spark, sf_dir):
    rows = with_features(view(spark, sf_dir, "tweets"), [*P.CALENDAR, P.TIME_TO_RETWEET])
    return P.sequence_features(rows).select(
        "tweet_id", "user_id", "previous_tweet_ts_long", "time_from_previous_tweet",
        "time_to_retweet", "tweet_hour", "tweet_date")


@query(f"""{TWEETS}, {LINKED}
select tweet_id, tweet_ts_long - coalesce(previous_ts, 0) as time_from_previous_tweet from linked""")
def tweet_gaps_from_epoch(spark, sf_dir):
    return P.sequence_features(view(spark, sf_dir, "tweets"), compat=True).select(
        "tweet_id", "time_from_previous_tweet")


@query(f"""{TWEETS}, {LINKED} select tweet_id, previous_lat as previous_tweet_latitude,
  previous_lon as previous_tweet_longitude, round(miles, 4) as dist_from_previous_tweet from distances""")
def tweet_distance(spark, sf_dir):
    rows = P.sequence_features(view(spark, sf_dir, "tweets")).select(
        "tweet_id", "previous_tweet_latitude", "previous_tweet_longitude", "dist_from_previous_tweet")
    return rounded(rows, "dist_from_previous_tweet", digits=4)


@query(f"""{TWEETS} select user_id, round(avg(abs(user_id - in_reply_to_user_id)), 6) as avg_reply_id_distance,
  round(avg(abs(user_id - retweeted_status_user_id)), 6) as avg_retweet_id_distance from tweets group by user_id""")
def id_distances(spark, sf_dir):
    rows = with_features(view(spark, sf_dir, "tweets"), [P.REPLY_ID_DISTANCE, P.RETWEET_ID_DISTANCE])
    means = rows.groupBy("user_id").agg(*P.average("reply_id_distance"), *P.average("retweet_id_distance"))
    return rounded(means, "avg_reply_id_distance", "avg_retweet_id_distance")


@query("select user_id, count(*) as total_tweets from events group by user_id")
def total_tweets(spark, sf_dir):
    return view(spark, sf_dir, "tweets").groupBy("user_id").agg(*P.total_tweets())


@query(f"""{TWEETS} select user_id, count(retweeted_status_id) as num_retweets,
  round(count(retweeted_status_id)::double / count(*), 6) as perc_retweets from tweets group by user_id""")
def retweet_share(spark, sf_dir):
    rows = view(spark, sf_dir, "tweets").groupBy("user_id").agg(*P.retweet_share())
    return rounded(rows, "perc_retweets")


@query(f"""{TWEETS} select user_id, count(distinct retweeted_status_id) as unique_users_retweeted,
  count(distinct retweeted_status_user_id) as unique_accounts_retweeted
from tweets where retweeted_status_id is not null group by user_id""")
def retweeted_distinct(spark, sf_dir):
    retweets = view(spark, sf_dir, "tweets").where("retweeted_status_id is not null")
    return retweets.groupBy("user_id").agg(*P.distinct_counts(
        unique_users_retweeted="retweeted_status_id", unique_accounts_retweeted="retweeted_status_user_id"))


@query("""select user_id, round(avg(hours), 6) as avg_distinct_hours_tweeted from (
  select user_id, ts::date as day, count(distinct hour(ts)) as hours from events group by user_id, ts::date)
group by user_id""")
def hours_tweeted(spark, sf_dir):
    rows = P.hours_tweeted(with_features(view(spark, sf_dir, "tweets"), P.CALENDAR))
    return rounded(rows, "avg_distinct_hours_tweeted")


def _entity_sql(entity):
    return f"""sum(num_{entity})::bigint as num_tweets_{entity},
  round(avg(num_{entity}), 6) as avg_num_{entity}_in_tweets,
  round(avg(case when num_{entity} > 0 then 1 else 0 end), 6) as perc_tweets_has_{entity}"""


@query(f"{TWEETS} select user_id, {', '.join(_entity_sql(e) for e in P.ENTITIES)} from tweets group by user_id")
def entity_features(spark, sf_dir):
    totals = [c for e in P.ENTITIES for c in P.entity_totals(e)]
    rows = view(spark, sf_dir, "tweets").groupBy("user_id").agg(*totals)
    return rounded(rows, *[c for c in rows.columns if c.startswith(("avg", "perc"))])


@query("select user_id, count(distinct event_type) as num_sources from events group by user_id")
def num_sources(spark, sf_dir):
    return view(spark, sf_dir, "tweets").groupBy("user_id").agg(
        *P.distinct_counts(num_sources="tweet_source"))


@query("select source as user_id, count(distinct lang) as num_languages from documents group by source")
def num_languages(spark, sf_dir):
    """Documents stand for posts, their source for the account."""
    return table(spark, sf_dir, "documents").withColumnRenamed("source", "user_id").groupBy("user_id").agg(
        *P.distinct_counts(num_languages="lang"))


_DUPLICATE_SQL = """
select user_id, sum(texts)::bigint as duplicates, max(texts) as max_daily_duplicates from (
  select user_id, day, count(*) as texts from (
    select user_id, day, text from originals group by user_id, day, text having count(*) > 1)
  group by user_id, day) group by user_id"""


@query(f"""{TWEETS}, originals as (select user_id, tweet_ts::date as day, tweet_text as text from tweets
  where retweeted_status_id is null and in_reply_to_user_id is null) {_DUPLICATE_SQL}""")
def duplicate_text(spark, sf_dir):
    return P.duplicate_texts(with_features(view(spark, sf_dir, "tweets"), P.CALENDAR))


@query(f"""with originals as (select source as user_id, date '2024-01-01' + (n_chars % 7)::int as day, text
  from documents) {_DUPLICATE_SQL}""")
def duplicate_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.col("source").alias("user_id"), F.col("text").alias("tweet_text"),
        F.expr("date_add(date '2024-01-01', cast(n_chars % 7 as int))").alias("tweet_date"),
        F.lit(None).cast("bigint").alias("retweeted_status_id"),
        F.lit(None).cast("bigint").alias("in_reply_to_user_id"))
    return P.duplicate_texts(documents)


@query(f"{TWEETS} select user_id, min(tweet_ts_long) as oldest_ts_long from tweets group by user_id")
def oldest_tweet(spark, sf_dir):
    return view(spark, sf_dir, "tweets").groupBy("user_id").agg(*P.oldest_tweet())


@query(f"""{TWEETS}, {LINKED} select user_id, round(avg(tweet_ts_long - previous_ts), 4) as avg_time_from_previous_tweet,
  round(avg(previous_ts), 3) as avg_previous_tweet_ts_long from linked group by user_id""")
def mean_gaps(spark, sf_dir):
    rows = view(spark, sf_dir, "tweets").groupBy("user_id").agg(*P.mean_gaps())
    return rounded(rounded(rows, "avg_time_from_previous_tweet", digits=4), "avg_previous_tweet_ts_long", digits=3)


@query(f"""{TWEETS}, {LINKED} select user_id,
  round(avg(tweet_ts_long - coalesce(previous_ts, 0)), 3) as avg_time_from_previous_tweet,
  round(avg(coalesce(previous_ts, 0)), 3) as avg_previous_tweet_ts_long from linked group by user_id""")
def mean_gaps_from_epoch(spark, sf_dir):
    rows = view(spark, sf_dir, "tweets").groupBy("user_id").agg(*P.mean_gaps(compat=True))
    return rounded(rows, "avg_time_from_previous_tweet", "avg_previous_tweet_ts_long", digits=3)


@query(f"""{TWEETS}, {LINKED}
select user_id, round(avg(miles), 4) as avg_dist_from_previous_tweet from distances group by user_id""")
def mean_distance(spark, sf_dir):
    return rounded(P.mean_distance(view(spark, sf_dir, "tweets")), "avg_dist_from_previous_tweet", digits=4)


@query("""select user_id, event_id as tweet_id from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
where r <= 200""")
def last_timeline(spark, sf_dir):
    posts = view(spark, sf_dir, "tweets")
    return newest_per_key(posts, ["user_id"], ["tweet_ts", "tweet_id"], TIMELINE_LENGTH).select(
        "user_id", "tweet_id")


@query("""select account, event_id as tweet_id from (
  select user_id % 15 as account, event_id,
    row_number() over (partition by user_id % 15 order by ts desc, event_id desc) as r from events)
where r <= 200""")
def last_timeline_long(spark, sf_dir):
    """The newest 200 of few accounts with many posts each."""
    posts = view(spark, sf_dir, "tweets").withColumn("account", F.expr("user_id % 15"))
    return newest_per_key(posts, ["account"], ["tweet_ts", "tweet_id"], TIMELINE_LENGTH, SALTS).select("account", "tweet_id")


_AGGREGATES = f"""
  wide as (
    select user_id, count(*) as total_tweets, count(retweeted_status_id) as num_retweets,
      round(count(retweeted_status_id)::double / count(*), 6) as perc_retweets,
      min(tweet_ts_long) as oldest_ts_long,
      round(avg(abs(user_id - in_reply_to_user_id)), 6) as avg_reply_id_distance,
      round(avg(abs(user_id - retweeted_status_user_id)), 6) as avg_retweet_id_distance,
      round(avg(tweet_ts_long - retweet_ts_long), 4) as avg_time_to_retweet,
      round(avg(case when in_reply_to_user_id is not null then k * 60 end), 4) as avg_time_to_reply,
      round(avg(retweet_ts_long), 3) as avg_retweet_ts_long,
      count(distinct k % 3) as num_languages,
      nullif(count(distinct retweeted_status_id), 0) as unique_users_retweeted,
      nullif(count(distinct retweeted_status_user_id), 0) as unique_accounts_retweeted,
      {', '.join(_entity_sql(e) for e in P.ENTITIES)}
    from tweets group by user_id),
  gaps as (
    select user_id, round(avg(previous_ts), 3) as avg_previous_tweet_ts_long,
      round(avg(tweet_ts_long - previous_ts), 4) as avg_time_from_previous_tweet,
      round(avg(miles), 4) as avg_dist_from_previous_tweet
    from distances group by user_id),
  hours as (
    select user_id, round(avg(hours), 6) as avg_distinct_hours_tweeted from (
      select user_id, tweet_ts::date as day, count(distinct hour(tweet_ts)) as hours
      from tweets group by user_id, tweet_ts::date) group by user_id),
  originals as (select user_id, tweet_ts::date as day, tweet_text as text from tweets
    where retweeted_status_id is null and in_reply_to_user_id is null),
  repeats as ({_DUPLICATE_SQL})"""

_COMMON = """total_tweets, num_retweets, perc_retweets, oldest_ts_long, avg_reply_id_distance,
  num_tweets_urls, avg_num_urls_in_tweets, perc_tweets_has_urls, num_tweets_hashtags,
  avg_num_hashtags_in_tweets, perc_tweets_has_hashtags, num_tweets_users_mentioned,
  avg_num_users_mentioned_in_tweets, perc_tweets_has_users_mentioned, avg_distinct_hours_tweeted,
  duplicates, max_daily_duplicates, avg_previous_tweet_ts_long, unique_users_retweeted"""

_JOINS = """from profiles a left join wide w using (user_id) left join gaps g using (user_id)
  left join hours h using (user_id) left join repeats r using (user_id)"""
_PROFILES = f"{_ENTROPY_SQL}, profiles as (select {ACCOUNT_SQL} from accounts join entropies using (id))"

ROUNDING = {
    "avg_time_to_retweet": 4, "avg_time_to_reply": 4, "avg_retweet_ts_long": 3,
    "avg_previous_tweet_ts_long": 3, "avg_time_from_previous_tweet": 4, "avg_dist_from_previous_tweet": 4,
}


def rounded_features(df):
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, ROUNDING.get(c, 6)) for c in doubles})


def assembled(spark, sf_dir, mode="unknown", **options):
    return assemble(all_account_features(spark, sf_dir), posts_with_columns(spark, sf_dir), mode, **options)


@query(f"""{_BOTH}, {LINKED}, {_AGGREGATES}, {_PROFILES}
select a.*, {_COMMON}, num_languages,
  unique_accounts_retweeted, avg_retweet_id_distance, avg_time_to_retweet, avg_dist_from_previous_tweet,
  avg_retweet_ts_long, avg_time_to_reply, null::double as avg_time_from_previous_tweet {_JOINS}""")
def assembled_features(spark, sf_dir):
    return rounded_features(assembled(spark, sf_dir))


@query(f"""{_BOTH}, {LINKED}, {_AGGREGATES}, {_PROFILES}
select a.*, {_COMMON}, avg_time_from_previous_tweet,
  null::bigint as num_languages, null::bigint as unique_accounts_retweeted,
  null::double as avg_retweet_id_distance, null::double as avg_time_to_retweet,
  null::double as avg_dist_from_previous_tweet, null::double as avg_retweet_ts_long,
  null::double as avg_time_to_reply {_JOINS}""")
def training_features(spark, sf_dir):
    return rounded_features(assembled(spark, sf_dir, "training"))
