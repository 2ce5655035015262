"""Queries on ingest, the work list, files and streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctsignal import schemas
from acctsignal.catalog.account_queries import ACCOUNTS, raw_accounts, rounded
from acctsignal.catalog.post_queries import TWEETS
from acctsignal.catalog.raw import messages, raw_posts, shaped
from acctsignal.catalog.registry import query
from acctsignal.catalog.views import oracle_cte, table, view
from acctsignal.functions import has_all_terms
from acctsignal.operators import ingest as I
from acctsignal.operators import worklist as W
from acctsignal.operators.features import with_features
from acctsignal.operators.posts import POST_FEATURES, post_features, reply_times_from_parents
from acctsignal.plans.extract import extract
from acctsignal.session import new_shared_path
from acctsignal.sources import (
    append_records,
    read_accounts,
    read_posts,
    read_timelines,
    read_training_accounts,
    read_training_posts,
)
from acctsignal.streaming import collect as C

# ---- ingest ------------------------------------------------------------------------------------

def timelines(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Posts nested per account; ids rise with time."""
    posts = raw_posts(spark, sf_dir).withColumns({
        "user_id": F.col("user.id"), "user_id_str": F.col("user.id_str"), "name": F.col("user.screen_name")})
    nested = I.nest_posts(posts, ["user_id", "user_id_str", "name"], schemas.post().names, ["id"],
                          limit)
    tweets = F.transform("tweets", lambda t: F.struct(*[t[c].alias(c) for c in schemas.post().names]))
    return nested.select(F.col("user_id").alias("id"), F.col("user_id_str").alias("id_str"),
                         F.col("name").alias("screen_name"), tweets.alias("tweets"))


_FLAT_SQL = """tweet_id, user_id, tweet_ts_long, retweet_ts_long, retweeted_status_id, retweeted_status_user_id,
  in_reply_to_user_id, latitude, longitude, num_hashtags::int as num_hashtags, num_urls::int as num_urls,
  num_users_mentioned::int as num_users_mentioned, tweet_text, tweet_source, 'l' || (k % 3) as tweet_language,
  k as num_retweets, k % 7 as num_favorites"""
_FLAT = ["tweet_id", "user_id", "tweet_ts_long", "retweet_ts_long", "retweeted_status_id",
         "retweeted_status_user_id", "in_reply_to_user_id", "latitude", "longitude", "num_hashtags", "num_urls",
         "num_users_mentioned", "tweet_text", "tweet_source", "tweet_language", "num_retweets", "num_favorites"]


@query(f"""{TWEETS} select {_FLAT_SQL} from (
  select *, row_number() over (partition by user_id order by tweet_id desc) as r from tweets) where r <= 200""")
def nest_explode(spark, sf_dir):
    """Nest per account, explode, flatten, and the features of single posts."""
    posts = I.flatten_posts(I.explode_posts(timelines(spark, sf_dir, I.TIMELINE_LENGTH)))
    return post_features(posts).select(*_FLAT)


@query(f"{TWEETS} select {_FLAT_SQL} from tweets")
def nest_explode_all(spark, sf_dir):
    """The same without a limit."""
    return post_features(I.flatten_posts(I.explode_posts(timelines(spark, sf_dir)))).select(*_FLAT)


@query(f"{TWEETS} select {_FLAT_SQL} from tweets")
def json_posts(spark, sf_dir):
    """Through gzip JSON files and back."""
    path = new_shared_path(spark, "posts-json")
    append_records(raw_posts(spark, sf_dir), path)
    return post_features(I.flatten_posts(read_posts(spark, path, spread=8))).select(*_FLAT)


@query(f"""{ACCOUNTS} select id, id::varchar as id_str, screen_name, protected, statuses_count as tweet_count,
  case when id % 2 = 0 then 'stream' else 'enum' end as source, lang as language,
  date '2018-08-05' - age_days::int as created_day from accounts""")
def account_summaries(spark, sf_dir):
    """Accounts through gzip JSON files into work-list records."""
    path = new_shared_path(spark, "x.accounts-2018-08-05.json")
    append_records(raw_accounts(spark, sf_dir).drop("file_name"), path)
    summary = I.account_summary(read_accounts(spark, path))
    return summary.select("id", "id_str", "screen_name", "protected", "tweet_count", "source", "language",
                          F.to_date("created_date").alias("created_day"))


@query(f"""{TWEETS} select tweet_id, user_id, tweet_text, tweet_source, k as tweet_retweet_count,
  num_users_mentioned::int as num_users_mentioned, tweet_ts::date as tweet_date from tweets where k % 10 <> 0""")
def training_posts(spark, sf_dir):
    """The labelled layout: binary text, incomplete rows dropped, user ids as text."""
    path = new_shared_path(spark, "training-posts")
    view(spark, sf_dir, "tweets").select(
        F.col("tweet_id").alias("id"), F.col("user_id").cast("string").alias("user_id"),
        F.date_format("tweet_ts", "E MMM dd HH:mm:ss '+0000' yyyy").cast("binary").alias("created_at"),
        F.when(F.col("k") % 10 != 0, F.col("tweet_text")).cast("binary").alias("text"),
        F.col("tweet_source").cast("binary").alias("source"), F.col("k").alias("retweet_count"),
        (F.col("k") % 7).alias("favorite_count"), F.col("num_users_mentioned").cast("int").alias("num_mentions"),
        F.col("num_urls").cast("int"), F.col("num_hashtags").cast("int"), "retweeted_status_id",
        "in_reply_to_user_id").write.parquet(path)
    posts = post_features(I.normalize_training_posts(read_training_posts(spark, path)), "training")
    return posts.select("tweet_id", "user_id", "tweet_text", "tweet_source", "tweet_retweet_count",
                        "num_users_mentioned", "tweet_date")


@query(f"""{ACCOUNTS} select id, screen_name, followers_count, case when protected then 1 end as protected,
  statuses_count from accounts""")
def training_csv(spark, sf_dir):
    """Labelled accounts through CSV files whose columns are in an order of their own."""
    path = new_shared_path(spark, "training-accounts")
    accounts = view(spark, sf_dir, "accounts").withColumn("protected", F.when(F.col("protected"), 1))
    accounts.select("statuses_count", "screen_name", "protected", "id", "followers_count").write.option(
        "header", True).csv(path)
    return read_training_accounts(spark, path).select(
        "id", "screen_name", "followers_count", "protected", "statuses_count")


@query(f"""{ACCOUNTS} select id, screen_name, followers_count from accounts""")
def training_csv_two_headers(spark, sf_dir):
    """Labelled accounts from two CSV files whose headers name the columns in other orders."""
    path = new_shared_path(spark, "training-accounts")
    accounts = view(spark, sf_dir, "accounts")
    for rest, columns in ((0, ["id", "followers_count", "screen_name"]), (1, ["followers_count", "screen_name", "id"])):
        accounts.where(F.col("id") % 2 == rest).select(columns).coalesce(1).write.mode("append").option(
            "header", True).csv(path)
    return read_training_accounts(spark, path).select("id", "screen_name", "followers_count")


_EXTRACT_SQL = """
  kept as (
    select * from (select *, row_number() over (partition by user_id order by tweet_id desc) as r from tweets)
    where r <= 200),
  wide as (
    select user_id, count(*) as total_tweets, count(retweeted_status_id) as num_retweets,
      nullif(count(distinct retweeted_status_id), 0) as unique_users_retweeted,
      count(distinct k % 3) as num_languages, min(tweet_ts_long) as oldest_ts_long,
      round(avg(tweet_ts_long - retweet_ts_long), 4) as avg_time_to_retweet,
      sum(num_urls)::bigint as num_tweets_urls
    from kept group by user_id)
select id as user_id, age_days::int as account_age_days, followers_count as num_followers,
  round(coalesce(statuses_count::double / nullif(age_days, 0), 0), 6) as tweet_rate, total_tweets, num_retweets,
  unique_users_retweeted, num_languages, oldest_ts_long, avg_time_to_retweet, num_tweets_urls
from accounts left join wide on id = user_id"""


@query(f"{oracle_cte('accounts', 'tweets')}, {_EXTRACT_SQL}")
def extract_from_files(spark, sf_dir):
    """The whole feature job from JSON files."""
    folder = new_shared_path(spark, "dump")
    account_path, post_path = f"{folder}/x.accounts-2018-08-05.json", f"{folder}/tweets"
    append_records(raw_accounts(spark, sf_dir).drop("file_name"), account_path)
    append_records(timelines(spark, sf_dir, I.TIMELINE_LENGTH), post_path)
    rows = extract(spark, account_path, post_path, spread=8).select(
        "user_id", "account_age_days", "num_followers", "tweet_rate", "total_tweets", "num_retweets",
        "unique_users_retweeted", "num_languages", "oldest_ts_long", "avg_time_to_retweet", "num_tweets_urls")
    return rounded(rounded(rows, "tweet_rate"), "avg_time_to_retweet", digits=4)


@query("""select c.event_id as tweet_id, floor(epoch(c.ts))::bigint - floor(epoch(p.ts))::bigint as time_to_reply
from events c left join events p on p.event_id = c.event_id // 3""")
def reply_times(spark, sf_dir):
    """Reply times where the parent post is in the data; post n replies to post n div 3."""
    text = "E MMM dd HH:mm:ss '+0000' yyyy"
    posts = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tweet_id"), F.expr("event_id div 3").alias("in_reply_to_status_id"),
        F.date_format("ts", text).alias("tweet_created_at"), "user_id",
        F.lit(None).cast("string").alias("replied_status_tweet_created_at"))
    filled = reply_times_from_parents(posts)
    wanted = {"tweet_ts", "tweet_ts_long", "reply_ts", "reply_ts_long", "time_to_reply"}
    return with_features(filled, [f for f in POST_FEATURES["unknown"] if f.name in wanted]).select(
        "tweet_id", "time_to_reply")


# ---- work list ---------------------------------------------------------------------------------

def _work(spark, sf_dir):
    return view(spark, sf_dir, "accounts").selectExpr(
        "id", "screen_name", "protected", "lang as language", "statuses_count as tweet_count",
        "id as found_date", "id % 4 = 1 as fetched_tweets")


_ELIGIBLE_SQL = """from accounts where not protected and lang = 'en' and not (id % 4 = 1) and statuses_count >= 10"""


@query(f"{ACCOUNTS} select id, screen_name {_ELIGIBLE_SQL} order by id limit 100")
def next_work(spark, sf_dir):
    """The limit is the batch the list hands out."""
    return W.next_work(_work(spark, sf_dir)).select("id", "screen_name")


@query(f"{ACCOUNTS} select id, statuses_count as tweet_count {_ELIGIBLE_SQL} and id not in (select user_id from events)")
def eligible_accounts(spark, sf_dir):
    """Fetched ids come from a table of their own."""
    fetched = table(spark, sf_dir, "events").selectExpr("user_id as id")
    return W.eligible(_work(spark, sf_dir), fetched=fetched).select("id", "tweet_count")


@query("select c_custkey as id, c_name from customer where c_custkey not in (select user_id from events)")
def unseen_accounts(spark, sf_dir):
    found = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name")
    return W.unseen(found, table(spark, sf_dir, "events").selectExpr("user_id as id"))


@query(f"""{oracle_cte('accounts', 'tweets')}, ids as (
  select retweeted_status_user_id as id, 'tweet' as source from tweets where retweeted_status_user_id is not null
  union all select in_reply_to_user_id, 'stream' from tweets where in_reply_to_user_id is not null)
select a.id, a.screen_name, min(source) as _tbsource from ids join accounts a using (id) group by a.id, a.screen_name""")
def hydrate_ids(spark, sf_dir):
    posts = view(spark, sf_dir, "tweets")
    ids = W.tagged_union(
        tweet=posts.select(F.col("retweeted_status_user_id").alias("id")).where("id is not null"),
        stream=posts.select(F.col("in_reply_to_user_id").alias("id")).where("id is not null"))
    return W.hydrate(ids, view(spark, sf_dir, "accounts")).select("id", "screen_name", "_tbsource")


@query("""select user_id as id, 'stream' as _tbsource, count(*) as n from events group by user_id
union all select c_custkey, 'enum', 1 from customer""")
def account_sources(spark, sf_dir):
    """Accounts from two sources in one queue."""
    found = W.tagged_union(stream=table(spark, sf_dir, "events").selectExpr("user_id as id"),
                           enum=table(spark, sf_dir, "customer").selectExpr("c_custkey as id"))
    return found.groupBy("id", "_tbsource").agg(F.count("*").alias("n"))


_MENTION_SQL = """
  pointed as (
    select tweet_id, user_id, in_reply_to_user_id as target, 0 as pos from tweets
    union all select tweet_id, user_id, k % 50, 1 from tweets where num_users_mentioned > 0)"""


@query(f"""{TWEETS}, {_MENTION_SQL}, distinct_targets as (
  select distinct tweet_id, target from pointed where target is not null and target <> user_id)
select target::varchar as id_str, 'tweet' as _tbsource, count(*) as n from distinct_targets group by target""")
def mentioned_users(spark, sf_dir):
    found = W.mentioned_accounts(raw_posts(spark, sf_dir))
    return found.groupBy("id_str", "_tbsource").agg(F.count("*").alias("n"))


@query("""select id from (
  select id, row_number() over (partition by (id - lo) // 100 order by md5(id::varchar || '-26')) as r
  from (select unnest(range(lo, hi)) as id, lo from (
    select min(o_orderkey) as lo, max(o_orderkey) as hi from orders))) where r <= 7""")
def stratified_ids(spark, sf_dir):
    """7 of every 100 ids of the range that the orders span."""
    first, end = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return W.sample_ids(spark, first, end, percentage=7)


@query("""select doc_id, length(text) as chars from documents
where lower(text) like '%the%' and lower(text) like '%and%'""")
def tracked_keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(has_all_terms(F.col("text"), "The AND"))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("chars"))


# ---- streams -----------------------------------------------------------------------------------

# Posts of one file, which one task writes.
POSTS_PER_FILE = 250_000


def _message_files(spark, sf_dir):
    """The messages as JSON files in a folder to stream from, four at least; with their number.

    Dealt by their place in the input, as many may share an id or have none.
    """
    path = new_shared_path(spark, "messages")
    posts = messages(spark, sf_dir)
    files = max(4, posts.count() // POSTS_PER_FILE + 1)
    posts.repartition(files, F.monotonically_increasing_id()).write.json(path)
    return path, files


_STREAMED = "messages as (select * from tweets where tweet_id % 10 <> 9)"


@query(f"""{TWEETS}, {_STREAMED}
select count(distinct user_id) as accounts, count(distinct case when user_id % 3 = 0 then user_id end) as fetched
from messages""")
def collection_progress(spark, sf_dir):
    """Counts after a stream is stored and every third account is marked as fetched."""
    store = C.AccountStore(spark, new_shared_path(spark, "store"))
    posts = C.read_post_stream(spark, _message_files(spark, sf_dir)[0])
    C.collect_accounts(posts, store, new_shared_path(spark, "checkpoint")).awaitTermination()
    store.mark_fetched(store.work_list().where("id % 3 = 0"))
    return store.progress()


@query(f"""{oracle_cte('accounts', 'tweets')}, {_STREAMED}, pointed as (
  select user_id, in_reply_to_user_id as id from messages
  union all select user_id, k % 50 from messages where num_users_mentioned > 0)
select distinct 1000000 + user_id as id, 'u' || user_id as screen_name, 'en' as language from messages
union select a.id, a.screen_name, a.lang from pointed p join accounts a on a.id = p.id where p.id <> p.user_id""")
def stream_accounts(spark, sf_dir):
    """Authors and mentioned accounts of a stream of files in two batches, each stored once.

    Authors' ids are moved away from those that are mentioned, so every mentioned account comes from the lookup.
    """
    store = C.AccountStore(spark, new_shared_path(spark, "store"))
    path, files = _message_files(spark, sf_dir)
    posts = C.read_post_stream(spark, path, files_per_batch=-(-files // 2))
    moved = F.col("user").withField("id", F.col("user.id") + 1_000_000)
    known = view(spark, sf_dir, "accounts").select(*shaped(schemas.account(), {
        c: F.col(c) for c in ("id", "screen_name", "lang", "followers_count", "statuses_count")}))
    C.collect_accounts(posts.withColumn("user", moved), store, new_shared_path(spark, "checkpoint"), known).awaitTermination()
    return store.work_list().select("id", "screen_name", "language")


@query(f"""{TWEETS}, {_STREAMED}, pointed as (
  select user_id, in_reply_to_user_id as id from messages
  union all select user_id, k % 50 from messages where num_users_mentioned > 0)
select distinct id::varchar as id_str from pointed where id <> user_id""")
def stream_mentions(spark, sf_dir):
    """Mentioned ids, deduplicated in the stream's state and appended as JSON."""
    posts = C.tracked(C.read_post_stream(spark, _message_files(spark, sf_dir)[0]))
    path = new_shared_path(spark, "mentions")
    C.append_stream(C.once(C.mentioned(posts), "id_str"), path,
                    new_shared_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("id_str string").json(path)


@query(f"""{oracle_cte('accounts', 'tweets')}, {_STREAMED}
select distinct a.id, a.screen_name, 'stream' as _tbsource from messages m join accounts a on a.id = m.k % 50
where num_users_mentioned > 0 and m.k % 50 <> user_id
union select distinct a.id, a.screen_name, 'stream' from messages m join accounts a on a.id = m.in_reply_to_user_id
where in_reply_to_user_id <> user_id""")
def stream_hydration(spark, sf_dir):
    """Mentioned ids joined with an account dump inside the stream."""
    posts = C.tracked(C.read_post_stream(spark, _message_files(spark, sf_dir)[0]))
    ids = C.once(C.mentioned(posts), "id_str").select(
        F.col("id_str").try_cast("bigint").alias("id"), "_tbsource")
    accounts = view(spark, sf_dir, "accounts").select("id", "screen_name")
    path = new_shared_path(spark, "hydrated")
    C.append_stream(C.hydrated(ids, accounts), path, new_shared_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("id bigint, screen_name string, _tbsource string").json(path)
