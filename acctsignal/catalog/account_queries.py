"""Queries on accounts."""

from pyspark.sql import functions as F

from acctsignal.catalog.registry import query
from acctsignal.catalog.views import oracle_cte, table, view
from acctsignal.operators import account as A
from acctsignal.operators.features import with_features

ACCOUNTS = oracle_cte("accounts")

# Fixed day of the snapshots made from the account view.
DUMP_DAY = "2018-08-05"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_all_flags(accounts):
    return accounts.withColumns({
        "geo_enabled": F.expr("id % 3 = 1"),
        "default_profile": F.expr("case when id % 11 <> 0 then id % 4 = 0 end"),
    })


def raw_accounts(spark, sf_dir):
    """Accounts as collected: creation time as text, the snapshot day in the file name."""
    created = F.date_sub(F.lit(DUMP_DAY).cast("date"), F.col("age_days").cast("int"))
    return with_all_flags(view(spark, sf_dir, "accounts")).withColumns({
        "created_at": F.date_format(created, "E MMM dd 12:34:56 '+0000' yyyy"),
        "file_name": F.lit(f"dump/x.accounts-{DUMP_DAY}.json.gz"),
        "id_str": F.col("id").cast("string"),
        "_tbsource": F.when(F.expr("id % 2 = 0"), "stream").otherwise("enum"),
    })


_FLAG_SQL = """
  case when coalesce(protected, false) then 1 else 0 end as is_protected,
  case when coalesce(verified, false) then 1 else 0 end as is_verified,
  case when id % 3 = 1 then 1 else 0 end as is_geo_enabled,
  case when id % 11 <> 0 and id % 4 = 0 then 1 else 0 end as is_default_profile"""

_RATE_SQL = """
  round(coalesce(followers_count::double / nullif(friends_count, 0), 0), 6) as ratio_followers_friends,
  round(coalesce(favourites_count::double / nullif(age_days, 0), 0), 6) as favorite_rate,
  round(coalesce(statuses_count::double / nullif(age_days, 0), 0), 6) as tweet_rate,
  round(coalesce(listed_count::double / nullif(age_days, 0), 0), 6) as listed_rate"""

_ENTROPY_SQL = """
  entropies as (
    select id, round(coalesce(-sum(p * log2(p)), 0), 6) + 0.0 as screen_name_entropy
    from (select id, count(*)::double / any_value(length(screen_name)) as p
          from (select id, screen_name, unnest(string_split(screen_name, '')) as ch from accounts)
          group by id, ch)
    group by id)"""

_DIGIT_SQL = r"""
  length(regexp_extract(screen_name, '^([0-9]*)', 1))::int as numbers_at_beginning_of_screen_name,
  length(regexp_extract(screen_name, '([0-9]*)$', 1))::int as numbers_at_end_of_screen_name"""


@query(f"{ACCOUNTS} select id, {_FLAG_SQL} from accounts")
def account_flags(spark, sf_dir):
    rows = with_features(with_all_flags(view(spark, sf_dir, "accounts")), A.FLAGS)
    return rows.select("id", *[f.name for f in A.FLAGS])


@query(f"{ACCOUNTS} select id, {_RATE_SQL} from accounts")
def account_rates(spark, sf_dir):
    accounts = view(spark, sf_dir, "accounts").withColumnRenamed("age_days", "account_age_days")
    rows = A.fill_rates(with_features(accounts, A.RATES))
    return rounded(rows.select("id", *A.FILLED), *A.FILLED)


@query(f"{ACCOUNTS}, {_ENTROPY_SQL} select id, screen_name_entropy from entropies")
def screen_name_entropy(spark, sf_dir):
    rows = with_features(view(spark, sf_dir, "accounts"), A.NAME[:1])
    return rounded(rows.select("id", "screen_name_entropy"), "screen_name_entropy")


@query(f"""{ACCOUNTS} select id, {_DIGIT_SQL},
  length(regexp_replace(screen_name, '[^0-9]', '', 'g'))::int as numbers_in_screen_name from accounts""")
def screen_name_digits(spark, sf_dir):
    features = [*A.NAME[1:], A.DIGITS_IN_NAME]
    return with_features(view(spark, sf_dir, "accounts"), features).select(
        "id", *[f.name for f in features])


#: All account columns of the feature table, from the tables ``accounts`` and ``entropies``.
ACCOUNT_SQL = f"""id as user_id, date '{DUMP_DAY}' - age_days::int + interval '12:34:56' as created_at_ts,
  date '{DUMP_DAY}'::timestamp as dump_ts, age_days::int as account_age_days, lang, screen_name,
  followers_count as num_followers, friends_count as num_friends, favourites_count as num_favorites,
  statuses_count as num_tweets, screen_name_entropy, {_FLAG_SQL}, {_RATE_SQL}, {_DIGIT_SQL}"""


def all_account_features(spark, sf_dir):
    """Every account column, times without a zone as the checking database has them."""
    rows = A.account_features(raw_accounts(spark, sf_dir))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at_ts", "dump_ts")})


@query(f"{ACCOUNTS}, {_ENTROPY_SQL} select {ACCOUNT_SQL} from accounts join entropies using (id)")
def account_features(spark, sf_dir):
    return rounded(all_account_features(spark, sf_dir), "screen_name_entropy", *A.FILLED)


@query(f"""{ACCOUNTS}, {_ENTROPY_SQL}
select id as user_id, age_days::int as account_age_days, screen_name_entropy, {_FLAG_SQL}, {_RATE_SQL}
from accounts join entropies using (id)""")
def training_account_features(spark, sf_dir):
    """The labelled layout: flags 1 or blank, two plain timestamps."""
    age = F.col("age_days").cast("int")
    accounts = with_all_flags(view(spark, sf_dir, "accounts")).withColumns({
        "updated": F.lit(f"{DUMP_DAY} 01:02:03"),
        "timestamp": F.concat(F.date_sub(F.lit(DUMP_DAY).cast("date"), age).cast("string"), F.lit(" 10:00:00")),
        **{c: F.when(F.col(c), 1) for c in ("protected", "verified", "geo_enabled", "default_profile")},
    })
    rows = A.account_features(accounts, "training").select(
        "user_id", "account_age_days", "screen_name_entropy", *[f.name for f in A.FLAGS], *A.FILLED)
    return rounded(rows, "screen_name_entropy", *A.FILLED)


@query("""select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r
  from orders) where r = 1""")
def latest_account_snapshot(spark, sf_dir):
    """Orders stand for snapshots of the customer's account."""
    rows = A.newest_snapshot(table(spark, sf_dir, "orders"), "o_custkey",
                             F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select user_id, event_id, event_type from (
  select *, row_number() over (partition by user_id order by event_id) as r from events) where r = 1""")
def first_seen_accounts(spark, sf_dir):
    """Event ids rise with time, so they stand for the time an account was found."""
    rows = A.first_seen(table(spark, sf_dir, "events"), "user_id", "event_id")
    return rows.select("user_id", "event_id", "event_type")


@query(f"""{ACCOUNTS} select id as user_id, greatest(age_days, 1) as account_age_days,
  round(favourites_count::double / greatest(age_days, 1), 6) as favorite_rate,
  round(statuses_count::double / greatest(age_days, 1), 6) as tweet_rate from accounts""")
def zero_age_repair(spark, sf_dir):
    features = view(spark, sf_dir, "accounts").selectExpr(
        "id as user_id", "age_days as account_age_days", "favourites_count as num_favorites",
        "statuses_count as num_tweets")
    rows = A.repair_zero_age(features).drop("num_favorites", "num_tweets")
    return rounded(rows, "favorite_rate", "tweet_rate")
