"""The post view in the layout of collected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acctsignal import schemas
from acctsignal.catalog.views import view

_TEXT_TIME = "E MMM dd HH:mm:ss '+0000' yyyy"


def shaped(schema: StructType, values: dict[str, Column]) -> list[Column]:
    """Columns of ``schema`` from ``values``, NULL where there is none."""
    return [(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]


def _part(schema: StructType, name: str, **values: Column) -> Column:
    return F.struct(*shaped(schema[name].dataType, values))


def _text_time(seconds: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.expr(seconds)), _TEXT_TIME)


def _repeat(number: str, item: Column) -> Column:
    return F.array_repeat(item, F.col(number).cast("int"))


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single posts, one per row of the post view."""
    post = schemas.post()
    text = lambda c: F.col(c).cast("string")
    author = _part(post, "user", id=F.col("user_id"), id_str=text("user_id"),
                   screen_name=F.concat(F.lit("u"), text("user_id")), lang=F.lit("en"),
                   statuses_count=F.col("user_id") % 40, protected=F.expr("user_id % 10 = 3"),
                   created_at=_text_time("1400000000 + user_id"))
    mention = F.struct((F.col("k") % 50).alias("id"), (F.col("k") % 50).cast("string").alias("id_str"))
    entities = F.struct(
        _repeat("num_hashtags", F.struct(F.lit("tag").alias("text"))).alias("hashtags"),
        _repeat("num_urls", F.struct(F.lit("http://x").alias("url"))).alias("urls"),
        _repeat("num_users_mentioned", mention).alias("user_mentions"))
    original_user = F.struct(
        F.col("retweeted_status_user_id").alias("id"), F.lit("o").alias("screen_name"), F.lit("en").alias("lang"))
    original = F.when(F.col("retweeted_status_id").isNotNull(), _part(
        post, "retweeted_status", id=F.col("retweeted_status_id"), created_at=_text_time("retweet_ts_long"),
        text=F.col("rt_text"), retweet_count=F.col("rt_retweet_count"),
        favorite_count=F.col("rt_favorite_count"), user=original_user))
    where = F.when(F.col("longitude").isNotNull(),
                   F.struct(F.array("longitude", "latitude").alias("coordinates")))
    return view(spark, sf_dir, "tweets").select(*shaped(post, {
        "created_at": _text_time("tweet_ts_long"), "id": F.col("tweet_id"), "text": F.col("tweet_text"),
        "source": F.col("tweet_source"), "lang": F.expr("concat('l', k % 3)"), "user": author,
        "in_reply_to_user_id": F.col("in_reply_to_user_id"),
        "in_reply_to_user_id_str": text("in_reply_to_user_id"), "coordinates": where,
        "entities": entities, "retweeted_status": original,
        "retweet_count": F.col("k"), "favorite_count": F.col("k") % 7,
    }))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's messages: posts, and every tenth something without an author."""
    posts = raw_posts(spark, sf_dir)
    return posts.withColumn("user", F.when(F.col("id") % 10 != 9, F.col("user")))
