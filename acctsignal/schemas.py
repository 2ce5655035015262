"""Declared schemas of the inputs; nothing is inferred.

Functions, since parsing a schema text needs an active session.
"""

from pyspark.sql.types import StructType


def account() -> StructType:
    return StructType.fromDDL("""
    id bigint, id_str string, screen_name string, created_at string, lang string,
    protected boolean, verified boolean, geo_enabled boolean, default_profile boolean,
    followers_count bigint, friends_count bigint, favourites_count bigint,
    statuses_count bigint, listed_count bigint, _tbsource string
""")

_ENTITIES = """struct<
    hashtags: array<struct<text: string>>,
    urls: array<struct<url: string>>,
    user_mentions: array<struct<id: bigint, id_str: string>>>"""
_BRIEF_USER = "struct<id: bigint, screen_name: string, lang: string>"


def post() -> StructType:
    """One post as delivered; a stream carries these without the per-account nesting."""
    return StructType.fromDDL(f"""
    created_at string, id bigint, text string, source string, lang string, truncated boolean,
    in_reply_to_status_id bigint, in_reply_to_user_id bigint, in_reply_to_user_id_str string,
    in_reply_to_screen_name string, contributors string,
    coordinates struct<coordinates: array<double>>,
    user struct<
        id: bigint, id_str: string, name: string, screen_name: string, url: string,
        location: string, description: string, protected: boolean, verified: boolean,
        default_profile: boolean, followers_count: bigint, favourites_count: bigint,
        friends_count: bigint, listed_count: bigint, statuses_count: bigint,
        created_at: string, utc_offset: bigint, geo_enabled: boolean, lang: string,
        profile_image_url_https: string>,
    place string, is_quote_status boolean, quoted_status_id bigint,
    quoted_status struct<user: {_BRIEF_USER}, created_at: string>,
    retweeted_status struct<
        id: bigint, created_at: string, text: string, retweet_count: bigint,
        favorite_count: bigint, user: {_BRIEF_USER}, entities: {_ENTITIES}>,
    in_reply_to_status struct<created_at: string>,
    retweet_count bigint, favorite_count bigint, entities {_ENTITIES},
    possibly_sensitive boolean, extended_entities string
""")


def timeline() -> StructType:
    """One record per account with its posts nested."""
    return StructType.fromDDL(
    f"id bigint, id_str string, screen_name string, tweets array<{post().simpleString()}>")


def training_account() -> StructType:
    return StructType.fromDDL("""
    id bigint, id_str string, screen_name string, lang string,
    protected int, verified int, geo_enabled int, default_profile int,
    followers_count bigint, friends_count bigint, favourites_count bigint,
    statuses_count bigint, listed_count bigint, timestamp string, updated string
""")


def follower() -> StructType:
    return StructType.fromDDL("target bigint, position bigint, created_date string")


def work_item() -> StructType:
    return StructType.fromDDL("""
    id bigint, id_str string, screen_name string, created_date timestamp, found_date timestamp,
    fetched_tweets_date timestamp, fetched_tweets boolean, protected boolean, tweet_count bigint,
    source string, language string
""")
