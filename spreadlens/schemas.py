"""Column contracts of the input tables and the check every operator runs on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns each reader projects to, in order.
POST_COLUMNS = (
    "id", "author_id", "body", "created_at", "like_count", "retweet_count",
    "reply_count", "views_count", "lang", "has_media", "has_link", "version",
)
ACCOUNT_COLUMNS = (
    "tweet_id", "author_id", "author_handle", "person", "party", "account_kind",
    "author_followers", "created_at", "text", "lang", "like_count",
    "retweet_count", "reply_count", "view_count", "in_reply_to_tweet_id",
)
VIDEO_COLUMNS = ("video_id", "creator_id", "music_id", "music_title", "created_at")

RAW_POST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("like_count", T.LongType()),
        T.StructField("retweet_count", T.LongType()),
        T.StructField("reply_count", T.LongType()),
        T.StructField("views_count", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("media", T.StringType()),
        T.StructField("reply_to_status_id", T.StringType()),
        T.StructField("version", T.TimestampType()),
    ]
)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` itself, or a `ValueError` naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"table is missing columns {missing}")
    return df
