"""Scans, the materialised layer and its incremental writer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.functions.text import has_link_raw
from spreadlens.schemas import ACCOUNT_COLUMNS, POST_COLUMNS, require_columns

# What a post id and an empty media field look like, and how many hour files a month has.
ID_LENGTH = 19
EMPTY_MEDIA = ("", "[]", "null")
HOUR_FILES = 396


def is_original(body: Column, reply_to: Column) -> Column:
    """Neither a repost nor a reply; a missing body is neither."""
    return ~body.startswith("RT @") & reply_to.isNull()


def has_media(media: Column) -> Column:
    return media.isNotNull() & ~media.cast("string").isin(*EMPTY_MEDIA)


def scan_posts(raw: DataFrame, lang: str | None = "en", originals_only: bool = True, carry: Sequence[str] = ("file_index",)) -> DataFrame:
    """The shared post shape: valid ids, optionally one language and originals only, twelve columns and the carried ones it has."""
    kept = raw.where(F.length("id") == ID_LENGTH)
    if lang is not None:
        kept = kept.where(F.col("lang") == lang)
    if originals_only:
        kept = kept.where(is_original(F.col("body"), F.col("reply_to_status_id")))
    shaped = kept.withColumns({"has_media": has_media(F.col("media")), "has_link": has_link_raw(F.col("body"))})
    extra = [c for c in carry if c in raw.columns]
    return shaped.select(*POST_COLUMNS, *extra)


def with_file_index(raw: DataFrame, start: str) -> DataFrame:
    """Hours since `start`: the partition key that stands for one hour file."""
    seconds = F.unix_timestamp("created_at") - F.unix_timestamp(F.lit(start).cast("timestamp"))
    return raw.withColumn("file_index", F.floor(seconds / 3600).cast("bigint"))


def scan_hour_range(indexed: DataFrame, first: int, last: int, hours: int = HOUR_FILES) -> DataFrame:
    """Hour files `first` to `last`, inclusive, of a layer of `hours`; a partition filter where the table is partitioned by them."""
    if not 0 <= first <= last < hours:
        raise ValueError(f"hours must satisfy 0 <= first <= last < {hours}")
    return indexed.where(F.col("file_index").between(first, last))


def latest_window(indexed: DataFrame, hours: int) -> DataFrame:
    """The newest `hours` partitions present."""
    if hours < 1:
        raise ValueError("hours must be at least 1")
    newest = indexed.select("file_index").distinct().orderBy(F.desc("file_index")).limit(hours)
    # At most `hours` rows of one number each.
    return indexed.join(F.broadcast(newest), "file_index", "left_semi")


def scan_accounts(accounts: DataFrame, handles: Sequence[str] | None = None) -> DataFrame:
    """The fifteen account columns; a table that lacks one is refused."""
    chosen = require_columns(accounts, ACCOUNT_COLUMNS).select(*ACCOUNT_COLUMNS)
    if handles:
        chosen = chosen.where(F.lower("author_handle").isin(*[h.lower() for h in handles]))
    return chosen


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Hadoop path or pattern holds anything; works for any file system Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def read_or_fallback(spark: SparkSession, path: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The materialised table at `path`, or what `fallback` reads while it is not there yet."""
    return spark.read.parquet(path) if path_exists(spark, path) else fallback()


def materialise_new_hours(indexed: DataFrame, path: str) -> None:
    """Write the hours `path` lacks, one directory each; a rerun writes nothing.

    Dynamic overwrite moves a partition into place only once all its files are complete, so a lost
    executor or a killed driver leaves either the whole hour or none of it.
    """
    spark = indexed.sparkSession
    todo = require_columns(indexed, ["file_index"])
    # A dynamic overwrite leaves no mark of success in the folder, only the hours it has moved into place.
    if path_exists(spark, f"{path}/file_index=*"):
        # Reads directory names only; a month has a few hundred hours.
        done = spark.read.parquet(path).select(F.col("file_index").cast("bigint")).distinct()
        todo = todo.join(done, "file_index", "left_anti")
    (
        # `rebalance` splits a hot hour over several tasks and merges small ones.
        todo.hint("rebalance", "file_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("file_index")
        .parquet(path)
    )


def copy_once(df: DataFrame, path: str) -> None:
    """Write `df` unless something is there already."""
    df.write.mode("ignore").option("compression", "zstd").parquet(path)


def extract_columns(df: DataFrame, renames: dict[str, str], rows: int | None, order: Sequence[str], path: str) -> DataFrame:
    """A renamed column extract, capped to its first `rows` in `order`, written as zstd parquet and read back."""
    picked = df.select(*[F.col(source).alias(target) for source, target in renames.items()])
    if rows is not None:
        picked = picked.orderBy(*order).limit(rows)
    picked.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def recent_per_account(accounts: DataFrame, n: int, handle: str = "author_handle") -> DataFrame:
    """Each handle's newest `n` rows; the rank limit is applied before and after the shuffle."""
    newest = Window.partitionBy(handle).orderBy(F.desc("created_at"), F.desc("tweet_id"))
    return accounts.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON record with ISO timestamps."""
    fields = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(fields, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "ignoreNullFields": "false"}).alias("record"))
