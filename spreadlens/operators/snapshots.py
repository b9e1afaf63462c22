"""The snapshot log: final state per post, trajectories and labels at a horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.schemas import require_columns

# What a trajectory needs, and the first-hour window.
MIN_POINTS = 3
HOUR_WINDOW = (5.0, 60.0)


def latest(df: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One row per id, its highest version; `ties` make equal versions deterministic.

    `row_number() = 1` lets Spark drop all but one row per id before the shuffle, so an id observed very
    often does not fill one task.
    """
    require_columns(df, ("id", "version", *ties))
    newest = Window.partitionBy("id").orderBy(F.desc("version"), *[F.desc(t) for t in ties])
    return df.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole-second boundaries crossed, in minutes."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60.0


def curves(df: DataFrame) -> DataFrame:
    """Every observation with its minutes since creation; no global order is imposed."""
    require_columns(df, ("id", "author_id", "created_at", "version", "like_count", "views_count"))
    return df.select(
        "id", "author_id", "created_at", "version", "like_count", "views_count",
        minutes_between(F.col("created_at"), F.col("version")).alias("minutes"),
    )


def trajectories(df: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(id, minutes, likes) for posts with enough points and some likes; long form, so no post is one big array."""
    points = curves(df).where("minutes >= 0").select("id", "minutes", F.coalesce("like_count", F.lit(0)).alias("likes"))
    qualified = (
        points.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("likes").alias("top"))
        .where((F.col("n") >= min_points) & (F.col("top") > 0))
        .select("id")
    )
    return points.join(qualified, "id", "left_semi")


def observe(points: DataFrame, minutes: float) -> DataFrame:
    """Each post's points within `minutes`, or its earliest point when none is."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    earliest = points.groupBy("id").agg(F.min(F.struct("minutes", "likes")).alias("first")).select("id", "first.*")
    return points.where(F.col("minutes") <= minutes).unionByName(earliest.where(F.col("minutes") > minutes))


def likes_in_window(df: DataFrame, ties: Sequence[str] = (), window: tuple[float, float] = HOUR_WINDOW) -> DataFrame:
    """Final rows with `likes_1h`: the likes at the last counted snapshot inside the window."""
    minutes = minutes_between(F.col("created_at"), F.col("version"))
    order = F.struct(minutes, *[F.col(t) for t in ties])
    labels = (
        df.where(minutes.between(*window))
        .groupBy("id")
        .agg(F.max_by(F.col("like_count"), F.when(F.col("like_count").isNotNull(), order)).alias("likes_1h"))
    )
    return latest(df, ties).join(labels, "id")
