"""Observed engagement against the forecast, and the points a poller adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The early checkpoint, the bands around a forecast, and the reads one post may cost.
HALF_HOUR = 30.0
AHEAD, BEHIND = 1.2, 0.8
MAX_READS = 60


def checkpoint_label(minutes: Column) -> Column:
    """The checkpoint a curve reached: hours below two days, then days."""
    hours = minutes / 60.0
    return F.when(hours < 48, F.format_string("%.0f hours", F.bround(hours, 0))).otherwise(
        F.format_string("%.0f days", F.bround(hours / 24, 0))
    )


def compare_forecast(points: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per forecast (id, likes_1d, likes_1h): observed, predicted, ratio and verdict.

    With an hour forecast and a point in the first half hour, the last such point is held against half the
    hour's figure; otherwise the final point is held against the day's. Forecasts without points are kept.
    The two points needed are aggregates, so a post's points are never gathered.
    """
    at = F.struct("minutes", "likes")
    reached = points.groupBy("id").agg(
        F.max(F.when(F.col("minutes") <= HALF_HOUR, at)).alias("early"), F.max(at).alias("last")
    )
    use_early = F.col("early").isNotNull() & F.col("likes_1h").isNotNull()
    observed = F.when(use_early, F.col("early.likes")).otherwise(F.col("last.likes"))
    predicted = F.when(use_early, F.col("likes_1h") * (HALF_HOUR / 60.0)).otherwise(F.col("likes_1d"))
    label = F.when(use_early, F.lit("30 minutes")).otherwise(checkpoint_label(F.col("last.minutes")))
    ratio = observed / F.greatest(predicted, F.lit(1.0))
    state = (
        F.when(ratio > AHEAD, "ahead of forecast").when(ratio < BEHIND, "behind forecast").otherwise("on track")
    )
    seen = F.col("last").isNotNull()
    return forecasts.join(reached, "id", "left").select(
        "id",
        F.when(seen, observed).otherwise(F.lit(0)).cast("bigint").alias("observed"),
        F.when(seen, predicted).otherwise(F.lit(0.0)).alias("predicted"),
        F.when(seen, F.concat_ws(" at ", state, label)).otherwise(F.lit("no observations yet")).alias("verdict"),
    )


def poll_points(reads: DataFrame, max_reads: int = MAX_READS) -> DataFrame:
    """(id, read, minutes, likes): the first `max_reads` reads of each post, minutes rounded to two decimals.

    Reads with equal versions and likes are numbered by their publication time, so that reruns agree.
    """
    order = Window.partitionBy("id").orderBy("version", "likes", "created_at")
    kept = reads.withColumn("read", F.row_number().over(order)).where(F.col("read") <= max_reads)
    elapsed = (F.unix_timestamp("version") - F.unix_timestamp("created_at")) / 60.0
    return kept.select("id", "read", F.round(elapsed, 2).alias("minutes"), "likes")


def poll_window(points: DataFrame, minutes: float) -> DataFrame:
    """The polled points (id, read, minutes, likes) up to `minutes` after posting; a post without any has its last read instead.

    A post has at most as many points as reads are allowed, so its window is small.
    """
    of_post = Window.partitionBy("id")
    inside = F.coalesce(F.col("minutes") <= minutes, F.lit(False))
    marked = points.withColumns({"_inside": inside, "_any": F.max(inside).over(of_post), "_last": F.col("read") == F.max("read").over(of_post)})
    return marked.where(F.col("_inside") | (~F.col("_any") & F.col("_last"))).select(*points.columns)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per request the candidate with the highest forecast, the first one on ties."""
    best = F.max(F.struct(F.col("likes_1d"), (-F.col("ordinal")).alias("back"))).alias("best")
    return candidates.groupBy("request_id").agg(best).select(
        "request_id", (-F.col("best.back")).alias("ordinal"), F.col("best.likes_1d").alias("likes_1d")
    )
