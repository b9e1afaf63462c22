"""One-line reports: latency by step, dataset health, ranking quality of a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.operators.ranks import ranked_values, value_at


def latency_report(requests: DataFrame, step: str, seconds: str, problem: str) -> DataFrame:
    """Per step: requests, median, nearest-rank 95th percentile, maximum, and how many rows name a problem."""
    rows = requests.select(F.col(step).alias("step"), F.col(seconds).alias("seconds"), F.col(problem).alias("problem"))
    ranked = ranked_values(rows.where("seconds is not null"), ["step"], "seconds")
    n = F.col("total")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    p95 = F.least(n, F.floor(n * 95 / 100) + 1)
    timings = ranked.groupBy("step").agg(
        F.max("total").alias("requests"),
        ((value_at(low, "seconds") + value_at(high, "seconds")) / 2).alias("p50"),
        value_at(p95, "seconds").alias("p95"),
        F.max("seconds").alias("longest"),
    )
    problems = rows.groupBy("step").agg(F.count("problem").alias("problems"))
    return timings.join(problems, "step")


def dataset_health(posts: DataFrame, author: str) -> DataFrame:
    """One row: rows in the dataset, and the baseline (median likes, posts) of one account, in one pass."""
    own = (F.col("author_id") == author) & F.col("like_count").isNotNull()
    return posts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(author).alias("author"),
        F.coalesce(F.median(F.when(own, F.col("like_count"))), F.lit(0.0)).alias("median_likes"),
        F.count_if(own).alias("posts"),
    )


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve of `score` for binary `label`, ties counting half, over whole counts.

    Equal scores are counted first, then ranked by bucket, so the rows are never sorted in one task.
    """
    rows = scored.select(F.lit(0).alias("all"), F.col(score).alias("score"), F.col(label).alias("label"))
    rows = rows.where("score is not null and label is not null")
    below = ranked_values(rows, ["all"], "score").select("score", "n", "below")
    positives = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"))
    # Twice the average rank; sums of ranks pass the range of a long from some three billion rows.
    big = lambda c: F.col(c).cast("decimal(38,0)")
    middle = big("below") * 2 + F.col("n") + 1
    joined = below.join(positives, "score").agg(
        F.sum((F.col("pos") * middle).cast("decimal(38,0)")).alias("twice_ranks"), F.sum("pos").alias("p"), F.sum("n").alias("total")
    )
    p, q = F.col("p"), F.col("total") - F.col("p")
    return joined.select(
        F.when((p > 0) & (q > 0), (F.col("twice_ranks") - (big("p") * (p + 1)).cast("decimal(38,0)")).cast("double") / (2.0 * p * q)).alias("auc"),
        p.alias("positives"),
        q.alias("negatives"),
    )
