"""Exact order statistics per key that stay spread out when one key holds most rows.

Values are first counted (`key, value, n`), which combines on the map side. The counted values of a key are
then split into buckets that follow the value's own order, so ranks come from a window over a bounded
number of buckets plus a window inside one bucket, never from sorting a whole key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spreadlens.schemas import require_columns

STEPS_PER_OCTAVE = 64


def order_bucket(value: Column) -> Column:
    """A bucket number that never decreases as `value` grows: 64 steps in every doubling.

    Doubles span some 2,000 octaves, counts at most 63, so the number of buckets is bounded.
    """
    size = F.abs(value.cast("double"))
    octave = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    base = F.pow(F.lit(2.0), octave)
    step = F.least(F.floor((size / base - 1) * STEPS_PER_OCTAVE), F.lit(STEPS_PER_OCTAVE - 1))
    magnitude = (octave + 1100) * STEPS_PER_OCTAVE + F.greatest(step, F.lit(0))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * magnitude).cast("bigint")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, below, total): for each distinct value, its count, the rows under it and the key's rows."""
    require_columns(df, (*keys, value))
    counted = (
        df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", order_bucket(F.col(value)))
    )
    buckets = counted.groupBy(*keys, "bucket").agg(F.sum("n").alias("bucket_n"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *keys,
        "bucket",
        F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("bucket_below"),
        F.sum("bucket_n").over(of_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counted.join(buckets, [*keys, "bucket"]).select(
        *keys,
        value,
        "n",
        (F.col("bucket_below") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"),
        "total",
    )


def value_at(position: Column, value: str = "value") -> Column:
    """Aggregate: the value at one-based `position` within the key, from the rows of `ranked_values`."""
    return F.max(F.when((F.col("below") < position) & (position <= F.col("below") + F.col("n")), F.col(value)))
