"""Approximate account counts: error, windows and folded templates from hour sketches."""

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import templates
from spreadlens.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    # Three templates; the first has 60,000 accounts, who come back every few hours.
    key = F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c")
    return spark.range(300_000).select(
        key.alias("key"),
        F.when(F.col("id") % 97 == 0, None).otherwise((F.col("id") % 100_000).cast("string")).alias("author_id"),
        F.timestamp_seconds(F.col("id") % 36_000).alias("created_at"),
        (F.col("id") % 2).cast("int").alias("link"),
        F.lit(0).alias("unseen"),
    )


@pytest.fixture(scope="module")
def sketches(spark, rows):
    path = scratch_path(spark, "sketches")
    templates.hour_sketches(rows).write.parquet(path)
    return spark.read.parquet(path)


def exact(rows, *keys):
    return {tuple(r[:-2]): (r.authors, r.posts) for r in rows.groupBy(*keys).agg(F.countDistinct("author_id").alias("authors"), F.count("*").alias("posts")).collect()}


def close(found, wanted, keys):
    got = {tuple(r[k] for k in keys): (r.authors, r.posts) for r in found.collect()}
    assert got.keys() == wanted.keys()
    for k, (authors, posts) in wanted.items():
        assert got[k][1] == posts and abs(got[k][0] - authors) <= 0.02 * authors


def test_error_is_below_two_percent(rows, sketches):
    close(templates.merged_sketches(sketches), exact(rows, "key"), ["key"])


def test_a_window_reads_sketches_only(rows, sketches):
    window = templates.merged_sketches(sketches.where("hour >= timestamp'1970-01-01 02:00:00' and hour < timestamp'1970-01-01 05:00:00'"))
    text = window._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "author_id" not in text
    close(window, exact(rows.where("created_at >= timestamp'1970-01-01 02:00:00' and created_at < timestamp'1970-01-01 05:00:00'"), "key"), ["key"])


def test_folded_templates_count_an_account_once(spark, rows, sketches):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "key string, root string")
    rooted = rows.join(members, "key")
    found = templates.folded_sketches(sketches, members)
    close(found, exact(rooted, "root"), ["root"])
    assert {r.root: r.variants for r in found.collect()} == {"a": 2, "c": 1}
    hourly = rooted.withColumn("hour", F.date_trunc("hour", "created_at"))
    close(templates.sketched_cells(sketches, members), exact(hourly, "root", "hour"), ["root", "hour"])
