"""Plans keep what makes them scale: pushed filters, pruned columns, no Python and no cartesian product where none is needed."""

import pytest

from spreadlens.operators import snapshots, templates
from spreadlens.plans.queries import QUERIES
from spreadlens.sources import views

NATIVE = (
    "scan_posts", "latest", "trajectories", "likes_in_window", "author_baselines", "loo_medians", "register_adoption_monthly",
    "normalise_text", "named_features", "budget_admission", "route_messages", "hash_embed", "latency_report", "captions",
)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cartesian_product(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "MapInPandas", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_scan_prunes_and_pushes(spark, sf_dir):
    text = plan(views.table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey"))
    assert "EqualTo(o_custkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_latest_drops_rows_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(snapshots.latest(views.posts(spark, sf_dir)))


@pytest.mark.parametrize("name", ["captions", "chars_to_words"])
def test_in_row_operators_shuffle_nothing(spark, sf_dir, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf_dir))


def test_mining_normalises_distinct_bodies_behind_their_digest(spark, sf_dir):
    """The patterns run above the exchange by the body's digest, so a document that most posts share is read once."""
    text = templates.keyed_posts(views.posts(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("partial_first(body", 1)
    narrow, merged = above.rsplit("functions=[first(body", 1)
    assert "Exchange hashpartitioning(raw" in merged and "normalised" in merged
    assert "normalised" not in below and "normalised" not in narrow.rsplit("md5(cast(normalised", 1)[0]


def test_a_document_that_most_posts_share(spark):
    rows = [(str(k), f"a{k % 50}", "The same text @x, of many accounts" if k % 10 < 6 else f"text number {k} of one account", k) for k in range(2000)]
    posts = spark.createDataFrame(rows, "id string, author_id string, body string, n int").selectExpr(
        "*", "timestamp_seconds(n) as created_at", "timestamp_seconds(n) as version", "false as has_link", "0L as views_count"
    )
    keyed = templates.keyed_posts(posts)
    assert keyed.count() == 2000
    assert keyed.groupBy("key").count().agg({"count": "max"}).first()[0] == 1200


def test_hours_are_pruned_by_folder(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(file_index" in plan(QUERIES["scan_hour_range"](spark, sf_dir))


def test_timed_characters_are_made_once(spark, sf_dir):
    """No filter on the array, which would be moved below it and make it a second time."""
    assert QUERIES["chars_to_words"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("filter(split(text") == 1
