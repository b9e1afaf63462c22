"""Work that must be whole, and texts that must not travel."""

import pytest
from pyspark.sql import functions as F

from spreadlens.operators import templates

TEMPLATE = "join us for the town hall on thursday"


def log(spark, rows):
    """(id, author, body, hour or None) as observations."""
    made = [(i, a, b, None if h is None else f"2024-01-01 {h:02d}:10:00") for i, a, b, h in rows]
    return spark.createDataFrame(made, "id string, author_id string, body string, t string").selectExpr(
        "id", "author_id", "body", "cast(t as timestamp) as created_at", "cast(t as timestamp) as version", "false as has_link", "1L as views_count"
    )


def test_a_template_has_all_its_accounts_and_its_curve(spark):
    rows = [(f"p{k}", f"a{9 - k % 7}", f"{TEMPLATE} @u{k}", k % 3) for k in range(14)] + [("q", "a1", "a text of one account only, long enough", 1)]
    found = templates.cluster_templates(log(spark, rows), min_authors=2).collect()
    assert len(found) == 1 and found[0].authors == 7
    assert found[0].author_ids == [f"a{k}" for k in range(3, 10)]
    points = [(p.hour.hour, p.authors, p.posts) for p in found[0].curve]
    of = lambda h: [r for r in rows[:14] if r[3] == h]
    assert points == [(h, len({r[1] for r in of(h)}), len(of(h))) for h in range(3)]


def test_a_template_with_a_post_without_a_time_is_not_lost(spark):
    rows = [(f"p{k}", f"a{k}", TEMPLATE, None if k == 3 else 5 - k) for k in range(5)]
    found = templates.cluster_templates(log(spark, rows), min_authors=2).collect()
    assert [(r.authors, r.posts, r.text, r.sample_ids) for r in found] == [(5, 5, TEMPLATE, ["p4", "p2", "p1", "p0", "p3"])]


def test_marked_posts_are_keyed_posts(spark):
    rows = [(f"p{k % 30}", f"a{k % 7}", None if k % 11 == 0 else f"text {k % 5} @u{k} of some length", k % 9) for k in range(90)]
    posts = log(spark, rows).withColumn("n", F.monotonically_increasing_id())
    marked = templates.marked_posts(posts, ("n",))
    told = lambda df: sorted(map(repr, df.select("id", "raw", "key", "chars", "n").collect()))
    assert told(templates.keyed_marked(marked, ("n",))) == told(templates.keyed_posts(posts, ("n",)))
    assert "body" not in marked.columns


@pytest.mark.parametrize("name", ["scan_hour_range", "scan_named_posts", "stream_load", "stream_curve"])
def test_observations_are_written_without_their_texts(spark, sf_dir, monkeypatch, name):
    from spreadlens.plans import queries
    from spreadlens.session import scratch_path
    from spreadlens.sources.readers import path_exists

    paths = []
    monkeypatch.setattr(queries, "scratch_path", lambda s, kind: paths.append(scratch_path(s, kind)) or paths[-1])
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
    folders = [p for path in paths for p in (path, f"{path}/posts", f"{path}/hours") if path_exists(spark, f"{p}/*.parquet") or path_exists(spark, f"{p}/file_index=*")]
    assert folders
    for folder in folders:
        rows = spark.read.parquet(folder)
        longest = rows.agg(F.max(F.length("body"))).first()[0] if "body" in rows.columns else 0
        assert "text" not in rows.columns and (longest or 0) <= 4


@pytest.mark.parametrize("name", ["named_features", "feature_medians", "feature_matrix", "forecast_inputs"])
def test_no_body_is_ranked_or_met_by_its_median(spark, sf_dir, name):
    """Medians, histories and last observations are told without texts: the join with the texts comes after those by author."""
    from spreadlens.plans.queries import QUERIES

    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join " in line and ("digest#" in line or "author" in line)]
    assert len(joins) > 1 and "digest#" in joins[0]
