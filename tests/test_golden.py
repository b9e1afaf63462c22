"""Known inputs and outputs of single operators."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spreadlens.functions import text as tx
from spreadlens.functions.messages import ordinal, pasted_text
from spreadlens.functions.verdict import NO_SIGNAL, verdict
from spreadlens.operators import baselines, dialogue, drafting, learn, media, publishing, snapshots, templates
from spreadlens.schemas import require_columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise(spark):
    body = "Do you REMEMBER when you joined X? I do! https://t.co/abc @someone #memories  "
    assert one(spark, tx.normalise(F.lit(body))) == "do you remember when you joined x? i do!"
    assert one(spark, tx.normalise(F.lit("a\t\tb c  www.x.org/y\n d"))) == "a b c d"


def test_counts_and_truncation(spark):
    assert one(spark, tx.word_count(F.lit("one two  three"))) == 3
    assert one(spark, tx.truncate(F.lit("abcdefgh"), 6)) == "abc..."
    with pytest.raises(ValueError):
        tx.truncate(F.lit("x"), 3)


def test_lexicon(spark):
    hits = one(spark, tx.lexicon_hits(F.lit("POV: you lowkey love the farm bill 💀")))
    assert hits == ["pov:", "lowkey", "💀"]
    assert one(spark, tx.lexicon_hits(F.lit("recapitulate"))) == []
    assert not one(spark, tx.uses_lexicon(F.lit("recapitulate")))


def test_spoken_text_and_mood(spark):
    post = "Town hall Thursday 6pm! Details: https://t.co/x @sam #Vermont"
    assert one(spark, tx.spoken_text(F.lit(post))) == "Town hall Thursday 6pm! Details: sam Vermont"
    assert one(spark, tx.mood(F.lit("BREAKING!! THIS IS HUGE!"))).startswith("urgent")
    assert one(spark, tx.mood(F.lit("a quiet note."))).startswith("calm")
    assert one(spark, tx.mood(F.lit("who knows?"))).startswith("curious")


def test_captions(spark):
    posts = spark.createDataFrame([("a", "one two three four five six seven")], "id string, text string")
    timed = media.timed_words(posts, wpm=120)
    rows = media.captions(timed).orderBy("caption").collect()
    assert [r.text for r in rows] == ["one two three four", "five six seven"]
    assert rows[0].start_s == 0.0 and rows[1].end_s == 3.5
    assert media.even_captions(posts, wpm=120).orderBy("caption").collect() == rows


def test_verdict(spark):
    def judged(*values):
        return one(spark, verdict(*[F.lit(v) for v in values]))

    quiet = judged(10, 10, 0.0, 0.0, "do you remember")
    assert quiet.score == 0.0 and quiet.reasons == [NO_SIGNAL] and not quiet.is_spam
    loud = judged(10, 20, 0.9, 0.7, "minted now")
    assert loud.score == 1.0 and len(loud.reasons) == 4 and loud.is_spam
    assert loud.reasons[0] == "accounts repeat it: 2.0 posts per author"
    assert loud.reasons[3] == "crypto copy: mint"


def test_leave_one_out_medians(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 1000), ("b", 5)], "author_id string, like_count bigint")
    got = {(r.author_id, r.like_count): (r.loo_median, r.known) for r in baselines.leave_one_out_medians(df).collect()}
    assert got == {("a", 0): (505.0, 1.0), ("a", 10): (500.0, 1.0), ("a", 1000): (5.0, 1.0), ("b", 5): (0.0, 0.0)}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="version"):
        require_columns(spark.range(1), ["id", "version"])
    with pytest.raises(ValueError, match="music_id"):
        templates.cluster_sounds(spark.range(1))


def test_sounds(spark):
    start = datetime(2024, 5, 1, 12)
    rows = [(f"v{i}", f"c{i % 12}", "m1", "song", start + timedelta(minutes=i)) for i in range(30)]
    rows += [(f"w{i}", f"c{i}", "m2", "other", start) for i in range(4)]
    videos = spark.createDataFrame(rows, "video_id string, creator_id string, music_id string, music_title string, created_at timestamp")
    found = templates.sounds(videos, 5).collect()
    assert [(s.music_id, s.creators, s.videos) for s in found] == [("m1", 12, 30)]
    assert sum(p.posts for p in found[0].curve) == 30


def test_missing_likes_count_as_none(spark):
    start = datetime(2024, 5, 1)
    rows = [("p", "a", start, start + timedelta(minutes=m), likes, 1) for m, likes in ((5, None), (10, 4), (20, 9))]
    df = spark.createDataFrame(rows, "id string, author_id string, created_at timestamp, version timestamp, like_count bigint, views_count bigint")
    points = snapshots.trajectories(df)
    assert [r.likes for r in points.orderBy("minutes").collect()] == [0, 4, 9]
    assert [r.likes for r in snapshots.observe(points, 12).orderBy("minutes").collect()] == [0, 4]
    assert [r.likes for r in snapshots.observe(points, 1).collect()] == [0]


def test_compare_forecast(spark):
    points = spark.createDataFrame(
        [("h", 5.0, 10), ("h", 25.0, 40), ("h", 45.0, 90), ("d", 3000.0, 80), ("d", 4400.0, 95)], "id string, minutes double, likes bigint"
    )
    forecasts = spark.createDataFrame([("h", 100.0, 40.0), ("d", 100.0, None), ("none", 1.0, None)], "id string, likes_1d double, likes_1h double")
    got = {r.id: (r.observed, r.predicted, r.verdict) for r in learn.compare_forecast(points, forecasts).collect()}
    assert got == {
        "h": (40, 20.0, "ahead of forecast at 30 minutes"),
        "d": (95, 100.0, "on track at 3 days"),
        "none": (0, 0.0, "no observations yet"),
    }


def test_parse_completions(spark):
    raws = [
        "Here:\n[" + ", ".join('{"text": "Let\\\'s talk %d", "why": "w"}' % i for i in range(1, 6)) + "]",
        "\n".join(f"{i}. Draft {i} here" for i in range(1, 6)),
        "1. only one",
        json.dumps([{"text": f"Post {i}.", "why": "short"} for i in range(1, 7)]),
        json.dumps(["a", "b", "c", "d", {"text": "e"}, 3]),
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "id bigint, completion string")
    rows = drafting.parse_completions(df).orderBy("id", "ordinal").collect()
    texts = {i: [r.text for r in rows if r.id == i] for i in range(5)}
    assert texts[0] == [f"Let's talk {i}" for i in range(1, 6)]
    assert texts[1] == [f"Draft {i} here" for i in range(1, 6)]
    assert texts[2] == [None] and "parsed 1" in next(r.error for r in rows if r.id == 2)
    assert texts[3] == [f"Post {i}." for i in range(1, 6)]
    assert texts[4] == list("abcde")


def test_failing_completer_becomes_rows(spark):
    def factory():
        def complete(system, request):
            raise RuntimeError("no answer")

        return complete

    prompts = spark.createDataFrame([(1, "s", "r")], "id bigint, system string, request string")
    assert drafting.batch_complete(prompts, factory).first().error == "RuntimeError: no answer"


def test_draft_errors_are_rows(spark):
    requests = spark.createDataFrame(
        [(1, "a", "say hello", None, None), (2, "a", " ", None, None), (3, "b", "say hello", None, None)],
        "id bigint, author string, intent string, template_text string, template_authors bigint",
    )
    sets = spark.createDataFrame([("a", ["one post"])], "author string, posts array<string>")
    rows = drafting.draft(requests, sets).collect()
    assert sorted((r.id, r.error) for r in rows if r.error) == [(2, "intent is empty"), (3, "exemplars are empty")]
    assert sorted(r.ordinal for r in rows if r.id == 1) == [1, 2, 3, 4, 5]


def test_validation(spark):
    rows = publishing.validate_posts(spark.createDataFrame([(1, "  "), (2, "x" * 281), (3, " ok ")], "id bigint, text string")).collect()
    assert [(r.id, r.ok, r.reason) for r in sorted(rows)] == [
        (1, False, "post text is empty"), (2, False, "post is 281 characters; the limit is 280"), (3, True, None),
    ]


def test_budget(spark):
    at = datetime(2024, 1, 1)
    queue = [("a", "http://x"), ("a", "plain"), ("a", "http://y"), ("a", "http://z"), ("a", "plain")]
    rows = [(str(i), author, at + timedelta(minutes=i), text) for i, (author, text) in enumerate(queue)]
    df = spark.createDataFrame(rows, "id string, author_id string, created_at timestamp, text string")
    got = {r.id: r.admitted for r in publishing.budget_admission(df, 500).collect()}
    assert got == {"0": True, "1": True, "2": True, "3": False, "4": True}
    assert not any(r.admitted for r in publishing.budget_admission(df, 10).collect())


def test_messages(spark):
    assert one(spark, ordinal(F.lit("post the second one"))) == 2
    assert one(spark, ordinal(F.lit("post it"))) == 1
    assert one(spark, ordinal(F.lit("make draft 3 a clip"))) == 3
    assert one(spark, pasted_text(F.lit('what is "do you remember when you joined x"?'))) == "do you remember when you joined x"
    assert one(spark, pasted_text(F.lit("explain this: hello there friend"))) == "hello there friend"


def test_routing_with_memory(spark):
    said = [
        ("What are people posting this hour?", "listen"),
        ('Someone posted this at me, what does it mean: "do you remember when you joined x? i do!"', "explain"),
        ("Help me announce Thursday's town hall.", "draft"),
        ("how did it do?", "draft"),
        ("Post the third one.", "ship"),
        ("how did it do?", "learn"),
        ("Turn the third one into a TikTok.", "render"),
        ("score draft 2", "score"),
        ("hi", "help"),
    ]
    turns = spark.createDataFrame([(0, i, m) for i, (m, _) in enumerate(said)], "conv_id bigint, turn bigint, text string")
    rows = dialogue.route_messages(turns).orderBy("turn").collect()
    assert [r.tool for r in rows] == [tool for _, tool in said]
    assert [rows[i]["index"] for i in (4, 6, 7)] == [3, 3, 2]


def test_intents_that_cannot_be_answered_are_refused_in_their_rows(spark):
    from spreadlens.operators import drafting

    posts = spark.createDataFrame([("a", 1, "the new road opens"), ("a", 2, "tea at four")], "author string, id bigint, text string")
    intents = spark.createDataFrame([("a", "x", "the road"), ("a", "y", " \t"), ("b", "z", "the road"), ("a", "n", None)], "author string, intent_id string, intent string")
    rows = drafting.retrieve_exemplars(posts, intents, 1).collect()
    assert {(r.intent_id, r.id, r.error) for r in rows} == {("x", 1, None), ("y", None, drafting.NO_INTENT), ("n", None, drafting.NO_INTENT), ("z", None, drafting.NO_POSTS)}
