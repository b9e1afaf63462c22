"""The routes taken for large or skewed inputs give what brute force gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadlens.functions import grams
from spreadlens.operators import baselines, ranks, sampling, similarity
from spreadlens.session import scratch_path
from spreadlens.sources import views
from spreadlens.sources.readers import path_exists

WORDS = "town hall thursday health care vote farm bill remember joined party night final score match".split()


def texts(seed, n, copies):
    """Distinct texts, `copies` of them near copies of one: a hot group."""
    rng = random.Random(seed)
    base = " ".join(rng.choices(WORDS, k=25))
    rows = [(i, f"{base} {i}") for i in range(copies)]
    return rows + [(i, " ".join(rng.choices(WORDS, k=12)) + f" {i}") for i in range(copies, n)]


def dense(spark, df):
    rows = similarity.hash_vectors(df, "id", "text").orderBy("id").collect()
    return [r.id for r in rows], np.stack([np.frombuffer(r.vec, "<f4") / np.sqrt(r.sq) for r in rows])


@pytest.mark.parametrize("block_rows", [7, 4096])
@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_linked_pairs_equal_brute_force(spark, threshold, block_rows):
    df = spark.createDataFrame(texts(1, 90, 30), "id bigint, text string")
    ids, matrix = dense(spark, df)
    sims = np.round(matrix @ matrix.T, 6)
    expected = {(ids[i], ids[j]) for i in range(90) for j in range(i + 1, 90) if sims[i, j] >= threshold}
    vectors = similarity.hash_vectors(df, "id", "text")
    found = similarity.linked_pairs(vectors, "id", threshold, block_rows=block_rows).collect()
    assert len(found) == len({(r.a, r.b) for r in found})
    assert {(r.a, r.b) for r in found} == expected
    forest = similarity.linked_pairs(vectors, "id", threshold, forest=True, block_rows=block_rows)
    assert forest.count() <= len(expected)
    roots = lambda pairs: {r.node: r.root for r in similarity.fold_members(pairs).collect()}
    all_pairs = spark.createDataFrame(sorted(expected), "a bigint, b bigint")
    assert roots(forest) == roots(all_pairs)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)]
    pairs = spark.createDataFrame(links, "a bigint, b bigint")
    expected = {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}
    rows = similarity.fold_members(pairs).collect()
    assert len(rows) == len(expected) and {r.node: r.root for r in rows} == expected


def test_nearest_blocked_equals_whole(spark):
    df = spark.createDataFrame(texts(2, 60, 10), "id bigint, text string")
    vectors = similarity.hash_vectors(df, "id", "text")
    whole = sorted(map(tuple, similarity.nearest(vectors, vectors, 3).collect()))
    blocked = sorted(map(tuple, similarity.nearest(vectors, vectors, 3, block_rows=8).collect()))
    assert whole == blocked and len(whole) == 180


def test_long_and_packed_embeddings_agree(spark):
    df = spark.createDataFrame(texts(3, 20, 3) + [(99, "")], "id bigint, text string")
    ids, matrix = dense(spark, df.where("id <> 99"))
    for r in similarity.hash_embed(df, "id", "text").collect():
        assert abs(matrix[ids.index(r.id), r.dim] - r.w) < 1e-6
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1)
    assert similarity.hash_vectors(df.where("id = 99"), "id", "text").first().sq == 0
    with pytest.raises(ValueError):
        similarity.hash_embed(df, "id", "text", dim=8)


def test_matching(spark):
    templates = spark.createDataFrame([(1, "do you remember when you joined x? i do!"), (2, "claim your airdrop now")], "id bigint, normalised string")
    posts = spark.createDataFrame(
        [(1, "do you remember when you joined x? i do!"), (2, "do you remember when you joined x? i sure do!"), (3, "the senate votes on the farm bill tuesday")],
        "id bigint, normalised string",
    )
    got = {r.id: (r.template_id, r.similarity) for r in similarity.match_templates(posts, templates).collect()}
    assert got[1] == (1, 1.0)
    assert got[2][0] == 1 and 0.55 <= got[2][1] < 1
    assert got[3][0] is None and got[3][1] < 0.55
    none = similarity.match_templates(posts, templates.limit(0)).collect()
    assert {(r.template_id, r.similarity) for r in none} == {(None, 0.0)}


def test_leave_one_out_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.6 else f"a{rng.randrange(25)}", rng.choice([None, rng.randrange(4), rng.randrange(10**6)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, author_id string, like_count bigint")
    got = {r.id: (r.loo_median, r.known) for r in baselines.leave_one_out_medians(df).select("id", "loo_median", "known").collect()}
    for i, author, _ in rows:
        others = [likes or 0 for j, a, likes in rows if a == author and j != i]
        assert got[i] == ((float(np.median(others)), 1.0) if len(others) >= 2 else (0.0, 0.0))


def test_ranked_values(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-5, 5) * 10 ** rng.randrange(-3, 6), 4) for _ in range(400)] + [0.0, -0.5, 2.0, 2.0]
    df = spark.createDataFrame([("k", v) for v in values], "key string, value double")
    for r in ranks.ranked_values(df, ["key"], "value").collect():
        assert (r.n, r.below, r.total) == (values.count(r.value), sum(v < r.value for v in values), len(values))


def test_sampling(spark):
    df = spark.range(1000)
    ranked = sampling.hash_ranked(df, "id", 3)
    assert sorted(r.hash_rank for r in ranked.collect()) == list(range(1, 1001))
    first = {r.id for r in ranked.where("hash_rank <= 137").collect()}
    assert {r.id for r in sampling.sample_rows(df, 137, "id", 3).collect()} == first
    assert sampling.sample_rows(df, 5000, "id", 3).count() == 1000


def test_turing_test_tells_junk_from_copies(spark):
    from spreadlens.operators import drafting

    rng = random.Random(6)
    real = [(i, " ".join(rng.choices(WORDS, k=14))) for i in range(60)]
    copies = [(100 + i, " ".join(rng.choices(WORDS, k=14))) for i in range(8)]
    junk = [(200 + i, f"CLAIM ur airdrop $$$ {i} wagmi ser gm") for i in range(8)]
    embed = lambda rows: similarity.unit_arrays(spark.createDataFrame(rows, "id bigint, text string"), "text")
    assert drafting.turing_test(embed(junk), embed(real)).first().auc > 0.8
    assert drafting.turing_test(embed(copies), embed(real)).first().auc < 0.8
    with pytest.raises(ValueError):
        drafting.turing_test(embed(copies[:1]), embed(real))


def test_vectors_are_copied_once_for_each_block(spark):
    df = spark.createDataFrame(texts(3, 200, 20), "id bigint, text string")
    vectors = similarity.hash_vectors(df, "id", "text")
    copies = similarity.block_copies(vectors, 7)
    assert copies.count() == 7 * 200
    assert copies.groupBy("i", "j").count().count() == 28
    text = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


@pytest.mark.parametrize("scale", [1, 100, 10**6])
def test_pairs_are_met_without_a_shuffle(spark, scale):
    """Blocks are read again instead of copied; components of any kind of number hold from one link per vector and task."""
    rng = np.random.default_rng(5)
    base = rng.integers(-100, 100, (12, 16))
    rows = [(i, [float(x) for x in (base[i % 12] + rng.integers(-9, 9, 16)) * scale]) for i in range(120)]
    vectors = similarity.pack_arrays(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v")
    matrix = np.array([r[1] for r in rows], np.float32).astype(float)
    lengths = np.sqrt((matrix**2).sum(axis=1))
    sims = np.round(matrix @ matrix.T / np.sqrt(np.outer(lengths**2, lengths**2)), 6)
    expected = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.98}
    pairs = similarity.linked_pairs(vectors, "id", 0.98, block_rows=16)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = pairs.collect()
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected) > 100
    assert all(r.similarity == sims[r.a, r.b] for r in found)
    one_task = similarity.linked_pairs(vectors.coalesce(1), "id", 0.98, forest=True, block_rows=16)
    members = lambda p: sorted(map(tuple, similarity.fold_members(p).collect()))
    assert members(one_task) == members(spark.createDataFrame(sorted(expected), "a bigint, b bigint"))


def test_codes_in_python_equal_those_of_the_jvm(spark):
    from pyspark.sql import functions as F

    from spreadlens.functions.grams import hashed_grams, word_codes

    names = ["a", "it", "the", "über", "a\U0001f600b", "x" * 40, "1,5"]
    df = spark.createDataFrame([(w,) for w in names], "w string")
    for hash_name in ("md5", "xxhash64"):
        rows = [r.c for r in df.select(word_codes(F.col("w"), 64, (3, 5), hash_name).alias("c")).collect()]
        codes, ends = hashed_grams(names, 64, (3, 5), hash_name)
        assert rows == [codes[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_scratch_needs_a_shared_folder_off_a_local_master():
    from types import SimpleNamespace

    from spreadlens.session import shared_dir

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_hot_author_is_spread(spark):
    """One author with most rows: every row gets the median of the author's others."""
    from spreadlens.operators.baselines import leave_one_out_medians

    rows = [(i, "hot", 0 if i % 3 else i) for i in range(600)] + [(1000 + i, f"a{i % 40}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, author_id string, like_count bigint")
    got = leave_one_out_medians(df).collect()
    assert len(got) == 1000
    values = [r[2] for r in rows if r[1] == "hot"]
    for r in got[:200]:
        if r.author_id == "hot":
            others = list(values)
            others.remove(r.like_count)
            assert r.loo_median == float(np.median(others))


def test_own_embedder(spark):
    """Vectors of a caller's own model take the hashed grams' place."""
    from spreadlens.operators import drafting

    def first_letter(df, id_col, text_col):
        letters = F.array(*[F.when(F.col(text_col).startswith(x), 1.0).otherwise(0.0).cast("float") for x in "abc"])
        return similarity.pack_arrays(df.select(F.col(id_col).alias("id"), letters.alias("v")), "id", "v")

    posts = spark.createDataFrame([(1, "apple"), (2, "berry"), (3, "cherry")], "id bigint, normalised string")
    items = spark.createDataFrame([("x", "bond"), ("y", "axe")], "id string, normalised string")
    got = {r.id: r.template_id for r in similarity.match_templates(posts, items, embed=first_letter).collect()}
    assert got == {1: "y", 2: "x", 3: None}
    own = spark.createDataFrame([("a", 1, "axe"), ("a", 2, "bond")], "author string, id bigint, text string")
    intents = spark.createDataFrame([("a", "i", "berry")], "author string, intent_id string, intent string")
    assert [r.id for r in drafting.retrieve_exemplars(own, intents, 1, embed=first_letter).collect()] == [2]


def test_equal_reads_are_numbered_by_publication(spark):
    """Reads that tie on version and likes: the window holds the one within it, whatever order the rows come in."""
    from spreadlens.operators import learn

    rows = [("p", f"2024-01-{d:02d} 00:00:00", "2024-01-09 00:00:00", 5) for d in (8, 1, 7, 2, 6, 3)]
    for order in (rows, rows[::-1]):
        reads = spark.createDataFrame(order, "id string, c string, v string, likes long").selectExpr(
            "id", "cast(c as timestamp) as created_at", "cast(v as timestamp) as version", "likes"
        )
        points = learn.poll_points(reads.coalesce(1), 2)
        assert sorted((r.read, r.minutes) for r in points.collect()) == [(1, 8 * 1440.0), (2, 7 * 1440.0)]
        assert [(r.read, r.minutes) for r in learn.poll_window(points, 3 * 1440.0).collect()] == [(2, 7 * 1440.0)]


def test_final_posts_are_the_latest_posts(spark, tmp_path):
    """Last observations are told without their texts: repeated documents and events, missing texts and reposts."""
    from spreadlens.operators import snapshots
    from spreadlens.sources import views

    texts = ["RT @u: said before", "RT", None, "", "see http://x.y now", "plain", "plain", "\U0001f600\U0001f600\U0001f600\U0001f600 four signs"]
    docs = [(k % 7, "de" if k % 2 else None, x) for k, x in enumerate(texts)]
    spark.createDataFrame(docs[:7] + docs[5:6], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = ("click", "view", "signup", "error", "purchase", None)
    events = [(k, k % 9, kinds[k % 6], f"2024-01-01 {k % 24:02d}:00:00" if k % 31 else None, float(k)) for k in range(10**18, 10**18 + 300)]
    frame = spark.createDataFrame(events + events[:20], "event_id long, user_id long, event_type string, ts string, value double")
    frame.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    final = views.final_posts(spark, str(tmp_path))
    rows = lambda df: sorted(map(repr, df.collect()))
    expected = rows(snapshots.latest(views.posts(spark, str(tmp_path))))
    assert rows(final) == expected and len(expected) > 50
    ranked = [line for line in final._jdf.queryExecution().optimizedPlan().toString().splitlines() if "WindowGroupLimit" in line or "Window [" in line]
    assert ranked and "body" not in "".join(ranked) and "text" not in "".join(ranked)


def test_medians_move_no_text(spark):
    """What a caller drops after the medians isn't read for them."""
    df = spark.createDataFrame([(str(k), "a", k, "x" * 50) for k in range(5)], "id string, author_id string, like_count long, body string")
    got = baselines.leave_one_out_medians(df).select("id", "loo_median")
    hashed = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "xxhash64" in line]
    assert hashed and "body" not in "".join(hashed)
    assert got.count() == 5


def test_copies_of_a_body_are_dropped_before_they_are_grouped(spark):
    from spreadlens.operators import templates

    bodies = [None, "", "a", "b\u00fc", "a"] * 400
    posts = spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)
    found = templates.distinct_bodies(posts)
    assert sorted(r.body for r in found.collect()) == ["", "a", "b\u00fc"]
    assert "drop_copies" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.raw for r in found.collect()} == {r.raw for r in posts.selectExpr("md5(coalesce(body, '')) as raw").distinct().collect()}


@pytest.mark.parametrize("block_rows", [16, 4096])
@pytest.mark.parametrize("kind", ["mixed", "copies"])
def test_nearest_equals_brute_force_without_a_shuffle_of_vectors(spark, block_rows, kind):
    """Tops carried over blocks, with zero vectors, tiny and huge ones, and many equal ones whose ties go by id."""
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((150, 8)).astype("<f4")
    rows[40:60] = rows[3]
    rows[70] = 0
    rows[80] *= np.float32(1e-18)
    rows[81] *= np.float32(1e18)
    if kind == "copies":
        rows[20:] = rows[3]
    ids = [int(i) for i in rng.permutation(150)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows)], "id bigint, v array<float>").repartition(3)
    vectors = similarity.pack_arrays(df, "id", "v")
    found = similarity.nearest(vectors, vectors, 4, block_rows=block_rows)
    before_the_merge = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]
    assert "CartesianProduct" in before_the_merge and "Exchange" not in before_the_merge
    lengths = np.linalg.norm(rows.astype(float), axis=1)
    products = np.outer(lengths, lengths)
    sims = np.round(np.divide(rows.astype(float) @ rows.astype(float).T, products, out=np.zeros((150, 150)), where=products > 0), 6)
    expected = {(ids[a], p + 1, ids[b]) for a in range(150) for p, b in enumerate(sorted(range(150), key=lambda b: (-sims[a, b], ids[b]))[:4])}
    assert {(r.query_id, r.position, r.item_id) for r in found.collect()} == expected


def test_each_distinct_gram_is_hashed_once(monkeypatch):
    """Of a thousand words that share all their grams but a few, and the numbers are those of each word by itself."""
    import hashlib

    from spreadlens.functions import grams

    words = [f"vor{k % 10}zug{k // 10 % 10}ende{k // 100}\U0001f600" for k in range(1000)] + ["", "ÿ"]
    asked = []
    monkeypatch.setattr(grams, "_md5_number", lambda gram: asked.append(gram) or int(hashlib.md5(gram.encode()).hexdigest()[:8], 16))
    codes, ends = grams.hashed_grams(words, 64, (3, 5))
    assert len(asked) == len(set(asked)) < 1000
    for word, a, b in zip(words, ends[:-1], ends[1:]):
        padded = f" {word} "
        own = [padded[i : i + n] for n in range(3, min(5, max(3, len(padded))) + 1) for i in range(max(len(padded) - n + 1, 1))]
        numbers = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) for g in own]
        assert codes[a:b].tolist() == [v % 64 * 2 + v // 64 % 2 for v in numbers]


@pytest.mark.parametrize("name", ["stream_latest", "materialise_incremental"])
def test_texts_are_kept_out_of_written_observations(spark, sf_dir, monkeypatch, name):
    """What is copied, shuffled and written for each observation holds no text, and the posts made of it are the same."""
    from spreadlens.plans import queries

    paths = []
    monkeypatch.setattr(queries, "scratch_path", lambda s, kind: paths.append(scratch_path(s, kind)) or paths[-1])
    queries.QUERIES[name](spark, sf_dir).count()
    written = [p for path in paths for p in (path, f"{path}/log") if path_exists(spark, f"{p}/*.parquet") or path_exists(spark, f"{p}/*=*")]
    assert written and all(not {"body", "text"} & set(spark.read.parquet(p).columns) for p in written)
    narrow = views.with_bodies(views.narrow_posts(spark, sf_dir), views.post_texts(spark, sf_dir))
    posts = views.posts(spark, sf_dir)
    assert narrow.columns == posts.columns and narrow.exceptAll(posts).isEmpty() and posts.exceptAll(narrow).isEmpty()


def test_a_rerun_leaves_the_hours_alone(spark):
    """Only the hours that are missing are written; those that lie there keep their files."""
    import glob

    from spreadlens.sources import readers

    posts = spark.range(300).selectExpr("cast(id as string) as id", "id % 6 as file_index")
    path = scratch_path(spark, "rerun")
    readers.materialise_new_hours(posts.where("file_index < 4"), path)
    before = set(glob.glob(f"{path}/file_index=*/*.parquet"))
    readers.materialise_new_hours(posts, path)
    after = set(glob.glob(f"{path}/file_index=*/*.parquet"))
    assert before < after and {f.split("file_index=")[1][0] for f in after - before} == {"4", "5"}
    readers.materialise_new_hours(posts, path)
    assert set(glob.glob(f"{path}/file_index=*/*.parquet")) == after
    assert spark.read.parquet(path).count() == 300


def test_long_embedding_adds_rows_of_one_id_as_they_pass(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EMBEDDED_ROWS", 3, raising=False)
    rows = [(1, "vote today"), (1, None), (1, "vote for us all"), (None, "a"), (None, "bb cc"), (2, ""), (3, None)] + [(9, "again")] * 8
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    embedded = similarity.hash_embed(df, "id", "text")
    # No gram is shuffled or aggregated: one exchange, of texts.
    plan = embedded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    whole = spark.createDataFrame([(1, "vote today vote for us all"), (None, "a bb cc"), (9, " again" * 8)], "id bigint, text string")
    want = {}
    for r in whole.select("id", F.explode(grams.gram_codes(F.col("text"))).alias("code")).collect():
        own = want.setdefault(r.id, {})
        own[r.code // 2] = own.get(r.code // 2, 0) + (1 - 2 * (r.code % 2))
    got = {}
    for r in embedded.collect():
        got.setdefault(r.id, {})[r.dim] = r.w
    for own in want.values():
        norm = sum(v * v for v in own.values()) ** 0.5
        for k in [k for k, v in own.items() if not v]:
            del own[k]
        own.update({k: v / norm for k, v in own.items()})
    assert got == want
