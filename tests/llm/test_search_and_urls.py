"""URL rules and neighbour search against plain computations; the classifier; the pipeline's stages."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from spreadlens.llm import hnsw, kneser_ney, mixing, url_filter
from spreadlens.llm.common import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "/", "block"), ("b", "/ab", "allow"), ("b", "/ab", "block"), ("c.example.org", "", "allow")]
URLS = [
    "https://www.Example.ORG/es/x?q=1#f", "http://example.org/en/12", "http://example.org/en/2", "http://a.b.c.example.org", "ftp://x.COM/de/", "x.com/de/",
    None, "", "://", "://org/", "http://org/", "http://notorg/", "https://com?x=/fr/", "http://a.b/ab", "http://z.a.b/abc", "http://b/abc", "http://ex ample.com/fr/ y",
    "http://example.org/es/x", "http://example.org/es/x", "http://é.org/", "http://.org/", "http://org./", "file:///org/", "http://a://b.org/",
]


def judged(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(x) for x in "/?#" if x in rest], default=len(rest))
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(x) for x in "?#" if x in path], default=len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_urls(spark):
    pages = [(i if i % 5 else None, u, "html") for i, u in enumerate(URLS * 2)] + [(7, "http://www.example.org/es/hot", None)] * 300
    df = spark.createDataFrame(pages, "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = brute.nones_first(map(tuple, url_filter.judge_urls(df, rules).collect()))
    assert got == brute.nones_first((i, *judged(u)) for i, u, _ in pages)
    assert url_filter.judge_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}


def neighbours(rows, k=10):
    """{query: [(score, id)]} over usable rows."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = [i for i, _ in usable], np.array([v for _, v in usable])
    return {i: sorted((float(np.sqrt(((x[n] - v) ** 2).sum())), j) for n, j in enumerate(ids) if j != i)[:k] for i, v in usable}


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id bigint, embedding array<double>, shard int, score double")
    expected = neighbours(rows)
    for shard_rows in (8192, 30):
        got = {}
        for r in hnsw.search(hnsw.build_index(df, shard_rows), df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
            assert r["rank"] == len(got[r.query_id])
        assert got == expected
    # One vector of another length, longer ones too, takes no part and leaves the others alone.
    longer = df.unionByName(spark.createDataFrame([(300, [9.0] * 5, 1, 2.0), (400, [9.0] * 7, 1, 2.0)], df.schema))
    assert {r.query_id for r in hnsw.search(hnsw.build_index(longer), longer).collect()} == set(expected)
    few = df.where("vec_id < 3")
    found = hnsw.search(hnsw.build_index(few), few).collect()
    assert len(found) == 6
    assert hnsw.search(hnsw.build_index(df.limit(0)), df).collect() == []
    assert hnsw.search(hnsw.build_index(df), df.limit(0)).collect() == []


def test_recall(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    index = hnsw.build_index(vectors, 128)
    got = {}
    for r in hnsw.search(index, vectors.where("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 10 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(got[q] & set(best)), total + len(best)
    assert hits / total >= 0.9


def test_classifier(spark, odd, nothing, labels, no_labels):
    found = kneser_ney.classify(odd, labels).collect()
    assert len(found) == odd.count() and all((r.bits is None) == (not _text(r.doc_id, odd)) for r in found if r.doc_id is not None and r.doc_id != 13)
    assert all(not r.kept for r in found if r.bits is None)
    assert all(r.kept == (r.bits is not None) for r in kneser_ney.classify(odd, no_labels).collect())
    assert kneser_ney.classify(nothing, labels).collect() == []


def _text(doc_id, odd):
    return next(r.text for r in odd.where(odd.doc_id == doc_id).collect())


def test_kneser_ney_chances_sum_to_one(spark):
    df = spark.createDataFrame([(i, f"the quick brown fox number {i} jumps over {i * i} lazy dogs.") for i in range(50)], "doc_id bigint, text string")
    scores = kneser_ney.Scores(kneser_ney.train(df))
    sums = np.exp2(scores.logs.astype(float)).reshape(-1, 64).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_classifier_on_the_table(spark, sf_dir):
    out = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = out.join(table(spark, sf_dir, "labels"), "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_pipeline_stages(spark, sf_dir):
    from spreadlens.session import stored

    docs = table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stored(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        sizes.append(len(rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        before = [(r.doc_id, r.text) for r in given.collect()]
        if name == "minhash_near_dedup":
            roots = brute.components(before, corpus_pipeline.SHINGLE_WORDS)
            assert sorted(r.doc_id for r in rows) == sorted({i for i in roots if roots[i] == i})
        elif name == "suffix_array_dedup":
            want = {r[0]: r[1:3] for r in brute.repeated(before)}
            assert all(len((r.text or "").encode()) <= want[r.doc_id][0] - want[r.doc_id][1] for r in rows) and len(rows) == len(want)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            copies = {r.doc_id: r.taken // r.size for r in mixing.mix_plan(given).collect() if r.size and r.taken}
            assert {i: [r.doc_id for r in rows].count(i) for i in copies} == copies and len(rows) == sum(copies.values())
        elif name == "piece_encoding":
            assert all(r.round_trip for r in rows) and len(rows) == len(before)
    assert sizes[0] < table(spark, sf_dir, "documents").count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, nothing, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, nothing, sf_dir).collect() == []
