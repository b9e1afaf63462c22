"""Candidates by hyperplane signatures against all pairs: recall of links, planted chains, crowded keys."""

import random

import numpy as np
import pytest

from spreadlens.operators import similarity

SPELLER = random.Random(1)
WORDS = ["".join(SPELLER.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(SPELLER.randrange(4, 9))) for _ in range(600)]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for chain in range(n):
        words = [rng.choice(WORDS) for _ in range(18)]
        out.append(" ".join(words))
        # A chain: each copy differs from the last one by a word or two.
        for _ in range(chain % 4):
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    return [(f"{k:05d}", t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def vectors(spark):
    from spreadlens.session import stored

    return stored(similarity.hash_vectors(spark.createDataFrame(texts(5, 500), "id string, text string"), "id", "text"), "bands-test")


def links(pairs):
    return {(r.a, r.b): r.similarity for r in pairs.collect()}


def roots(pairs):
    return {r.node: r.root for r in similarity.fold_members(pairs).collect()}


def test_recall_and_exact_similarity(vectors):
    exact = links(similarity.linked_pairs(vectors, "id", 0.75))
    found = links(similarity.linked_pairs(vectors, "id", 0.75, candidates="bands"))
    assert found.items() <= exact.items() and len(found) >= 0.95 * len(exact) > 100


def test_planted_chains_have_the_same_components(vectors):
    assert roots(similarity.linked_pairs(vectors, "id", 0.85, candidates="bands")) == roots(similarity.linked_pairs(vectors, "id", 0.85))


@pytest.mark.parametrize("forest", [False, True])
def test_crowded_keys_meet_in_blocks(spark, monkeypatch, forest):
    monkeypatch.setattr(similarity, "HOT_ROWS", 3)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rows = texts(9, 40) + [(f"x{k:03d}", "the same long text of very many accounts about the river " + WORDS[k]) for k in range(60)]
    vectors = similarity.hash_vectors(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    exact = similarity.linked_pairs(vectors, "id", 0.8, block_rows=4096)
    found = similarity.linked_pairs(vectors, "id", 0.8, forest=forest, candidates="bands")
    assert roots(found) == roots(exact)
    if not forest:
        assert len(links(found)) >= 0.95 * len(links(exact))


def test_few_or_empty_vectors_and_wrong_names(spark):
    one = similarity.hash_vectors(spark.createDataFrame([("a", "some text"), ("b", "")], "id string, text string"), "id", "text")
    assert similarity.linked_pairs(one, "id", 0.75, candidates="bands").count() == 0
    with pytest.raises(ValueError, match="candidates"):
        similarity.linked_pairs(one, "id", 0.75, candidates="some")


def test_mean_of_unit_vectors(vectors):
    rows = vectors.collect()
    units = np.stack([np.frombuffer(r.vec, "<f4") / np.sqrt(r.sq) for r in rows])
    assert similarity.mean_unit(vectors) == pytest.approx(units.mean(axis=0))
