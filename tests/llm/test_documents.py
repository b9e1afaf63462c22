"""Operators on documents, held against plain computations on odd rows, empty tables and clashing columns."""

import math
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import rows

from spreadlens.llm import minhash_forest, mixing, quality_rules, suffix_dedup, suffix_tree_lm

ROWS = rows()
PAIRS = [(r[0], r[1]) for r in ROWS]


def test_quality_measures(odd, labels, no_labels, nothing):
    found = quality_rules.quality_rules(odd, labels).collect()
    got = brute.nones_first([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in found])
    assert got == brute.nones_first([(i, *brute.measures(t)[:4]) for i, t in PAIRS])
    repeats = Counter((r.doc_id, r.n_repeat_words) for r in found if r.n_words < 5000)
    assert repeats == Counter((i, brute.measures(t)[4]) for i, t in PAIRS if brute.measures(t)[0] < 5000)
    assert all(r.n_repeat_words == 20_000 for r in found if r.doc_id == 11)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in found)
    # Too few labels certify nothing.
    assert all(r.kept != r.base_failed for r in found)
    assert quality_rules.quality_rules(nothing, no_labels).collect() == []
    kept = quality_rules.passing_documents(odd, labels)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if r.kept)


def test_certified_cutoffs_keep_the_risk(spark):
    """The largest k is that of the exact tail, and a rule with enough clean labels is found."""
    from pyspark.sql import functions as F

    for n, limit, level in ((500, 0.01, 1e-3), (2000, 0.01, 1e-3), (5000, 0.02, 1e-6), (0, 0.01, 0.5)):
        tail, best = 0.0, -1
        for k in range(n + 1):
            tail += math.comb(n, k) * limit**k * (1 - limit) ** (n - k)
            if tail > level:
                break
            best = k
        k = spark.range(1).select(quality_rules._most_errors(F.lit(n).cast("long"), limit, level).alias("k")).first().k
        assert k == best or n == 0
    good = [(i, "word%d " % i + " ".join(f"w{i}_{k}" for k in range(60)), "en") for i in range(3000)]
    bad = [(i, " ".join(f"w{i}_{k}%%%" for k in range(60)), "en") for i in range(3000, 3300)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    known = spark.createDataFrame([(i, int(i < 3000)) for i in range(3300)], "doc_id bigint, quality int")
    out = quality_rules.quality_rules(docs, known).collect()
    assert {r.doc_id for r in out if not r.kept} == set(range(3000, 3300))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, odd, nothing, width):
    found = minhash_forest.near_duplicates(odd, width=width).collect()
    expected = brute.components(PAIRS, width)
    assert len(found) == len(ROWS)
    for r in found:
        assert r.component_id == expected.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((i, len(brute.shingles(t, width))) for i, t in PAIRS)
    assert minhash_forest.near_duplicates(nothing, width=width).collect() == []
    kept = minhash_forest.kept_documents(odd, width=width)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in expected if expected[i] == i}) and ids.count(None) == 2


def test_near_duplicates_in_crowded_regions_and_large_groups(spark):
    """Small bounds force deep regions, blocks, pivots and block pairs."""
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(160):
        words = list(base)
        for k in range(i % 20):
            words[(i * 7 + k * 13) % 300] = f"z{i}_{k}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"q{i}_{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    expected = brute.components(docs, 2)
    for region_rows, group_rows in ((8, 10), (50, 30), (1000, 5000)):
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, 2, 80, region_rows, group_rows).collect()}
        assert got == expected


def test_repeated_spans(spark, odd, nothing):
    got = brute.nones_first(map(tuple, suffix_dedup.repeated_spans(odd).collect()))
    assert got == brute.nones_first(brute.repeated(PAIRS))
    assert sum(r[2] for r in got) > 0
    assert suffix_dedup.repeated_spans(nothing).collect() == []
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    for length in (18, 40, 90):
        assert brute.nones_first(map(tuple, suffix_dedup.repeated_spans(odd, length).collect())) == brute.nones_first(brute.repeated(PAIRS, length))


def test_spans_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 128)
    docs = [(i, "".join(chr(97 + (k * k * (1 + i // 3)) % 26) for k in range(700)) + "tail " * i) for i in range(9)]
    tables = [suffix_dedup._stretches(*_flat([t]), 50) for _, t in docs]
    assert all((np_low <= np_high).all() for _, np_low, np_high, _ in tables)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, suffix_dedup.repeated_spans(df).collect())) == sorted(brute.repeated(docs))


def _flat(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.concatenate([np.frombuffer(b"".join(raw), np.uint8), np.zeros(80, np.uint8)]), np.concatenate([[0], np.cumsum([len(b) for b in raw])])


def test_mix(spark, odd, nothing):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(ROWS) and all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in plan)
    assert sum(r.taken for r in plan) <= sum(r.size for r in plan)
    assert mixing.mix_plan(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []
    again = mixing.mix_plan(odd.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, plan))
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.taken // r.size for r in plan if r.size)


def test_mix_targets(spark):
    docs = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    plan = mixing.mix_plan(df).collect()
    by = {}
    for (i, t, s), r in zip(sorted(docs), sorted(plan)):
        x = by.setdefault(s, [0, 0, r.target, r.source_size])
        x[0] += r.taken
        x[1] += r.size
    total = sum(x[1] for x in by.values())
    weights = dict(zip([*sorted(s for s in by if s), None], [5, 2, 1, 5, 2, 1]))
    assert all(x[1] == x[3] and abs(x[0] - x[2]) <= 14 and x[2] <= 3 * x[1] for x in by.values())
    open_ = [s for s in by if by[s][2] < 3 * by[s][1]]
    assert len({round(by[s][2] / weights[s], 6) for s in open_}) == 1
    assert abs(sum(x[2] for x in by.values()) - total) < 1e-6


def test_one_document_and_wordless_sources(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y"), (3, "", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id: (r.size, r.target, r.taken) for r in mixing.mix_plan(df).collect()} == {1: (3, 3.0, 3), 2: (0, 0.0, 0), 3: (0, 0.0, 0)}


def _tokens(text):
    return [*brute.words(text), None]


def test_scores_on_odd_rows(odd, nothing):
    found = suffix_tree_lm.score_texts(odd).collect()
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    counts = Counter(w for i, t in PAIRS if trains(i) for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in PAIRS:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in _tokens(t))
        expected.append((i, not trains(i), len(_tokens(t)), sum(counts[w] > 0 for w in _tokens(t)), n, round(base, 6)))
    assert brute.nones_first((*tuple(r)[:5], round(r.base_score, 6)) for r in found) == brute.nones_first(expected)
    assert suffix_tree_lm.score_texts(nothing).collect() == []


def test_chances_sum_to_one_and_contexts_help(spark):
    """Over all known words and one unknown the chances after any context sum to one; scores are those of the definition."""
    import numpy as np

    rng = np.random.default_rng(5)
    names = [f"v{k}" for k in range(12)]
    texts = []
    for i in range(400):
        state, out = 0, []
        for _ in range(40):
            state = (state * 3 + int(rng.integers(2))) % 12
            out.append(names[state])
        texts.append((i, " ".join(out)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    training = df.where(~suffix_tree_lm.held_out(df.doc_id)).select("text")
    lexicon = suffix_tree_lm.lexicon_of(training)
    tree = suffix_tree_lm.grow(training, lexicon, depth=3, word_share=1e-4, context_share=1e-4, pair_share=1e-4, nats=5.0)
    assert len(tree.node_keys[0]) > 4
    every = tree.tokens + tree.distinct + 1

    def chances(context):
        """P of each known symbol and of one unknown, after the words of a context."""
        p = np.append((tree.counts + 1) / every, 1 / every)
        suffix = 0
        for d, keys in enumerate(tree.node_keys):
            if d >= len(context):
                break
            at = suffix_tree_lm._find(keys, np.array([suffix * tree.width + context[-1 - d]]))[0]
            if at < 0:
                break
            own = suffix_tree_lm._find(tree.pair_keys[d], at * tree.width + np.arange(tree.width))
            p = tree.gammas[d][at] * p
            p[:-1] += np.where(own >= 0, tree.pair_shares[d][own], 0)
            suffix = at
        return p

    for context in ([], [0], [3, 7], [1, 2, 3], [5, 5, 5]):
        assert abs(chances(context).sum() - 1) < 1e-9
    scored = {r.doc_id: r for r in suffix_tree_lm.scored(df, tree, lexicon, 3).collect()}
    for i, text in texts[:25]:
        ids = [tree.words[w] for w in text.split()] + [tree.end]
        want = sum(math.log10(chances(ids[max(0, k - 3) : k])[x]) for k, x in enumerate(ids))
        assert abs(scored[i].score - want) < 1e-6
    held = [r for r in scored.values() if r.held_out]
    assert held and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def test_all_contexts_have_terms(spark):
    """Terms looked up in shards give the scores of the whole tree in memory; a phrase seen five times counts in any corpus."""
    import numpy as np

    rng = np.random.default_rng(8)
    # So many words that a share of the tokens would be above the five times of the phrase.
    docs = [(i, " ".join(f"v{k}" for k in np.minimum(rng.zipf(1.3, 600), 20_000))) for i in range(1400)]
    trains = [i for i in range(1400, 1500) if zlib.crc32(str(i).encode()) % 7 != 2][:5]
    held = next(i for i in range(1500, 1600) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs += [(i, "quixotic zebra flamboyance") for i in [*trains, held]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_tree_lm.score_texts(df).collect()}
    assert len(got) == len(docs) and got[held].train_tokens > 600_000
    assert got[held].score - got[held].base_score > 10
    training = df.where(~suffix_tree_lm.held_out(df.doc_id)).select("text")
    lexicon = suffix_tree_lm.lexicon_of(training)
    tree = suffix_tree_lm.grow(training, lexicon, word_share=0, context_share=0, pair_share=0)
    for r in suffix_tree_lm.scored(df, tree, lexicon, 3).collect():
        assert abs(got[r.doc_id].score - r.score) < 1e-6 and abs(got[r.doc_id].base_score - r.base_score) < 1e-6


def test_crowded_regions_compare_all_pairs(spark):
    """Two similar classes of one crowded region are linked, wherever they stand in it and in whichever range."""
    import numpy as np

    rng = np.random.default_rng(11)
    n = 240
    sketches = rng.integers(-(2**63), 2**63, (n, 2))
    # Members i and i + n / 2 are alike, the others are not; one order's first values are the same for all.
    sketches[n // 2 :] = sketches[: n // 2]
    signatures = rng.integers(0, 2**32, (n, minhash_forest.HASHES), dtype=np.uint32)
    signatures[:, : minhash_forest.DEPTH] = 7
    rows = [(i, 50, int(a), int(b), s.tobytes()) for i, ((a, b), s) in enumerate(zip(sketches, signatures))]
    classes = spark.createDataFrame(rows, "rep long, n_shingles long, s1 long, s2 long, sig binary")
    wanted = {(i, i + n // 2) for i in range(n // 2)}
    for region_rows in (8, 50, 1000):
        assert {tuple(r) for r in minhash_forest.candidate_links(classes, 80, region_rows).collect()} == wanted


def test_suffix_tree_holds_bounded_batches(monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "BATCH_BYTES", 100, raising=False)
    texts = ["a" * 60, None, "b" * 60, "", "c" * 500, "d"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(18)), pa.array(texts)], names=["doc_id", "text"])
    slices = [b.column(1).to_pylist() for b in suffix_tree_lm._texts(iter([batch]))]
    assert sum(slices, []) == texts
    assert all(sum(len(t or "") for t in own[:-1]) <= 100 for own in slices)


def test_suffix_tree_asks_without_copies_of_all_keys():
    rng = np.random.default_rng(2)
    n, parts = 200_000, 8
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)[rng.integers(0, 5000, n)]
    place, doc = np.arange(n) % 100, np.arange(n) // 100
    every = np.full(1 << 10, 255, np.uint8)
    tracemalloc.start()
    asked, told = 0, Counter()
    for part, distinct, keys, rest in suffix_tree_lm._asks(every, 2, parts, hashes, place, doc):
        keys, times = np.frombuffer(keys, np.uint64), np.frombuffer(rest[: 4 * distinct], np.uint32)
        owners = np.frombuffer(rest[4 * distinct :], np.uint16)
        assert (np.diff(keys.astype(object)) > 0).all() and set(suffix_tree_lm._part(keys, parts).tolist()) == {part} and times.sum() == len(owners)
        told.update(owners.tolist())
        asked += len(owners)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Every token asks for its context and itself at both depths, where its text has as many words before it.
    assert asked == 2 * ((place >= 1).sum() + (place >= 2).sum()) and set(told.values()) == {2 * (99 + 98)}
    assert peak < 40 * asked, peak / asked


def test_suffix_tree_exchanges_no_phrase_that_stands_once(spark):
    single = [(" ".join(f"w{k}x{j}" for j in range(40)),) for k in range(20)]
    df = spark.createDataFrame([*single, ("one two three four",), ("Two three four five",), (None,)], "text string").repartition(3)
    bits = []
    for k in (1, 2):
        bits.append(suffix_tree_lm._gram_bits(df, k, list(bits), 20))
        sent = spark.sparkContext.broadcast(list(bits))
        schema = ", ".join(f"h{j} long" for j in range(k + 1)) + ", n long"
        rows = df.mapInArrow(suffix_tree_lm._gram_counts(k, sent), schema).groupBy(*(f"h{j}" for j in range(k + 1))).sum("n").collect()
        # "two three" and "three four", then "two three four"; a collision could keep a few more, of 20 bits hardly any.
        assert sum(r["sum(n)"] == 2 for r in rows) == 3 - k and len(rows) <= 6
