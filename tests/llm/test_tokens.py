"""Words of sliced batches, tokenizers against their libraries, and the file format."""

import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_rows import rows
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from spreadlens.llm import piece_viterbi, token_files
from spreadlens.llm.common import table
from spreadlens.llm.tokens import word_codes

ROWS = rows()
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("lower", [True, False])
def test_words_of_slices(lower):
    texts = [r[1] for r in ROWS] * 3
    for part in (pa.array(texts), pa.array(texts).slice(7, 20), pa.array(texts, pa.large_string()).slice(33)):
        codes, starts, words = word_codes(part, lower)
        words = words.to_pylist()
        got = [[words[c] for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
        assert got == [brute.words(t, lower) for t in part.to_pylist()]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    reader = token_files.DacReader(token_files.dac_encode(np.array(ids, np.uint32)))
    assert reader.all().tolist() == ids
    assert [reader[i] for i in range(0, len(ids), 37)] == ids[::37]
    with pytest.raises(IndexError):
        reader[len(ids)]


def expected(docs):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark, odd, nothing, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd, path, WORD_BPE)
    got = [tuple(r) for r in token_files.read_digests(spark, path).collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want = expected([(r[0], r[1]) for r in order])
    # Rows of one id have no order between them, so starts are compared for the others.
    ids = [r[0] for r in ROWS]
    assert sorted((g for g in got if ids.count(g[0]) == 1)) == sorted(w for w in want if ids.count(w[0]) == 1)
    assert brute.nones_first((g[0], *g[2:]) for g in got) == brute.nones_first((w[0], *w[2:]) for w in want)
    assert token_files.token_at(spark, path, 7, 1) == 1 and token_files.token_at(spark, path, 7, 2) is None and token_files.token_at(spark, path, 777, 0) is None
    empty = str(tmp_path / "none")
    token_files.write_tokens(nothing, empty, WORD_BPE)
    assert token_files.read_digests(spark, empty).collect() == []


def test_token_files_of_the_table(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 5000)
    docs = table(spark, sf_dir, "documents")
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, WORD_BPE)
    pairs = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    assert sorted(map(tuple, token_files.read_digests(spark, path).collect())) == expected(pairs)


@given(st.text(alphabet=st.sampled_from("aAéÉ ß.,'!<|>\n\tthe ing日é\U0001f600 1xTWJHY\u0308\u030a\u030c\u0331\u1100\u1161\u11a8İK"), max_size=60))
@settings(max_examples=250, deadline=None)
def test_words_alone_give_the_ids_of_the_whole(text):
    encoder = token_files.encoder_of(WORD_BPE)
    codes, _, words = word_codes(pa.array([text]), lower=False)
    body, tail = encoder.table(words)
    flat, _ = token_files.ragged_take(encoder.ids, encoder.ends, np.stack([body[codes], tail[codes]], axis=1).ravel())
    assert flat.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(st.text(alphabet=st.sampled_from("aAéÉ  ß.,'!<0xA>\n\tthe ing日\U0001f600 1x▁"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = piece_viterbi.encoder_of(PIECES)
    ids, _ = encoder.encode([text])
    assert ids.tolist() == library.encode(text)
    assert encoder.pieces.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["T\u0308", "W\u030a x", "J\u030c", "H\u0331.", "Y\u030ab", "a\u0308A\u0308", "\u1112\u1161\u11ab"])
def test_letters_that_are_composed_first(text):
    test_words_alone_give_the_ids_of_the_whole.hypothesis.inner_test(text)


@pytest.mark.parametrize("n", [2, 3, 17, 1000, 100_000])
def test_long_runs_of_spaces(library, n):
    encoder = piece_viterbi.encoder_of(PIECES)
    texts = ["a" + " " * n + "b", " " * n, "x" + " " * n]
    begun = time.perf_counter()
    got = [encoder.encode([t])[0].tolist() for t in texts]
    assert time.perf_counter() - begun < 10
    assert got == [library.encode(t) for t in texts]


def test_pieces_of_odd_rows_and_of_the_table(spark, sf_dir, odd, nothing, library):
    for docs in (odd, table(spark, sf_dir, "documents")):
        coded = piece_viterbi.encode_pieces(docs, PIECES)
        got = [(r.doc_id, tuple(r.ids)) for r in coded.collect()]
        texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert brute.nones_first(got) == brute.nones_first((i, tuple(library.encode(t or ""))) for i, t in texts)
        assert coded.where("not round_trip or n_pieces <> size(ids)").count() == 0
        back = [tuple(r) for r in piece_viterbi.decode_pieces(coded, PIECES).collect()]
        assert brute.nones_first(back) == brute.nones_first((i, t or "") for i, t in texts)
    assert piece_viterbi.encode_pieces(nothing, PIECES).collect() == []


def test_unigram_scores_give_the_best_sum(monkeypatch):
    """With log probabilities nothing is barred; the result is that of trying all segmentations."""
    import random

    pieces = piece_viterbi.encoder_of(PIECES).pieces
    rng = random.Random(3)
    own = object.__new__(piece_viterbi.Pieces)
    own.__dict__.update(pieces.__dict__)
    own.merges, own.scores = False, np.array([-rng.random() * 10 - 1 for _ in pieces.scores])
    own.fallback = own.scores.min() - 10
    text_of = {int(own.ids[i]): t for t, i in own.place.items()}
    score = {int(own.ids[i]): own.scores[i] for i in own.place.values()}
    for unit in ("▁the", "▁singing", "▁anderson", "▁über日"):
        best = {0: 0.0}
        for j in range(1, len(unit) + 1):
            tries = [best[i] + own.scores[own.place[unit[i:j]]] for i in range(j) if unit[i:j] in own.place]
            if unit[j - 1] not in own.place:
                tries.append(best[j - 1] + own.fallback * len(unit[j - 1].encode()))
            best[j] = max(tries)
        ids = own.segment([unit])[1].tolist()
        assert "".join(text_of.get(i, "") for i in ids) in unit
        assert abs(sum(score.get(i, own.fallback) for i in ids) - best[len(unit)]) < 1e-9
