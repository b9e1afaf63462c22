"""Phrase mining against plain counting with exact integers, on odd texts; the double array against a dictionary."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from spreadlens.llm import phrase_mining as pm

SCHEMA = "doc_id bigint, lang string, text string, n bigint, phrase string"


def plain(rows, least, longest=5, first=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, lang, text, *_ in rows:
        lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        named = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in named.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in named.items())
            if not inside:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows_.sort(key=lambda v: (-v[0], -v[1], v[2].encode()))
        out += [(lang, n, p, a, x, y, total[lang], s) for n, (s, a, p, x, y) in enumerate(rows_[:first], 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(11)
    words = ["one", "Two", "three", "ÄÖ", "äö", " x", "a-b", "it's", "\x00", "w" * 3000]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["new york city hall"] * 40 + ["NEW york city", "york, city", "a a a a a a a a", "", None, " \t", ".,;", "x" * 100_000] + ["of the " * 6000]
    rows = [(k, rng.choice(["en", "en", "en", "de", None, "und"]), t, 1, "p") for k, t in enumerate(texts)]
    return rows + rows[:5]


@pytest.mark.parametrize("least, states", [(3, 1 << 20), (3, 64), (40, 64)])
def test_phrases_of_odd_rows(spark, monkeypatch, least, states):
    monkeypatch.setattr(pm, "MOST_STATES", states)
    rows = odd_rows()
    got = sorted(map(tuple, pm.mine_phrases(spark.createDataFrame(rows, SCHEMA), least=least).collect()))
    assert got == plain(rows, least)


def test_first_of_each_language(spark):
    rows = odd_rows()
    got = sorted(map(tuple, pm.mine_phrases(spark.createDataFrame(rows, SCHEMA), least=2, longest=3, first=7).collect()))
    assert got == plain(rows, 2, 3, 7)


def test_products_pass_64_bits(spark):
    big = "1000 * cast(9000000000000 as decimal(19, 0)) * cast(80000000000000000 as decimal(19, 0))"
    assert spark.sql(f"select ({big}) div (cast(300000000 as decimal(19, 0)) * cast(900000000000 as decimal(19, 0))) as x").first().x == 1000 * 9000000000000 * 80000000000000000 // (300000000 * 900000000000)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pm.mine_phrases(none).collect() == []
    assert pm.mine_phrases(spark.createDataFrame([(1, "en", "one two one two", 0, "")], SCHEMA)).collect() == []


def test_rows_of_codes_end_between_pieces(monkeypatch):
    monkeypatch.setattr(pm, "ROW_CODES", 8)
    monkeypatch.setattr(pm, "SLICE_BYTES", 64)
    texts = ["one two three four. five six seven, eight nine ten one two"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 9), pa.array(texts)], names=["lang", "text"])
    every = SimpleNamespace(value=[np.full(16, 255, np.uint8)])
    rows = [r for b in pm._coded(every)(iter([batch])) for r in b.to_pylist()]
    streams = [r["codes"] for r in rows if r["codes"] is not None]
    assert all(s[-1] == 0 for s in streams) and sum(len([x for x in s if x]) for s in streams) == 9 * 12
    assert [(r["lang"], r["n"]) for r in rows if r["codes"] is None] == [("en", 9 * 12)]
    none = SimpleNamespace(value=[np.zeros(16, np.uint8)])
    assert [r["n"] for r in next(pm._coded(none)(iter([batch]))).to_pylist()] == [9 * 12]


def test_double_array_holds_exactly_its_phrases():
    rng = np.random.default_rng(7)
    for symbols, n in ((3, 40), (500, 3000), (40, 2000)):
        closed = set()
        for _ in range(n):
            p = tuple(rng.integers(1, symbols + 1, rng.integers(2, 6)).tolist())
            closed |= {p[:k] for k in range(2, len(p) + 1)}
        phrases = sorted(closed)
        table = np.zeros((len(phrases), 5), np.uint64)
        for k, p in enumerate(phrases):
            table[k, : len(p)] = np.array(p, np.uint64) * np.uint64(1 << 50)
        alphabet, base, check, state = pm.double_array(table)
        assert len(set(state.tolist())) == len(phrases)
        number = {int(x) >> 50: k + 1 for k, x in enumerate(alphabet)}

        def walk(p):
            s = 0
            for x in p:
                t = base[s] + number.get(x, -(10**9))
                if not 0 < t < len(check) or check[t] != s:
                    return None
                s = t
            return s

        assert [walk(p) for p in phrases] == state.tolist()
        firsts = {p[0] for p in phrases}
        for _ in range(500):
            p = tuple(rng.integers(1, symbols + 1, rng.integers(1, 6)).tolist())
            assert (walk(p) is not None) == (p in closed or (len(p) == 1 and p[0] in firsts))


@pytest.mark.parametrize("told_keys, most", [(1 << 21, 1), (100, 40)])
def test_a_task_reports_a_candidate_once_and_none_is_lost(monkeypatch, told_keys, most):
    monkeypatch.setattr(pm, "HELD_PHRASES", 64)
    monkeypatch.setattr(pm, "TOLD_KEYS", told_keys, raising=False)
    rng = np.random.default_rng(1)
    rows = [np.append(rng.integers(1, 8, 60), 0) for _ in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([row, row])], names=["lang", "codes"]) for row in rows * 2]
    bits = SimpleNamespace(value=[np.full(1 << 10, 255, np.uint8)] * 3)
    got = Counter()
    for batch in pm._candidates(bits)(iter(batches)):
        for lang, phrases in zip(batch.column("lang").to_pylist(), batch.column("phrases").to_pylist(), strict=True):
            got.update((lang, *map(int, p)) for p in np.frombuffer(phrases, np.uint64).reshape(-1, 3))
    want = {(lang, *row[i : i + k].tolist(), *[0] * (3 - k)) for lang in ("en", "de") for row in rows for k in (1, 2, 3) for i in range(61 - k)}
    assert set(got) == want and max(got.values()) <= most
