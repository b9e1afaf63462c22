"""Phrase collocations by double-array tries of candidates that no count can rule out.

Words are 64-bit codes, of which the language is part. Level by level (1 to 5 words), positions whose two overlapping phrases
of one word less may both be frequent hash their phrase to a bucket; bucket counts, packed by the thousands, are summed over
the shards. A phrase is a candidate only if its bucket and those of all its parts reach `least` (Apriori, with the buckets of
direct hashing and pruning): collisions add candidates and can't lose any. Buckets come back as one bit each, whose number
follows the bytes of the corpus up to 2^MOST_BITS (128 MB); beyond it fewer phrases are pruned, results stay.

1. A pass over the texts counts the buckets of words. A second writes the texts as rows of codes, one language each, with one
   0 for every piece's end and every stretch of words that can't be frequent; the other levels read these rows.
2. The distinct candidates are collected, packed too, and dealt to tries by their first two words, at most MOST_STATES / 2 to
   a trie. Each trie is built in a task as a double array (base, check) over its own alphabet of codes.
3. The tries are broadcast one after another (their size is bounded by MOST_STATES). A pass takes the states of all text
   positions through the trie together, one word at a time, positions that fall out being dropped; accepting states are
   binned, and the bins of all shards are summed by Spark.
4. Scores and closedness are joins of the counted phrases, in decimals of 38 digits. Phrases that score as well as a language's
   last ones at least are spelt by a pass that looks for their words' codes in the texts, then ranked.

Defined cases: NULL and empty texts have no words; a NULL language is `und`; repeated rows count each; a language whose
phrases all fall short has no rows; other columns are ignored, however they are named. Two words of one 64-bit code would
count as one; with ten million words the chance is 3e-6.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.llm.tokens import U64, mix
from spreadlens.session import stored

SLICE_BYTES = 1 << 20
HELD_SLICES = 4
ROW_CODES, TAKEN_CODES = 1 << 10, 1 << 16
LEAST_BITS, MOST_BITS, BYTES_PER_BIT = 20, 30, 24
BYTES_PER_TASK = 256 << 20
MOST_STATES = 1 << 20
PIECE_STATES = 1 << 14
HELD_KEYS, HELD_PHRASES, TOLD_KEYS = 1 << 20, 1 << 17, 1 << 21
PIECES = 10
ODD = U64(0x9E3779B97F4A7C15)

# What separates pieces and what separates words.
BETWEEN_PIECES, BETWEEN_WORDS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BETWEEN_WORDS)] = 1
KIND[list(BETWEEN_PIECES)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = LOWER.astype(U64) + U64(1)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, SLICE_BYTES of them unless a language has less; at most HELD_SLICES slices wait."""
    waiting: dict[str, list[bytes]] = {}
    held: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            text = text.as_py()
            waiting.setdefault(lang, []).append(text)
            held[lang] += len(text)
            if held[lang] >= SLICE_BYTES or held.total() >= HELD_SLICES * SLICE_BYTES:
                largest = max(held, key=held.get)
                del held[largest]
                yield largest, waiting.pop(largest)
    yield from waiting.items()


def _joined(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)


def _word_codes(lang: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, start, end, whether a piece ends behind it) of each word of bytes that end with a line end."""
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, U64), starts, ends, np.zeros(0, bool)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    weights = mix(np.arange(1, int(size.max()) + 1, dtype=U64) * ODD)
    codes = np.add.reduceat(weights[place] * LETTER[raw[inside]], first)
    codes = mix(codes + size.astype(U64) * ODD + U64(xxhash.xxh3_64_intdigest(lang, 12)))
    codes[codes == 0] = 1
    breaks = np.flatnonzero(kind == 2)
    return codes, starts, ends, breaks[np.searchsorted(breaks, ends)] < np.append(starts[1:], len(raw))


def _stream(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Codes with a 0 behind each piece; stretches of 0 become one."""
    out = np.zeros(len(codes) + int(last.sum()), U64)
    out[np.arange(len(codes)) + np.cumsum(last) - last] = codes
    return out[(out != 0) | (np.concatenate([np.zeros(1, U64), out[:-1]]) != 0)]


def _text_streams(batches: Iterator[pa.RecordBatch], beyond: int) -> Iterator[np.ndarray]:
    for lang, texts in _by_language(batches):
        yield np.append(_word_codes(lang, _joined(texts))[0], np.zeros(beyond, U64))


def _coded(bits):
    """Rows (lang, text) to rows (lang, codes) of the words that may be frequent, and rows (lang, n) with the words of a language."""
    names, kinds = ["lang", "codes", "n"], [pa.string(), pa.list_(pa.int64()), pa.int64()]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for lang, texts in _by_language(batches):
            codes, _, _, last = _word_codes(lang, _joined(texts))
            totals[lang] += len(codes)
            stream = _stream(np.where(_kept(bits.value[0], codes), codes, U64(0)), last)
            if len(stream):
                cuts = np.flatnonzero(stream == 0) + 1
                ends = np.unique(np.append(cuts[np.searchsorted(cuts, np.arange(ROW_CODES, len(stream), ROW_CODES))], len(stream)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(stream.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ends), kinds[0]), lists, pa.nulls(len(ends), kinds[2])], names=names)
        if totals:
            n = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), kinds[0]), pa.nulls(n, kinds[1]), pa.array(list(totals.values()), kinds[2])], names=names)

    return code


def _spelt(needed):
    """Rows (lang, text) to the words whose codes are needed, once a task: code, word."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = needed.value
        missing = np.ones(len(wanted), bool)
        for lang, texts in _by_language(batches):
            raw = _joined(texts)
            codes, starts, ends, _ = _word_codes(lang, raw)
            if not len(codes) or not len(wanted):
                continue
            near = np.searchsorted(wanted, codes).clip(max=len(wanted) - 1)
            hits = np.flatnonzero((wanted[near] == codes) & missing[near])
            found, first = np.unique(near[hits], return_index=True)
            missing[found] = False
            at = hits[first]
            words = [LOWER[raw[a:b]].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int64)), pa.array(words, pa.string())], names=["code", "word"])

    return spell


def _language_streams(batches: Iterator[pa.RecordBatch], beyond: int) -> Iterator[tuple[str, np.ndarray]]:
    """Codes of neighbouring rows of one language, with as many zeros behind them as a look beyond the end needs."""
    for batch in batches:
        langs, lists = batch.column("lang").to_pylist(), batch.column("codes")
        ends, codes = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U64)
        start = 0
        for k in range(1, len(langs) + 1):
            if k == len(langs) or langs[k] != langs[start] or ends[k + 1] - ends[start] > TAKEN_CODES:
                yield langs[start], np.append(codes[ends[start] : ends[k]], np.zeros(beyond, U64))
                start = k


def _streams(batches: Iterator[pa.RecordBatch], beyond: int) -> Iterator[np.ndarray]:
    for _, codes in _language_streams(batches, beyond):
        yield codes


def _kept(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bucket's bit."""
    at = keys & U64(8 * len(bits) - 1)
    return (bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 != 0


def _levels(codes: np.ndarray, bits: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, positions, keys) of phrases of 1, 2, ... words that the bits of all their parts allow; one level more than `bits`, unfiltered."""
    at = np.flatnonzero(codes)
    keys = codes[at]
    alive = np.zeros(len(codes) + 1, bool)
    for k, level in enumerate(bits, 1):
        keep = _kept(level, keys)
        at, keys = at[keep], keys[keep]
        yield k, at, keys
        alive[:] = False
        alive[at] = True
        both = alive[at + 1]
        at, keys = at[both], keys[both]
        keys = mix(keys * ODD + codes[at + k])
    yield len(bits) + 1, at, keys


def _planes(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then their next ones: the zeros of small values lie together, and compress. Codes stay whole."""
    if values.dtype == U64:
        return values.tobytes()
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(pieces: np.ndarray, values: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each piece (ascending) with its part of each of the values, as byte planes."""
    starts = np.flatnonzero(np.diff(pieces, prepend=-1))
    ends = np.append(starts[1:], len(pieces))
    for k in range(0, len(starts), 1024):
        own = list(zip(starts[k : k + 1024].tolist(), ends[k : k + 1024].tolist(), strict=True))
        columns = [pa.array([_planes(v[a:b]) for a, b in own], pa.binary()) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array(pieces[starts[k : k + 1024]].astype(np.int64)), *columns], names=["piece", *names])


def _bucket_counts(bits, n_bits: int):
    """Rows (piece, low, n): a task's counts of the buckets of a piece of 2^16, the buckets' low bits as differences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        buckets, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            at = np.flatnonzero(np.diff(fresh, prepend=-1))
            keys, ns = np.concatenate([buckets, fresh[at]]), np.concatenate([counts, np.diff(np.append(at, len(fresh)))])
            order = np.argsort(keys, kind="stable")
            keys, ns = keys[order], ns[order]
            at = np.flatnonzero(np.diff(keys, prepend=-1))
            return keys[at], np.add.reduceat(ns, at) if len(at) else ns

        for codes in (_streams if bits.value else _text_streams)(batches, len(bits.value) + 1):
            *_, (_, _, keys) = _levels(codes, bits.value)
            held.append((keys & U64((1 << n_bits) - 1)).view(np.int64))
            n += len(keys)
            if n >= HELD_KEYS:
                buckets, counts = merged()
                held, n = [], 0
        buckets, counts = merged()
        steps = np.diff(buckets, prepend=0)
        fresh = np.flatnonzero(np.diff(buckets >> 16, prepend=-1))
        steps[fresh] = buckets[fresh] & 0xFFFF
        yield from _packed(buckets >> 16, [steps.astype("<u2"), counts.clip(max=0xFFFFFFFF).astype("<u4")], ["low", "n"])

    return count


def _frequent_bits(least: int):
    """Rows (piece, low, n), sorted by piece, to (piece, bits): which buckets of the piece reach `least`."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def row() -> pa.RecordBatch:
            bits = np.packbits(sums >= least, bitorder="little").tobytes() if (sums >= least).any() else b""
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits], pa.binary())], names=["piece", "bits"])

        for batch in batches:
            for piece, low, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if piece != now:
                    if now is not None:
                        yield row()
                    now, sums = piece, np.zeros(1 << 16, np.int64)
                sums[np.cumsum(_values(low, "<u2"), dtype=np.int64)] += _values(n, "<u4")
        if now is not None:
            yield row()

    return add_up


def _bits(rows: DataFrame, bits: list[np.ndarray], n_bits: int, least: int) -> np.ndarray:
    """One bit for each of 2^n_bits buckets of the phrases of one word more than `bits` has levels; texts for the first level."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bits)
    counts = rows.mapInArrow(_bucket_counts(sent, n_bits), "piece bigint, low binary, n binary")
    placed = counts.repartition(c.shuffle_partitions(spark), "piece").sortWithinPartitions("piece")
    out = np.zeros(1 << (n_bits - 3), np.uint8)
    for row in placed.mapInArrow(_frequent_bits(least), "piece bigint, bits binary").where("length(bits) > 0").collect():
        out[row["piece"] << 13 : (row["piece"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    sent.destroy()
    return out


def _candidates(bits):
    """Rows (lang, codes) to rows (lang, piece, phrases): candidates, `longest` codes each, dealt by a hash to 2^PIECES pieces.

    A task reports a phrase when it first meets it and keeps no more than its key; beyond TOLD_KEYS it may report phrases again.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = len(bits.value)
        told: dict[str, np.ndarray] = {}
        held: dict[str, list] = {}
        n = 0

        def dealt(lang: str) -> Iterator[pa.RecordBatch]:
            keys, phrases = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            keys, first = np.unique(keys, return_index=True)
            told[lang] = np.sort(np.concatenate([told[lang], keys])) if lang in told else keys
            for batch in _packed((keys >> U64(64 - PIECES)).astype(np.int64), [phrases[first]], ["phrases"]):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(batch), pa.string()), *batch.columns], names=["lang", *batch.schema.names])

        for lang, codes in _language_streams(batches, longest + 1):
            for k, at, keys in _levels(codes, bits.value):
                if k > longest or not len(at):
                    continue
                # A key tells phrases of different lengths apart, as it is mixed once more for each word.
                keys, first = np.unique(keys, return_index=True)
                if lang in told:
                    fresh = told[lang].take(np.searchsorted(told[lang], keys), mode="clip") != keys
                    keys, first = keys[fresh], first[fresh]
                if not len(keys):
                    continue
                phrases = np.zeros((len(keys), longest), U64)
                for j in range(k):
                    phrases[:, j] = codes[at[first] + j]
                held.setdefault(lang, []).append((keys, phrases))
                n += len(keys)
            if n >= HELD_PHRASES:
                for each in list(held):
                    yield from dealt(each)
                n = 0
                if sum(map(len, told.values())) >= TOLD_KEYS:
                    told.clear()
        for each in list(held):
            yield from dealt(each)

    return collect


def _distinct(longest: int):
    """Rows (lang, piece, phrases), sorted by language and piece, to their distinct phrases."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held, n = None, np.zeros((0, longest), U64), [], 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([own, *held]), axis=0) if held else own

        def rows() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum((own != 0).sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own[own != 0].view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(own), pa.string()), lists], names=["lang", "phrase"])

        for batch in batches:
            for lang, piece, phrases in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (lang, piece) != now:
                    own = merged()
                    if len(own):
                        yield rows()
                    now, own, held, n = (lang, piece), np.zeros((0, longest), U64), [], 0
                held.append(np.frombuffer(phrases, U64).reshape(-1, longest))
                n += len(held[-1])
                if n > 4 * len(own) + TAKEN_CODES:
                    own, held, n = merged(), [], 0
        own = merged()
        if len(own):
            yield rows()

    return told


def double_array(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, base, check, state of each phrase) of distinct phrases: rows of codes, 0 beyond a phrase's end.

    Symbols are places in the sorted alphabet, from 1. State 0 is the root; from state s, symbol x leads to t = base[s] + x if
    check[t] = s. A state with one child takes the next free place; the others, widest first, the first base where all
    children are free.
    """
    alphabet = np.unique(phrases[phrases != 0])
    symbols = np.where(phrases != 0, np.searchsorted(alphabet, phrases) + 1, 0)
    size = len(alphabet) + 2
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0] = -2
    low = 1
    state = np.zeros(len(phrases), np.int64)
    for level in range(phrases.shape[1]):
        here = np.flatnonzero(symbols[:, level])
        if not len(here):
            break
        edges, edge_of = np.unique(np.stack([state[here], symbols[here, level]], axis=1), axis=0, return_inverse=True)
        parents, begin, fan = np.unique(edges[:, 0], return_index=True, return_counts=True)
        need = len(check) + len(edges) + len(alphabet) + 2
        base = np.concatenate([base, np.zeros(need - len(base), np.int64)])
        check = np.concatenate([check, np.full(need - len(check), -1, np.int64)])
        to = np.empty(len(edges), np.int64)
        wide = np.argsort(-fan, kind="stable")
        wide = wide[fan[wide] > 1] if level else wide
        for p in wide.tolist():
            own = edges[begin[p] : begin[p] + fan[p], 1]
            at = 0 if level == 0 else -1
            begun = low
            while at < 0:
                free = np.flatnonzero(check[begun : begun + 512] == -1) + begun
                ok = free[(free + own[-1] - own[0]) < len(check)]
                fits = np.flatnonzero((check[ok[:, None] + (own - own[0])] == -1).all(axis=1)) if len(ok) else ok
                if len(fits):
                    at = int(ok[fits[0]]) - int(own[0])
                    break
                begun += 512
                if begun + 512 + len(alphabet) > len(check):
                    base = np.concatenate([base, np.zeros(len(base), np.int64)])
                    check = np.concatenate([check, np.full(len(check), -1, np.int64)])
            if begun - low > 8 * 512:
                low = begun - 512
            base[parents[p]] = at if level else 0
            spots = base[parents[p]] + own
            check[spots] = parents[p]
            to[begin[p] : begin[p] + fan[p]] = spots
        if level:
            single = np.flatnonzero(fan == 1)
            free = np.flatnonzero(check == -1)
            if len(free) < len(single) + 1:
                extra = len(single) + 1
                base = np.concatenate([base, np.zeros(extra, np.int64)])
                check = np.concatenate([check, np.full(extra, -1, np.int64)])
                free = np.flatnonzero(check == -1)
            spots = free[: len(single)]
            base[parents[single]] = spots - edges[begin[single], 1]
            check[spots] = parents[single]
            to[begin[single]] = spots
        state[here] = to[edge_of.ravel()]
    used = int(np.flatnonzero(check != -1)[-1]) + 2
    return alphabet, base[:used], np.append(check[: used - 1], -1), state


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    lists = rows["phrase"].tolist()
    phrases = np.zeros((len(lists), max(map(len, lists))), U64)
    for k, p in enumerate(lists):
        phrases[k, : len(p)] = np.asarray(p, np.int64).view(U64)
    alphabet, base, check, state = double_array(phrases)
    head = {"shard": [rows["shard"].iat[0]], "state": [None], "lang": [None], "phrase": [None], "alphabet": [alphabet.tobytes()], "base": [base.tobytes()], "check": [check.tobytes()]}
    told = pd.DataFrame({"shard": rows["shard"], "state": state, "lang": rows["lang"], "phrase": rows["phrase"], "alphabet": None, "base": None, "check": None})
    return pd.concat([pd.DataFrame(head), told.astype({"state": object})], ignore_index=True)


def _state_counts(trie):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, base, check, words = trie.value
        bins, held, n = np.zeros(len(check), np.int64), [], 0
        for codes in _streams(batches, words):
            near = np.searchsorted(alphabet, codes).clip(max=len(alphabet) - 1)
            symbols = np.where(alphabet[near] == codes, near + 1, 0)
            at = np.flatnonzero(symbols)
            state = np.zeros(len(at), np.int64)
            for level in range(words):
                x = symbols[at + level]
                to = base[state] + x
                ok = (x > 0) & (check.take(to, mode="clip") == state) & (to < len(check)) & (to > 0)
                at, state = at[ok], to[ok]
                held.append(state)
                n += len(state)
            if n >= HELD_KEYS:
                bins += np.bincount(np.concatenate(held), minlength=len(bins))
                held, n = [], 0
        if held:
            bins += np.bincount(np.concatenate(held), minlength=len(bins))
        yield from _packed(np.arange(len(bins)) // PIECE_STATES, [bins.astype("<u4")], ["n"])

    return count


def _state_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (piece, n), sorted by piece, to the sums of the states (state, f)."""
    now, sums = None, None

    def rows() -> pa.RecordBatch:
        some = np.flatnonzero(sums)
        return pa.RecordBatch.from_arrays([pa.array(some + now * PIECE_STATES), pa.array(sums[some])], names=["state", "f"])

    for batch in batches:
        for piece, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if piece != now:
                if now is not None:
                    yield rows()
                now, sums = piece, 0
            sums = sums + _values(n, "<u4").astype(np.int64)
    if now is not None:
        yield rows()


def _told(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def count_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, phrase (array of codes), f, of 1 to `longest` words with f >= least; languages: lang, n words)."""
    spark = docs.sparkSession
    texts = _told(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BIT).bit_length()))
    bits = [_bits(texts, [], n_bits, least)]
    sent = spark.sparkContext.broadcast(bits)
    coded = stored(texts.mapInArrow(_coded(sent), "lang string, codes array<bigint>, n bigint"), "coded")
    sent.destroy()
    languages = stored(coded.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    streams = coded.where("codes is not null").select("lang", "codes")
    while len(bits) < longest and bits[-1].any():
        bits.append(_bits(streams, bits, n_bits, least))
    sent = spark.sparkContext.broadcast(bits)
    # A task reports each of its candidates once, so it takes many rows.
    tasks = max(spark.sparkContext.defaultParallelism, size // BYTES_PER_TASK)
    packed = streams.coalesce(tasks).mapInArrow(_candidates(sent), "lang string, piece bigint, phrases binary")
    placed = packed.repartition(c.shuffle_partitions(spark), "lang", "piece").sortWithinPartitions("lang", "piece")
    candidates = stored(placed.mapInArrow(_distinct(len(bits)), "lang string, phrase array<bigint>"), "candidates")
    sent.destroy()
    return stored(_counted(spark, streams, candidates, longest).where(F.col("f") >= least), "phrases"), languages


def _counted(spark: SparkSession, streams: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    shards = 2 * candidates.count() // MOST_STATES + 1
    dealt = candidates.withColumn("shard", F.pmod(F.xxhash64(F.slice("phrase", 1, 2)), F.lit(shards)).cast("int"))
    schema = "shard int, state bigint, lang string, phrase array<bigint>, alphabet binary, base binary, check binary"
    tries = stored(dealt.groupBy("shard").applyInPandas(_tries, schema), "tries")
    sums = None
    for row in tries.where("state is null").select("shard").collect():
        head = tries.where(F.col("state").isNull() & (F.col("shard") == row["shard"])).select("alphabet", "base", "check").first()
        arrays = (np.frombuffer(head["alphabet"], U64), np.frombuffer(head["base"], np.int64), np.frombuffer(head["check"], np.int64), longest)
        sent = spark.sparkContext.broadcast(arrays)
        bins = streams.mapInArrow(_state_counts(sent), "piece bigint, n binary")
        placed = bins.repartition(c.shuffle_partitions(spark), "piece").sortWithinPartitions("piece")
        own = stored(placed.mapInArrow(_state_sums, "state bigint, f bigint").withColumn("shard", F.lit(row["shard"])), "states")
        sent.destroy()
        sums = own if sums is None else sums.unionByName(own)
    if sums is None:
        return candidates.select("lang", "phrase").withColumn("f", F.lit(0).cast("bigint")).limit(0)
    return tries.where("state is not null").select("shard", "state", "lang", "phrase").join(sums, ["shard", "state"]).select("lang", "phrase", "f")


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    part, languages = count_phrases(docs, least, longest)
    found = part.where(F.size("phrase") > 1)
    cuts = F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")
    cut = found.select("lang", "phrase", F.col("f").alias("a"), cuts)
    cut = cut.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("right"))
    cut = cut.join(part.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left")
    cut = cut.join(part.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right").join(languages, "lang")
    wide = [f"cast({x} as decimal(19, 0))" for x in ("1000 * a", "n", "l", "r")]
    scored = cut.withColumn("score", F.expr(f"({wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]})"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = scored.groupBy("phrase", "lang", "a", "n").agg(lowest).select("phrase", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    longer = found.where(F.size("phrase") > 2)
    inside = F.array(F.slice("phrase", F.lit(1), F.size("phrase") - 1), F.slice("phrase", F.lit(2), F.size("phrase") - 1))
    # f(longer) can't exceed f(phrase), so only equal counts drop a phrase, and one more word tells of any number more.
    covered = longer.select(F.explode(inside).alias("phrase"), F.col("f").alias("a"))
    closed = scored.join(covered, ["phrase", "a"], "left_anti")
    at_least = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = stored(closed.withColumn("_place", F.rank().over(at_least)).where(F.col("_place") <= first).drop("_place"), "best")
    # At most `first` phrases a language, and those that tie with the last.
    needed = np.sort(np.array([r["code"] for r in best.select(F.explode("phrase").alias("code")).distinct().collect()], np.int64).view(U64))
    words = _told(docs).mapInArrow(_spelt(spark.sparkContext.broadcast(needed)), "code bigint, word string").groupBy("code").agg(F.min("word").alias("word"))
    spelt = best.select("phrase", F.posexplode("phrase").alias("k", "code")).join(words, "code")
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("spelt"))
    told = best.join(spelt, "phrase").select("lang", F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score")
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return told.withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
