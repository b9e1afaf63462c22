"""Words of whole Arrow batches as integer codes, for the operators that work on arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, starts, words): the words of all texts as codes into `words`, text i having codes[starts[i]:starts[i + 1]].

    Words are runs free of space, tab, newline, vertical tab, form feed and carriage return; NULL has none. Only A-Z are
    lowered.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten().dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    if lower:
        # Distinct words are lowered, not texts: fewer bytes, and ascii_lower misplaces the values of sliced arrays.
        lowered = pc.ascii_lower(words).dictionary_encode()
        codes, words = lowered.indices.to_numpy(zero_copy_only=False)[codes], lowered.dictionary
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        keep = codes != empty
        codes, doc = codes[keep], doc[keep]
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int64)
    return codes, starts, words


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit integers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of each text's distinct shingles of `width` words, sorted within a text.

    A text with fewer words, but some, has its whole word sequence as the only shingle.
    """
    codes, starts, words = word_codes(texts)
    return shingles_of(word_hashes(words)[codes] if len(codes) else np.empty(0, U64), starts, width)


def shingles_of(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    out, ends = [], [0]
    for i in range(len(starts) - 1):
        own = hashes[starts[i] : starts[i + 1]]
        n = min(len(own), width)
        if n:
            rolled = np.zeros(len(own) - n + 1, U64)
            for k in range(n):
                rolled = mix(rolled + own[k : len(own) - n + 1 + k])
            # Fewer words than the width make another kind of shingle.
            own = np.unique(rolled + U64(n))
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else np.empty(0, U64)), np.array(ends, np.int64)
