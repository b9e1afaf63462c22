"""Character n-grams inside blank-padded words, hashed to signed dimensions."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from spreadlens.functions.text import words

# The default embedding shape.
DIM = 512
NGRAM = (3, 5)


def _hash32(gram: Column, hash_name: str) -> Column:
    if hash_name == "md5":
        # Eight hex digits, a number any SQL engine can compute.
        return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint")
    if hash_name == "xxhash64":
        return F.pmod(F.xxhash64(gram), F.lit(1 << 32))
    raise ValueError(f"unknown hash {hash_name!r}; use md5 or xxhash64")


def _checked(dim: int, ngram: tuple[int, int]) -> tuple[int, int]:
    low, high = ngram
    if dim < 16:
        raise ValueError("dim must be at least 16")
    if low < 1 or high < low:
        raise ValueError("ngram must be (low, high) with 1 <= low <= high")
    return low, high


def check_grams(dim: int, ngram: tuple[int, int], hash_name: str) -> None:
    _checked(dim, ngram)
    _hash32(F.lit(""), hash_name)


def _grams(word: Column, low: int, high: int) -> Column:
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    # Longer grams stop at the padded word's own length, so a short word counts once.
    lengths = F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(low), size)))
    return F.flatten(
        F.transform(
            lengths,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
                lambda start: F.substring(padded, start, n),
            ),
        )
    )


def _codes(grams: Column, dim: int, hash_name: str) -> Column:
    # Numbers first, then codes: inside one lambda the hash would be computed twice.
    numbers = F.transform(grams, lambda gram: _hash32(gram, hash_name))
    return F.transform(numbers, lambda number: (F.pmod(number, F.lit(dim)) * 2 + F.floor(number / dim) % 2).cast("int"))


def word_codes(word: Column, dim: int = DIM, ngram: tuple[int, int] = NGRAM, hash_name: str = "md5") -> Column:
    """array<int>, one per gram of one word: twice its dimension, plus one where its sign is negative."""
    return _codes(_grams(word, *_checked(dim, ngram)), dim, hash_name)


def gram_codes(text: Column, dim: int = DIM, ngram: tuple[int, int] = NGRAM, hash_name: str = "md5") -> Column:
    """array<int>, one per gram of all words of a text."""
    low, high = _checked(dim, ngram)
    return _codes(F.flatten(F.transform(words(F.lower(text)), lambda word: _grams(word, low, high))), dim, hash_name)


@lru_cache(maxsize=1 << 20)
def _md5_number(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "big")


@lru_cache(maxsize=1 << 20)
def _xxhash_number(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), 42) & 0xFFFFFFFF


def hashed_grams(distinct: list[str], dim: int = DIM, ngram: tuple[int, int] = NGRAM, hash_name: str = "md5") -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words one after another, ends with a leading zero): the numbers of `word_codes`, for tasks that work on arrays.

    Grams of all words are told apart by rank, one character longer at a time, so each distinct gram is cut out and hashed once.
    """
    low, high = _checked(dim, ngram)
    numbers_by = {"md5": _md5_number, "xxhash64": _xxhash_number}
    if hash_name not in numbers_by:
        raise ValueError(f"unknown hash {hash_name!r}; use md5 or xxhash64")
    number = numbers_by[hash_name]
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    text = "".join(f" {word} " for word in distinct)
    sizes = np.array([len(word) + 2 for word in distinct], np.int64)
    stops = np.cumsum(sizes)
    # How many grams of each length a word has; one shorter than the shortest length counts once, whole.
    lengths = range(low, high + 1)
    counts = np.array([np.where((sizes >= n) | (n == low), np.maximum(sizes - n + 1, 1), 0) for n in lengths])
    ends = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    before = ends[:-1] + np.cumsum(counts, axis=0) - counts
    numbers = np.zeros(ends[-1], np.int64)
    _, signs = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    base = signs.max() + 1
    place, rank = np.arange(len(signs)), signs
    word = np.repeat(np.arange(len(distinct)), sizes)
    for n in range(1, high + 1):
        if n > 1:
            inside = place + n <= stops[word[place]]
            place = place[inside]
            rank = rank[inside] * base + signs[place + n - 1]
        _, first, rank = np.unique(rank, return_index=True, return_inverse=True)
        if n >= low and len(place):
            of_rank = np.array([number(text[p : p + n]) for p in place[first].tolist()], np.int64)
            of = word[place]
            numbers[before[n - low][of] + place - (stops - sizes)[of]] = of_rank[rank]
    for k in np.flatnonzero(sizes < low).tolist():
        numbers[ends[k]] = number(f" {distinct[k]} ")
    return numbers % dim * 2 + numbers // dim % 2, ends
