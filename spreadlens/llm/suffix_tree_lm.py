"""Language-model scores by a probabilistic suffix tree over words.

A node is a context of up to `depth` words, read backwards from the word to predict. Every context that stands twice in the
training texts is a candidate; it stays if the count-weighted divergence of its next-word distribution from that of its suffix
(the context without its oldest word) reaches `nats`, or if a longer context needs it. Next words that follow a context twice have
counts; the distribution is smoothed by absolute discounting, what is discounted going to the suffix's distribution, down to the
root, which is the add-one unigram distribution over all training words. A text's state is the longest suffix in the tree.

No part of the tree is gathered: n-grams, contexts and words are tables that grow with the corpus. Before n-grams of a length are
counted, a pass counts them by bucket, and only those whose bucket, and those of whose parts, hold two are exchanged at all. A token's gain over its unigram
chance is a sum of terms that depend on one key each: log10 gamma for each context of its state, and
log10((share + gamma * below) / (gamma * below)) for each context whose counted next words hold it. So a batch of texts sends its
distinct keys, packed, to the shards of one table of such terms, and gets sums for each text back. Unigram counts come the same
way, but for frequent words, which are sent to the tasks (at most 1 / word_share of them). A bitmap of the keys spares asking for
most of those that the table doesn't hold; a full one would only spare less.

`grow` is the same tree in the driver's memory with floors by share, for corpora that fit; `score_texts` doesn't use its contexts.

Defined cases: NULL and empty texts are the end token alone; a NULL doc_id counts as '' for the split, so it trains;
repeated rows count and are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.llm.phrase_mining import _frequent_bits, _kept, _packed
from spreadlens.llm.tokens import U64, mix, word_codes, word_hashes
from spreadlens.session import stored

DEPTH, WORD_SHARE, CONTEXT_SHARE, PAIR_SHARE, NATS, DISCOUNT = 2, 2e-6, 1e-5, 1e-6, 10.0, 0.75
BATCH, BATCH_BYTES, SCORED_BYTES, ROW_BYTES = 4000, 1 << 24, 1 << 22, 1 << 22
BYTES_PER_BIT, LEAST_BITS, HELD_KEYS = 2, 20, 1 << 21  # of the buckets of n-grams
LEAST = 2  # times that a context, and a next word after it, must be seen
END = U64(0x5EEDED0FE0D0FEED)  # stands for the end of a text among word hashes
PAIR = U64(0xA5A5_0F0F_3C3C_9669)
MOST_BITS = 30  # of the bitmap, as a power of two


@dataclass
class Tree:
    """What the tasks need: frequent words, and per depth the nodes and their pairs, as sorted arrays."""

    tokens: int = 0  # N
    distinct: int = 0  # V
    words: dict[str, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # of frequent words, then of the end
    node_keys: list[np.ndarray] = field(default_factory=list)  # depth d: suffix node * width + oldest word, sorted
    gammas: list[np.ndarray] = field(default_factory=list)  # what each node leaves to its suffix
    pair_keys: list[np.ndarray] = field(default_factory=list)  # node * width + next word, sorted
    pair_shares: list[np.ndarray] = field(default_factory=list)

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def width(self) -> int:
        return len(self.words) + 1

    def ids(self, words: pa.Array) -> np.ndarray:
        """Places of words; -1 for rare ones."""
        return np.fromiter((self.words.get(w, -1) for w in words.to_pylist()), np.int64, len(words))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted `keys`, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _symbols(codes: np.ndarray, starts: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, place in its text, text) of every token, the end of each text included."""
    sizes = np.diff(starts) + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(doc)) - first[doc]
    symbols = np.full(len(doc), end, np.int64)
    symbols[place < sizes[doc] - 1] = ids[codes] if len(codes) else 0
    return symbols, place, doc


def _states(tree: Tree, symbols: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The node of each depth before every token; -1 where there is none."""
    states = []
    for d, keys in enumerate(tree.node_keys, 1):
        older = np.full(len(symbols), -1, np.int64)
        older[d:] = symbols[:-d]
        older[place < d] = -1
        suffix = states[-1] if states else np.zeros(len(symbols), np.int64)
        node = np.full(len(symbols), -1, np.int64)
        some = np.flatnonzero((older >= 0) & (suffix >= 0))
        node[some] = _find(keys, suffix[some] * tree.width + older[some])
        states.append(node)
    return states


def _texts(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH rows, whose texts (the last column) have about `most` bytes, BATCH_BYTES if not given."""
    most = most or BATCH_BYTES
    for whole in batches:
        for i in range(0, whole.num_rows, BATCH):
            rows = whole.slice(i, BATCH)
            sizes = pc.fill_null(pc.binary_length(rows.column(rows.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = (np.cumsum(sizes) - sizes) // most
            for a, b in zip(*_runs(turn)):
                yield rows.slice(a, b - a)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _texts(batches):
        codes, _, words = word_codes(batch.column(0))
        counts = np.bincount(codes, minlength=len(words))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)).cast(pa.string()), pa.array(counts[seen])], names=["word", "n"])


def _pair_counts(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            codes, starts, words = word_codes(batch.column(0))
            symbols, place, _ = _symbols(codes, starts, tree.ids(words), tree.end)
            node = _states(tree, symbols, place)[-1]
            some = (node >= 0) & (symbols >= 0)
            keys, counts = np.unique(node[some] * tree.width + symbols[some], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return run


def lexicon_of(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, written: lower-cased words with exact counts."""
    counted = texts.select("text").mapInArrow(_word_counts, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "lexicon")


def grow(
    texts: DataFrame, lexicon: DataFrame, depth: int = DEPTH, word_share: float = WORD_SHARE, context_share: float = CONTEXT_SHARE,
    pair_share: float = PAIR_SHARE, nats: float = NATS, discount: float = DISCOUNT,
) -> Tree:
    """The tree of training texts; one pass over them for each depth."""
    n_texts = texts.count()
    distinct, total = lexicon.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tree = Tree(tokens=total + n_texts, distinct=distinct + (n_texts > 0))
    least = lambda share: max(2, math.ceil(share * tree.tokens))
    # At most 1 / word_share words reach that share of the tokens.
    frequent = lexicon.where(F.col("n") >= least(word_share)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    tree.words = {w: i for i, w in enumerate(frequent["word"])}
    tree.counts = np.append(frequent["n"].to_numpy(np.int64), n_texts)
    root = (tree.counts + 1) / (tree.tokens + tree.distinct + 1)
    levels = []
    # Contexts as (suffix node, oldest word) with their counts; at depth 1 the suffix is the root.
    many = np.flatnonzero(tree.counts[:-1] >= least(context_share))
    keys, counts = many.astype(np.int64), tree.counts[many]
    for d in range(1, depth + 1):
        if not len(keys):
            break
        tree.node_keys.append(keys)
        pairs = texts.select("text").mapInArrow(_pair_counts(tree), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # At most 1 / pair_share pairs reach that share.
        pairs = pairs.where(F.col("n") >= least(pair_share)).toPandas().sort_values("pair")
        pair, n = pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
        node, symbol = pair // tree.width, pair % tree.width
        shares = (n - discount) / counts[node]
        gamma = np.maximum(1 - np.bincount(node, shares, minlength=len(keys)), 1e-12)
        levels.append({"keys": keys, "counts": counts, "pair": pair, "n": n, "shares": shares, "gamma": gamma})
        below = _chance(levels[:-1], tree.width, root, node, symbol, keys) if len(pair) else np.empty(0)
        levels[-1]["gain"] = np.bincount(node, n * np.log(np.maximum((shares + gamma[node] * below) / np.maximum(below, 1e-300), 1e-300)), minlength=len(keys)) if len(pair) else np.zeros(len(keys))
        # A context and its next word make a longer context, if the suffix of that is a node too.
        grown = np.flatnonzero((symbol < tree.end) & (n >= least(context_share)))
        oldest = _words_of(levels, d, node[grown], tree.width)[0]
        suffix = _suffix_nodes(levels, d, node[grown], symbol[grown], tree.width)
        good = suffix >= 0
        new = suffix[good] * tree.width + oldest[good]
        order = np.argsort(new)
        keys, counts = new[order], n[grown][good][order]
    _prune(tree, levels, nats)
    return tree


def _split(levels: list[dict], d: int, node: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(oldest word, suffix node) of nodes at depth d."""
    key = levels[d - 1]["keys"][node]
    return key % width, key // width


def _words_of(levels: list[dict], d: int, node: np.ndarray, width: int) -> list[np.ndarray]:
    """The words of nodes at depth d, oldest first."""
    out = []
    for k in range(d, 0, -1):
        oldest, node = _split(levels, k, node, width)
        out.append(oldest)
    return out


def _suffix_nodes(levels: list[dict], d: int, node: np.ndarray, symbol: np.ndarray, width: int) -> np.ndarray:
    """The node at depth d of a context of d words, its oldest left out, followed by `symbol`; -1 if there is none."""
    words = [*_words_of(levels, d, node, width)[1:], symbol]
    at = np.zeros(len(node), np.int64)
    for k in range(1, d + 1):
        at = np.where(at >= 0, _find(levels[k - 1]["keys"], np.maximum(at, 0) * width + words[-k]), -1)
    return at


def _chance(levels: list[dict], width: int, root: np.ndarray, node: np.ndarray, symbol: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """P(symbol | suffix of the node), for nodes one depth below `levels`."""
    chain, at = [], keys[node] // width
    for k in range(len(levels), 0, -1):
        chain.append((k, at))
        at = levels[k - 1]["keys"][at] // width
    p = root[symbol]
    for k, at in reversed(chain):
        found = _find(levels[k - 1]["pair"], at * width + symbol)
        p = np.where(found >= 0, levels[k - 1]["shares"][found], 0) + levels[k - 1]["gamma"][at] * p
    return p


def _prune(tree: Tree, levels: list[dict], nats: float) -> None:
    """Keep nodes that pass the test or are the suffix of a kept one, and number them anew."""
    keep = [level["gain"] >= nats for level in levels]
    for d in range(len(levels) - 1, 0, -1):
        keep[d - 1][levels[d]["keys"][keep[d]] // tree.width] = True
    tree.node_keys, numbers = [], None
    for d, level in enumerate(levels):
        kept = np.flatnonzero(keep[d])
        old = level["keys"][kept]
        new = old if numbers is None else numbers[old // tree.width] * tree.width + old % tree.width
        number = np.full(len(level["keys"]), -1)
        number[kept] = np.arange(len(kept))  # suffixes keep their order, so keys stay sorted
        node = level["pair"] // tree.width
        of_kept = keep[d][node] if len(node) else np.empty(0, bool)
        tree.node_keys.append(new)
        tree.gammas.append(level["gamma"][kept])
        tree.pair_keys.append(number[node[of_kept]] * tree.width + level["pair"][of_kept] % tree.width)
        tree.pair_shares.append(level["shares"][of_kept])
        numbers = number


def _older(symbols: np.ndarray, place: np.ndarray, k: int, none: int) -> np.ndarray:
    """The symbol k places before each token, `none` where its text begins later."""
    out = np.full(len(symbols), none, symbols.dtype)
    out[k:] = symbols[:-k]
    out[place < k] = none
    return out


def _alive(symbols: np.ndarray, hashes: np.ndarray, place: np.ndarray, k: int, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the n-grams of a word and its k predecessors that the bits of their own and all shorter ones allow."""
    word = hashes[symbols]
    alive = np.ones(len(word), bool)
    for j in range(1, k + 1):
        some = np.flatnonzero(alive & (place >= j))
        # Both n-grams of one word less must be frequent: the one that ends here, and the one that ends before.
        some = some[alive[some - 1]] if j > 1 else some
        key = np.full(len(some), j, U64)
        for i in range(j + 1):
            key = mix(key + word[some - i])
        if j <= len(bits):
            kept = _kept(bits[j - 1], key)
            some, key = some[kept], key[kept]
        alive[:] = False
        alive[some] = True
    return some, key


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, hashes of the symbols, places) of slices of texts."""
    for batch in _texts(batches):
        codes, starts, words = word_codes(batch.column(0))
        symbols, place, _ = _symbols(codes, starts, np.arange(len(words)), len(words))
        yield symbols, np.append(word_hashes(words), END), place


def _gram_buckets(k: int, bits, n_bits: int):
    """Rows (piece, low, n): a task's n-grams by bucket, as `phrase_mining` packs them; a bucket counts to LEAST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            both = np.concatenate([buckets, fresh])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, n])[order]
            at = np.flatnonzero(np.diff(both, prepend=-1))
            return both[at], np.minimum(np.add.reduceat(n, at), LEAST) if len(at) else n

        for symbols, hashes, place in _tokens(batches):
            key = _alive(symbols, hashes, place, k, bits.value)[1]
            held.append((key & U64((1 << n_bits) - 1)).view(np.int64))
            size += len(key)
            if size >= HELD_KEYS:
                buckets, counts = merged()
                held, size = [], 0
        buckets, counts = merged()
        steps = np.diff(buckets, prepend=0)
        first = np.flatnonzero(np.diff(buckets >> 16, prepend=-1))
        steps[first] = buckets[first] & 0xFFFF
        yield from _packed(buckets >> 16, [steps.astype("<u2"), counts.astype("<u4")], ["low", "n"])

    return run


def _gram_bits(texts: DataFrame, k: int, bits: list[np.ndarray], n_bits: int) -> np.ndarray:
    """One bit for each bucket of n-grams: whether they may stand LEAST times. Collisions keep n-grams and can't lose any."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(bits)
    counts = texts.select("text").mapInArrow(_gram_buckets(k, sent, n_bits), "piece bigint, low binary, n binary")
    placed = counts.repartition(c.shuffle_partitions(spark), "piece").sortWithinPartitions("piece")
    out = np.zeros(1 << (n_bits - 3), np.uint8)
    for row in placed.mapInArrow(_frequent_bits(LEAST), "piece bigint, bits binary").where("length(bits) > 0").toLocalIterator():
        out[row["piece"] << 13 : (row["piece"] + 1) << 13] = np.frombuffer(row["bits"], np.uint8)
    sent.destroy()
    return out


def _gram_counts(k: int, bits):
    """Distinct (next word, its k predecessors) of each batch as hashes h0 to hk, with counts; only what the bits allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, hashes, place in _tokens(batches):
            width, some = len(hashes), _alive(symbols, hashes, place, k, bits.value)[0]
            gram, most = symbols[some], width
            for j in range(1, k + 1):
                if most * width >= 2**62:
                    gram = np.unique(gram, return_inverse=True)[1]
                    most = len(gram) + 1
                gram, most = gram * width + symbols[some - j], most * width
            _, first, counts = np.unique(gram, return_index=True, return_counts=True)
            at = some[first]
            columns = [pa.array(hashes[symbols[at - j]].view(np.int64)) for j in range(k + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*_names(0, k), "n"])

    return run


def _names(a: int, b: int) -> list[str]:
    return [f"h{j}" for j in range(a, b + 1)]


def _context_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """One key for each context, from the hashes of its words, newest first."""
    key = np.full(len(hashes[0]), len(hashes), U64)
    for h in hashes:
        key = mix(key + h)
    return key


def _keyed(k: int, parts: int, pairs: bool):
    """(part, key, value) of contexts (h1 to hk, value), or of their next words (h0 to hk, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [x.to_numpy(zero_copy_only=False).view(U64) for x in batch.columns[:-1]]
            key = _context_keys(hashes[1:] if pairs else hashes)
            key = mix((key ^ PAIR) + hashes[0]) if pairs else key
            yield pa.RecordBatch.from_arrays([pa.array(_part(key, parts)), pa.array(key.view(np.int64)), batch.column(batch.num_columns - 1)], names=["part", "key", "value"])

    return run


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Shards in the order of keys."""
    return (((keys >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(batch.column(0)).view(np.int64)), batch.column(1)], names=["h0", "n"])


def context_terms(texts: DataFrame, lexicon: DataFrame, parts: int, depth: int = DEPTH, nats: float = NATS, discount: float = DISCOUNT) -> DataFrame:
    """(part, key, value), written: the terms of all contexts of the tree and of their next words; one pass for each depth."""
    spark, n_texts = texts.sparkSession, texts.count()
    distinct, total = lexicon.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = total + n_texts + distinct + (n_texts > 0) + 1
    ends = spark.createDataFrame([(int(END.view(np.int64)), n_texts)], "h0 long, n long")
    lower = lexicon.select("word", "n").mapInArrow(_word_rows, "h0 long, n long").unionByName(ends)
    lower = stored(lower.withColumn("p", (F.col("n") + 1) / F.lit(float(every))), "words")
    levels, kept, bits = [], None, []
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BIT).bit_length()))
    for k in range(1, depth + 1):
        context, gram = _names(1, k), _names(0, k)
        bits.append(_gram_bits(texts, k, bits, n_bits))
        sent = spark.sparkContext.broadcast(list(bits))
        types = ", ".join(f"{x} long" for x in [*gram, "n"])
        counts = texts.select("text").mapInArrow(_gram_counts(k, sent), types).groupBy(*gram).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        # A context's count is that of its newest word after the others.
        totals = lower.select(*(F.col(f"h{j - 1}").alias(f"h{j}") for j in range(1, k + 1)), F.col("n").alias("total"))
        below = lower.select(*_names(0, k - 1), F.col("p").alias("below"))
        rows = counts.join(totals, context).join(below, _names(0, k - 1))
        rows = stored(rows.withColumn("share", (F.col("n") - discount) / F.col("total")).drop("total"), f"grams{k}")
        gammas = rows.groupBy(*context).agg(F.greatest(1 - F.sum("share"), F.lit(1e-12)).alias("gamma"))
        lower = stored(rows.join(gammas, context).withColumn("p", F.col("share") + F.col("gamma") * F.col("below")), f"chances{k}")
        nodes = lower.groupBy(*context).agg(F.first("gamma").alias("gamma"), F.sum(F.col("n") * F.log(F.col("p") / F.col("below"))).alias("gain"))
        levels.append((k, lower, stored(nodes, f"nodes{k}")))
    terms = []
    for k, rows, nodes in reversed(levels):
        context = _names(1, k)
        own = nodes.where(F.col("gain") >= nats).select(*context)
        # A kept context needs its suffixes.
        kept = stored((own if kept is None else own.unionByName(kept.select(*context))).distinct(), f"kept{k}")
        leaves = nodes.join(kept, context).select(*context, F.log10("gamma").alias("value"))
        terms.append(leaves.mapInArrow(_keyed(k, parts, False), "part long, key long, value double"))
        seen = rows.join(kept, context).select("h0", *context, F.log10(F.col("p") / (F.col("gamma") * F.col("below"))).alias("value"))
        terms.append(seen.mapInArrow(_keyed(k, parts, True), "part long, key long, value double"))
    table = terms[0]
    for other in terms[1:]:
        table = table.unionByName(other)
    return stored(table, "terms")


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(2**bits // 8, np.uint8)
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(U64)) >> U64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(found, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["bits"])

    return run


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """A bitmap that has every key of the table."""
    n = terms.count()
    bits = min(MOST_BITS, max(10, math.ceil(math.log2(8 * n + 1))))
    # One after the other, so that the driver holds two of them at most.
    out = np.zeros(2**bits // 8, np.uint8)
    for row in terms.select("key").coalesce(4).mapInArrow(_bits(bits), "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _asks(bitmap: np.ndarray, depth: int, parts: int, hashes: np.ndarray, place: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """(part, number of keys, keys, their times and owners) for tokens given by their words' hashes."""
    keys, owners = [], []
    shift = U64(64 - int(math.log2(8 * len(bitmap))))
    for k in range(1, depth + 1):
        some = np.flatnonzero(place >= k)
        context = _context_keys([hashes[some - j] for j in range(1, k + 1)])
        for key in (context, mix((context ^ PAIR) + hashes[some])):
            at = (mix(key) >> shift).astype(np.int64)
            there = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            keys.append(key[there])
            owners.append(doc[some[there]].astype(np.uint16))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    keys = owners = None
    yield from _by_part(key, owner, parts)


def _by_part(key: np.ndarray, owner: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, number of keys, keys, their times and owners) for keys of tokens and the texts that these stand in."""
    if not len(key):
        return
    # Parts are told first and sorted one after the other, so that no sorted copy of all keys is held.
    part = _part(key, parts)
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    part = None
    for p, (i, j) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        if i == j:
            continue
        own, whose = key[order[i:j]], owner[order[i:j]]
        sorted_ = np.argsort(own, kind="stable")
        own, whose = own[sorted_], whose[sorted_]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        times = np.diff(np.append(first, len(own))).astype(np.uint32)
        yield p, len(first), own[first].tobytes(), times.tobytes() + whose.tobytes()


def _record_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of _SCORE as batches of about ROW_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + len(row[4])
        if size >= ROW_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _SCORE)], schema=_SCORE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _SCORE)], schema=_SCORE)


def _add_up(asked: pa.Table, terms: pa.Table) -> pa.Table:
    """Sums of the terms for each document of each batch that asks."""
    keys = terms.column("key").to_numpy().view(U64) if terms.num_rows else np.empty(0, U64)
    order = np.argsort(keys)
    keys, values = keys[order], (terms.column("value").to_numpy() if terms.num_rows else np.empty(0))[order]
    rows = []
    for batch, n, a, b in zip(*(asked.column(x) for x in ("batch", "n", "a", "b"))):
        n, b = n.as_py(), b.as_py()
        at = _find(keys, np.frombuffer(a.as_py(), U64))
        value = np.where(at >= 0, values[at], 0.0) if len(values) else np.zeros(n)
        owner = np.frombuffer(b[4 * n :], np.uint16)
        gain = np.bincount(owner, np.repeat(value, np.frombuffer(b[: 4 * n], np.uint32)))
        docs = np.flatnonzero(gain)
        rows.append((batch.as_py(), 1, len(docs), docs.astype(np.uint32).tobytes(), gain[docs].astype("<f8").tobytes()))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, list(_SCORE)[:5])], names=["batch", "part", "n", "a", "b"])


def _local_scores(tree_of, parts: int, bitmap_of_terms=None, depth: int = 0):
    """Per batch: one row with what is known here, the rare words by part of the hash space, and keys of terms by part, from `parts` on."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tree = tree_of.value
        every = math.log10(tree.tokens + tree.distinct + 1)
        for batch in _texts(batches, SCORED_BYTES):
            codes, starts, words = word_codes(batch.column(2))
            n = batch.num_rows
            if not n:
                continue
            ids = tree.ids(words)
            symbols, place, doc = _symbols(codes, starts, ids, tree.end)
            known = symbols >= 0
            unigram = np.zeros(len(symbols))
            unigram[known] = np.log10(tree.counts[symbols[known]] + 1)
            root = np.where(known, np.power(10.0, unigram - every), 1.0)
            chance = root.copy()
            for d, node in enumerate(_states(tree, symbols, place)):
                some = np.flatnonzero(node >= 0)
                found = np.full(len(some), -1)
                near = np.flatnonzero(known[some])
                found[near] = _find(tree.pair_keys[d], node[some[near]] * tree.width + symbols[some[near]])
                share = np.where(found >= 0, tree.pair_shares[d][found], 0) if len(tree.pair_shares[d]) else 0
                chance[some] = share + tree.gammas[d][node[some]] * chance[some]
            # A rare word's chance is its unigram chance times what the contexts leave to it.
            gain = np.bincount(doc, np.log10(chance) - np.log10(root), minlength=n)
            base = np.bincount(doc, unigram - every, minlength=n)
            seen = np.bincount(doc, known & (tree.counts[symbols] > 0), minlength=n).astype(np.int64)
            number = uuid.uuid4().int >> 65
            head = [np.diff(starts) + 1, seen, base, gain]
            yield (number, -1, n, b"".join(x.astype("<f8" if x.dtype.kind == "f" else "<i8").tobytes() for x in head), b"", batch.column(0).to_pylist(), batch.column(1).to_pylist())
            known = unigram = root = chance = head = None
            if bitmap_of_terms is not None:
                every_hash = np.append(word_hashes(words), END)
                place_of = _symbols(codes, starts, np.arange(len(words)), len(words))[0]
                for part, *ask in _asks(bitmap_of_terms.value, depth, parts, every_hash[place_of], place, doc):
                    yield number, parts + part, *ask, None, None
            rare = ids < 0
            token = np.flatnonzero(rare[codes]) if len(codes) else np.empty(0, np.int64)
            if len(token):
                owner = np.repeat(np.arange(n), np.diff(starts))[token]
                chosen = np.flatnonzero(rare)
                hashes = np.zeros(len(words), U64)
                hashes[chosen] = word_hashes(words.take(pa.array(chosen)))
                check = np.zeros(len(words), U64)
                check[chosen] = word_hashes(words.take(pa.array(chosen)), 1)
                part = (hashes % U64(parts)).astype(np.int64)
                order = np.lexsort((codes[token], part[codes[token]]))
                code, owner = codes[token][order], owner[order]
                at = part[code]
                for i, j in zip(*_runs(at)):
                    first = np.flatnonzero(np.concatenate([[True], code[i + 1 : j] != code[i : j - 1]]))
                    word = code[i:j][first]
                    keys = hashes[word].tobytes() + (check[word] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                    times = np.diff(np.append(first, j - i)).astype(np.uint32)
                    yield number, int(at[i]), len(word), keys, times.tobytes() + owner[i:j].astype(np.uint32).tobytes(), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _record_batches(told(batches))

    return run


_SCORE = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])
_ROW = "batch long, part long, n long, a binary, b binary"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    return cuts[:-1], cuts[1:]


def _hashed_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k = word_hashes(batch.column(0)), word_hashes(batch.column(0), 1) & U64(0xFFFFFFFF)
            columns = [pa.array((h % U64(parts)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int64)), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "h", "k", "n"])

    return run


def _look_up(asked: pa.Table, words: pa.Table) -> pa.Table:
    """Sums of log10(n + 1) and numbers of known tokens for each document of each batch that asks."""
    keys = words.column("h").to_numpy().view(U64) if words.num_rows else np.empty(0, U64)
    check = words.column("k").to_numpy().astype(U64) if words.num_rows else np.empty(0, U64)
    both = mix(keys) + check
    order = np.argsort(both)
    both, keys, check, counts = both[order], keys[order], check[order], (words.column("n").to_numpy() if words.num_rows else np.empty(0, np.int64))[order]
    rows = []
    for row in asked.to_pylist():
        n = row["n"]
        h, k = np.frombuffer(row["a"][: 8 * n], U64), np.frombuffer(row["a"][8 * n :], np.uint32).astype(U64)
        times = np.frombuffer(row["b"][: 4 * n], np.uint32)
        owner = np.frombuffer(row["b"][4 * n :], np.uint32)
        at = _find(both, mix(h) + k)
        count = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
        docs, inverse = np.unique(owner, return_inverse=True)
        per_token = np.repeat(count, times)
        logs = np.bincount(inverse, np.log10(per_token + 1))
        known = np.bincount(inverse, per_token > 0).astype("<i8")
        rows.append((row["batch"], 0, len(docs), docs.astype(np.uint32).tobytes(), known.tobytes() + logs.astype("<f8").tobytes()))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, list(_SCORE)[:5])], names=["batch", "part", "n", "a", "b"])


def _gather(tree: Tree):
    tokens = tree.tokens

    def run(head: pa.Table, sums: pa.Table) -> pa.Table:
        row = head.to_pylist()[0]
        n = row["n"]
        size, seen = np.frombuffer(row["a"][: 16 * n], "<i8").reshape(2, n).copy()
        base, gain = np.frombuffer(row["a"][16 * n :], "<f8").reshape(2, n).copy()
        # In a fixed order, so that sums of floats agree between runs.
        for other in sorted(sums.to_pylist(), key=lambda x: (x["part"], x["a"], x["b"])):
            docs = np.frombuffer(other["a"], np.uint32)
            if other["part"]:
                gain[docs] += np.frombuffer(other["b"], "<f8")
                continue
            seen[docs] += np.frombuffer(other["b"][: 8 * other["n"]], "<i8")
            base[docs] += np.frombuffer(other["b"][8 * other["n"] :], "<f8")
        return pa.table({
            "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(size), "n_known": pa.array(seen),
            "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(base), "score": pa.array(base + gain),
        })

    return run


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_texts(docs: DataFrame, depth: int = DEPTH, nats: float = NATS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = c.shuffle_partitions(spark)
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    lexicon = lexicon_of(training)
    tree = grow(training, lexicon, 0)
    return scored(docs, tree, lexicon, parts, context_terms(training, lexicon, parts, depth, nats), depth)


def scored(docs: DataFrame, tree: Tree, lexicon: DataFrame, parts: int, terms: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """Scores by the tree's words and contexts, and by a table of terms."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(terms)) if terms is not None else None
    sent = docs.sparkSession.sparkContext.broadcast(tree)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    # Written before it is split, so that all parts of a batch stem from one run of its task.
    local = stored(rows.mapInArrow(_local_scores(sent, parts, bitmap, depth), _ROW + ", docs array<bigint>, held array<boolean>"), "scores")
    hashed = lexicon.select("word", "n").mapInArrow(_hashed_words(parts), "part long, h long, k long, n long")
    asked = local.where(F.col("part").between(0, parts - 1)).select("batch", "part", "n", "a", "b")
    sums = asked.groupBy("part").cogroup(hashed.groupBy("part")).applyInArrow(_look_up, _ROW)
    if terms is not None:
        asked = local.where(F.col("part") >= parts).select((F.col("part") - parts).alias("part"), "batch", "n", "a", "b")
        sums = sums.unionByName(asked.groupBy("part").cogroup(terms.groupBy("part")).applyInArrow(_add_up, _ROW))
    heads = local.where("part < 0").select("batch", "n", "a", "docs", "held")
    return heads.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(_gather(tree), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
