"""Hashed text vectors, nearest neighbours, exact near-copy pairs and their components.

A vector travels as `(id, vec, sq)`: `vec` packs the whole-number gram weights as little-endian float32 and
`sq` is their squared length, so every dot product is exact and a cosine is `dot / sqrt(sq * sq)`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from spreadlens.functions.grams import DIM, NGRAM, check_grams, hashed_grams
from spreadlens.functions.text import words
from spreadlens.operators.graph import components
from spreadlens.schemas import require_columns
from spreadlens.session import spread, stored

# Rows of one side of a block product: 4,096 vectors of 512 dims are 8 MB packed.
BLOCK_ROWS = 4096
# Rows embedded at once.
EMBEDDED_ROWS = 2048
# More than a cosine in single precision, and its rounding to six digits, can be off.
SINGLE_ERROR = 1e-4
# Pairs that are told exactly at once, and the share of a strip's pairs from which all are.
PAIRS_AT_ONCE, DENSE_SHARE = 1 << 13, 0.05


# ---- embedding -----------------------------------------------------------------------------------


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DIM, ngram: tuple[int, int] = NGRAM, hash_name: str = "md5") -> DataFrame:
    """Long sparse form (id, dim, w) of unit vectors; a zero vector has no rows, and rows of one id are one text.

    Texts are placed and sorted by id, and a task adds up the grams of the rows of one id as they pass: grams are neither
    shuffled nor sorted, and what a task holds is a few rows.
    """
    check_grams(dim, ngram, hash_name)
    placed = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").sortWithinPartitions("id")
    coded = placed.select("id", words(F.lower(F.coalesce("text", F.lit("")))).alias("_words"))

    def told(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        norms = np.sqrt((sums * sums).sum(axis=1))
        row, at = np.nonzero(sums)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(sums[row, at] / norms[row])], ["id", "dim", "w"])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, EMBEDDED_ROWS):
                rows = batch.slice(k, EMBEDDED_ROWS)
                ids, sums = rows.column("id"), _packed_sums(rows.column("_words"), dim, ngram, hash_name).astype(np.int64)
                if held is not None:
                    # The last id may go on in the next rows.
                    ids, sums = pa.concat_arrays([held[0], ids]), np.concatenate([held[1], sums])
                ids, sums = _sums_by_id(ids, sums)
                held = ids.slice(len(ids) - 1), sums[-1:]
                if len(ids) > 1:
                    yield told(ids.slice(0, len(ids) - 1), sums[:-1])
        if held is not None:
            yield told(*held)

    fields = [coded.schema["id"], T.StructField("dim", T.IntegerType()), T.StructField("w", T.DoubleType())]
    return coded.mapInArrow(units, T.StructType(fields))


def _sums_by_id(ids: pa.Array, sums: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in the order they come first, NULL one of them, and the sums of their rows."""
    coded = ids.dictionary_encode(null_encoding="encode")
    if len(coded.dictionary) == len(ids):
        return ids, sums
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    return coded.dictionary, np.add.reduceat(sums[order], np.flatnonzero(np.diff(code[order], prepend=-1)))


def _packed_sums(texts: pa.ListArray, dim: int, ngram: tuple[int, int], hash_name: str) -> np.ndarray:
    """One row of signed gram counts per text, from its words. Each distinct word of a batch is hashed once, and each text
    adds a word's grams once, times its count."""
    lengths = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    flat = texts.flatten().dictionary_encode()
    n_words = max(len(flat.dictionary), 1)
    text = np.repeat(np.arange(len(texts)), lengths)
    pairs, times = np.unique(text * n_words + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    codes, ends = hashed_grams(flat.dictionary.to_pylist(), dim, ngram, hash_name)
    text, word = pairs // n_words, pairs % n_words
    out = np.zeros(len(texts) * dim)
    step = 1 << 18
    for a in range(0, len(word), step):
        own = word[a : a + step]
        size = ends[own + 1] - ends[own]
        code = codes[np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        weight = np.repeat(times[a : a + step], size) * (1 - 2 * (code % 2))
        slots = np.repeat(text[a : a + step], size) * dim + code // 2
        low = int(text[a]) * dim
        sums = np.bincount(slots - low, weights=weight)
        out[low : low + len(sums)] += sums
    return out.reshape(len(texts), dim)


def hash_vectors(
    df: DataFrame, id_col: str, text_col: str, dim: int = DIM, ngram: tuple[int, int] = NGRAM, hash_name: str = "md5", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, vec, sq) and the carried columns. The JVM splits the texts and numpy adds up the grams, where the rows are:
    nothing is shuffled, so the number of tasks is the scan's."""
    coded = df.select(F.col(id_col).alias("id"), words(F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("_words"), *carry)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _packed_sums(batch.column("_words"), dim, ngram, hash_name)
            packed = fixed_binary(sums.astype("<f4"))
            squares = pa.array((sums * sums).sum(axis=1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, squares, *(batch.column(c) for c in carry)], ["id", "vec", "sq", *carry])

    fields = [coded.schema["id"], T.StructField("vec", T.BinaryType()), T.StructField("sq", T.LongType()), *(coded.schema[c] for c in carry)]
    return coded.mapInArrow(add_up, T.StructType(fields))


# (df, id column, text column) to (id, vec, sq): the hashed grams, or a model's vectors by way of `pack_arrays`.
Embed = Callable[[DataFrame, str, str], DataFrame]


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int64) if width else np.zeros(len(rows) + 1, np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return whole.cast(pa.binary())


def unit_arrays(df: DataFrame, text_col: str, out: str = "embedding", dim: int = DIM, hash_name: str = "md5") -> DataFrame:
    """`df` with the unit vector of a text column as array<double> in the text's place, for estimators."""
    coded = df.withColumn("_words", words(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).drop(text_col)
    kept = [c for c in coded.columns if c != "_words"]

    def normalised_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _packed_sums(batch.column("_words"), dim, NGRAM, hash_name)
            units = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1.0)
            offsets = pa.array(np.arange(0, units.size + 1, dim, dtype=np.int32))
            arrays = pa.ListArray.from_arrays(offsets, pa.array(units.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), arrays], [*kept, out])

    return coded.mapInArrow(normalised_sums, coded.select(*kept).schema.add(out, T.ArrayType(T.DoubleType())))


def pack_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(id, vec, sq) from ready-made float vectors, such as a model's embeddings."""
    plain = df.select(F.col(id_col).alias("id"), F.col(array_col).cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v")
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            rows = flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), "<f4")
            squares = pa.array((rows.astype(float) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), fixed_binary(rows), squares], ["id", "vec", "sq"])

    return plain.mapInArrow(pack, f"id {plain.schema['id'].dataType.simpleString()}, vec binary, sq double")


def _matrix(vecs: pd.Series | pa.ChunkedArray) -> np.ndarray:
    rows = vecs.to_pylist() if isinstance(vecs, pa.ChunkedArray) else vecs
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1).astype(np.float64)


def _cosines(left: pd.DataFrame | pa.Table, right: pd.DataFrame | pa.Table) -> np.ndarray:
    lengths = np.sqrt(np.outer(left["sq"].to_numpy().astype(float), right["sq"].to_numpy().astype(float)))
    dots = _matrix(left["vec"]) @ _matrix(right["vec"]).T
    return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


# ---- nearest neighbours --------------------------------------------------------------------------


def nearest(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, item_id, similarity, position): each query's `k` most similar items, ties by item id.

    Both sides are packed into blocks of at most `block_rows`, written once, and every block of queries meets every block of items
    by reading them again: nothing is copied or shuffled. A task carries a block's top k from one block of items to the next and
    looks only at what may still enter it; the tops are merged afterwards. The result is exact.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    query_type, item_type = (x.schema["id"].dataType for x in (queries, items))
    left, right = (packed_blocks(x, block_rows) for x in (queries, items))
    left, right = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in x.columns]) for side, x in (("x", left), ("y", right)))
    met = left.join(right.hint("shuffle_replicate_nl"))
    kinds = [to_arrow_type(query_type), to_arrow_type(item_type), pa.float64()]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (_Block(*(batch.column(f"{side}_{c}")[row] for c in ("block", "ids", "sqs", "kind", "vecs"))) for side in ("x", "y"))
                if held is not None and held.queries.block != x.block:
                    yield held.rows(kinds)
                    held = None
                if held is None:
                    held = _Tops(x, k)
                held.meet(y)
        if held is not None:
            yield held.rows(kinds)

    schema = f"query_id {query_type.simpleString()}, item_id {item_type.simpleString()}, similarity double"
    found = met.mapInArrow(top, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def _units(rows: np.ndarray, sqs: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, scaled in double; zero vectors stay zero."""
    lengths = np.sqrt(sqs)
    with np.errstate(invalid="ignore"):
        return (rows * np.divide(1.0, lengths, out=np.zeros(len(sqs)), where=lengths > 0)[:, None]).astype("<f4")


def _rounded(dots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Cosines to six digits; of a zero vector 0."""
    return np.round(np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0), 6)


class _Tops:
    """The `k` most similar items that each row of a block of queries has met so far, the most similar first, ties by item id."""

    def __init__(self, queries: _Block, k: int) -> None:
        self.queries, self.k = queries, k
        self.row, self.sims, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        # What an item must reach to enter a row's top: the last of it, if it is full.
        self.least = np.full(len(queries.ids), -np.inf)

    def meet(self, items: _Block) -> None:
        x, n = self.queries, len(items.ids)
        # By id, so that a stable order breaks ties by id.
        order = pc.array_sort_indices(items.ids, null_placement="at_start").to_numpy()
        y, y_sqs = items.rows[order].astype(float), items.sqs[order]
        units = _units(y, y_sqs).T
        found = []
        for at in range(0, len(x.ids), STRIP_ROWS):
            own, sqs = x.rows[at : at + STRIP_ROWS].astype(float), x.sqs[at : at + STRIP_ROWS]
            near = _units(own, sqs) @ units
            least = self.least[at : at + STRIP_ROWS]
            if n > self.k and np.isinf(least).any():
                # The k-th best of this block alone is a bound as well.
                least = np.maximum(least, -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1])
            # Not "at least", so that what isn't a number is told below.
            i, j = np.nonzero(~(near < (least - SINGLE_ERROR)[:, None]))
            if len(i) > DENSE_SHARE * near.size:
                # Many copies: every pair in double precision, and the first k of each row.
                sims = _rounded(own @ y.T, np.sqrt(np.outer(sqs, y_sqs)))
                j = np.argsort(-sims, axis=1, kind="stable")[:, : self.k].ravel()
                i = np.repeat(np.arange(len(own)), min(self.k, n))
                sims = sims[i, j]
            else:
                cuts = range(0, max(len(i), 1), PAIRS_AT_ONCE)
                pairs = [(i[c : c + PAIRS_AT_ONCE], j[c : c + PAIRS_AT_ONCE]) for c in cuts]
                sims = np.concatenate([_rounded(np.einsum("ij,ij->i", own[a], y[b]), np.sqrt(sqs[a] * y_sqs[b])) for a, b in pairs])
            found.append((i + at, order[j], sims))
        rows, columns, sims = (np.concatenate(parts) for parts in zip(*found))
        self._merge(rows, sims, items.ids.take(pa.array(columns)))

    def _merge(self, rows: np.ndarray, sims: np.ndarray, ids: pa.Array) -> None:
        rows, sims = np.concatenate([self.row, rows]), np.concatenate([self.sims, sims])
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        order = order[np.lexsort((-sims[order], rows[order]))]
        rows, sims = rows[order], sims[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < self.k
        self.row, self.sims, self.ids = rows[kept], sims[kept], ids.take(pa.array(order[kept]))
        full = place == self.k - 1
        # Rows that still hold what isn't a number have no bound.
        self.least[rows[full]] = np.where(np.isnan(sims[full]), -np.inf, sims[full])

    def rows(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = [self.queries.ids.take(pa.array(self.row)), self.ids, pa.array(self.sims)]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=["query_id", "item_id", "similarity"])


def block_copies(vectors: DataFrame, blocks: int) -> DataFrame:
    """Copies of `vectors` for tasks (i, j), i <= j: a vector of block b is a row of (b, j) for j >= b and a column of (i, b)
    for i < b, so it is copied once for each block."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    roles = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j"), (k < block).alias("right")),
    )
    return vectors.select("id", "vec", "sq", F.explode(roles).alias("role")).select("role.i", "role.j", "role.right", "id", "vec", "sq")


def packed_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, sqs, kind, vecs): runs of at most `block_rows` vectors as one row each, packed where they lie and written.

    `kind` is the narrowest number type that holds the block's components exactly. A block is a file of its own, so the scan
    deals blocks out by their bytes.
    """
    vectors = vectors.select("id", "vec", "sq")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f4")
            small = next((k for k in ("<i1", "<i2") if np.array_equal(rows.astype(k), rows)), "<f4")
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "sq")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([small]), pa.array([rows.astype(small).tobytes()], pa.binary())], names=["ids", "sqs", "kind", "vecs"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - sum(h.num_rows for h in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(h.num_rows for h in held) == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    of = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "sq")}
    packed = vectors.mapInArrow(pack, f"ids array<{of['id']}>, sqs array<{of['sq']}>, kind string, vecs binary")
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), "blocks", maxRecordsPerFile=1)


# ---- near copies ---------------------------------------------------------------------------------


def linked_pairs(
    vectors: DataFrame, id_col: str, threshold: float, forest: bool = False, block_rows: int = BLOCK_ROWS, candidates: str = "blocks"
) -> DataFrame:
    """(a, b, similarity), a < b: every pair with cosine at least `threshold`, found exactly.

    With `candidates="bands"` only pairs that share a hyperplane signature are compared (`banded_pairs`): the work no longer
    grows with the square of the texts, and links near the threshold may be missed. Never chosen by size.

    Vectors are packed into blocks of at most `block_rows`, written once, and every pair of blocks is met by reading the blocks
    again: nothing is copied or shuffled, so what is written grows with the vectors and only the comparing with their square.
    With `forest`, a task returns a spanning forest of the links in all its pairs of blocks instead of all of them: the same
    components from at most one link per vector, also where a third of the texts are copies.
    """
    require_columns(vectors, ("id", "vec", "sq"))
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if candidates not in ("blocks", "bands"):
        raise ValueError("candidates must be 'blocks' or 'bands'")
    if candidates == "bands":
        return banded_pairs(vectors, threshold, forest)
    id_type = vectors.schema["id"].dataType
    blocks = packed_blocks(vectors.where("sq > 0"), block_rows)
    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("x", "y"))
    # Of the two ways to meet, one: by turns, so that all tasks have about as much to compare.
    turn = (F.col("x_block") + F.col("y_block")) % 2
    once = F.when(F.col("x_block") < F.col("y_block"), turn == 0).when(F.col("x_block") > F.col("y_block"), turn == 1).otherwise(True)
    met = left.join(right.hint("shuffle_replicate_nl"), once)
    kind = to_arrow_type(id_type)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (_Block(*(batch.column(f"{side}_{c}")[k] for c in ("block", "ids", "sqs", "kind", "vecs"))) for side in ("x", "y"))
                a, b, sims = _links(x, y, threshold, forest)
                if forest:
                    fresh = joined.fresh(x, a, y, b)
                    a, b, sims = a[fresh], b[fresh], sims[fresh]
                a, b = x.ids.take(pa.array(a)), y.ids.take(pa.array(b))
                swap = pc.greater(a, b)
                columns = [pc.if_else(swap, b, a).cast(kind), pc.if_else(swap, a, b).cast(kind), pa.array(sims, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"])

    return met.mapInArrow(compare, f"a {id_type.simpleString()}, b {id_type.simpleString()}, similarity double")


# Rows of a block that are held against the other block at once.
STRIP_ROWS = 512


class _Block:
    """A row of `packed_blocks` as arrays."""

    def __init__(self, block: pa.Scalar, ids: pa.Scalar, sqs: pa.Scalar, kind: pa.Scalar, vecs: pa.Scalar) -> None:
        self.block, self.ids = block.as_py(), ids.values
        self.sqs = sqs.values.to_numpy(zero_copy_only=False).astype(float)
        self.whole = kind.as_py() != "<f4"
        self.rows = np.frombuffer(vecs.as_buffer(), kind.as_py()).reshape(len(self.ids), -1)


class _Joined:
    """Which rows of the blocks that a task has met are connected so far."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.first: dict[int, int] = {}

    def _places(self, block: _Block, rows: np.ndarray) -> list[int]:
        if block.block not in self.first:
            self.first[block.block] = len(self.parent)
            self.parent.extend(range(len(self.parent), len(self.parent) + len(block.ids)))
        return (rows + self.first[block.block]).tolist()

    def _root(self, place: int) -> int:
        parent = self.parent
        while parent[place] != place:
            parent[place] = parent[parent[place]]
            place = parent[place]
        return place

    def fresh(self, x: _Block, rows: np.ndarray, y: _Block, columns: np.ndarray) -> np.ndarray:
        """Which of the links connect what was apart."""
        out = np.zeros(len(rows), bool)
        for k, (a, b) in enumerate(zip(self._places(x, rows), self._places(y, columns))):
            a, b = self._root(a), self._root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out[k] = True
        return out


def _links(x: _Block, y: _Block, threshold: float, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, similarities) of the links between two blocks, or of a forest of them."""
    # Partial sums of whole numbers stay below the product of the lengths, so below 2^24 single precision is exact.
    kind = "<f4" if x.whole and y.whole and x.sqs.max() * y.sqs.max() < 2.0**48 else float
    a, b = x.rows.astype(kind), y.rows.astype(kind).T
    long_x, long_y = (np.sqrt(s).astype(kind) for s in (x.sqs, y.sqs))
    same = x.block == y.block
    found = []
    for top in range(0, len(a), STRIP_ROWS):
        dots = a[top : top + STRIP_ROWS] @ b
        # A first cut with room for its own rounding; what passes is told in double precision.
        near = dots >= np.outer(long_x[top : top + STRIP_ROWS], long_y * np.dtype(kind).type(threshold - 1e-4))
        rows, columns = np.nonzero(near)
        if same:
            rows, columns = rows[columns > rows + top], columns[columns > rows + top]
        sims = np.round(dots[rows, columns].astype(float) / np.sqrt(x.sqs[rows + top] * y.sqs[columns]), 6)
        close = sims >= threshold
        found.append((rows[close] + top, columns[close], sims[close]))
    rows, columns, sims = (np.concatenate(parts) for parts in zip(*found))
    if not forest or not len(rows):
        return rows, columns, sims
    close = np.zeros((len(a), b.shape[1]), bool)
    close[rows, columns] = True
    rows, columns = _forest(close, same)
    dots = np.einsum("ij,ij->i", x.rows[rows].astype(float), y.rows[columns].astype(float))
    return rows, columns, np.round(dots / np.sqrt(x.sqs[rows] * y.sqs[columns]), 6)


def _comparer(threshold: float, forest: bool):
    """The links of one pair of blocks (rows with i, j and whether they are its right side)."""

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        i, j = int(block["i"].iloc[0]), int(block["j"].iloc[0])
        left = block[~block["right"]]
        right = left if i == j else block[block["right"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        sims = np.round(_cosines(left, right), 6)
        close = sims >= threshold
        if i == j:
            close &= np.triu(np.ones_like(close), 1).astype(bool)
        rows, columns = _forest(close, i == j) if forest else np.nonzero(close)
        x, y = left["id"].to_numpy()[rows], right["id"].to_numpy()[columns]
        swap = x > y
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "similarity": sims[rows, columns]})

    return compare


# ---- candidates by signatures --------------------------------------------------------------------

# Signatures of a vector: tables, bits of a key, and how many of its bits, the least certain first, are also tried flipped.
TABLES, KEY_BITS, FLIPS = 48, 12, 12
# Bits of a sketch that candidates are held against before their vectors are fetched, and the spread allowed for.
SKETCH_BITS, SKETCH_SPREAD = 512, 4.0
# A key with more vectors than this is compared in pairs of blocks.
HOT_ROWS = 256


def mean_unit(vectors: DataFrame) -> np.ndarray:
    """The mean of the unit vectors, from one sum per dimension."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(float)
            sums = (rows / np.sqrt(batch.column("sq").to_numpy(zero_copy_only=False).astype(float))[:, None]).sum(axis=0)
            total, n = sums if total is None else total + sums, n + len(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["k", "v", "n"])

    sums = vectors.select("vec", "sq").mapInArrow(add_up, "k bigint, v double, n bigint").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v"))
    return np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["k"])])


def signatures(vectors: DataFrame, mean: np.ndarray, tables: int = TABLES, bits: int = KEY_BITS, flips: int = FLIPS, seed: int = 7) -> DataFrame:
    """(id, keys: array of (table, key, base), sketch: array of longs) of vectors taken relative to their mean.

    Texts of one language share most of a hashed vector, so hyperplanes through the mean tell them apart. A key has one bit for
    each plane; keys with one of the `flips` bits nearest their plane flipped are listed with `base` false.
    """
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((len(mean), tables * bits + SKETCH_BITS)).astype("<f4")
    lift = mean @ planes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<f4").reshape(n, -1)
            sides = rows @ planes / np.sqrt(batch.column("sq").to_numpy(zero_copy_only=False).astype("<f4"))[:, None] - lift
            own = sides[:, : tables * bits].reshape(n, tables, bits)
            base = ((own > 0) * weights).sum(axis=2)
            near = np.argsort(np.abs(own), axis=2)[:, :, :flips]
            keys = np.concatenate([base[:, :, None], base[:, :, None] ^ weights[near]], axis=2)
            size = keys.shape[1] * keys.shape[2]
            table = np.broadcast_to(np.arange(tables)[None, :, None], keys.shape)
            is_base = np.broadcast_to(np.arange(keys.shape[2])[None, None, :] == 0, keys.shape)
            structs = pa.StructArray.from_arrays([pa.array(a.ravel()) for a in (table.astype(np.int32), keys.astype(np.int64), is_base)], names=["table", "key", "base"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), structs)
            packed = np.packbits(sides[:, tables * bits :] > 0, axis=1).view("<i8")
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32)), pa.array(packed.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, sketch], names=["id", "keys", "sketch"])

    added = T.StructType.fromDDL("keys array<struct<table:int,key:bigint,base:boolean>>, sketch array<bigint>")
    return vectors.select("id", "vec", "sq").mapInArrow(sign, T.StructType([vectors.schema["id"], *added.fields]))


def banded_pairs(
    vectors: DataFrame, threshold: float, forest: bool = False, tables: int = TABLES, bits: int = KEY_BITS, flips: int = FLIPS, seed: int = 7
) -> DataFrame:
    """(a, b, similarity), a < b: pairs that share a key in one of the tables and have a cosine of at least `threshold`.

    Candidates are pairs of narrow rows: a vector's keys, some bits flipped, meet the others' own keys, and sketches of
    SKETCH_BITS bits must agree as far as the threshold asks for, less SKETCH_SPREAD standard deviations. Only what is left
    fetches vectors and is compared exactly. Keys of more than HOT_ROWS vectors are compared in pairs of blocks instead, with a
    spanning forest from each if `forest` is asked for.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors.where("sq > 0").select("id", "vec", "sq"), "vectors")
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"a {id_type}, b {id_type}, similarity double"
    if vectors.count() < 2:
        return spark.createDataFrame([], schema)
    mean = mean_unit(vectors)
    signed = stored(signatures(vectors, mean, tables, bits, flips, seed), "signatures")
    listed = signed.select("id", "sketch", F.explode("keys").alias("k")).select("id", "sketch", "k.*")
    sizes = listed.where("base").groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.where(F.col("n") > HOT_ROWS), "hot")
    cold = listed.join(hot, ["table", "key"], "left_anti")

    # Links between texts that have more than the average share of the mean are further apart around it.
    shared = min(2 * float(mean @ mean), threshold)
    angle = math.acos(max(-1.0, min(1.0, (threshold - shared) / max(1 - shared, 1e-9)))) / math.pi
    allowed = int(SKETCH_BITS * angle + SKETCH_SPREAD * math.sqrt(SKETCH_BITS * angle * (1 - angle)))
    left = cold.select("table", "key", F.col("id").alias("a"), F.col("sketch").alias("x"))
    right = cold.where("base").select("table", "key", F.col("id").alias("b"), F.col("sketch").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    met = left.join(right, ["table", "key"]).where((F.col("a") != F.col("b")) & (apart <= allowed))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = vectors.select(F.col("id").alias("a"), F.struct("vec", "sq").alias("left"))
    other = vectors.select(F.col("id").alias("b"), F.struct("vec", "sq").alias("right"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(_matrix(c.field("vec").to_pylist()), c.field("sq").to_numpy(zero_copy_only=False).astype(float)) for c in (batch.column("left"), batch.column("right"))]
            (x, p), (y, q) = sides
            sims = np.round((x * y).sum(axis=1) / np.sqrt(p * q), 6)
            keep = pa.array(sims >= threshold)
            columns = [batch.column("a"), batch.column("b"), pa.array(sims)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "similarity"])

    checked = pairs.join(own, "a").join(other, "b").select("a", "b", "left", "right").mapInArrow(check, schema)
    return checked.unionByName(_hot_pairs(vectors, listed, hot, threshold, forest, schema)).distinct()


def _hot_pairs(vectors: DataFrame, listed: DataFrame, hot: DataFrame, threshold: float, forest: bool, schema: str) -> DataFrame:
    """The links within crowded keys: a vector is copied once for each block of its key."""
    members = listed.join(hot.select("table", "key"), ["table", "key"]).select("table", "key", "id").distinct()
    sized = members.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    roles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j"), (k < F.col("block")).alias("right")),
    )
    copies = members.join(sized, ["table", "key"]).withColumn("block", block).select("table", "key", "id", F.explode(roles).alias("role"))
    tasks = copies.join(vectors, "id").select("table", "key", "role.i", "role.j", "role.right", "id", "vec", "sq")
    return tasks.groupBy("table", "key", "i", "j").applyInPandas(_comparer(threshold, forest), schema)


def _forest(close: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of links that connect whatever `close` connects: breadth first, one link per newcomer."""
    if same:
        close = close | close.T
    n_left, n_right = close.shape
    seen_left, seen_right = np.zeros(n_left, bool), np.zeros(n_right, bool)
    if same:
        seen_right = seen_left
    rows, columns = [], []
    for start in np.flatnonzero(close.any(axis=1)):
        if seen_left[start]:
            continue
        seen_left[start] = True
        queue = [(start, True)]
        while queue:
            node, is_left = queue.pop()
            line = close[node] if is_left else close[:, node]
            seen = seen_right if is_left else seen_left
            fresh = np.nonzero(line & ~seen)[0]
            seen[fresh] = True
            for other in fresh:
                rows.append(node if is_left else other)
                columns.append(other if is_left else node)
                queue.append((other, is_left if same else not is_left))
    return np.asarray(rows, dtype=int), np.asarray(columns, dtype=int)


def fold_members(pairs: DataFrame) -> DataFrame:
    """(node, root) for every linked node: the smallest node of its connected component."""
    return components(pairs)


# ---- matching ------------------------------------------------------------------------------------

# Fixed value: the similarity from which a post rides a template.
MATCH_THRESHOLD = 0.55


def match_templates(posts: DataFrame, templates: DataFrame, threshold: float = MATCH_THRESHOLD, embed: Embed = hash_vectors) -> DataFrame:
    """(id, template_id, similarity) for posts (id, normalised) against templates (id, normalised).

    An equal normalised text is a match of 1. Otherwise the most similar template counts from `threshold`
    on; below it the template is NULL and the similarity is still the best one seen. Without templates
    every post gets (NULL, 0).
    """
    digest = F.md5("normalised").alias("digest")
    exact_keys = templates.select(digest, "id").groupBy("digest").agg(F.min("id").alias("template_id"))
    keyed = posts.select("id", "normalised", digest).join(exact_keys, "digest", "left")
    exact = keyed.where("template_id is not null").select("id", "template_id", F.lit(1.0).alias("similarity"))
    # Copies of one text share a best template, so each distinct text is compared once.
    texts = keyed.where("template_id is null").groupBy("digest").agg(F.min("normalised").alias("normalised"))
    best = nearest(embed(texts, "digest", "normalised"), embed(templates, "id", "normalised"), k=1)
    best = best.select(F.col("query_id").alias("digest"), "item_id", "similarity")
    near = (
        keyed.where("template_id is null")
        .select("id", "digest")
        .join(best, "digest", "left")
        .select(
            "id",
            F.when(F.col("similarity") >= threshold, F.col("item_id")).alias("template_id"),
            F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        )
    )
    return exact.unionByName(near)
