"""Token ids in directly addressable codes: any token of any file can be read without decoding a block.

Ids are cut into chunks of eight bits. Level 0 holds the low chunk of every id and a bitmap of those that go on; level k
holds the next chunk of the ids that reach it. The k-th chunk of an id is found by its rank among the continuing ones: a
directory has the rank at every 512th bit, the rest is a count of bits in one block. Segments of about a million ids are the
values of a binary column, with the documents' ids and ends beside them; the container is Parquet, so that any store that Spark
writes serves, with its commit protocol.

The vocabulary never spans white space, so each task encodes the distinct words of its batches with the tokenizer library
and joins the results; the ids of a text equal those of encoding it whole. Ranges of doc_id come from a quantile sketch, so
neither texts nor ids are read twice for placing them.

Defined cases: NULL and empty texts have the end id alone; a NULL doc_id comes first; rows of one doc_id are ordered by
their ids' digest; an empty table makes no segment; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.llm.tokens import word_codes

BLOCK_BITS, SEGMENT_IDS, CACHED_WORDS, JOINED = 512, 1 << 20, 300_000, 50
TAILED = "^(?P<body>.*[A-Za-zÀ-ÖØ-öø-ÿ])(?P<tail>[.,;:!?]+)$"
# Only words of these characters are joined: the library's normalising keeps their places.
JOINABLE = re.compile("[!-~À-ÿ]+").fullmatch
# Marks and the later letters of Hangul syllables join the letter before them.
COMPOSED = r"\p{M}|[\x{1160}-\x{11FF}]"
HEAD = "<4sIQ"
MAGIC = b"DAC1"


# ---- the codes -----------------------------------------------------------------------------------


def dac_encode(ids: np.ndarray) -> bytes:
    """MAGIC, number of levels, number of ids; then per level its length, chunks, bitmap (whole blocks) and rank directory."""
    left, levels = ids.astype(np.uint32), []
    while len(left) or not levels:
        more = left >> np.uint32(8) > 0
        blocks = -(-len(left) // BLOCK_BITS)
        bits = np.zeros(blocks * BLOCK_BITS, np.uint8)
        bits[: len(left)] = more
        counts = bits.reshape(blocks, BLOCK_BITS).sum(axis=1, dtype=np.uint64)
        ranks = (np.cumsum(counts, dtype=np.uint64) - counts).astype("<u8")
        levels.append(struct.pack("<Q", len(left)) + (left & np.uint32(255)).astype(np.uint8).tobytes() + np.packbits(bits, bitorder="little").tobytes() + ranks.tobytes())
        left = left[more] >> np.uint32(8)
    return struct.pack(HEAD, MAGIC, len(levels), len(ids)) + b"".join(levels)


class DacReader:
    """Reads ids of one segment by position."""

    def __init__(self, blob: bytes):
        magic, n_levels, self.n = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at, self.levels = struct.calcsize(HEAD), []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            blocks = -(-n // BLOCK_BITS)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            bitmap = np.frombuffer(blob, np.uint8, blocks * BLOCK_BITS // 8, at + n)
            ranks = np.frombuffer(blob, "<u8", blocks, at + n + len(bitmap))
            self.levels.append((chunks, bitmap, ranks))
            at += n + len(bitmap) + 8 * blocks

    def __getitem__(self, i: int) -> int:
        value = 0
        if not 0 <= i < self.n:
            raise IndexError(i)
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            upto = int.from_bytes(bitmap[block * BLOCK_BITS // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
            i = int(ranks[block]) + upto.bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, reach = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[reach] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            reach = reach[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


# ---- encoding ------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of words, by the tokenizer library, kept for the words of a process up to a bound.

    The vocabulary's rule cuts between a letter and the full stops, commas and the like after it, and it lowers A-Z, so
    words are looked up without such a tail and lowered. Words that hold the mark of special tokens are left as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.slots: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.slots.clear()
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self._slots([""])

    def _slots(self, words: list[str]) -> np.ndarray:
        slots = self.slots
        new = [w for w in words if w not in slots]
        if new:
            letters, rest = [], []
            for w in new:
                (letters if w.isalpha() and JOINABLE(w) else rest).append(w)
            for own, encode in ((letters, self._encode_letters), (rest, self._encode)):
                if own:
                    coded, sizes = encode(own)
                    slots.update(zip(own, range(len(self.ends) - 1, len(self.ends) - 1 + len(own))))
                    self.ids = np.concatenate([self.ids, coded])
                    self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(slots.__getitem__, words), np.int64, len(words))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: such a word ends where a piece ends a word, so no offsets are needed."""
        coded, sizes = [], []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            groups = [" ".join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)]
            lists = [e.ids for e in self.tokenizer.encode_batch(groups, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                ids, own = self._encode(part)
            else:
                own = np.diff(ends, prepend=0)
            coded.append(ids)
            sizes.append(own)
        return np.concatenate(coded), np.concatenate(sizes)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of each). Simple words are encoded some dozens at a time, joined by spaces."""
        plain = [w for w in words if JOINABLE(w)]
        out: dict[str, list[int]] = {}
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            groups = [part[k : k + JOINED] for k in range(0, len(part), JOINED)]
            for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                begins = np.cumsum([0, *(len(w) + 1 for w in group)])
                ids, at = e.ids, [a for a, _ in e.offsets]
                cuts = np.searchsorted(at, begins)
                for k, w in enumerate(group):
                    out[w] = ids[cuts[k] : cuts[k + 1]]
        others = [w for w in words if w not in out]
        for i in range(0, len(others), 20_000):
            part = others[i : i + 20_000]
            out.update(zip(part, (e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False))))
        coded = [out[w] for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slots of each word's body and of its tail; rows of `ids` between `ends`."""
        if len(self.slots) > CACHED_WORDS:
            self._reset()
        parts = pc.extract_regex(words, TAILED)
        body = pc.if_else(parts.is_valid(), pc.struct_field(parts, "body"), words)
        tail = pc.if_else(parts.is_valid(), pc.struct_field(parts, "tail"), "")
        # The library composes before it lowers, so a word whose signs may still be composed goes to it as it is.
        as_is = pc.or_(pc.match_substring(words, "<|"), pc.match_substring_regex(words, COMPOSED))
        body = pc.if_else(as_is, body, pc.ascii_lower(body)).dictionary_encode()
        tail = tail.dictionary_encode()
        of = lambda x: self._slots(x.dictionary.to_pylist())[x.indices.to_numpy()]
        return of(body), of(tail)


def ragged_take(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the rows one after another, length of each); row r is values[ends[r]:ends[r + 1]]."""
    size = ends[rows + 1] - ends[rows]
    begin = np.cumsum(size) - size
    return values[np.repeat(ends[rows] - begin, size) + np.arange(size.sum())], size


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This process's encoder: it outlives a task, as a worker runs many."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode(path: str, end_id: int, bounds: list[int]):
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("digest", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from spreadlens.llm.token_files import encoder_of

        encoder = encoder_of(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                codes, starts, words = word_codes(batch.column(1), lower=False)
                body, tail = encoder.table(words)
                flat, size = ragged_take(encoder.ids, encoder.ends, np.stack([body[codes], tail[codes]], axis=1).ravel())
                upto = np.concatenate([[0], np.cumsum(size)])[2 * starts]
                rows = []
                for d, doc_id in enumerate(batch.column(0).to_pylist()):
                    own = np.append(flat[upto[d] : upto[d + 1]], np.uint32(end_id))
                    high = (own >> np.uint32(16)).astype("<u2")
                    shard = 0 if doc_id is None else bisect_right(bounds, doc_id)
                    rows.append((shard, doc_id, len(own), own.astype("<u2").tobytes(), high.tobytes() if high.any() else b"", zlib.crc32(own.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return encode


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, doc_id) to segments; the next one begins when the shard changes or a segment is full."""
    names = ["shard", "segment", "n_ids", "doc_ids", "doc_ends", "codes"]
    now, number, docs, parts, held = None, 0, [], [], 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts]).astype("<i8")
        values = [now, number, len(ids), docs, ends.tobytes(), dac_encode(ids)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for shard, doc_id, n, low, high in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if docs and (shard != now or held >= SEGMENT_IDS):
                yield row()
                number, docs, parts, held = (number + 1 if shard == now else 0), [], [], 0
            now = shard
            ids = np.frombuffer(low, "<u2").astype(np.uint32)
            if high:
                ids |= np.frombuffer(high, "<u2").astype(np.uint32) << np.uint32(16)
            docs.append(doc_id)
            parts.append(ids)
            held += n
    if docs:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode documents (doc_id, text) and write segments to `path` in ascending order of doc_id."""
    spark = docs.sparkSession
    n = c.shuffle_partitions(spark)
    shards = 4 * n
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = rows.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.25 / shards)
    bounds = sorted({int(x) for x in cuts})
    coded = rows.mapInArrow(_encode(tokenizer, end_id, bounds), "shard int, doc_id long, n long, low binary, high binary, digest long")
    placed = coded.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "digest")
    placed.mapInArrow(_segments, "shard int, segment long, n_ids long, doc_ids array<bigint>, doc_ends binary, codes binary").write.parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"]
    for batch in batches:
        for shard, segment, docs, ends, codes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            ids, ends = DacReader(codes).all().astype("<u4"), np.frombuffer(ends, "<i8")
            begins = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
            n = len(docs)
            columns = [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files at `path`."""
    segments = spark.read.parquet(path)
    sizes = segments.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all_ids"))
    # One row per shard in this window; their number is a multiple of the shuffle partitions.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all_ids").over(earlier), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("before") + F.col("shard_start")).alias("segment_start"))
    digests = segments.select("shard", "segment", "doc_ids", "doc_ends", "codes").mapInArrow(_digests, "shard int, segment long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return digests.join(starts, ["shard", "segment"]).select("doc_id", (F.col("begin") + F.col("segment_start")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, doc_id: int, place: int) -> int | None:
    """One token of one document; only the segments whose id statistics allow it are read, none is decoded."""
    rows = spark.read.parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("doc_ids", "doc_ends", "codes").take(1)
    if not rows:
        return None
    nth = rows[0]["doc_ids"].index(doc_id)
    ends = np.frombuffer(rows[0]["doc_ends"], "<i8")
    at = (int(ends[nth - 1]) if nth else 0) + place
    return DacReader(bytes(rows[0]["codes"]))[at] if 0 <= place and at < ends[nth] else None
