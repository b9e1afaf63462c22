"""Removal of byte strings that occur in an earlier document, by distributed prefix doubling.

Positions are ranked by growing prefixes, and only those whose rank more than one document holds go on:

1. Prefixes of 24 bytes (for strings of 50), at sampled positions: every 50-byte window holds the position whose next eight
   bytes hash lowest among those whose 24 bytes lie within the window. The choice depends on the window alone, so equal windows
   choose equal positions, and a window whose chosen prefix occurs in one document only is unique. About one position in
   fourteen is sorted. Neighbouring windows that chose the same position form one stretch, ranked at the same time
   by all its bytes: an equal stretch in an earlier document settles all its windows at once.
2. Windows left open (their prefix repeats, their stretch doesn't) are ranked by the pair (rank of the first 25 bytes, rank
   of the 25 bytes at offset 25), which is the threshold; the smallest document of each rank is its first holder.

Ranks are names: 64-bit fingerprints of the bytes instead of places in a sorted list, so no round waits for a global order;
equal bytes have equal names. What decides a removal compares 96 bits (stretches) or 128 bits (pairs).

Documents are dealt into buckets, once, and that exchange is reused: each bucket sends its distinct ranks with their first
document, packed in arrays, to the parts of the rank space, and parts answer by the place in the sender's sorted list. So a passage that many
documents share is one entry per bucket, and a task holds one bucket's texts or one part's entries. Both numbers follow
`spark.sql.shuffle.partitions`.

Defined cases: NULL and short texts lose nothing; a NULL doc_id comes before all others; rows of one doc_id don't count
against each other; texts are judged as given, not as left; other columns pass through (`without_repeats`), where a character
that loses some of its bytes loses all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.llm.tokens import U64, mix

LENGTH, CHUNK, BUCKETS = 50, 1 << 21, 2
_BLOB = "bucket int, part int, base long, n long, a binary, b binary, d binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("base", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("d", pa.binary())])


# ---- bytes and windows ---------------------------------------------------------------------------


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on; `data` ends with at least eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def _name(v: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Names of the `n` (at least eight) bytes at each of the positions."""
    h = np.full(len(at), seed + n, U64)
    for k in (*range(0, n - 7, 8), *([n - 8] if n % 8 else [])):
        h = mix(h + v[at + k])
    return h


def _key_bytes(length: int) -> int:
    if length < 18:
        raise ValueError("strings of fewer than 18 bytes aren't supported")
    return (length - 2) // 2 // 8 * 8


def _stretches(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(chosen, low, high, doc): windows that begin at low..high chose the prefix at `chosen`."""
    key, width = _key_bytes(length), length - _key_bytes(length) + 1
    found = []
    total = int(starts[-1])
    for c0 in range(0, total, CHUNK):
        piece = np.zeros(min(CHUNK, total - c0) + length + 8, np.uint8)
        part = data[c0 : c0 + len(piece) - 8]
        piece[: len(part)] = part
        v = _words8(piece)
        least = ((v * U64(0x9E3779B97F4A7C15)) >> U64(32) << U64(32)) | np.arange(len(v), dtype=U64)
        have = 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        # Windows that begin here and end within their document.
        edge = np.zeros(CHUNK + 1, np.int32)
        docs = np.arange(np.searchsorted(starts, c0, side="right") - 1, min(np.searchsorted(starts, c0 + CHUNK), len(starts) - 1))
        first, last = np.maximum(starts[docs] - c0, 0), np.minimum(starts[docs + 1] - length + 1 - c0, CHUNK)
        some = last > first
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some], -1)
        at = np.flatnonzero(np.cumsum(edge))
        if len(at):
            own = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            found.append((own[cut[:-1]] + c0, at[cut[:-1]] + c0, at[cut[1:] - 1] + c0))
    if not found:
        return (np.empty(0, np.int64),) * 4
    chosen, low, high = (np.concatenate(x) for x in zip(*found))
    return chosen, low, high, np.searchsorted(starts, chosen, side="right") - 1


def _stretch_names(v: np.ndarray, chosen: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """A name for all bytes of a stretch and the place of the chosen position in it."""
    size = high - low + length
    h = mix((chosen - low).astype(U64) * U64(1_000_003) + size.astype(U64))
    for k in range(0, int(size.max()) - 7 if len(size) else 0, 8):
        inside = np.flatnonzero(k + 8 <= size)
        h[inside] = mix(h[inside] + v[low[inside] + k])
    return mix(h + v[low + size - 8]) if len(size) else h


# ---- packing -------------------------------------------------------------------------------------


def _pack(values: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of integers, byte by byte in planes, so that bytes which are all alike compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :n_bytes].T).tobytes()


def _unpack(blobs: list[bytes], n_bytes: int) -> np.ndarray:
    out = []
    for blob in blobs:
        n = len(blob) // n_bytes
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :n_bytes] = np.frombuffer(blob, np.uint8).reshape(n_bytes, n).T
        out.append(wide.view(U64).ravel())
    return np.concatenate(out) if out else np.empty(0, U64)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)], schema=_FIELDS)


def _ints(text: bytes) -> np.ndarray:
    return np.frombuffer(text or b"", np.int64)


class _Bucket:
    """One bucket's texts in a fixed order, and its distinct stretches in the order of the rank space."""

    def __init__(self, table: pa.Table, parts: int, length: int, ranks: bool = True):
        ids = table.column("_order").to_numpy()
        texts = table.column("_text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
        table, ids, texts = self._sorted(table, ids, texts)
        self.table, self.ids = table, ids
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.starts = offsets - offsets[0]
        self.data = np.concatenate([raw, np.zeros(length + 16, np.uint8)])
        if ranks:
            self._rank(parts, length)

    @staticmethod
    def _sorted(table, ids, texts):
        order = np.lexsort((table.column("_digest").to_numpy(), ids))
        take = pa.array(order)
        return table.take(take), ids[order], texts.take(take)

    def _rank(self, parts: int, length: int):
        chosen, low, high, doc = _stretches(self.data, self.starts, length)
        v = _words8(self.data)
        prefix = _name(v, chosen, _key_bytes(length))
        stretch = _stretch_names(v, chosen, low, high, length) & U64(0xFFFFFFFFFFFFFF)
        # The part comes from the high bits, as the low ones are what is sent.
        part = ((prefix >> U64(40)) % U64(parts)).astype(np.int64)
        key = prefix & U64(0xFFFFFFFFFF)
        order = np.lexsort((self.ids[doc], stretch, key, part))
        self.chosen, self.low, self.high, self.doc = chosen[order], low[order], high[order], doc[order]
        part, key, stretch = part[order], key[order], stretch[order]
        new = np.ones(len(order), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])
        self.kind = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.first, self.part, self.key, self.stretch, self.holder = first, part[first], key[first], stretch[first], self.ids[self.doc[first]]

    def slices(self, part: np.ndarray):
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
        return zip(edges[:-1], edges[1:])


# ---- the four steps ------------------------------------------------------------------------------


def _send_stretches(parts: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        b = _Bucket(table, parts, length)
        number = table.column("bucket")[0].as_py()
        return _table(
            [(number, int(b.part[i]), int(i), int(j - i), _pack(b.key[i:j], 5), _pack(b.stretch[i:j], 7), _pack(b.holder[i:j], 8)) for i, j in b.slices(b.part)]
        )

    return run


def _rank_stretches(table: pa.Table) -> pa.Table:
    """Answers: places of stretches that an earlier document holds (a), and of those left open (b)."""
    key, stretch = _unpack(table.column("a").to_pylist(), 5), _unpack(table.column("b").to_pylist(), 7)
    holder = _unpack(table.column("d").to_pylist(), 8).view(np.int64)
    n, base, bucket, part = (table.column(x).to_numpy() for x in ("n", "base", "bucket", "part"))
    place = np.concatenate([np.arange(a, a + m) for a, m in zip(base, n)])
    sender = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((stretch, key))
    key, stretch, holder, place, sender = key[order], stretch[order], holder[order], place[order], sender[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], stretch[1:] != stretch[:-1]])
    first, first_key = np.flatnonzero(new), np.flatnonzero(new_key)
    earliest = np.minimum.reduceat(holder, first)[np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), first_key)
    shared = np.minimum.reduceat(holder, first_key) != np.maximum.reduceat(holder, first_key)
    open_key = ((kinds > 1) & shared)[np.cumsum(new_key) - 1]
    gone = holder > earliest
    opened = ~gone & open_key
    rows = []
    by = np.argsort(sender, kind="stable")
    cuts = np.searchsorted(sender[by], np.arange(len(n) + 1))
    for s in range(len(n)):
        own = by[cuts[s] : cuts[s + 1]]
        g, o = np.sort(place[own[gone[own]]]), np.sort(place[own[opened[own]]])
        if len(g) or len(o):
            rows.append((int(bucket[s]), int(part[0]), 0, 0, _pack(g, 5), _pack(o, 5), b""))
    return _table(rows)


def _merged(doc: np.ndarray, low: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the covered bytes of each document, from [low, end) in bucket positions."""
    order = np.lexsort((low, doc))
    doc, low, end = doc[order], low[order], end[order]
    # Positions of different documents don't overlap, so a running maximum needs no reset.
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.concatenate([[True], (low[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]) if len(low) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return doc[first], low[first], reach[np.append(first[1:], len(low)) - 1] if len(low) else end


def _settle_and_ask(parts: int, length: int):
    """Per bucket: runs that are settled (passed on as they are) and the bytes of stretches left open, by part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        b = _Bucket(left, parts, length)
        number = left.column("bucket")[0].as_py()
        state = np.zeros(len(b.first), np.int8)
        state[_unpack(right.column("a").to_pylist(), 5).astype(np.int64)] = 1
        state[_unpack(right.column("b").to_pylist(), 5).astype(np.int64)] = 2
        # A stretch within the bucket goes with all documents but its first holder's.
        later = b.ids[b.doc] > b.holder[b.kind] if len(b.doc) else np.empty(0, bool)
        of_kind = state[b.kind] if len(b.kind) else np.empty(0, np.int8)
        gone = later | (of_kind == 1)
        doc, low, end = _merged(b.doc[gone], b.low[gone], b.high[gone] + length)
        opened = np.flatnonzero(state == 2)
        ask = np.full(len(state), -1)
        ask[opened] = np.arange(len(opened))
        waiting = np.flatnonzero((of_kind == 2) & ~later)
        windows = (b.high - b.low + 1)[b.first[opened]] if len(opened) else np.empty(0, np.int64)
        known = np.concatenate([[len(low), len(waiting), len(opened)], low, end, ask[b.kind[waiting]] if len(waiting) else [], b.low[waiting], windows]).astype(np.int64)
        rows = [(number, -1 - number % parts, 0, 0, known.tobytes(), b"", b"")]
        part = b.part[opened]
        for i, j in b.slices(part):
            own = b.first[opened[i:j]]
            size = windows[i:j] + length - 1
            at = np.repeat(b.low[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((number, int(part[i]), int(windows[:i].sum()), int(j - i), windows[i:j].tobytes(), b.data[at].tobytes(), b.holder[opened[i:j]].tobytes()))
        return _table(rows)

    return run


def _rank_windows(length: int):
    """Answers: for each window of the stretches asked about, whether an earlier document holds it."""
    half = -(-length // 2)

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table
        windows = [_ints(x) for x in table.column("a").to_pylist()]
        per_row = np.array([int(w.sum()) for w in windows])
        windows = np.concatenate(windows)
        data = np.frombuffer(b"".join(table.column("b").to_pylist()) + bytes(length + 16), np.uint8)
        holder = np.concatenate([_ints(x) for x in table.column("d").to_pylist()])
        size = windows + length - 1
        begin = np.cumsum(size) - size
        total = int(windows.sum())
        at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(total)
        who = np.repeat(holder, windows)
        v = _words8(data)
        first, second = _name(v, at, half), _name(v, at + length - half, half, seed=1)
        order = np.lexsort((second, first))
        new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        earliest = np.empty(total, np.int64)
        earliest[order] = np.minimum.reduceat(who[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = earliest < who
        ends = np.cumsum(per_row)
        rows = []
        for bucket, base, n, end in zip(table.column("bucket").to_pylist(), table.column("base").to_pylist(), per_row, ends):
            own = hit[end - n : end]
            if own.any():
                rows.append((bucket, 0, base, int(n), np.packbits(own).tobytes(), b"", b""))
        return _table(rows)

    return run


def _removed_runs(b: _Bucket, right: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, low, end) of the maximal removed runs of a bucket."""
    lows, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    answers, known = [], None
    for row in right.to_pylist():
        if row["part"] < 0:
            known = _ints(row["a"])
        else:
            answers.append(row)
    if known is not None:
        n_runs, n_waiting, n_open = known[:3]
        at = np.cumsum([3, n_runs, n_runs, n_waiting, n_waiting, n_open])
        low, end, ask, where, windows = (known[i:j] for i, j in zip(at[:-1], at[1:]))
        lows, ends = [low], [end]
        hit = np.zeros(int(windows.sum()), bool)
        for row in answers:
            hit[row["base"] : row["base"] + row["n"]] = np.unpackbits(np.frombuffer(row["a"], np.uint8), count=row["n"]).astype(bool)
        begin = np.cumsum(windows) - windows
        size = windows[ask]
        flat = np.repeat(begin[ask] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        spot = np.repeat(where - (np.cumsum(size) - size), size) + np.arange(size.sum())
        spot = spot[hit[flat]]
        lows.append(spot)
        ends.append(spot + length)
    low, end = np.concatenate(lows), np.concatenate(ends)
    return _merged(np.searchsorted(b.starts, low, side="right") - 1, low, end)


def _finish(length: int, texts: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Bucket(left, 1, length, ranks=False)
        doc, low, end = _removed_runs(b, right, length)
        of = np.searchsorted(doc, np.arange(len(b.ids) + 1))
        size, removed, digests, kept_texts = np.diff(b.starts), np.zeros(len(b.ids), np.int64), [], []
        raw = b.data.tobytes()
        for i in range(len(b.ids)):
            at, kept = b.starts[i], []
            for k in range(of[i], of[i + 1]):
                kept.append(raw[at : low[k]])
                at = end[k]
                removed[i] += end[k] - low[k]
            kept = b"".join((*kept, raw[at : b.starts[i + 1]]))
            if texts:
                kept_texts.append(kept.decode("utf-8", "ignore") if removed[i] else None)
            else:
                digests.append(hashlib.sha256(kept).hexdigest())
        if texts:
            return pa.table({"_doc": b.table.column("_doc"), "_changed": pa.array(kept_texts, pa.string())})
        return pa.table({"doc_id": b.table.column("doc_id"), "n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(of)), "kept_sha256": pa.array(digests, pa.string())})

    return run


def _deduplicated(docs: DataFrame, length: int, texts: bool) -> DataFrame:
    parts = c.shuffle_partitions(docs.sparkSession)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(c.LONG_MIN))
    digest = F.xxhash64("text")
    carried = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_doc") if texts else F.col("doc_id")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", digest), F.lit(BUCKETS * parts)).cast("int").alias("bucket"), order.alias("_order"), digest.alias("_digest"), F.col("text").cast("binary").alias("_text"), carried)
    by_bucket = dealt.groupBy("bucket")
    answers = by_bucket.applyInArrow(_send_stretches(parts, length), _BLOB).groupBy("part").applyInArrow(_rank_stretches, _BLOB)
    asked = by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(_settle_and_ask(parts, length), _BLOB)
    settled = asked.groupBy("part").applyInArrow(_rank_windows(length), _BLOB)
    done = dealt.groupBy("bucket").cogroup(settled.groupBy("bucket"))
    if texts:
        return done.applyInArrow(_finish(length, True), f"_doc {dict(dealt.dtypes)['_doc']}, _changed string")
    return done.applyInArrow(_finish(length, False), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _deduplicated(docs, length, texts=False)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with exactly their columns, texts without the removed bytes."""
    out = _deduplicated(docs, length, texts=True)
    fields = [F.coalesce("_changed", "_doc.text").alias("text") if x == "text" else F.col("_doc").getField(x).alias(x) for x in docs.columns]
    return out.select(*fields)
