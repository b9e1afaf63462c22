"""SentencePiece encoding and decoding by a batched Viterbi over the pieces' scores.

A text is cut where no piece can reach across: before runs of the space mark, and around characters that are in no longer
piece. Distinct units of one length are the rows of a matrix of code points and advance together: at each end, the hash of
every substring up to the longest piece (from prefix hashes) is looked up among the sorted hashes of the pieces, and the
best sum with its back pointer is kept for all rows at once. Every found piece is compared with the unit's characters, so a
chance hit of a hash can't pass.

A unigram model's scores are log probabilities and the best sum is the answer. A BPE model's scores are merge ranks; there
a step from one piece to the next is barred when merging would have joined across their border first. A sequence is what
merging gives exactly if no two neighbours are barred, so the one path that is left equals the library's result. Whether a pair
is barred follows from undoing the two pieces' merges, latest first, for all rows at once. Runs of spaces, whose pieces
share one rank in such models, are merged one by one. Characters without a piece become byte pieces, each ten below the
worst score. Of equal sums, the one whose last piece is longer is taken.

Defined cases: NULL and empty texts have no pieces; the space mark U+2581 in a text reads as a space, as in the library;
decoding gives back every other text exactly. Other columns pass through.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.llm.token_files import ragged_take
from spreadlens.llm.tokens import U64

MARK, CACHED_UNITS, ROWS = "▁", 350_000, 1 << 17
_BASE, _OF_LENGTH = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
# A bitmap of the keys' hashes stands before the search: most substrings are no piece.
_BITS = 20


class Pieces:
    """Sorted hashes, scores and ids of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte_ids = np.zeros(256, np.uint32)
        text, scores, ids = [], [], []
        self.bytes_of: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                text.append(piece)
                scores.append(model.get_score(i))
                ids.append(i)
        scores = np.array(scores)
        self.longest = max(map(len, text), default=1)
        self.power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(self.longest, _BASE)]), dtype=U64)
        self.of_length = np.arange(self.longest + 1, dtype=U64) * _OF_LENGTH
        length = np.array([len(t) for t in text], np.int64)
        points = np.zeros((len(text), self.longest), np.uint32)
        for row, t in enumerate(text):
            points[row, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        plain = np.zeros(len(text), U64)
        for k in range(self.longest):
            inside = length > k
            plain[inside] = plain[inside] * _BASE + points[inside, k].astype(U64) + U64(1)
        keys = plain + self.of_length[length]
        order = np.argsort(keys)
        self.keys, self.scores, self.ids = keys[order], scores[order], np.array(ids, np.uint32)[order]
        self.points, self.plain, self.length = points[order], plain[order], length[order]
        # Integer scores down from zero are merge ranks.
        self.merges = bool(len(scores)) and bool(np.all(scores == np.round(scores)) and np.all(scores <= 0))
        if self.merges:
            self._undo([text[i] for i in order])
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self._slot(self.keys)] = True
        singles = [(int(self.points[i, 0]), i) for i, t in enumerate(order) if len(text[t]) == 1]
        self.single = np.full(0x110000, -1, np.int32)
        for point, i in singles:
            self.single[point] = i
        self.fallback = (scores.min() if len(scores) else 0.0) - 10
        inside = {ch for t in text if len(t) > 1 for ch in t}
        follows = {(x, y) for t in text for x, y in zip(t, t[1:])}
        # Spaces begin a unit; some characters are in no longer piece and stand alone; some signs never follow another
        # character than a sign in a piece, so a unit ends before them.
        alone = "".join(ch for ch in "\t\n\r\x0b\x0c" if ch not in inside)
        signs = ".,;:!?"
        signs = "".join(y for y in signs if not any(b == y and a not in signs + MARK for a, b in follows))
        if any(MARK in t.lstrip(MARK) for t in text):
            pattern = f"[{alone}]|[^{alone}]+" if alone else "(?s).+"
        else:
            stop = MARK + alone + signs
            pattern = "|".join(x for x in (f"[{alone}]" if alone else "", f"{MARK}*[{signs}]+[^{stop}]*" if signs else "", f"{MARK}*[^{stop}]+", f"{MARK}+") if x)
        self.units = re.compile(pattern)

    def _undo(self, text: list[str]) -> None:
        """When each piece is made (0: a character), of which two pieces, and whether merging makes it at all."""
        place = {t: i for i, t in enumerate(text)}
        length = self.length
        self.place = place
        ranked = np.unique(-self.scores[length > 1])
        self.time = np.where(length > 1, 1 + np.searchsorted(ranked, -self.scores), 0)
        self.left, self.right = np.arange(len(text)), np.arange(len(text))
        self.made = np.ones(len(text), bool)
        for t, i in place.items():
            if len(t) > 1:
                whole, last = self.merged(t)
                self.made[i] = len(whole) == 1
                if last is not None:
                    self.left[i], self.right[i] = last

    def merged(self, unit: str) -> tuple[list[str], tuple[int, int] | None]:
        """Pieces of a unit by merging one by one, and the two places of the last merge.

        Pairs wait in a heap by the time they are made and by place, so a long run takes little more than its length.
        """
        parts, last = list(unit), None
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                at = self.place.get(parts[i] + parts[after[i]])
                if at is not None:
                    heapq.heappush(waiting, (int(self.time[at]), i, at))

        for i in range(len(parts)):
            offer(i)
        while waiting:
            _, i, at = heapq.heappop(waiting)
            j = after[i]
            if not parts[i] or j >= len(parts) or self.place.get(parts[i] + parts[j]) != at:
                continue
            last = self.place[parts[i]], self.place[parts[j]]
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p], last

    def allowed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between the two pieces (places; -1: no piece) alone."""
        pairs, inverse = np.unique((first + 1) * (len(self.keys) + 1) + second + 1, return_inverse=True)
        a, b = pairs // (len(self.keys) + 1) - 1, pairs % (len(self.keys) + 1) - 1
        good = np.ones(len(pairs), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            size = self.length[b]
            whole = self.length[a] + size
            at = self.find(self.plain[a] * self.power[size] + self.plain[b] + self.of_length[np.minimum(whole, self.longest)] + (whole > self.longest).astype(U64))
            earlier = (at >= 0) & (self.time[at] < limit)
            good[live[earlier]] = False
            go = ~earlier & (np.maximum(self.time[a], self.time[b]) > 0)
            live, a, b = live[go], a[go], b[go]
            of_a = self.time[a] > self.time[b]
            limit = np.where(of_a, self.time[a], self.time[b] + 1)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return good[inverse]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _BASE) >> U64(64 - _BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys among the sorted ones, -1 where missing."""
        out = np.full(len(keys), -1, np.int64)
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == keys[some], at, -1)
        return out

    def segment(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, sizes): the ids of all units one after another, in an order of its own, and the number of each."""
        order: list[int] = []
        flat, sizes = [], []
        by_length: dict[int, list[int]] = {}
        for i, unit in enumerate(units):
            if self.merges and unit.startswith(MARK * 2):
                order.append(i)
                flat.append(self._ids_of(self.merged(unit)[0]))
                sizes.append(np.array([len(flat[-1])]))
            else:
                by_length.setdefault(len(unit), []).append(i)
        for length, rows in by_length.items():
            step = max(1, ROWS // length)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                points = np.frombuffer("".join([units[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                ids, n = self._advance(points)
                order += part
                flat.append(ids)
                sizes.append(n)
        return order, np.concatenate([np.empty(0, np.uint32), *flat]), np.concatenate([np.empty(0, np.int64), *sizes])

    def _ids_of(self, parts: list[str]) -> np.ndarray:
        ids: list[int] = []
        for part in parts:
            at = self.place.get(part)
            ids += [int(self.ids[at])] if at is not None else [int(self.byte_ids[x]) for x in part.encode("utf-8", "surrogatepass")]
        return np.array(ids, np.uint32)

    def _advance(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of each)."""
        rows, length = points.shape
        prefix = np.zeros((length + 1, rows), U64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + points[:, j].astype(U64) + U64(1)
        n_bytes = 1 + (points >= 0x80).astype(int) + (points >= 0x800) + (points >= 0x10000)
        # best[j]: the largest sum of scores up to j; back and piece: the length and place of the last piece.
        best = np.full((length + 1, rows), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, rows), np.int32)
        piece = np.full((length + 1, rows), -1, np.int32)
        known = self.single[points]
        for j in range(1, length + 1):
            for k in range(min(j, self.longest), 0, -1):
                if k == 1:
                    at = known[:, j - 1]
                    who = np.arange(rows)
                else:
                    at = self.find(prefix[j] - prefix[j - k] * self.power[k] + self.of_length[k])
                    who = np.flatnonzero(at >= 0)
                    if not len(who):
                        continue
                    at = at[who]
                    same = (self.points[at, :k] == points[who, j - k : j]).all(axis=1)
                    who, at = who[same], at[same]
                before = best[j - k][who]
                if self.merges:
                    good = (before > -np.inf) & ((at < 0) | self.made[at])
                    who, at, before = who[good], at[good], before[good]
                    if j > k and len(who):
                        good = self.allowed(piece[j - k][who], at)
                        who, at, before = who[good], at[good], before[good]
                total = before + (self.scores[at] if k > 1 else np.where(at >= 0, self.scores[at], self.fallback * n_bytes[who, j - 1]))
                better = total > best[j][who]
                who = who[better]
                best[j][who], back[j][who], piece[j][who] = total[better], k, at[better]
        # Back from the ends, all rows a piece at a time; ids fill a matrix from the right, so reading it by rows restores
        # their order. A character without a piece takes as many places as it has bytes.
        wide = length + int(np.where(known < 0, n_bytes - 1, 0).sum(axis=1).max(initial=0))
        ids, used = np.zeros((rows, wide), np.uint32), np.zeros((rows, wide), bool)
        at, column, live = np.full(rows, length), np.full(rows, wide - 1), np.arange(rows)
        while len(live):
            j = at[live]
            p = piece[j, live]
            whole = p >= 0
            r = live[whole]
            ids[r, column[r]], used[r, column[r]] = self.ids[p[whole]], True
            column[r] -= 1
            for r in live[~whole]:
                for byte in reversed(chr(points[r, at[r] - 1]).encode("utf-8", "surrogatepass")):
                    ids[r, column[r]], used[r, column[r]] = self.byte_ids[byte], True
                    column[r] -= 1
            at[live] = j - back[j, live]
            live = live[at[live] > 0]
        return ids[used], used.sum(axis=1)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before every text is dropped."""
        text = b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes batches of texts; the units of a task are kept up to a bound."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.slots: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.slots.clear()
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ends with a leading zero)."""
        if len(self.slots) > CACHED_UNITS:
            self._reset()
        slots, rows, counts = self.slots, [], []
        new: dict[str, None] = {}
        units_of = self.pieces.units.findall
        split = [units_of(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        for units in split:
            for u in units:
                if u not in slots:
                    new[u] = None
        if new:
            names = list(new)
            order, ids, sizes = self.pieces.segment(names)
            first = len(self.ends) - 1
            slots.update((names[i], first + k) for k, i in enumerate(order))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        for units in split:
            rows.extend(map(slots.__getitem__, units))
            counts.append(len(units))
        flat, size = ragged_take(self.ids, self.ends, np.array(rows, np.int64))
        upto = np.concatenate([[0], np.cumsum(size)])
        return flat, upto[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder: it outlives a task, as a worker runs many."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _coded(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from spreadlens.llm.piece_viterbi import encoder_of

        encoder = encoder_of(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1500):
                batch = whole.slice(i, 1500)
                texts = batch.column(1).to_pylist()
                ids, ends = encoder.encode(texts)
                crc, same = [], []
                for k, text in enumerate(texts):
                    own = ids[ends[k] : ends[k + 1]]
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    same.append(encoder.pieces.decode(own) == (text or "").replace(MARK, " "))
                columns = [batch.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(same)]
                names = [batch.schema.names[0], "n_pieces", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_pieces(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_pieces, ids_crc32, round_trip (decoding gives the text), and ids."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, round_trip boolean"
    return rows.mapInArrow(_coded(model, keep_ids), schema + (", ids array<int>" if keep_ids else ""))


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = coded.select("doc_id", F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
