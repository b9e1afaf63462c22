"""Conversation repair by a dynamic program over runs of equal turns.

Turns of a conversation, in order, become symbols: the role's initial (s, u, a or another) and the first fault (none,
truncated, or one that must go: blank, duplicate). A repair must give the role initials (s?(ua)+)?, which an automaton of four
states reads: nothing yet, after s, after u, after a. A symbol is then a 4 x 4 min-plus matrix: the cheapest way from state to
state by inserting turns before it and keeping, reroling or deleting it. Equal symbols in a row are one run; a run of n is
crossed by the cached powers of its matrix for the bits of n. Crossing the runs backwards leaves the cost to go after each, and
the choices are unrolled forwards from it: of the edits that keep the cost least, the first in ASCII.

Rows that are equal in conversation, turn, role and text are counted before they are moved (all but the first are duplicates),
without their text. The counted rows are sorted over range partitions, so a conversation of any length spreads over several:
its part in one partition is a segment. Segments of conversations that cross a border are at most two per partition; their
matrices and, for each of the four states, their end states are chained on the driver, and every segment is then unrolled by
itself. Only the digest of a repaired text reads a conversation's texts one after another, as a stream.

Defined cases: a NULL role or text counts as one space, a NULL conversation is one of its own, NULL turns come first; rows of
one turn go by role, then by the md5 of their text; an empty role has no legal initial; conversations without rows have empty
results; extra columns are ignored, however they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlens.llm import common as c
from spreadlens.session import stored

KEY = ("conv_id", "turn", "role", "digest")
SORTED = (*KEY, "n", "blank", "truncated", "first", "class", "place", "part")
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, ROLES, INITIAL = range(4), "suao", {2: "u", 3: "a"}
RETOLD = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GONE = 8
FAR = 1 << 60
Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]
CACHED_PIECES = 64
READY_ROWS = 5000


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, min(a[p][k] + b[k][q] for k in STATES)) for q in STATES) for p in STATES)


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, min(a[p][q] + v[q] for q in STATES)) for p in STATES)


def _inserts() -> Matrix:
    step = [[0 if p == q else FAR for q in STATES] for p in STATES]
    for initial in RETOLD:
        for p, q in NEXT[initial].items():
            step[p][q] = INSERT
    once = tuple(map(tuple, step))
    return times(times(once, once), times(once, once))


UNIT: Matrix = tuple(tuple(0 if p == q else FAR for q in STATES) for p in STATES)
INSERTS = _inserts()
# What it costs to end: nothing at all, or after a.
ENDING: Vector = onto(INSERTS, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def edits_of(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, next state) of what can be done with a turn, in ASCII order of the edits."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, extra = ROLES[symbol // 2], TRUNCATED * (symbol % 2)
        if state in NEXT.get(role, {}):
            out.append(("K", KEEP + extra, NEXT[role][state]))
        out += [("R", REROLE + extra, NEXT[r][state]) for r in RETOLD if state in NEXT[r]]
    return tuple(out)


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> Matrix:
    """The symbol's matrix for 2^bit turns."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    edits = [[FAR] * 4 for _ in STATES]
    for p in STATES:
        for _, cost, q in edits_of(symbol, p):
            edits[p][q] = min(edits[p][q], cost)
    return times(INSERTS, tuple(map(tuple, edits)))


def across(symbol: int, n: int, v: Vector) -> Vector:
    """The cost to go before a run of n turns, from the one after it."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            v = onto(power(symbol, bit), v)
    return v


def runs_of(pieces) -> list[tuple[int, int]]:
    return [(symbol, sum(n for _, n in run)) for symbol, run in groupby(pieces, key=lambda p: p[0])]


def matrix_of(pieces) -> Matrix:
    out = UNIT
    for symbol, n in runs_of(pieces):
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                out = times(out, power(symbol, bit))
    return out


def unroll(pieces, state: int, after: Vector, last: bool) -> tuple[list[tuple[str, str, int]], int]:
    """((edits, resulting initials, cost) of each piece (symbol, turns), the end state); `after` is the cost to go at the end.

    With `last`, the inserts that end the conversation belong to its last piece.
    """
    runs = runs_of(pieces)
    behind = [after]
    for symbol, n in reversed(runs):
        behind.append(across(symbol, n, behind[-1]))
    behind.reverse()
    out, at = [], 0
    for k, (symbol, n) in enumerate(runs):
        own = []
        while n > 0:
            own.append(pieces[at][1])
            n -= pieces[at][1]
            at += 1
        if symbol == GONE:
            # Deleting first and inserting later costs the same and sorts first.
            out += [("D" * m, "", DELETE * m) for m in own]
            continue
        to_go = [behind[k + 1]]
        for _ in range(sum(own)):
            to_go.append(onto(power(symbol, 0), to_go[-1]))
        row = len(to_go) - 1
        for m in own:
            done, gives, cost = [], [], 0
            for _ in range(m):
                state, edits, initials, spent = _one(symbol, state, to_go[row], to_go[row - 1])
                done.append(edits)
                gives.append(initials)
                cost += spent
                row -= 1
            out.append(("".join(done), "".join(gives), cost))
    if last and pieces:
        edits, initials, cost = out[-1]
        while state in (1, 2):
            state = NEXT["u" if state == 1 else "a"][state]
            edits, initials, cost = edits + "I", initials + INITIAL[state], cost + INSERT
        out[-1] = (edits, initials, cost)
    return out, state


@lru_cache(maxsize=1 << 16)
def _one(symbol: int, state: int, here: Vector, after: Vector) -> tuple[int, str, str, int]:
    """The edits of one turn: inserts before it, as long as nothing that sorts before them is as cheap, and what happens to it."""
    edits, gives, cost = "", "", 0
    while True:
        options = {e: (spent, q) for e, spent, q in edits_of(symbol, state) if spent + after[q] == here[state]}
        inserted = next((q for r in RETOLD if (q := NEXT[r].get(state)) is not None and INSERT + here[q] == here[state]), None)
        if inserted is not None and "D" not in options:
            state, edits, gives, cost = inserted, edits + "I", gives + INITIAL[inserted], cost + INSERT
            continue
        edit = min(options)
        spent, to = options[edit]
        initial = "" if edit == "D" else "s" if to == 1 else INITIAL[to]
        return to, edits + edit, gives + initial, cost + spent


@lru_cache(maxsize=1 << 16)
def _short(pieces: tuple, state: int, after: Vector, last: bool):
    return unroll(pieces, state, after, last)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` after planted faults, chosen by a checksum of conversation and turn."""
    named = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, text); NULL roles and texts are one space."""
    told = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return told.withColumn("digest", F.unhex(F.md5("text")))


def _symbols(rows: DataFrame) -> DataFrame:
    """One row for equal rows: KEY, n of them, blank, first (not seen at an earlier turn), truncated, role class; placed in order.

    `place` grows with (conv_id, turn, role, digest); its upper bits are the range partition `part`.
    """
    body = F.rtrim(F.col("text"), F.lit(c.SPACES))
    flagged = _turns(rows).select(*KEY, (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))
    counted = stored(flagged.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("blank").alias("blank"), F.min("truncated").alias("truncated")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(when).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    initial = F.substring("role", 1, 1)
    ranked = counted.join(seen, same).select(
        *KEY, "n", "blank", "truncated", when.eqNullSafe(F.col("_first")).alias("first"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("class")
    )
    ordered = ranked.repartitionByRange(c.shuffle_partitions(rows.sparkSession), *KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id())
    return stored(ordered.withColumn("part", F.shiftright("place", 33).cast("int")), "ordered")


def _rows(batches: Iterator[pa.RecordBatch], seen: list[pa.Schema]) -> Iterator[tuple]:
    for batch in batches:
        seen[:] = [batch.schema]
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _segments(rows: Iterator[tuple]) -> Iterator[tuple[int, str, list[tuple], list[tuple]]]:
    """(part, which, pieces of each row, rows) of the sorted rows (SORTED); which is '', or 'first' and 'last' within its part."""
    at = {name: k for k, name in enumerate(SORTED)}
    part_of, conv_of = at["part"], at["conv_id"]
    before, waiting = None, None
    for (part, _), own in groupby(rows, key=lambda r: (r[part_of], r[conv_of])):
        if waiting is not None:
            yield waiting[0], waiting[1] + ("last" if waiting[0] != part else ""), waiting[2], waiting[3]
        own = list(own)
        pieces = []
        for r in own:
            n, lead = r[at["n"]], ROLES.index(r[at["class"]]) * 2 + bool(r[at["truncated"]])
            if r[at["blank"]] or not r[at["first"]]:
                pieces.append(((GONE, n),))
            else:
                pieces.append(((lead, 1), (GONE, n - 1)) if n > 1 else ((lead, 1),))
        waiting = (part, "first" if before != part else "", pieces, own)
        before = part
    if waiting is not None:
        yield waiting[0], waiting[1] + "last", waiting[2], waiting[3]


def _flat(pieces) -> tuple:
    return tuple(p for entry in pieces for p in entry)


def _crossings(ordered: DataFrame) -> list[list[tuple[int, str]]]:
    """The segments (part, which) of each conversation that crosses a border, in order; from one row per range partition."""
    ends = ordered.groupBy("part").agg(F.min_by("conv_id", "place").alias("a"), F.max_by("conv_id", "place").alias("b"))
    chains, open_ = [], False
    rows = sorted(ends.collect(), key=lambda r: r["part"])
    for k, r in enumerate(rows):
        whole = r["a"] == r["b"]
        if open_:
            chains[-1].append((r["part"], "firstlast" if whole else "first"))
        goes_on = k + 1 < len(rows) and rows[k + 1]["a"] == r["b"]
        if goes_on and not (open_ and whole):
            chains.append([(r["part"], "firstlast" if whole else "last")])
        open_ = goes_on
    return chains


def _segment_ends(ordered: DataFrame, chains: list[list[tuple[int, str]]]) -> dict[tuple[int, str], dict]:
    """For each crossing segment: start state, cost to go after it, the class before it, and whether it is the last."""
    wanted = {s for chain in chains for s in chain}
    if not wanted:
        return {}
    rows = _by_part(ordered.where(F.col("part").isin(sorted({p for p, _ in wanted}))))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [
            {"part": part, "which": which, "flat": list(sum(matrix_of(_flat(pieces)), ())), "last_class": own[-1][SORTED.index("class")]}
            for part, which, pieces, own in _segments(_rows(batches, []))
            if (part, which) in wanted
        ]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema({"part": pa.int32(), "which": pa.string(), "flat": pa.list_(pa.int64()), "last_class": pa.string()}))

    found = {(r["part"], r["which"]): r for r in rows.mapInArrow(matrices, "part int, which string, flat array<bigint>, last_class string").collect()}
    known = {}
    for chain in chains:
        after = ENDING
        for k in reversed(range(len(chain))):
            known[chain[k]] = {"start": 0, "after": after, "before": found[chain[k - 1]]["last_class"] if k else None, "last": k == len(chain) - 1}
            flat = found[chain[k]]["flat"]
            after = onto(tuple(tuple(flat[4 * p : 4 * p + 4]) for p in STATES), after)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, which, pieces, _ in _segments(_rows(batches, [])):
            if (own := known.get((part, which))) is not None:
                to_go = before_all(_flat(pieces), own["after"])
                to = [unroll(_flat(pieces), p, own["after"], False)[1] if to_go[p] < FAR else -1 for p in STATES]
                out.append({"part": part, "which": which, "to": to})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema({"part": pa.int32(), "which": pa.string(), "to": pa.list_(pa.int32())}))

    ended = {(r["part"], r["which"]): r["to"] for r in rows.mapInArrow(ends, "part int, which string, to array<int>").collect()}
    for chain in chains:
        state = 0
        for segment in chain:
            known[segment]["start"] = state
            state = ended[segment][state]
    return known


def before_all(pieces, after: Vector) -> Vector:
    """The cost to go before all pieces."""
    for symbol, n in reversed(runs_of(pieces)):
        after = across(symbol, n, after)
    return after


def _by_part(ordered: DataFrame) -> DataFrame:
    return ordered.select(*SORTED).repartition(c.shuffle_partitions(ordered.sparkSession), "part").sortWithinPartitions("place")


def turn_edits(rows: DataFrame) -> DataFrame:
    """Edits of conversations (conv_id, turn, role, text): one row for equal rows, KEY, n, blank, first, truncated, place, and

    edits (initials of what was done, in order), gives (initials of the roles that come out of it), cost, illegal (pairs of
    neighbouring roles before the repair that may not follow each other, this row being the second).
    """
    ordered = _symbols(rows)
    known = _segment_ends(ordered, _crossings(ordered))
    whole = {"start": 0, "after": ENDING, "before": None, "last": True}
    schema = T.StructType([*(ordered.schema[x] for x in SORTED), *T.StructType.fromDDL("edits string, gives string, cost bigint, illegal bigint").fields])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, seen = [], []
        kind_of, n_of = SORTED.index("class"), SORTED.index("n")

        def batch() -> pa.RecordBatch:
            fields = [*seen[0], pa.field("edits", pa.string()), pa.field("gives", pa.string()), pa.field("cost", pa.int64()), pa.field("illegal", pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ready, strict=True), fields, strict=True)], schema=pa.schema(fields))

        for part, which, pieces, own in _segments(_rows(batches, seen)):
            at = known.get((part, which), whole)
            flat = _flat(pieces)
            solve = _short if len(flat) <= CACHED_PIECES else unroll
            done, _ = solve(flat, at["start"], at["after"], at["last"])
            k, before = 0, at["before"]
            for entry, row in zip(pieces, own, strict=True):
                parts = done[k : k + len(entry)]
                k += len(entry)
                illegal = row[n_of] - 1 + (before is not None and before + row[kind_of] not in ("su", "ua", "au"))
                ready.append((*row, "".join(p[0] for p in parts), "".join(p[1] for p in parts), sum(p[2] for p in parts), illegal))
                before = row[kind_of]
            if len(ready) >= READY_ROWS:
                yield batch()
                ready.clear()
        if ready:
            yield batch()

    return stored(_by_part(ordered).mapInArrow(repaired, schema), "edits")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place and step (their order), edit, role, text; deleted turns are not among them."""
    edits = turn_edits(rows)
    texts = _turns(rows).groupBy(*KEY).agg(F.min("text").alias("text"))
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}"))
    steps = F.posexplode(F.split(F.regexp_replace("edits", "D", ""), "(?<=.)(?=.)"))
    both = edits.where("gives <> ''").alias("e").join(texts.alias("t"), same).select("e.conv_id", "place", "gives", "e.role", "text", "edits")
    told = both.select("*", steps.alias("step", "edit")).withColumn("_initial", F.expr("substring(gives, step + 1, 1)"))
    named: Column = F.when(F.col("edit") == "K", F.col("role")).when(F.col("_initial") == "u", "user").otherwise("assistant")
    return told.select("conv_id", "place", "step", "edit", named.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _digests(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): each conversation's edits and texts read as one sorted stream, text by text."""
    conv = edits.schema["conv_id"].dataType
    texts = _turns(rows).select(*KEY, F.lit(1).alias("kind"), "text", F.lit("").alias("edits"), F.lit("").alias("gives"))
    lines = edits.select(*KEY, F.lit(0).alias("kind"), F.lit("").alias("text"), "edits", "gives").unionByName(texts)
    placed = lines.repartition(c.shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*KEY, "kind")
    kept = placed.select("conv_id", "kind", "role", "text", "edits", "gives")
    schema = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("audit string, repaired_sha256 string").fields])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, lines_, pending = None, None, None, 0, None

        def put(role: str, text: str) -> None:
            nonlocal lines_
            sha.update(("\n" if lines_ else "").encode() + f"{role}:".encode())
            sha.update(text.encode())
            lines_ += 1

        def carry_out(edits: str, gives: str, role: str, text: str) -> None:
            initials = iter(gives)
            for edit in edits:
                if edit != "D":
                    initial = next(initials)
                    put(role if edit == "K" else RETOLD[initial], "" if edit == "I" else text)

        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for conv_id, kind, role, text, edits_, gives in zip(*columns, strict=True):
                if audit is None or conv_id != now:
                    if audit is not None:
                        out.append((now, "".join(audit), sha.hexdigest()))
                    now, audit, sha, lines_, pending = conv_id, [], hashlib.sha256(), 0, None
                if kind == 0:
                    audit.append(edits_)
                    pending = (edits_, gives) if gives else None
                elif pending:
                    carry_out(*pending, role, text)
                    pending = None
            if out:
                yield _table(out, batch.schema.field(0).type)
        if audit is not None:
            yield _table([(now, "".join(audit), sha.hexdigest())], batch.schema.field(0).type)

    return kept.mapInArrow(digest, schema)


def _table(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    ids, audits, shas = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, conv), pa.array(audits, pa.string()), pa.array(shas, pa.string())], names=["conv_id", "audit", "repaired_sha256"])


def repair_summary(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """One row for each conv_id of `originals`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    edits = turn_edits(rows)
    single = F.col("first") & ~F.col("blank")
    counted = edits.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - single.cast("long"))).alias("duplicate"),
        F.sum((single & F.col("truncated")).cast("long")).alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
    )
    totals = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = counted.groupBy(F.col("conv_id").alias("_c")).agg(gaps, *totals)
    digests = _digests(edits, rows).withColumnRenamed("conv_id", "_d")
    named = originals.select("conv_id").distinct()
    joined = named.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
