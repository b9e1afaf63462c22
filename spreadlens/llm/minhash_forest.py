"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every document's distinct shingles give a digest of the set, 128 MinHash values and a sketch of 128 bits. Documents with
   one set become one class, so a hot group of copies is a single row from here on.
2. The signature is read in 32 rotated orders (trees) and all classes are range-sorted by them, so that the longest common
   prefixes are neighbours. Classes that share the first four values of an order are a region, a run of the sorted rows. All
   pairs of sketches of a region are compared, and a spanning forest of those that may reach the similarity is kept: candidates
   only group documents here, so fewer links lose nothing. A region of more than `region_rows` classes, or one that may go on in
   the next range, is dealt into blocks by a hash, and each pair of its blocks is compared by a task.
   A pair at 0.8 shares no region of 32 with probability (1 - 0.8^4)^32, about 5e-8.
3. Candidate groups get their texts back, each once, and links are confirmed on whole sets, again as a spanning forest: within
   a group every pair is compared until it is known to be connected. A group of more than `group_rows` classes is not
   gathered: its members meet a few pivots; what isn't in the largest star meets all members in blocks.
4. Components of the confirmed links name each class.

Defined cases: NULL or wordless texts have an empty set and are linked with nothing; rows of one doc_id are one document, so
they share a component; a NULL doc_id takes no part, its component is NULL and it is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadlens.llm import common as c
from spreadlens.llm.tokens import U64, mix, shingle_hashes
from spreadlens.operators.graph import components
from spreadlens.session import stored

WIDTH, PERCENT = 2, 80
TREES, DEPTH = 32, 4
HASHES = TREES * DEPTH
REGION_ROWS, GROUP_ROWS, PIVOTS = 4000, 5000, 4
CHUNK = 1 << 15
_ODD = np.random.default_rng(20240).integers(1, 2**63, size=(2, HASHES), dtype=np.uint64) * U64(2) + U64(1)


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, HASHES) MinHash values of 32 bits; rows of empty texts are zero."""
    n = len(starts) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(starts))
    i = 0
    while i < len(full):
        # As many whole texts as fit a chunk that stays in cache, one at least.
        j = max(i + 1, int(np.searchsorted(starts[full + 1], starts[full[i]] + CHUNK, side="right")))
        part = full[i:j]
        x, at = hashes[starts[part[0]] : starts[part[-1] + 1]], starts[part] - starts[part[0]]
        for k in range(HASHES):
            out[part, k] = np.minimum.reduceat(((x * _ODD[0, k] + _ODD[1, k]) >> U64(32)).astype(np.uint32), at)
        i = j
    return out


def _sketches(minima: np.ndarray) -> np.ndarray:
    """(texts, 2) words of 64 bits: one bit of each MinHash value."""
    bits = (minima.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(63)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of each text's values, modulo 2^64: a digest that doesn't depend on their order."""
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
    return (upto[starts[1:]] - upto[starts[:-1]]).view(np.int64)


def _sign(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = shingle_hashes(batch.column(1), width)
            sizes = np.diff(starts)
            minima = _minima(hashes, starts)
            sketch = _sketches(minima)
            sig = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.arange(0, (len(sizes) + 1) * HASHES * 4, HASHES * 4, dtype=np.int32)), pa.py_buffer(minima.tobytes())])
            h1, h2 = (_sums(mix(hashes + U64(k)), starts) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h1), pa.array(h2), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), sig], schema=schema)

    return sign


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, s1, s2, sig) for each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign(width), "doc_id long, n_shingles long, h1 long, h2 long, s1 long, s2 long, sig binary")


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, rep, n_shingles, s1, s2), part being the region: one for each tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(n, HASHES)
        region = np.empty((TREES, n), U64)
        for t in range(TREES):
            key = np.full(n, t + 1, U64)
            for k in range(DEPTH):
                key = mix(key + sig[:, t * DEPTH + k].astype(U64))
            region[t] = key
        again = lambda i: pa.array(np.tile(batch.column(i).to_numpy(zero_copy_only=False), TREES))
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.ravel().view(np.int64)), again(0), again(1), again(2), again(3)],
            names=_COLUMNS,
        )


def _agreeing_bits(percent: int) -> int:
    """So many of 128 bits agree at the similarity, less six standard deviations."""
    p = (1 + percent / 100) / 2
    return int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5)


def _forest(sizes: np.ndarray, s1: np.ndarray, s2: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose sketches may reach the similarity: breadth first over what isn't yet reached."""
    least, links = _agreeing_bits(percent), []
    rest, queue = np.arange(len(sizes)), []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        i = queue.pop()
        agree = HASHES - np.bitwise_count(s1[rest] ^ s1[i]).astype(int) - np.bitwise_count(s2[rest] ^ s2[i])
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        near = (agree >= least) & (100 * small >= percent * large)
        found = rest[near].tolist()
        links += [(i, j) for j in found]
        queue += found
        rest = rest[~near]
    return links


_COLUMNS = ["part", "rep", "n_shingles", "s1", "s2"]
_LINKED = "a long, b long, part long, n_shingles long, s1 long, s2 long"


def _sorted_links(percent: int, most: int):
    """Links within regions from rows in sorted order. Rows (part, a, n_shingles, s1, s2) without b are of regions that aren't settled
    here: crowded ones, and those at either end of the partition, which may go on in the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_part = crowded = held = None
        for batch in batches:
            if not len(batch):
                continue
            if first_part is None:
                first_part = batch["part"].iloc[0]
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            part = rows["part"].to_numpy()
            counts = rows.groupby("part", sort=False)["part"].transform("size").to_numpy()
            is_open = (part == first_part) | (counts > most)
            if crowded is not None:
                is_open |= part == crowded
            last = part == part[-1]
            # The rest of a region that is known to be open follows it; another one is held until it ends or is crowded.
            crowded = part[-1] if is_open[-1] else None
            yield _open_rows(rows[is_open])
            yield _links_of(rows[~is_open & ~last], percent)
            held = rows[~is_open & last]
        if held is not None:
            yield _open_rows(held)

    return run


def _open_rows(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.rename(columns={"rep": "a"}).assign(b=None)[["a", "b", "part", "n_shingles", "s1", "s2"]]


def _links_of(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    out: list[np.ndarray] = []
    if len(rows):
        part = rows["part"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rep, n = rows["rep"].to_numpy(), rows["n_shingles"].to_numpy()
        s1, s2 = (rows[x].to_numpy().view(U64) for x in ("s1", "s2"))
        several = np.flatnonzero(np.diff(cuts) > 1)
        for a, b in zip(cuts[several], cuts[several + 1]):
            links = _forest(n[a:b], s1[a:b], s2[a:b], percent)
            if links:
                out.append(rep[a:b][np.array(links)])
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    found = pd.DataFrame({"a": pairs.min(axis=1, initial=2**63 - 1), "b": pairs.max(axis=1, initial=-(2**63))}).drop_duplicates()
    return found.assign(part=None, n_shingles=None, s1=None, s2=None)


def _whole_runs(percent: int):
    """Links within runs of `part` that no other task has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = rows["part"] == rows["part"].iloc[-1]
                yield _links_of(rows[~last], percent)[["a", "b"]]
                held = rows[last]
        if held is not None:
            yield _links_of(held, percent)[["a", "b"]]

    return run


def _across(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b) links of regions (part, rep, n_shingles, s1, s2) that several tasks hold: each pair of blocks is a run of rows in some task."""
    # A region that one range began and ended alone has one row only; two are needed for a link.
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Two blocks together are as large as a region that one task settles.
    blocks = F.when(F.col("n") <= most, 1).otherwise(F.ceil(2 * F.col("n") / most)).cast("int")
    dealt = rows.join(sizes.select("part", blocks.alias("k")), "part").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    # A block meets every other; the first meets itself where it is alone. Pairs inside a block come with any pair that has it.
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own")))
    copies = dealt.select(*_COLUMNS, "own", F.explode(others).alias("other"))
    pair = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")).alias("part")
    pairs = copies.select(pair, "rep", "n_shingles", "s1", "s2").repartition(c.shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")
    return pairs.mapInPandas(_whole_runs(percent), "a long, b long")


def candidate_links(classes: DataFrame, percent: int, region_rows: int = REGION_ROWS) -> DataFrame:
    """(a, b) links between classes (rep, n_shingles, s1, s2, sig) that share a region and may be similar."""
    rows = classes.select("rep", "n_shingles", "s1", "s2", "sig").mapInArrow(_plant, "part long, rep long, n_shingles long, s1 long, s2 long")
    n = c.shuffle_partitions(classes.sparkSession)
    placed = rows.repartitionByRange(n, "part", "rep").sortWithinPartitions("part").select(*_COLUMNS)
    found = stored(placed.mapInPandas(_sorted_links(percent, region_rows), _LINKED), "candidates")
    unsettled = found.where("b is null").select("part", F.col("a").alias("rep"), "n_shingles", "s1", "s2")
    return found.where("b is not null").select("a", "b").unionByName(_across(unsettled, percent, region_rows)).distinct()


def _set_links(keys: list, sets: list[np.ndarray], percent: int, first_only: bool = False) -> list[tuple]:
    """Spanning forest of the confirmed pairs: breadth first over what isn't reached; each step compares one set with all of those."""
    flat = np.concatenate(sets) if sets else np.empty(0, U64)
    _, codes = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(codes.max() + 1 if len(codes) else 1, bool)
    waiting = np.ones(len(sets), bool)
    live, live_owner, links, queue = codes, owner, [], []
    while waiting.any():
        if not queue:
            queue.append(int(np.argmax(waiting)))
            waiting[queue[0]] = False
        i = queue.pop()
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.bincount(live_owner[mark[live]], minlength=len(sets))
        mark[own] = False
        near = waiting & (100 * both >= percent * (sizes + sizes[i] - both)) & (both > 0)
        found = np.flatnonzero(near)
        links += [(keys[i], keys[j]) for j in found]
        queue += found.tolist()
        waiting[found] = False
        if len(found):
            keep = waiting[live_owner]
            live, live_owner = live[keep], live_owner[keep]
    return links


def _group_links(width: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        hashes, starts = shingle_hashes(pa.array(group["text"]), width)
        sets = [hashes[starts[i] : starts[i + 1]] for i in range(len(group))]
        return pd.DataFrame(_set_links(group["rep"].tolist(), sets, percent), columns=["a", "b"]).astype("int64")

    return run


def _pair_links(width: int, percent: int):
    """Confirmed pairs of one pivot, or of a block of rows with a block of others."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            (xs, xo), (ys, yo) = (shingle_hashes(pa.array(f["text"]), width) for f in (left, right))
            sizes, owner = np.diff(yo), np.repeat(np.arange(len(right)), np.diff(yo))
            for i, a in enumerate(left["rep"]):
                own = xs[xo[i] : xo[i + 1]]
                at = np.minimum(np.searchsorted(own, ys), len(own) - 1)
                both = np.bincount(owner[own[at] == ys], minlength=len(right)) if len(own) else np.zeros(len(right), int)
                near = (100 * both >= percent * (sizes + len(own) - both)) & (both > 0)
                out += [(a, b) for b in right["rep"].to_numpy()[near] if a != b]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def confirmed_links(members: DataFrame, width: int, percent: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b) links that hold on whole sets and connect whatever is connected within each group; members: (grp, rep, text)."""
    members = stored(members, "members")
    counts = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = stored(counts.where(F.col("n") > group_rows), "large_groups")
    if not large.take(1):
        return members.groupBy("grp").applyInPandas(_group_links(width, percent), "a long, b long")
    small = members.join(large, "grp", "left_anti").groupBy("grp").applyInPandas(_group_links(width, percent), "a long, b long")
    hot = members.join(large, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(2 * F.col("n") / group_rows)).cast("int"))
    # Pivots are the members with the smallest hashes; they meet every block of their group.
    lowest = Window.partitionBy("grp").orderBy(F.xxhash64("rep", F.lit(1)), "rep")
    pivots = hot.select("grp", "rep", "text", "n").withColumn("turn", F.row_number().over(lowest)).where(F.col("turn") <= PIVOTS)
    n_blocks = F.ceil(2 * F.col("n") / group_rows).cast("int")
    meeting = pivots.select("grp", "rep", "text", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    # toDF names the columns anew: both sides stem from the members.
    meeting = meeting.toDF(*meeting.columns)
    stars = stored(
        meeting.groupBy("grp", "block").cogroup(hot.select("grp", "block", "rep", "text").groupBy("grp", "block")).applyInPandas(_pair_links(width, percent), "a long, b long"), "stars"
    )
    in_star = components(stars).select(F.col("node").alias("rep"), "root")
    placed = hot.select("grp", "block", "rep", "n").join(in_star, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    sizes = placed.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("m"))
    widest = sizes.groupBy("grp").agg(F.max(F.struct("m", "root"))["root"].alias("widest"))
    loose = placed.join(widest, "grp").where("root <> widest").select("rep", "n")
    # What isn't in the widest star meets all blocks of its group.
    again = hot.select("grp", "rep", "text").join(loose, "rep").select("grp", "rep", "text", F.pmod(F.xxhash64("rep", F.lit(2)), n_blocks).alias("piece"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    again = again.toDF(*again.columns)
    pieces = again.select("grp", "block", "piece").distinct()
    others = hot.select("grp", "block", "rep", "text").join(pieces, ["grp", "block"])
    others = others.toDF(*others.columns)
    rest = again.groupBy("grp", "block", "piece").cogroup(others.groupBy("grp", "block", "piece")).applyInPandas(_pair_links(width, percent), "a long, b long")
    return small.unionByName(stars).unionByName(rest)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, region_rows: int = REGION_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = stored(signatures(docs, width), "signatures")
    sets = ["n_shingles", "h1", "h2"]
    known = signed.where("doc_id is not null and n_shingles > 0")
    classes = stored(known.groupBy(*sets).agg(F.min("doc_id").alias("rep"), *(F.any_value(x).alias(x) for x in ("s1", "s2", "sig"))), "classes")
    groups = components(candidate_links(classes, percent, region_rows)).select(F.col("node").alias("rep"), F.col("root").alias("grp"))
    groups = stored(groups, "groups")
    # A shuffled join at every size: the groups grow with the documents, so a broadcast would only suit small inputs.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(groups.hint("shuffle_hash"), "rep")
    # A doc_id of several rows is one document: the largest of its texts stands for it here, its other sets are tied below.
    texts = texts.groupBy("rep").agg(F.any_value("grp").alias("grp"), F.max("text").alias("text"))
    links = confirmed_links(texts, width, percent, group_rows)
    in_class = classes.select(*sets, "rep")
    # Sets of one doc_id that differ are tied; there are none where ids are unique.
    rows = known.select("doc_id", *sets).join(in_class, sets).select("doc_id", "rep")
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").drop("z")
    ties = rows.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    roots = components(links.unionByName(ties)).select(F.col("node").alias("rep"), "root")
    named = in_class.join(roots, "rep", "left").select(*sets, F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", *sets).join(named, sets, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with exactly its columns; of rows that share doc_id and component one stays."""
    verdict = near_duplicates(docs, width, percent)
    dropped = stored(verdict.where("not kept").select("doc_id").distinct(), "dropped")
    first = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("_doc"))
    kept = packed.join(dropped, "doc_id", "left_anti").withColumn("_n", F.row_number().over(first))
    return kept.where("_n = 1 or doc_id is null").select("_doc.*")
