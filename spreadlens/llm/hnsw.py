"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt into shards of about `shard_rows` by a hash of their id. A shard's graph is built at once: distinct
vectors are the nodes (a hot vector is one node with many ids), a node's level is geometric, and on every level each node
links to nearest others of that level, thinned so that links point in different directions, plus the reverse links. A level
is stored as flat arrays: its nodes, offsets and neighbours. All queries of a block walk a shard's graph together: from the
top level down, each keeps a beam of its best nodes and expands the nearest unexpanded ones until none is left. Scores
are computed on the original vectors in double precision; the shards' best are merged by (score, vec_id).

Work follows rows for building and queries times shards for searching; a task holds one shard and one block of queries.

Defined cases: vectors that are NULL, zero, hold NULL or non-finite components, or have another length than most (the
shorter one on ties) take no part, neither do rows with a NULL id; a query id of several rows is searched with its smallest vector; equal scores
go by vec_id; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlens.session import stored

SHARD_ROWS, BLOCK_QUERIES, LINKS, CANDIDATES, BEAM, UPPER_BEAM, EXPAND, K = 8192, 512, 16, 48, 128, 16, 4, 10
_INDEX = "shard int, vectors binary, dim int, ids binary, owner binary, levels array<struct<nodes:binary,offsets:binary,links:binary>>"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), dim)


def _near(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) places of the nearest others, nearest first."""
    norms = (x * x).sum(axis=1)
    d = norms[rows][:, None] + norms[None, :] - 2 * (x[rows] @ x.T)
    d[np.arange(len(rows)), rows] = np.inf
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(d, axis=1)[:, : len(x) - 1]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


def _thinned(x: np.ndarray, rows: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """A mask of `near`: a candidate stays if it is closer to the node than to every link kept before it."""
    found = x[near]
    to_node = ((found - x[rows][:, None, :]) ** 2).sum(axis=2)
    norms = (found * found).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.einsum("nid,njd->nij", found, found, optimize=True)
    kept = np.zeros(near.shape, bool)
    for r in range(near.shape[1]):
        closest = np.where(kept, between[:, r, :], np.inf).min(axis=1)
        kept[:, r] = (to_node[:, r] < closest) & (kept.sum(axis=1) < most)
    # What is left is filled up with the nearest, so that dense spots stay connected.
    room = most // 2 - kept.sum(axis=1)
    others = np.cumsum(~kept, axis=1) * ~kept
    return kept | ((others > 0) & (others <= room[:, None]))


def _level(x: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, links) between the nodes of a level, as places in `nodes`."""
    own, pairs = x[nodes], []
    if len(nodes) > 1:
        for i in range(0, len(nodes), 1024):
            rows = np.arange(i, min(i + 1024, len(nodes)))
            near = _near(own, rows, min(CANDIDATES, len(nodes) - 1))
            for j in range(0, len(rows), 256):
                mask = _thinned(own, rows[j : j + 256], near[j : j + 256], most)
                at = np.nonzero(mask)
                pairs.append(np.stack([rows[j : j + 256][at[0]], near[j : j + 256][at]], axis=1))
    edges = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(edges[:, 0], minlength=len(nodes)))])
    return offsets.astype(np.int64), edges[:, 1].astype(np.int32)


def _build(dim: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, raw = table.column("vec_id").to_numpy(), _matrix(table.column("vector"), dim)
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], raw[order]
        _, first, owner = np.unique(raw.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        x = raw[first]
        rng = np.random.default_rng(shard)
        level = np.floor(-np.log(1 - rng.random(len(x))) / math.log(LINKS)).astype(int)
        levels, depth = [], 0
        while True:
            nodes = np.flatnonzero(level >= depth)
            # The top level is small enough to be looked at whole.
            offsets, links = _level(x, nodes, 2 * LINKS if depth == 0 else LINKS)
            levels.append({"nodes": nodes.astype(np.int32).tobytes(), "offsets": offsets.tobytes(), "links": links.tobytes()})
            depth += 1
            if not 2 * LINKS < len(nodes) or not (level >= depth).any():
                break
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "vectors": pa.array([x.tobytes()], pa.binary()), "dim": pa.array([dim], pa.int32()),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "owner": pa.array([owner.astype(np.int32).tobytes()], pa.binary()),
            "levels": pa.array([levels], pa.list_(pa.struct([("nodes", pa.binary()), ("offsets", pa.binary()), ("links", pa.binary())]))),
        })

    return run


def _beam_search(x: np.ndarray, q: np.ndarray, offsets: np.ndarray, links: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, width) places and squared distances of each query's beam, nearest first; -1 fills up. start: (queries, s), -1 for none."""
    n = len(q)
    norms, qn = (x * x).sum(axis=1), (q * q).sum(axis=1)
    seen = np.zeros((n, len(x)), bool)
    beam, dist, done = np.full((n, width), -1), np.full((n, width), np.inf), np.ones((n, width), bool)

    def merge(who: np.ndarray, what: np.ndarray) -> None:
        """Add nodes to the queries' beams."""
        new = ~seen[who, what]
        who, what = who[new], what[new]
        pair = np.unique(who.astype(np.int64) * len(x) + what)
        who, what = pair // len(x), pair % len(x)
        seen[who, what] = True
        if not len(who):
            return
        d = norms[what] + qn[who] - 2 * np.einsum("nd,nd->n", x[what], q[who])
        touched = np.unique(who)
        at = np.searchsorted(touched, who)
        most = np.bincount(at).max()
        first = np.concatenate([[0], np.cumsum(np.bincount(at))])[:-1]
        column = np.arange(len(who)) - first[at]
        wide = np.full((len(touched), width + most), -1)
        wide_d, wide_done = np.full(wide.shape, np.inf), np.ones(wide.shape, bool)
        wide[:, :width], wide_d[:, :width], wide_done[:, :width] = beam[touched], dist[touched], done[touched]
        wide[at, width + column], wide_d[at, width + column], wide_done[at, width + column] = what, d, False
        best = np.argsort(wide_d, axis=1, kind="stable")[:, :width]
        for target, source in ((beam, wide), (dist, wide_d), (done, wide_done)):
            target[touched] = np.take_along_axis(source, best, axis=1)

    who, col = np.nonzero(start >= 0)
    merge(who, start[who, col])
    while True:
        open_ = ~done & (beam >= 0)
        turn = open_ & (np.cumsum(open_, axis=1) <= EXPAND)
        who, col = np.nonzero(turn)
        if not len(who):
            return beam, dist
        done[who, col] = True
        node = beam[who, col]
        size = offsets[node + 1] - offsets[node]
        at = np.repeat(offsets[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        merge(np.repeat(who, size), links[at])


def _search(k: int, beam_width: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        row = index.to_pylist()[0]
        dim = row["dim"]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        ids, owner = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owner"], np.int32)
        qid, q = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"), dim)
        found = None
        for depth in range(len(row["levels"]) - 1, -1, -1):
            level = row["levels"][depth]
            nodes, offsets, links = (np.frombuffer(level[f], t) for f, t in (("nodes", np.int32), ("offsets", np.int64), ("links", np.int32)))
            own = x[nodes]
            if found is None:
                entry = np.tile(np.arange(min(len(nodes), 4 * LINKS)), (len(q), 1))
            else:
                entry = np.where(found >= 0, np.searchsorted(nodes, np.maximum(found, 0)), -1)
            beam, _ = _beam_search(own, q, offsets, links, entry, beam_width if depth == 0 else UPPER_BEAM)
            found = np.where(beam >= 0, nodes[np.maximum(beam, 0)], -1)
        # A node's ids in ascending order; the query's own id may be among them.
        by_node = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[by_node], np.arange(len(x) + 1))
        who, col = np.nonzero(found >= 0)
        node = found[who, col]
        size = np.minimum(first[node + 1] - first[node], k + 1)
        at = np.repeat(first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        who, node, vec = np.repeat(who, size), np.repeat(node, size), ids[by_node[at]]
        score = np.sqrt(((x[node] - q[who]) ** 2).sum(axis=1))
        other = vec != qid[who]
        who, vec, score = who[other], vec[other], score[other]
        order = np.lexsort((vec, score, who))
        who, vec, score = who[order], vec[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < k
        return pa.table({"query_id": qid[who[top]], "vec_id": vec[top], "score": score[top]}, schema=schema)

    return run


def usable(vector: Column) -> Column:
    plain = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & plain & F.exists(vector, lambda v: v != 0), F.lit(False))


def _vectors(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def build_index(df: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of (vec_id, embedding), written: distinct vectors, ids, and each level's flat neighbour arrays."""
    rows = _vectors(df)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    # One vector of another length must not decide for all others.
    n, dim = sizes.orderBy(F.desc("n"), "dim").select("n", "dim").first() or (0, 0)
    shards = max(1, -(-n // shard_rows))
    rows = rows.where(F.size("vector") == dim).select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "vector")
    return stored(rows.groupBy("shard").applyInArrow(_build(dim), _INDEX), "hnsw")


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` nearest found for each query (vec_id, embedding), itself left out."""
    dims = index.agg(F.max("dim"), F.max("shard")).first()
    asked = _vectors(queries).where(F.size("vector") == (dims[0] or 0)).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    asked = stored(asked, "queries")
    blocks = max(1, -(-asked.count() // block_queries))
    in_blocks = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    # Each block goes to each shard: the stated queries meet all rows.
    sent = in_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit((dims[1] or 0)).cast("int"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.select("query_id", F.row_number().over(best).cast("int").alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)

