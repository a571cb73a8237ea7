"""Approximate nearest neighbours by largest inner product.

Vectors are dealt to shards by a hash of their id. Each shard builds a hierarchical
navigable small-world graph over its distinct vectors, held as flat arrays of
neighbour numbers, one row a vector and level. Queries go to every shard in blocks,
are searched there side by side, and the shards' results are merged by a windowed
ranking.

A new vector is linked to the nearest ones found by a search of the graph so far;
of these, those stay that are nearer to it than to a neighbour chosen before.
Vectors enter in rounds that double the graph at most, and those of one round are
compared with each other directly.

The graph uses vectors extended by one component that gives all the same length, so
the largest inner product is the smallest distance; scores are computed in double
precision on the original vectors.

Edge cases: vectors that are null, zero or hold null or non-finite components take
no part, as queries or candidates; vectors of another length than most raise an
error; equal vectors are one vertex with all their ids, so ties go to the smaller
id; repeated ids are separate candidates; fewer than ``k`` candidates give all; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regweave.session import cut_lineage

LINKS, WIDTH_BUILD, WIDTH_SEARCH = 16, 64, 96
SHARD_ROWS = 8192
QUERY_ROWS = 2048
FOUND = "query_id long, vec_id long, score double"


class Graph:
    """Flat neighbour arrays: ``near[level][i]`` holds vertex numbers, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, links: int = LINKS, width: int = WIDTH_BUILD, seed: int = 5):
        self.x, self.links, self.width = np.ascontiguousarray(x, np.float32), links, width
        n = len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        self.x = self.x[order]
        self.number = order  # of each vertex, the row it was given as
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / math.log(links)).astype(int), 8)
        self.level = np.sort(level)[::-1].copy()  # vertices of high levels come first
        self.near = [np.full((int((self.level >= l).sum()), 2 * links if l == 0 else links), -1, np.int32)
                     for l in range(int(self.level.max(initial=0)) + 1)]
        done = min(n, 1)
        while done < n:
            more = min(n, 2 * done, done + 1024)
            self._insert(np.arange(done, more))
            done = more

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        start = np.zeros(len(new), np.int64)
        among = q @ q.T
        for l in range(len(self.near) - 1, -1, -1):
            here = self.level[new] >= l
            known = self.level[:new[0]] >= l
            if known.any():
                ids, score = self._search(q, start, l, self.width if here.any() else 1)
                start = np.where(ids[:, 0] >= 0, ids[:, 0], start)
            else:
                ids, score = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
            if not here.any():
                continue
            peers = np.flatnonzero(here)
            k = min(self.width // 2, len(peers) - 1)
            if k > 0:
                own = among[np.ix_(peers, peers)].copy()
                np.fill_diagonal(own, -np.inf)
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                both = np.concatenate([ids[peers], new[peers][best]], axis=1)
                value = np.concatenate([score[peers], np.take_along_axis(own, best, 1)], axis=1)
            else:
                both, value = ids[peers], score[peers]
            if both.shape[1]:
                self._link(new[peers], both, value, l)

    def _select(self, v: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to the vertex than to any chosen before; then the nearest others."""
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        valid = (ids >= 0) & np.isfinite(score)
        vectors = self.x[np.maximum(ids, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        n, c = ids.shape
        chosen, count = np.zeros((n, c), bool), np.zeros(n, np.int64)
        for j in range(c):
            clash = (chosen & (between[:, j] > score[:, j:j + 1])).any(axis=1)
            take = valid[:, j] & ~clash & (count < most)
            chosen[:, j] = take
            count += take
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.full((n, most), -1, np.int32)
        got = np.take_along_axis(np.where(valid, ids, -1), order, 1)
        out[:, :got.shape[1]] = got
        return out

    def _link(self, v: np.ndarray, ids: np.ndarray, score: np.ndarray, l: int) -> None:
        near = self.near[l]
        chosen = self._select(v, ids, score, self.links)
        near[v, :self.links] = chosen
        src = np.repeat(v, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0].astype(np.int64)
        # the other direction: add to each row, and choose anew where it is full
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        rows, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = near.shape[1]
        by_count = np.argsort(count, kind="stable")
        rows, first, count = rows[by_count], first[by_count], count[by_count]
        c0 = 0
        while c0 < len(rows):
            # few rows at a time where many new vertices point to one
            part = slice(c0, max(c0 + 1, min(c0 + 512, c0 + int(np.searchsorted(
                (np.arange(len(rows) - c0) + 1) * (count[c0:] + wide), 40_000)))))
            c0 = part.stop
            r, n_new = rows[part], count[part]
            pool = np.full((len(r), wide + int(n_new.max())), -1, np.int64)
            pool[:, :wide] = near[r]
            at = np.repeat(np.arange(len(r)), n_new)
            col = np.arange(n_new.sum()) - np.repeat(np.cumsum(n_new) - n_new, n_new) + wide
            pool[at, col] = src[np.repeat(first[part], n_new) + col - wide]
            again = np.sort(pool, axis=1)
            dup = np.zeros_like(again, bool)
            dup[:, 1:] = again[:, 1:] == again[:, :-1]
            pool = np.where(dup, -1, again)
            value = np.einsum("nd,ncd->nc", self.x[r], self.x[np.maximum(pool, 0)])
            value[pool < 0] = -np.inf
            if pool.shape[1] > wide + 64:
                best = np.argpartition(-value, wide + 63, axis=1)[:, :wide + 64]
                pool, value = np.take_along_axis(pool, best, 1), np.take_along_axis(value, best, 1)
            near[r] = self._select(r, pool, value, wide)

    def _search(self, q: np.ndarray, start: np.ndarray, l: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` vertices of level ``l`` for each query, best first: all queries step together."""
        n, near = len(q), self.near[l]
        ids = np.full((n, width), -1, np.int64)
        score = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.x)), bool)
        ids[:, 0], open_[:, 0] = start, True
        score[:, 0] = np.einsum("nd,nd->n", q, self.x[start])
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while len(live):
            best = np.argmax(np.where(open_[live], score[live], -np.inf), axis=1)
            live = live[open_[live, best]]
            if not len(live):
                break
            best = np.argmax(np.where(open_[live], score[live], -np.inf), axis=1)
            open_[live, best] = False
            other = near[ids[live, best]].astype(np.int64)
            fresh = (other >= 0) & ~seen[live[:, None], np.maximum(other, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], other[r, c]] = True
            value = np.full(other.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[other[r, c]])
            both = np.concatenate([score[live], value], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], other], axis=1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), order, 1)
            score[live] = np.take_along_axis(both, order, 1)
            dead = ~np.isfinite(score[live])
            ids[live] = np.where(dead, -1, ids[live])
            open_[live] = open_[live] & ~dead
        return ids, score

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Row numbers of the ``width`` best vectors for each query, -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        start = np.zeros(len(q), np.int64)
        for l in range(len(self.near) - 1, 0, -1):
            ids, _ = self._search(q, start, l, 4)
            start = ids[:, 0]
        ids, _ = self._search(q, start, 0, width)
        return np.where(ids >= 0, self.number[np.maximum(ids, 0)], -1)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return rows.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n:
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1)


def _shard_search(k: int, width: int):
    """For one shard: the graph over its candidates, and the best k for each block of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, shard, rows = None, None, []
        for b in batches:
            for lo, hi in _runs(b.column(0), b.column(1)):
                own, is_query = b.column(0)[lo].as_py(), b.column(1)[lo].as_py()
                part = b.slice(lo, hi - lo)
                if own != shard:
                    shard, rows, graph = own, [], None
                if not is_query:
                    rows.append(part)
                    continue
                if graph is None and rows:
                    graph = _Shard(rows)
                if graph is not None:
                    for at in range(0, len(part), QUERY_ROWS):
                        yield graph.answer(part.slice(at, QUERY_ROWS), k, width)
    return run


def _runs(*columns) -> list[tuple[int, int]]:
    keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
    if not keys.shape[1]:
        return []
    cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
    return list(zip(cuts.tolist(), np.append(cuts[1:], keys.shape[1]).tolist()))


class _Shard:
    def __init__(self, parts: list[pa.RecordBatch]):
        ids = np.concatenate([p.column(2).to_numpy() for p in parts])
        v = np.concatenate([_matrix(p.column(3)) for p in parts])
        self.v, group = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort([ids, group.ravel()])
        self.ids, self.group = ids[order], group.ravel()[order]
        self.first = np.searchsorted(self.group, np.arange(len(self.v) + 1))
        # one more component makes all vectors of a graph equally long; it would hide the others beside a much
        # longer vector, so vectors of about one length (a factor of four) have a graph of their own
        square = (self.v ** 2).sum(axis=1)
        band = np.floor(np.log2(np.maximum(square, np.finfo(float).tiny)) / 4 + 0.5)
        self.graphs = []
        for b in np.unique(band):
            members = np.flatnonzero(band == b)
            rest = np.sqrt(np.maximum(0, square[members].max() - square[members]))
            x = np.concatenate([self.v[members], rest[:, None]], axis=1)
            # inner products of one graph keep their order when all its vectors are divided by one number
            self.graphs.append((members, Graph(x / (np.sqrt(square[members].max()) or 1.0))))

    def answer(self, part: pa.RecordBatch, k: int, width: int) -> pa.RecordBatch:
        own, q = part.column(2).to_numpy(), _matrix(part.column(3))
        unit = q / np.maximum(np.sqrt((q ** 2).sum(axis=1, keepdims=True)), np.finfo(float).tiny)
        asked = np.concatenate([unit, np.zeros((len(q), 1))], axis=1)
        found = []
        for members, graph in self.graphs:
            near = graph.search(asked, width)
            found.append(np.where(near >= 0, members[np.maximum(near, 0)], -1))
        found = np.concatenate(found, axis=1)
        query, vec, score = [], [], []
        for i, vertices in enumerate(found):
            vertices = vertices[vertices >= 0]
            # k + 1 ids of each vertex are enough for the k nearest, the query itself left out
            n = np.minimum(self.first[vertices + 1] - self.first[vertices], k + 1)
            ids = np.concatenate([self.ids[self.first[x]:self.first[x] + m] for x, m in zip(vertices, n)])
            value = np.repeat(_products(self.v[vertices], q[i]), n)
            keep = ids != own[i]
            ids, value = ids[keep], value[keep]
            best = np.lexsort([ids, -value])[:k]
            query.append(np.full(len(best), own[i]))
            vec.append(ids[best])
            score.append(value[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(vec)),
                                           pa.array(np.concatenate(score))], ["query_id", "vec_id", "score"])


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    out = np.zeros(len(v))
    for j in range(v.shape[1]):
        out += v[:, j] * q[j]
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, width: int = WIDTH_SEARCH,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, its own id left out."""
    candidates = cut_lineage(usable_vectors(rows, id_col, vector_col))
    asked = usable_vectors(queries, id_col, vector_col)
    n, dims = candidates.agg(F.count("*"), F.count_distinct(F.size("v"))).first()
    if dims > 1:
        raise ValueError("vectors differ in length")
    shards = max(1, math.ceil(n / SHARD_ROWS))
    dealt = candidates.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                              F.lit(False).alias("is_query"), "id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                         F.lit(True).alias("is_query"), "id", "v")
    found = (dealt.unionByName(every).repartition(4 * shards, "shard").sortWithinPartitions("shard", "is_query", "id")
             .mapInArrow(_shard_search(k, width), FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
