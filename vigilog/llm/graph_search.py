"""Nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt by their hash into shards of about ``shard_rows``, one task's
work each. There the vectors enter a directed graph in growing batches: a greedy
search from the central vector expands the nearest vectors found so far, and what
it has expanded is proposed as neighbours. Robust pruning keeps the nearest of
them and lets go each other one that is ``alpha`` times nearer to a kept one than
to the vector itself, up to ``degree``; edges back are added and pruned alike.
Vectors that no edge path reaches get an edge from the nearest that one does.

A query is answered by beam search in every shard; the ``beam`` nearest vectors
that it finds are measured again in double precision, and the best of all shards
are ranked. Every vector is in the graph of its shard. Recall depends on
``degree`` and ``beam``; the tests measure it against brute force.

Equal vectors are one vertex with the smallest ids of its rows, one more than
``k``, which are all that an answer can need. They are found by range of a salted
key first, so a vector that a third of all rows share is not gathered in one task.
Queries go to the shards through a shuffle and are answered as they stream in, so
a task holds one shard and a batch of queries, and nothing is broadcast.

Defined results: vectors null, empty, zero or with a null or non-finite component
take no part, nor do rows of null id; of several rows of one id the one with the
least vector (in the order of arrays) takes part; vectors of different length
never meet; equal distances are ranked by id; other columns are ignored; empty
tables give no rows. Distances whose square leaves the range of a double are
infinite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import store

#: Searches that run side by side.
_SIDE_BY_SIDE = 256


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd.alias("odd"))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def vertices(rows: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """(v, ids): the different vectors with the ``most`` smallest ids of each."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    for keys in (["v", "_salt"], ["v"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    return salted.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


# -- a shard ---------------------------------------------------------------------


class Graph:
    """The directed graph of one shard's different vectors."""

    def __init__(self, vectors: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 11):
        self.exact = vectors
        self.scale = float(np.abs(vectors).max(initial=0.0)) or 1.0
        self.x = (vectors / self.scale).astype(np.float32)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n = len(vectors)
        self.out = np.full((n, degree), -1, np.int32)
        self.start = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))) if n else -1
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[self.start, order[order != self.start]] if n else order
        done, size = 1, 1
        while done < n:
            self._enter(order[done : done + size])
            done += size
            size = min(2 * size, _SIDE_BY_SIDE)
        if n:
            self._connect()

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of the scaled queries the ``beam`` nearest vertices found,
        nearest first (-1: none), and the vertices that the search expanded."""
        n = len(queries)
        ids = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        ids[:, 0] = self.start
        far[:, 0] = ((self.x[self.start] - queries) ** 2).sum(axis=1)
        fresh = np.zeros((n, beam), bool)
        fresh[:, 0] = True
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.start] = True
        steps = []
        live = np.arange(n)
        while len(live):
            pick = fresh[live].argmax(axis=1)
            at = ids[live, pick]
            fresh[live, pick] = False
            step = np.full(n, -1, np.int32)
            step[live] = at
            steps.append(step)
            near = self.out[at]
            rows = live[:, None]
            known = (near < 0) | seen[rows, near]
            seen[np.broadcast_to(rows, near.shape)[~known], near[~known]] = True
            gap = self.x[near]
            gap -= queries[live][:, None, :]
            away = np.einsum("ijk,ijk->ij", gap, gap)
            away[known] = np.inf
            all_far = np.concatenate([far[live], away], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
            new = np.concatenate([fresh[live], ~known], axis=1)
            fresh[live] = np.take_along_axis(new, best, 1) & np.isfinite(far[live])
            live = live[fresh[live].any(axis=1)]
        ids[~np.isfinite(far)] = -1
        return ids, np.stack(steps, axis=1) if steps else np.zeros((n, 0), np.int32)

    def _pruned(self, of: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Robust pruning of each row's proposals (-1: none)."""
        own = self.x[of]
        there = (proposed >= 0) & (proposed != of[:, None])
        gap = self.x[proposed] - own[:, None, :]
        far = np.where(there, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        proposed, far = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1)
        points = self.x[proposed]
        length = np.einsum("ijk,ijk->ij", points, points)
        between = length[:, :, None] + length[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        between *= self.alpha**2
        out = np.full((len(of), self.degree), -1, np.int32)
        taken = np.zeros(len(of), np.int64)
        alive = np.isfinite(far)
        for k in range(proposed.shape[1]):
            # A vertex proposed twice is let go by itself, at no distance.
            keep = np.flatnonzero(alive[:, k] & (taken < self.degree))
            if len(keep):
                out[keep, taken[keep]] = proposed[keep, k]
                taken[keep] += 1
                alive[keep] &= (between[keep, k] > far[keep]) & (proposed[keep] != proposed[keep, k][:, None])
        return out

    def _enter(self, batch: np.ndarray) -> None:
        _, expanded = self.search(self.x[batch], self.beam)
        self.out[batch] = self._pruned(batch, expanded)
        a = np.repeat(batch, self.degree)
        b = self.out[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))
        # Edges back, as many to a vertex at a time as it may have.
        for lo in range(0, int(place.max(initial=-1)) + 1, self.degree):
            now = (place >= lo) & (place < lo + self.degree)
            to = np.unique(b[now])
            more = np.full((len(to), self.degree), -1, np.int32)
            more[np.searchsorted(to, b[now]), place[now] - lo] = a[now]
            room = (self.out[to] >= 0).sum(axis=1) + (more >= 0).sum(axis=1) <= self.degree
            both = np.concatenate([self.out[to], more], axis=1)
            simple = np.sort(np.where(both[room] < 0, np.iinfo(np.int32).max, both[room]), axis=1)[:, : self.degree]
            self.out[to[room]] = np.where(simple == np.iinfo(np.int32).max, -1, simple)
            if (~room).any():
                self.out[to[~room]] = self._pruned(to[~room], both[~room])

    def _connect(self) -> None:
        """An edge to every vertex that no path reaches, from the nearest reached."""
        reached = np.zeros(len(self.x), bool)
        front = np.array([self.start])
        extra: list[tuple[int, int]] = []
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(self.out[front])
                front = near[(near >= 0) & ~reached[np.maximum(near, 0)]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            v = int(lost[0])
            inside = np.flatnonzero(reached)
            extra.append((int(inside[np.argmin(((self.x[inside] - self.x[v]) ** 2).sum(axis=1))]), v))
            front = np.array([v])
        if extra:
            own = np.array([a for a, _ in extra])
            places = [int((own[:i] == a).sum()) for i, a in enumerate(own)]
            wide = np.full((len(self.x), max(places) + 1), -1, np.int32)
            for (a, b), place in zip(extra, places):
                wide[a, place] = b
            self.out = np.concatenate([self.out, wide], axis=1)

    def nearest(self, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest vertices found for each query (-1: none), and their
        distances in double precision."""
        scaled = np.clip(queries / self.scale, -1e15, 1e15).astype(np.float32)
        ids, _ = self.search(scaled, max(beam, k))
        gap = self.exact[ids] - queries[:, None, :]
        far = np.sqrt((gap * gap).sum(axis=2))
        far[ids < 0] = np.inf
        order = np.lexsort((ids < 0, far), axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def _answer(k: int, degree: int, build_beam: int, beam: int, alpha: float):
    """Tasks over rows (shard, is_query, v, ids), sorted by the first two."""
    names = ["query_id", "ids", "score"]

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches):
        shard, parts, ids, graph = None, [], [], None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if shards[lo] != shard:
                    shard, parts, ids, graph = shards[lo], [], [], None
                own = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append(matrix(own.column(2)))
                    ids += own.column(3).to_pylist()
                    continue
                if not parts:
                    continue
                if graph is None:
                    graph = Graph(np.concatenate(parts), degree, build_beam, alpha)
                queries = own.column(3).to_pylist()
                vectors = matrix(own.column(2))
                for at in range(0, len(queries), _SIDE_BY_SIDE):
                    found, far = graph.nearest(vectors[at : at + _SIDE_BY_SIDE], k + 1, beam)
                    row, col = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([queries[at + r][0] for r in row.tolist()], pa.int64()),
                         pa.array([ids[v] for v in found[row, col].tolist()], pa.list_(pa.int64())),
                         pa.array(far[row, col], pa.float64())], names)

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding",
    shard_rows: int = 4096, degree: int = 32, build_beam: int = 64, beam: int = 96, alpha: float = 1.2,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row of ``vectors`` for
    which ``is_query`` (of its ``vec_id``) holds, its ``k`` nearest rows found."""
    rows = store(usable(vectors, id_, vector), "vectors")
    index = store(vertices(rows, k + 1), "vertices").withColumn("_dim", F.size("v"))
    # Shards of each vector length: their number and that of the first.
    sizes = index.groupBy("_dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_n"))
    shards = sizes.agg(F.sum("_n")).first()[0] or 0
    key = F.xxhash64("_dim", "_shard")
    dealt = index.join(sizes, "_dim").withColumn("_shard", F.pmod(F.xxhash64("v"), F.col("_n")).cast("int"))
    dealt = dealt.select(key.alias("shard"), F.lit(False).alias("asks"), "v", "ids")
    asked = rows.where(is_query).withColumn("_dim", F.size("v")).join(sizes, "_dim")
    asked = asked.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    asked = asked.select(key.alias("shard"), F.lit(True).alias("asks"), "v", F.array("vec_id").alias("ids"))
    # A number of partitions of its own: a shard is much work for few bytes.
    both = dealt.union(asked).repartition(int(min(max(3 * shards, 1), 50_000)), "shard").sortWithinPartitions("shard", "asks")
    found = both.mapInArrow(_answer(k, degree, build_beam, beam, alpha), "query_id long, ids array<long>, score double")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
