"""Approximate nearest neighbours: one navigable small-world graph per shard, shard results merged.

Rows are dealt to shards by a hash of their id, so no label, source or repeated vector fills one. A shard
indexes every row of its own: equal vectors are one node with a list of ids, and the graph is kept as flat
neighbour arrays, one for each layer, in one row of a table in the shared folder. A node draws its top layer,
and on each layer chooses links out of the ``EF_BUILD`` nodes nearest to it, those that no chosen one is
nearer to first; links go both ways. Nearest ones alone leave tight clusters without links to others, so a shard
has seeds too, one for ``M`` nodes, each the node farthest from those before it: a walk on the lowest layer starts
from the seeds nearest to the query as well as from where the upper layers lead. A cluster of no more than ``M`` nodes,
which no seed may lie in, has links that lead out of it and in. The nearest ones are found exactly, by products of
blocks of a shard's rows, instead of by walking the unfinished graph: for shards of this size that takes a tenth of
the time.
Largest inner product becomes nearest direction by one further component that gives all nodes of a shard
the same norm.

A shard's index is read once, and the queries stream past it, so a task holds an index and a batch of
queries. Where there are fewer shards than shuffle partitions, queries are dealt to as many blocks as there
are idle partitions, and an index is copied for each. Every query meets every shard, and the nearest of all
shards are merged by score: with a twentieth of the rows as queries, searching grows with the square of the
table. A shard's answers are scored on the original vectors in double precision; ties go to the smaller
vec_id. The graph is approximate and its recall is measured in tests.

Vectors that are null, zero, empty, or hold null or non-finite components take no part. Vectors are
compared with those of equal length only. Repeated rows of one vec_id count once if equal; of different
vectors of one vec_id the least, component by component, is the query, and each is a candidate. Rows
without a vec_id take no part. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm._common import cut, shuffle_width

M = 24  # links that a node chooses; with those from others M at most, twice as many on the lowest layer
EF_BUILD = 80
EF_SEARCH = 128
EF_DESCENT = 8
SHARD_ROWS = 20_000
MIN_SHARDS = 4
ROWS = 1024  # of a block of similarities
K = 20


class Graph:
    """A layered graph over unit-norm rows, similarity the inner product."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None, entry: int = 0, seeds: np.ndarray | None = None) -> None:
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.stamp = np.zeros(len(x), dtype=np.int32)
        self.turn = 0
        self.layers = layers or []
        self.entry = entry
        self.seeds = seeds if seeds is not None else np.empty(0, dtype=np.int32)
        if layers is None and len(x):
            self._build()
        else:
            self._place()

    def _place(self) -> None:
        self.row = []
        for nodes, _ in self.layers:
            row = np.full(len(self.x), -1, dtype=np.int32)
            row[nodes] = np.arange(len(nodes), dtype=np.int32)
            self.row.append(row)
        self.count = [(links >= 0).sum(axis=1).astype(np.int32) for _, links in self.layers]

    def _build(self) -> None:
        """Layers by a geometric draw; on each the nodes' links out of their exact nearest ones, and back."""
        n = len(self.x)
        rng = np.random.default_rng(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(np.int64), 8)
        for layer in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= layer).astype(np.int32)
            self.layers.append((nodes, self._links(nodes, 2 * M if layer == 0 else M)))
        self.entry = int(self.layers[-1][0][0])
        self._place()
        self.seeds = self._spread(n // M)

    def _spread(self, count: int) -> np.ndarray:
        """``count`` nodes, each the one that is least like those before it."""
        out = [self.entry]
        nearest = self.x @ self.x[self.entry]
        while len(out) < count:
            out.append(int(nearest.argmin()))
            np.maximum(nearest, self.x @ self.x[out[-1]], out=nearest)
        return np.array(out, dtype=np.int32)

    def _links(self, nodes: np.ndarray, most: int) -> np.ndarray:
        """Flat neighbour arrays of one layer, padded with -1; at most ``most`` links a node."""
        x, n = self.x[nodes], len(nodes)
        near, sims = np.empty((n, min(EF_BUILD, n - 1)), dtype=np.int32), np.empty((n, min(EF_BUILD, n - 1)), dtype=np.float32)
        for at in range(0, n, ROWS):
            part = x[at : at + ROWS] @ x.T
            part[np.arange(len(part)), np.arange(at, at + len(part))] = -np.inf
            if near.shape[1] < n - 1:
                found = np.argpartition(-part, near.shape[1], axis=1)[:, : near.shape[1]]
            else:
                found = np.argsort(-part, axis=1)[:, : near.shape[1]]
            values = np.take_along_axis(part, found, axis=1)
            order = np.argsort(-values, axis=1, kind="stable")
            near[at : at + ROWS], sims[at : at + ROWS] = np.take_along_axis(found, order, axis=1), np.take_along_axis(values, order, axis=1)
        own = [self._choose(x, sims[u], near[u], M) for u in range(n)]
        source = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in own])
        target = np.concatenate(own) if own else np.empty(0, np.int32)
        # Both ends of a link know it; a node with too many chooses anew.
        pairs = np.unique(np.concatenate([source.astype(np.int64) * n + target, target.astype(np.int64) * n + source]))
        starts = np.searchsorted(pairs, np.arange(n + 1, dtype=np.int64) * n)
        out = np.full((n, most), -1, dtype=np.int32)
        for u in range(n):
            links = (pairs[starts[u] : starts[u + 1]] - u * n).astype(np.int32)
            if len(links) > most:
                close = x[links] @ x[u]
                order = np.argsort(-close, kind="stable")
                links = self._choose(x, close[order], links[order], most)
            out[u, : len(links)] = nodes[links]
        return out

    @staticmethod
    def _choose(x: np.ndarray, sims: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours, nearest first, those that no chosen one is nearer to; then the nearest of the rest."""
        if len(near) <= most:
            return near
        between = x[near] @ x[near].T
        closest = np.full(len(near), -np.inf, dtype=np.float32)  # to any chosen one
        chosen = np.zeros(len(near), dtype=bool)
        open_ = np.ones(len(near), dtype=bool)
        for _ in range(most):
            i = int(open_.argmax())
            if not open_[i]:
                break
            chosen[i] = True
            np.maximum(closest, between[i], out=closest)
            open_ &= closest < sims
            open_[: i + 1] = False
        short = most - int(chosen.sum())
        if short > 0:
            chosen[np.flatnonzero(~chosen)[:short]] = True
        return near[chosen]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nodes nearest to ``q`` that a walk from ``start`` finds, as (similarity, node)."""
        self.turn += 1
        stamp, turn, x = self.stamp, self.turn, self.x
        row, links, count = self.row[layer], self.layers[layer][1], self.count[layer]
        found = list(start)
        heapq.heapify(found)
        todo = [(-s, u) for s, u in start]
        heapq.heapify(todo)
        for _, u in start:
            stamp[u] = turn
        while todo:
            s, u = heapq.heappop(todo)
            if -s < found[0][0] and len(found) >= ef:
                break
            r = row[u]
            near = links[r, : count[r]]
            near = near[stamp[near] != turn]
            if not len(near):
                continue
            stamp[near] = turn
            sims = x[near] @ q
            if len(found) >= ef:
                hit = sims > found[0][0]
                near, sims = near[hit], sims[hit]
            for s, v in zip(sims.tolist(), near.tolist(), strict=True):
                if len(found) < ef:
                    heapq.heappush(found, (s, v))
                    heapq.heappush(todo, (-s, v))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, v))
                    heapq.heappush(todo, (-s, v))
        return found

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        q = q.astype(np.float32)
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            if len(self.layers[layer][0]) > 1:
                at = self._search(q, at, EF_DESCENT, layer)
        known = {v for _, v in at}
        seeds = heapq.nlargest(EF_DESCENT, zip((self.x[self.seeds] @ q).tolist(), self.seeds.tolist(), strict=True))
        at = at + [p for p in seeds if p[1] not in known]
        return np.array([v for _, v in self._search(q, at, ef, 0)], dtype=np.int64)


def _same_norm(x: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)
    scale = np.sqrt(squares.max())
    more = np.sqrt(np.maximum(0.0, 1 - squares / scale**2))
    return np.hstack([x / scale, more[:, None]]).astype(np.float32)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's rows to one row of flat arrays."""
    ids = pdf["vec_id"].to_numpy(dtype=np.int64)
    x = np.array(pdf["v"].tolist(), dtype=np.float64)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    nodes, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by_node = np.argsort(inverse, kind="stable")  # ids stay ascending within a node
    starts = np.searchsorted(inverse[by_node], np.arange(len(nodes) + 1))
    graph = Graph(_same_norm(nodes))
    return pd.DataFrame(
        {
            "dim": [int(pdf["dim"].iloc[0])],
            "shard": [int(pdf["shard"].iloc[0])],
            "entry": [graph.entry],
            "vectors": [nodes.tobytes()],
            "ids": [ids[by_node].tobytes()],
            "starts": [starts.astype(np.int64).tobytes()],
            "nodes": [[n.tobytes() for n, _ in graph.layers]],
            "links": [[links.tobytes() for _, links in graph.layers]],
            "seeds": [graph.seeds.tobytes()],
        }
    )


_INDEX = "dim int, shard long, entry int, vectors binary, ids binary, starts binary, nodes array<binary>, links array<binary>, seeds binary"


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(finite & F.exists("v", lambda e: e != 0))
        .withColumn("dim", F.size("v"))
    )


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS) -> tuple[DataFrame, int]:
    """The table of shard indexes, and the number of shards."""
    rows = valid(vectors).dropDuplicates(["vec_id", "v"])
    n = valid(vectors).count()
    shards = max(min_shards, -(-n // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).repartition(2 * shards, "dim", "shard")
    return cut(dealt.groupBy("dim", "shard").applyInPandas(_index, _INDEX)), shards


class _Shard:
    """One shard's index, read back from its flat arrays."""

    def __init__(self, at: dict) -> None:
        self.x = np.frombuffer(at["vectors"], dtype=np.float64).reshape(-1, at["dim"])
        self.ids, self.starts = np.frombuffer(at["ids"], dtype=np.int64), np.frombuffer(at["starts"], dtype=np.int64)
        layers = []
        for nodes, links in zip(at["nodes"], at["links"], strict=True):
            own = np.frombuffer(nodes, dtype=np.int32)
            layers.append((own, np.frombuffer(links, dtype=np.int32).reshape(len(own), -1)))
        self.graph = Graph(_same_norm(self.x), layers, at["entry"], np.frombuffer(at["seeds"], dtype=np.int32))

    def nearest(self, query: int, v: list[float], k: int, ef: int) -> list[tuple[float, int]]:
        """(score, vec_id) of the ``k`` nearest rows found, but the query's own, nearest first."""
        q = np.asarray(v, dtype=np.float64)
        near = self.graph.nearest(np.append(q / np.linalg.norm(q), 0.0), max(ef, k + 1))
        scores = self.x[near] @ q
        best: list[tuple[float, int]] = []
        for s, u in sorted(zip((-scores).tolist(), near.tolist(), strict=True)):
            if len(best) > k and -s < best[k][0]:
                break
            ids = self.ids[self.starts[u] : min(self.starts[u + 1], self.starts[u] + k + 2)]
            best += [(-s, i) for i in ids.tolist() if i != query]
        return sorted(best, key=lambda p: (-p[0], p[1]))[:k]


def _searcher(k: int, ef: int):
    """Answers from rows sorted by shard and block, each index before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key = None, None
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            cells = zip(*(b.column(c).to_pylist() for c in ("dim", "shard", "block", "kind", "vec_id")), strict=True)
            for row, (dim, number, block, kind, query) in enumerate(cells):
                if kind == 0:
                    shard, key = _Shard(b.column("index")[row].as_py() | {"dim": dim}), (dim, number, block)
                elif key == (dim, number, block):
                    for s, i in shard.nearest(query, b.column("v")[row].as_py(), k, ef):
                        out[0].append(query)
                        out[1].append(i)
                        out[2].append(s)
            types = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, **sharding: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row of ``queries``, but itself."""
    index, shards = build(vectors, **sharding)
    asked = cut(valid(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    blocks = max(1, -(-shuffle_width(vectors.sparkSession) // shards))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    flat = F.struct("entry", "vectors", "ids", "starts", "nodes", "links", "seeds").alias("index")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "dim", "shard", "block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), flat
    )
    right = asked.select(
        "dim", F.explode(numbers).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"),
        "vec_id", "v", F.lit(None).cast(left.schema["index"].dataType).alias("index"),
    )
    cells = left.unionByName(right).repartition(2 * shards * blocks, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")
    found = cells.mapInArrow(_searcher(k, ef), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
