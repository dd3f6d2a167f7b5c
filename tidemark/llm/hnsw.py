"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, tidy
from .vectors import PACK, best, column_of, in_runs, matrix, own_tasks
from .words import mix64

#: Links of a node on upper layers (twice as many on the lowest), beam widths, nodes of a shard.
LINKS, BUILD_BEAM, SEARCH_BEAM, SHARD = 16, 80, 120, 8192
BATCH = 256


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries in step: (nodes, products), each row by descending product.

    A row has -1 and -inf behind the nodes that it reached.
    """
    n = len(q)
    rows = np.arange(n)
    seen = np.zeros((n, len(x)), bool)
    nodes = np.full((n, beam), -1)
    scores = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    nodes[:, 0], scores[:, 0], open_[:, 0] = entry, np.einsum("nd,nd->n", q, x[entry]), True
    seen[rows, entry] = True
    live = rows
    while len(live):
        pick = open_[live].argmax(axis=1)
        has = open_[live, pick]
        live, pick = live[has], pick[has]
        if not len(live):
            break
        open_[live, pick] = False
        near = links[nodes[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        gained = np.full(near.shape, -np.inf, np.float32)
        gained[row, col] = np.einsum("nd,nd->n", q[live[row]], x[near[row, col]])
        all_scores = np.concatenate([scores[live], gained], axis=1)
        order = np.argsort(-all_scores, axis=1, kind="stable")[:, :beam]
        scores[live] = np.take_along_axis(all_scores, order, axis=1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(fresh, near, -1)], axis=1), order, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), order, axis=1)
    return nodes, scores


def diverse(x: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Candidates by descending product, without those that are nearer to one already taken; filled up with the rest."""
    close = x[candidates] @ x[candidates].T
    taken: list[int] = []
    for i in range(len(candidates)):
        if not taken or (close[i, taken] < scores[i]).all():
            taken.append(i)
            if len(taken) == most:
                break
    if len(taken) < most:
        left = [i for i in range(len(candidates)) if i not in set(taken)]
        taken += left[: most - len(taken)]
    return candidates[taken]


class Graph:
    """Distinct vectors of a shard, their ids, and flat neighbour arrays for each layer."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        packed = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, of = np.unique(packed, return_index=True, return_inverse=True)
        # Copies share one node, which lists all of their ids in order.
        order = np.lexsort((ids, of))
        self.ids, self.at = ids[order], np.append(np.searchsorted(of[order], np.arange(len(first))), len(ids))
        self.vectors = vectors[first]
        norms = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.x = np.concatenate([self.vectors, lift[:, None]], axis=1).astype(np.float32)
        n = len(self.x)
        draw = (mix64(np.arange(n, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        self.level[0] = self.level.max()
        self.links = [np.full((n, LINKS * (1 if l else 2)), -1, np.int32) for l in range(self.level[0] + 1)]
        self.build()

    def build(self) -> None:
        x, n, done = self.x, len(self.x), 1
        while done < n:
            to = min(n, done + min(BATCH, done))
            new = np.arange(done, to)
            inside = x[new] @ x[new].T
            entry = np.zeros(len(new), np.int64)
            for layer in range(len(self.links) - 1, -1, -1):
                member = np.flatnonzero(self.level[new] >= layer)
                beam = BUILD_BEAM if len(member) else 1
                nodes, scores = beam_search(x, self.links[layer], x[new], entry, beam)
                for i in member:
                    found = nodes[i] >= 0
                    mates = member[member < i]
                    candidates, s = np.concatenate([nodes[i][found], new[mates]]), np.concatenate([scores[i][found], inside[i, mates]])
                    order = np.argsort(-s, kind="stable")[:BUILD_BEAM]
                    chosen = diverse(x, candidates[order], s[order], LINKS)
                    self.links[layer][new[i], : len(chosen)] = chosen
                self.link_back(layer, new[member])
                entry = nodes[:, 0]
            done = to

    def link_back(self, layer: int, new: np.ndarray) -> None:
        """Reverse links; a full node keeps a diverse choice of its nearest."""
        links = self.links[layer]
        out = links[new]
        target, source = out[out >= 0], np.repeat(new, (out >= 0).sum(axis=1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])), [len(target)]]) if len(target) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            t = target[a]
            old = links[t][links[t] >= 0]
            both = np.unique(np.concatenate([old, source[a:b]]))
            if len(both) > links.shape[1]:
                s = self.x[both] @ self.x[t]
                best_first = np.argsort(-s, kind="stable")
                both = diverse(self.x, both[best_first], s[best_first], links.shape[1])
            links[t, : len(both)] = both
            links[t, len(both) :] = -1

    def dump(self) -> dict[str, bytes]:
        return {"sizes": np.array([*self.vectors.shape, len(self.links)], np.int64).tobytes(), "ids": self.ids.astype(np.int64).tobytes(), "ends": self.at.astype(np.int64).tobytes(), "vectors": self.vectors.astype(np.float64).tobytes(), "links": b"".join(x.tobytes() for x in self.links)}

    @classmethod
    def load(cls, sizes: bytes, ids: bytes, ends: bytes, vectors: bytes, links: bytes) -> Graph:
        self = cls.__new__(cls)
        n, d, layers = np.frombuffer(sizes, np.int64)
        self.ids, self.at = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(n, d)
        self.x = self.vectors.astype(np.float32)  # a query's lift is 0, so that the lifts of nodes don't matter
        flat, at, self.links = np.frombuffer(links, np.int32), 0, []
        for layer in range(layers):
            width = LINKS * (1 if layer else 2)
            self.links.append(flat[at : at + n * width].reshape(n, width))
            at += n * width
        return self

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes for each query, by descending product, -1 behind."""
        low, entry = q.astype(np.float32), np.zeros(len(q), np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = beam_search(self.x, self.links[layer], low, entry, 1)[0][:, 0]
        return beam_search(self.x, self.links[0], low, entry, beam)[0]


INDEX = "shard long, kind int, pack binary, sizes binary, ids binary, ends binary, vectors binary, links binary"


def as_graph(width: int):
    def take(shard: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(column_of(rows, 1))
        order = np.argsort(ids, kind="stable")
        graph = Graph(ids[order], matrix(column_of(rows, 2), width)[order])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "kind": pa.array([0], pa.int32()), "pack": pa.array([None], pa.binary()), **{k: pa.array([v], pa.binary()) for k, v in graph.dump().items()}})

    return take


def as_packs(width: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                body = np.asarray(part.column(0)).astype(np.int64).tobytes() + matrix(part.column(1), width).tobytes()
                for a in range(0, shards, 256):
                    some = np.arange(a, min(shards, a + 256), dtype=np.int64)
                    empty = pa.nulls(len(some), pa.binary())
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(some), "kind": pa.array(np.ones(len(some), np.int32)), "pack": pa.array([body] * len(some), pa.binary()), **{k: empty for k in ("sizes", "ids", "ends", "vectors", "links")}})

    return run


def searched(width: int, k: int, beam: int):
    """Rows by (shard, kind): a graph, then the packs that search it; packs are searched together."""

    def answers(graph: Graph, bodies: list[bytes]) -> pa.RecordBatch:
        per = 8 + 8 * width
        ids = np.concatenate([np.frombuffer(b, np.int64, len(b) // per) for b in bodies])
        q = np.concatenate([np.frombuffer(b, np.float64, len(b) // per * width, len(b) // per * 8).reshape(-1, width) for b in bodies])
        nodes = graph.search(q, beam)
        out_q, out_v, out_s = [], [], []
        for i, row in enumerate(nodes):
            row = row[row >= 0]
            scores = (graph.vectors[row] * q[i]).sum(axis=1)
            order = np.argsort(-scores, kind="stable")
            n, last = 0, np.inf
            for node, score in zip(row[order], scores[order], strict=True):
                if n >= k and score < last:
                    break
                same = graph.ids[graph.at[node] : graph.at[node + 1]]
                same = same[same != ids[i]][:k]
                n, last = n + len(same), score
                out_q += [ids[i]] * len(same)
                out_v += same.tolist()
                out_s += [score] * len(same)
        return pa.RecordBatch.from_pydict({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, held, at = None, [], None
        for batch in batches:
            for shard, kind, pack, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and held:
                    yield answers(graph, held)
                    held = []
                if kind == 0:
                    graph, at = Graph.load(*rest), shard
                elif shard == at:
                    held.append(pack)
                    if len(held) == 8:
                        yield answers(graph, held)
                        held = []
        if held:
            yield answers(graph, held)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """About the k largest inner products of each query (id, v) among ``vectors`` (id, v) with another id.

    Returns (query_id, rank, vec_id, score): score is the inner product of the original vectors in double
    precision, ties go to the smaller vec_id, and all candidates come back if there are no more than k.

    Every vector is in a graph.  A hash of the id deals vectors to shards of about SHARD, so copies of one
    vector spread; inside a shard they share a node that lists all their ids.  A graph's row precedes the
    query packs in its task, and each graph is built once; each task cuts its answers to k a query.  Every row
    is a candidate of its own, also where ids repeat (such an id may be answered more than once); of queries with one
    id the least vector asks.  Vectors of unequal length are compared as if zeros followed.  Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return best(spark.createDataFrame([], "query_id long, vec_id long, score double"), k)
    shards = -(-n // SHARD)
    parts = max(1, min(20_000, shards))
    own = own_tasks(spark, parts)
    task = F.when(F.col("shard") < parts, own).otherwise(F.col("shard"))
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "id", "v").repartition(parts, task).sortWithinPartitions("shard")
    index = materialize(dealt.mapInArrow(tidy(in_runs(as_graph(width))), INDEX), "graphs")
    asked = queries.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(tidy(as_packs(width, shards)), INDEX)
    both = index.unionByName(asked).repartition(parts, task).sortWithinPartitions("shard", "kind")
    return best(both.mapInArrow(tidy(searched(width, k, beam)), "query_id long, vec_id long, score double"), k)
