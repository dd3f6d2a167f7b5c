"""Exact top-k by inner product over a pivot-distance index.

With M the largest norm, a vector x becomes x' = (x, sqrt(M^2 - |x|^2)) and a query q' = (q, 0); then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the smallest distances of a metric and the
triangle inequality bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, tidy
from .vectors import PACK, best, column_of, in_runs, matrix

#: Bounds of the index: pivots, annuli of a pivot, vectors aimed at for a block, and vectors scored at a time.
PIVOTS, RINGS, BLOCK, STEP = 128, 8, 2048, 256
#: Products are at most the largest squared norm, which must lie below this to fit a long; components then fit 32 bits.
LARGEST = 1 << 62
#: Distances are differences of squares in double precision: bounds allow for such a share of the squared norms.
SLACK = 1e-6
#: A score to beat that any score beats.
LEAST = -(1 << 63)
SALTS = 1 << 32


def quantized(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """Each component x becomes floor(factor * x), as double."""
    return vectors.select("id", F.transform("v", lambda x: F.floor(x * factor).cast("double")).alias("v"))


class Geometry:
    """Pivots and the lifted metric; its size is bounded by PIVOTS."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top
        self.norms = (pivots**2).sum(axis=1)
        self.lifts = np.sqrt(np.maximum(top - self.norms, 0))

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        norms = (x**2).sum(axis=1)
        lifts = np.sqrt(np.maximum(self.top - norms, 0)) if lifted else np.zeros(len(x))
        flat = norms[:, None] + self.norms - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(flat + (lifts[:, None] - self.lifts) ** 2, 0))


def spread_pivots(sample: np.ndarray, count: int, top: float) -> np.ndarray:
    """Farthest-first choice from a bounded sample."""
    sample = np.unique(sample, axis=0)
    chosen = [0]
    far = Geometry(sample[:1], top).distances(sample, True)[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, Geometry(sample[chosen[-1:]], top).distances(sample, True)[:, 0])
    return sample[chosen]


def keyed(geometry: Geometry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), geometry.pivots.shape[1])
            far = geometry.distances(x, True)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "pivot": pa.array(near.astype(np.int32)),
                    "far": pa.array(far[np.arange(len(x)), near]),
                    "body": pa.array([row.tobytes() for row in x.astype(np.int32)], pa.binary()),
                }
            )

    return run


def as_block(key: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block: its vectors in order of their distance to the pivot."""
    far, ids = np.asarray(column_of(rows, 1)), np.asarray(column_of(rows, 2))
    body = np.frombuffer(b"".join(column_of(rows, 3).to_pylist()), np.int32).reshape(len(ids), -1)
    order = np.lexsort((ids, far))
    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "kind": pa.array([0], pa.int32()), "ids": [ids[order].tobytes()], "body": [body[order].tobytes()], "extra": [far[order].tobytes()]})


class Cells:
    """The annuli (pivot, ring) with their bounds and numbers of blocks; at most PIVOTS * RINGS rows."""

    def __init__(self, rows):
        self.key = np.array([r["cell"] for r in rows], np.int64)
        self.low, self.high = np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
        self.salts = np.array([-(-r["n"] // BLOCK) for r in rows])

    def gaps(self, far: np.ndarray) -> np.ndarray:
        """Least |distance of the query - distance of a vector| to each cell's pivot: a bound on their distance."""
        d = far[:, self.key // RINGS]
        return np.maximum(np.maximum(self.low - d, d - self.high), 0)


def query_rows(geometry: Geometry, cells: Cells, probe: bool):
    """Packs of queries for blocks: (key, 1, ids, body, extra: score to beat and distance to the block's pivot).

    A probe goes to one block of the cell with the least bound.  Otherwise a query goes to every block whose
    bound admits a score as high as the one to beat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), geometry.pivots.shape[1])
            beat = np.full(len(ids), LEAST, np.int64) if probe else batch.column(2).fill_null(LEAST).to_numpy()
            far, norms = geometry.distances(x, False), (x**2).sum(axis=1)
            body = x.astype(np.int32)
            if len(ids) and len(cells.key):
                gaps = cells.gaps(far)
                if probe:
                    goes = np.zeros(gaps.shape, bool)
                    goes[np.arange(len(ids)), gaps.argmin(axis=1)] = True
                else:
                    goes = highest(norms, geometry.top, gaps) >= beat[:, None]
                out = []
                for c in np.flatnonzero(goes.any(axis=0)):
                    who = np.flatnonzero(goes[:, c])
                    salts = ids[who] % cells.salts[c] if probe else None
                    for salt in range(cells.salts[c]):
                        mine = who[salts == salt] if probe else who
                        for at in range(0, len(mine), PACK):
                            w = mine[at : at + PACK]
                            out.append((int(cells.key[c]) * SALTS + salt, 1, ids[w].tobytes(), body[w].tobytes(), beat[w].tobytes() + far[w, cells.key[c] // RINGS].tobytes()))
                for at in range(0, len(out), 500):
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out[at : at + 500], strict=True), kinds, strict=True)], names=["key", "kind", "ids", "body", "extra"])

    return run


def highest(norms: np.ndarray, top: float, gaps: np.ndarray) -> np.ndarray:
    """The highest product that a vector can have with a query of ``norms`` if their distance is at least a gap."""
    return (norms[:, None] + top - gaps**2) / 2 + 1 + SLACK * (norms[:, None] + top)


def scored(top: float, k: int):
    """Rows sorted by (key, kind): a block, then the packs that search it.

    A pack expands the block's annuli from those nearest to its queries' distances.  Before each step the
    queries whose bound for the annulus is below their score to beat drop out of it.
    """

    def search(block, pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, x, far = block
        qids, q, beat, d = pack
        none = np.asarray(-np.inf).astype(q.dtype) if q.dtype.kind == "f" else np.int64(LEAST)
        norms = (q.astype(np.float64) ** 2).sum(axis=1)
        starts = np.arange(0, len(ids), STEP)
        low, high = far[starts], far[np.minimum(starts + STEP, len(ids)) - 1]
        gaps = np.maximum(np.maximum(low - d[:, None], d[:, None] - high), 0)
        bound = highest(norms, top, gaps)
        found_q, found_v, found_s = [], [], []
        kept = np.full((len(q), k), none)
        for step in np.argsort(gaps.mean(axis=0), kind="stable"):
            who = np.flatnonzero(bound[:, step] >= beat)
            if not len(who):
                continue
            a, b = starts[step], min(starts[step] + STEP, len(ids))
            scores = q[who] @ x[a:b].T
            scores[qids[who][:, None] == ids[a:b]] = none
            rows, columns = np.nonzero((scores >= beat[who][:, None]) & (scores > none))
            found_q.append(who[rows]), found_v.append(ids[a:b][columns]), found_s.append(scores[rows, columns])
            merged = np.concatenate([kept[who], scores], axis=1)
            kept[who] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            beat[who] = np.maximum(beat[who], kept[who].min(axis=1))
        if not found_q:
            return (np.zeros(0, np.int64),) * 3
        who, vec, score = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
        order = np.lexsort((-vec, score, -who))[::-1]
        who, vec, score = who[order], vec[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < k
        return qids[who[keep]], vec[keep], score[keep].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        # Products and norms are at most ``top``: within 2**53 doubles hold them exactly, beyond it integers do.
        kind = np.float64 if top < 1 << 53 else np.int64
        for batch in batches:
            found = []
            for key, is_pack, ids, body, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(body, np.int32).reshape(len(ids), -1).astype(kind)
                if not is_pack:
                    block, at = (ids, x, np.frombuffer(extra, np.float64)), key
                elif key == at:
                    beat, far = np.frombuffer(extra, np.int64, len(ids)).astype(kind), np.frombuffer(extra, np.float64, len(ids), 8 * len(ids))
                    found.append(search(block, (ids, x, beat, far)))
            if found:
                q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array(s)})

    return run


RESULT = "query_id long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query (id, v) among ``vectors`` (id, v) with another id.

    Returns (query_id, rank, vec_id, score): all candidates if there are fewer, ties to the smaller vec_id.

    1. Pivots come farthest-first from a sample of 8 * PIVOTS vectors; each vector is keyed by its nearest
       pivot and its distance.  Annuli are quantiles of a pivot's distances; one with many vectors, be it
       copies of a single one, is dealt out to blocks of about BLOCK by a hash of the id.
    2. Each query first searches one block, which gives a score to beat.
    3. It then goes to the blocks that the triangle inequality doesn't exclude, in packs; no pair of vectors
       is ever a row.

    Only pivots and annuli's bounds (at most PIVOTS * RINGS rows) come to the driver.  Vectors of unequal
    length are compared as if zeros followed.  Every row is a candidate of its own, also where ids repeat (such an id may
    be answered more than once); of queries with one id the least vector asks.  Components are integers; a squared norm of
    LARGEST or more, with which products may not fit a long, is an error.  Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    size = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not size[0]:
        return best(spark.createDataFrame([], RESULT), k)
    n, width, top = size
    if top >= LARGEST:
        raise ValueError(f"a squared norm of {top:.3g}: integer inner products may not fit a long")
    sample = vectors.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(8 * PIVOTS).select("v").collect()
    padded = np.array([list(r[0]) + [0.0] * (width - len(r[0])) for r in sample])
    geometry = Geometry(spread_pivots(padded, min(PIVOTS, max(1, n // (RINGS * BLOCK // 4))), top), top)
    keys = materialize(vectors.mapInArrow(tidy(keyed(geometry)), "id long, pivot int, far double, body binary"), "keyed")

    inner = [i / RINGS for i in range(1, RINGS)]
    edges = F.broadcast(keys.groupBy("pivot").agg(F.percentile_approx("far", F.array(*map(F.lit, inner)), F.lit(10_000)).alias("edges")))  # at most PIVOTS rows
    ringed = keys.join(edges, "pivot").select("id", "far", "body", (F.col("pivot").cast("long") * RINGS + F.size(F.filter("edges", lambda e: e < F.col("far")))).alias("cell"))
    counts = ringed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    cells = Cells(sorted(counts.collect(), key=lambda r: r["cell"]))
    salts = F.broadcast(counts.select("cell", F.ceil(F.col("n") / BLOCK).alias("salts")))
    placed = ringed.join(salts, "cell").select((F.col("cell") * SALTS + F.pmod(F.xxhash64("id"), "salts")).alias("key"), "far", "id", "body")
    parts = max(8, min(20_000, n // (4 * BLOCK)))
    kinds = "key long, kind int, ids binary, body binary, extra binary"
    blocks = materialize(placed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(in_runs(as_block)), kinds), "blocks")

    asked = materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")

    def found(packs: DataFrame) -> DataFrame:
        both = blocks.unionByName(packs).repartition(parts, "key").sortWithinPartitions("key", "kind")
        return both.mapInArrow(tidy(scored(float(top), k)), RESULT)

    first = found(asked.select("id", "v").mapInArrow(tidy(query_rows(geometry, cells, True)), kinds))
    beat = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("beat"))
    known = asked.join(beat, "id", "left").select("id", "v", "beat")
    return best(found(known.mapInArrow(tidy(query_rows(geometry, cells, False)), kinds)), k)
