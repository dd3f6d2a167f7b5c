"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_key, tidy
from .words import BASE_WORD, arrow_bytes, mix64, slices, words

SCAN = 1 << 20
#: Byte classes of the statistics: upper case, lower case, digits, spaces, line ends, stops, calls, other signs, beyond ASCII.
CLASSES = 9
FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "upper", "digits", "stops", "calls", "signs", "beyond_ascii",
    "distinct_words", "commonest_word", "distinct_triples", "log_lines", "distinct_lines", "line_words", "signed_words",
)


def byte_classes() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    out[[0x20, 0x09]], out[[0x0A, 0x0B, 0x0C, 0x0D]] = 3, 4
    out[[ord(c) for c in ".,;:'-()\""]], out[[ord(c) for c in "!?"]] = 5, 6
    out[128:] = 8
    return out


OF_BYTE = byte_classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; a text without words has the statistics of nothing (zeros)."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = OF_BYTE[data]
    counts = np.bincount(of * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    hashes, starts, ends, first = words(data, offsets, True)
    per = np.diff(first).astype(np.float64)
    word_of = np.repeat(np.arange(n), np.diff(first))
    lengths = (ends - starts).astype(np.float64)
    some = np.maximum(per, 1)
    mean = np.bincount(word_of, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(word_of, lengths**2, n) / some - mean**2, 0))
    long = np.bincount(word_of, lengths > 14, n) / some
    total = np.concatenate([[0], np.cumsum((kinds == 7) | (kinds == 6))])
    signed = np.bincount(word_of, total[ends] > total[starts], n) / some
    triples = mix64((hashes[:-2] * BASE_WORD + hashes[1:-1]) * BASE_WORD + hashes[2:]) if len(hashes) > 2 else hashes[:0]
    raw = data.tobytes()
    distinct, commonest, fresh, lines, own_lines = np.zeros((5, n))
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        seen, times = np.unique(hashes[a:b], return_counts=True)
        distinct[i], commonest[i] = len(seen), times.max()
        fresh[i] = len(np.unique(triples[a : b - 2])) / (b - a - 2) if b - a > 2 else 1
        split = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x]
        lines[i], own_lines[i] = len(split), len(set(split)) / max(len(split), 1)
    chars = np.maximum(counts.sum(axis=1), 1)
    root = np.sqrt(counts / chars[:, None])
    return np.stack(
        [
            np.log1p(per), np.log1p(mean), np.log1p(spread), np.sqrt(long), root[:, 0], root[:, 2], root[:, 5], root[:, 6], root[:, 7], root[:, 8],
            np.log((distinct + 1) / (per + 1)), np.sqrt(commonest / some), fresh, np.log1p(lines), own_lines, np.log1p(per / np.maximum(lines, 1)), np.sqrt(signed),
        ],
        axis=1,
    )


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(1))
        for a, b in slices(offsets, SCAN):
            stats = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            values = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(FEATURES), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), values], names=["doc_id", "text_key", "stats"])


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: rows, sums and sums of products, as one array for each batch."""
    for batch in batches:
        x = np.asarray(batch.column(0).flatten()).reshape(-1, len(FEATURES))
        y = batch.column(1).to_numpy()
        for label in (0, 1):
            z = x[y == label]
            if len(z):
                flat = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
                yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "flat": pa.array([flat.tolist()])})


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors of the inverse-free covariances, and log prior odds; ``heat`` flattens the odds."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    heat: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the difference of the two log densities through the cached factors."""
        z = np.clip((x - self.center) / self.scale, -8, 8)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            solved = np.linalg.solve(factor, (z - mean).T)
            logs.append(constant - 0.5 * (solved**2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(-(logs[1] - logs[0]) / self.heat, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = 0.3, ridge: float = 0.05, heat: float = 3.0) -> Discriminant | None:
    """Fit from all rows of ``stats`` (doc_id, stats) that ``labels`` (doc_id, label) marks 0 or 1, and not both.

    Each covariance is (1 - pooled) of its class and pooled of both, then shrunk by ``ridge`` towards its mean
    variance.  Only the classes' moments, of a fixed size, come to the driver.  None without any labelled row.
    """
    d = len(FEATURES)
    single = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    known = stats.join(single, "doc_id").select("stats", F.col("label").cast("int").alias("label"))
    sums = known.mapInArrow(tidy(moments), "label int, flat array<double>").selectExpr("label", "posexplode(flat) as (i, v)").groupBy("label", "i").agg(F.sum("v"))
    found = np.zeros((2, 1 + d + d * d))
    for label, i, v in sums.collect():
        found[label, i] = v
    n = found[:, 0]
    if not n.sum():
        return None
    total = found.sum(axis=0)
    center = total[1 : d + 1] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(total[d + 1 :].reshape(d, d)) / n.sum() - center**2, 1e-12)) + 1e-6
    means, scatters = [], []
    for row in found:
        m = row[1 : d + 1] / max(row[0], 1) if row[0] else center
        s = row[d + 1 :].reshape(d, d) - row[0] * np.outer(m, m)
        means.append((m - center) / scale)
        scatters.append(s / np.outer(scale, scale))
    both = sum(scatters) / max(n.sum() - 2, 1)
    factors, constants = [], []
    for k, s in enumerate(scatters):
        cov = (1 - pooled) * (s / max(n[k] - 1, 1) if n[k] > 1 else both) + pooled * both
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factors.append(np.linalg.cholesky(cov))
        constants.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factors[-1])).sum())
    return Discriminant(center, scale, np.array(means), np.array(factors), np.array(constants), heat)


def scorer(model: Discriminant | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, len(FEATURES))
            score = model.score(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "text_key", "score"])

    return run


def held_out(column: str = "doc_id"):
    """The fold that never trains: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score in 0..1 (higher: label 1 likelier), predicted (score >= threshold), text_key.

    Trains on all rows of ``labels`` outside the held-out fold whose label is 0 or 1.  Only the text is an input
    of a score.  A null text is empty and is scored as such; a null id is never held out and never trains;
    repeated ids are scored row by row; other columns are ignored.  Without labelled rows every score is 0.5.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_key(text_col).alias("text_key"))
    stats = materialize(docs.mapInArrow(tidy(measure), "doc_id long, text_key long, stats array<double>"), "statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    model = fit(stats, marks.where(~held_out()))
    scored = stats.mapInArrow(tidy(scorer(model)), "doc_id long, text_key long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_key")
