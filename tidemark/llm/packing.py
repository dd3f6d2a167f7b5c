"""Lexical retrieval packing: a BM25 index of each shard gives a seed's unused neighbours, which fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_codes import encoded
from .tokens import encoder

#: Documents and ids of one shard's index.
SHARD_DOCS, SHARD_TOKENS = 4096, 4 << 20
#: Terms that ask for a seed: those that weigh most in it, of terms in at most such a share of the documents or so many of them.
QUERY_TERMS, COMMON, LEAST_COMMON = 64, 1 / 8, 16
#: Neighbours that are sorted before all others.
FEW = 24
#: The usual constants of BM25.
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index over documents given as arrays of term ids."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = n = len(docs)
        lengths = np.array([len(x) for x in docs], np.int64)
        # (term, document) as one number, sorted: the postings of each term in order of documents.
        flat = np.concatenate(docs).astype(np.int64) * n
        flat += np.repeat(np.arange(n), lengths)
        flat.sort()
        head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        tf = np.diff(np.append(head, len(flat)))
        flat = flat[head]
        term, self.docs = np.divmod(flat, n)
        self.at = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64), len(term))
        df = np.diff(self.at)
        damp = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        self.weights = np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)), df) * tf * (K1 + 1) / (tf + damp[self.docs])
        # The same postings by document, as places; the heaviest terms of each come first.
        row = np.repeat(np.arange(len(df)), df)
        rare = np.flatnonzero(df[row] <= max(LEAST_COMMON, n * COMMON))
        order = rare[np.lexsort((row[rare], -self.weights[rare], self.docs[rare]))]
        self.asks, self.first = row[order], np.searchsorted(self.docs[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for the seed's QUERY_TERMS heaviest terms."""
        rows = self.asks[self.first[seed] : min(self.first[seed + 1], self.first[seed] + QUERY_TERMS)]
        first, count = self.at[rows], self.at[rows + 1] - self.at[rows]
        take = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
        return np.bincount(self.docs[take], self.weights[take], self.n)

    def unused(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Documents that ``used`` does not mark, by descending score; ties by place.  Few are sorted at first."""
        scores = self.scores(seed)
        scores[used] = -1
        last = np.partition(scores, -FEW)[-FEW] if self.n > FEW else np.inf
        for bound in (scores > last, (scores <= last) & ~used):
            some = np.flatnonzero(bound)
            yield from some[np.argsort(-scores[some], kind="stable")].tolist()


def pack(docs: list[np.ndarray], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, n) with every id in one piece.

    A seed's window takes the seed's ids and then its best unused neighbours; the last of them is cut and
    its rest seeds the next window.  Only the shard's last window may be short: it is dealt out to
    sequences whose lengths are powers of two, which need no padding.
    """
    index, used, out = None, np.zeros(len(docs), bool), []
    seed = (0, 0) if docs else None
    window: list[tuple[int, int, int]] = []
    while seed is not None:
        doc, at = seed
        used[doc] = True
        left = len(docs[doc]) - at
        while left >= length:
            out.append([(doc, at, length)])
            at, left = at + length, left - length
        seed, room = None, length - left
        window = [(doc, at, left)] if left else []
        if left and not used.all():
            index = index or Bm25(docs)
            for other in index.unused(doc, used):
                used[other] = True
                n = min(room, len(docs[other]))
                window.append((other, 0, n))
                room -= n
                if not room:
                    if n < len(docs[other]):
                        seed = (other, n)
                    break
        if window and not room:
            out.append(window)
            window = []
        if seed is None and not used.all():
            seed = (int(np.argmin(used)), 0)
    rest = sum(n for _, _, n in window)
    for bit in range(length.bit_length(), -1, -1):
        if rest >> bit & 1:
            need, part = 1 << bit, []
            while need:
                doc, at, n = window.pop(0)
                part.append((doc, at, min(n, need)))
                if n > need:
                    window.insert(0, (doc, at + need, n - need))
                need -= part[-1][2]
            out.append(part)
    return out


def packed_rows(tokenizer: str, end: int, length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 40
        ids: list = []
        docs: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, size
            rows = []
            for pieces in pack(docs, length):
                offset = 0
                for doc, at, n in pieces:
                    raw = docs[doc][at : at + n].astype("<u4").tobytes()
                    rows.append((ids[doc], at, n, zlib.crc32(raw), len(docs[doc]), sequence, offset, raw if keep_ids else None))
                    offset += n
                sequence += 1
            ids.clear(), docs.clear()
            size = 0
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded(encode, batch.column(1), end), strict=True):
                ids.append(doc_id), docs.append(found)
                size += len(docs[-1])
                if len(docs) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Cut and pack the ids of all texts (each with ``end_id`` after it) into sequences of at most ``length`` ids.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``
    (ids: little-endian unsigned 32-bit, null unless ``keep_ids``).  Sequences are full, or a power of two
    long; nothing is shuffled, because each shard is a run of rows of one input partition.

    A null text is empty and still has its end id.  Every row counts as a document of its own, also where ids
    repeat or are null.  Other columns are ignored.  An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.mapInArrow(packed_rows(tokenizer, end_id, length, keep_ids), kinds)
