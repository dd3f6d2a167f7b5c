"""Token ids as directly addressable codes.

A file image holds many documents.  Ids are split into 8-bit chunks; level l stores chunk l of the ids
that are that long, and a bitmap that says which of them go on.  A rank directory counts the set bits
before each 512-bit block, so any id is read by one look-up in each of its levels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path
from .tokens import Encoder, encoder

MAGIC = b"TMDAC001"
CHUNK_BITS, BLOCK_BITS = 8, 512
#: Ids of one file image, and bytes of text for a partition of the sorted input.
SHARD_TOKENS, PARTITION_BYTES = 1 << 20, 24 << 20
HEAD = struct.Struct("<8sQQI")
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def write_codes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file image of documents with ``counts`` ids each."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(ONES[bits].reshape(-1, BLOCK_BITS // 8).sum(axis=1))]).astype("<u4")
        parts += [struct.pack("<QQQ", len(rest), len(bits), len(ranks)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    lead = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(parts) // 4)
    return b"".join([lead, known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), starts.tobytes(), *parts])


class Codes:
    """Random access to a file image."""

    def __init__(self, image: bytes):
        magic, n_docs, self.n_tokens, n_levels = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-code image")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        known, doc_ids = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [int(x) if k else None for k, x in zip(known, doc_ids, strict=True)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", image, at)
            at += 24
            self.levels.append((take("u1", n), take("u1", n_bits), take("<u4", n_ranks)))

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at // BLOCK_BITS
        out = ranks[block].astype(np.int64)
        byte = at // 8
        for step in range(BLOCK_BITS // 8):
            inside = block * (BLOCK_BITS // 8) + step
            use = inside < byte
            if not use.any():
                break
            out[use] += ONES[bits[inside[use]]]
        part = at % 8 > 0
        out[part] += ONES[bits[byte[part]] & ((1 << (at[part] % 8)) - 1)]
        return out

    @staticmethod
    def rank_one(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Set bits before one position."""
        block, byte = at // BLOCK_BITS, at // 8
        out = int(ranks[block]) + int(ONES[bits[block * (BLOCK_BITS // 8) : byte]].sum())
        return out + (int(ONES[bits[byte] & ((1 << (at % 8)) - 1)]) if at % 8 else 0)

    def access(self, positions) -> np.ndarray:
        """The ids at any positions, without decoding others."""
        at = np.asarray(positions, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = (bits[at // 8] >> (at % 8)) & 1 > 0
            at, live = self.rank(bits, ranks, at[more]), live[more]
            if not len(at):
                break
        return out

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids in [start, end): one slice of every level."""
        slices, a, b = [], start, end
        for chunks, bits, ranks in self.levels:
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            slices.append((chunks[a:b].astype(np.uint32), more))
            a = self.rank_one(bits, ranks, a)
            b = a + int(more.sum())
        out = np.zeros(0, np.uint32)
        for chunks, more in reversed(slices):
            if len(out):
                chunks[more] |= out << np.uint32(CHUNK_BITS)
            out = chunks
        return out

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.starts[i]), int(self.starts[i + 1]))


def encoded(encode: Encoder, texts, end: int, at_once: int = 256) -> Iterator[np.ndarray]:
    """The ids of an Arrow column of texts, some at a time."""
    for at in range(0, len(texts), at_once):
        yield from encode.ids_of(texts.slice(at, at_once).to_pylist(), end)


def encode_sorted(path: str, end: int):
    """Rows in order to file images; ``start`` counts the ids before the image in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, start, ids, arrays, size = encoder(path), TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            image = write_codes(ids, np.array([len(x) for x in arrays]), np.concatenate(arrays))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "start": pa.array([start], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded(encode, batch.column(1), end), strict=True):
                ids.append(doc_id), arrays.append(found)
                size += len(found)
                if size >= SHARD_TOKENS:
                    yield flush()
                    seq, start, ids, arrays, size = seq + 1, start + size, [], [], 0
        if ids:
            yield flush()

    return run


def write_token_files(df: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, add ``end_id``, and write file images in ascending id order to the folder ``out``.

    Each row of ``out`` (a Parquet container) is one image, in the order of (part, seq).  A null text is
    empty; null ids come first; rows of one id are ordered by their texts; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(20_000, max(8, size // PARTITION_BYTES))
    ordered = docs.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode_sorted(tokenizer, end_id), "part long, seq long, start long, n_tokens long, image binary").write.option("compression", "zstd").parquet(out)


def decode_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = Codes(image.as_py())
            found = [codes.document(i) for i in range(len(codes.doc_ids))]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(codes.doc_ids, pa.int64()),
                    "start": pa.array(codes.starts[:-1] + start),
                    "n_tokens": pa.array(np.diff(codes.starts)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                }
            )


def read_token_files(spark, out: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Only the token count of each input partition (at most 20,000) comes to the driver and goes back.
    """
    images = spark.read.schema("part long, seq long, start long, n_tokens long, image binary").parquet(out)
    before, total = [], 0
    for part, n in sorted(images.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    return images.join(offsets, "part").select((F.col("start") + F.col("before")).alias("start"), "image").mapInArrow(decode_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``df`` to the shared folder and read them back."""
    out = new_path(df.sparkSession, "token-codes")
    write_token_files(df, out, tokenizer, end_id)
    return read_token_files(df.sparkSession, out)
