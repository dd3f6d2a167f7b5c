"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, tidy
from .vectors import in_runs
from .words import BASE_WORD, arrow_bytes, mix64, run_hashes, slices, words

#: Bytes of text that one task reduces at a time, and windows aimed at for a bucket.
LOCAL_BYTES, BUCKET_WINDOWS = 20 << 20, 1_000_000
#: Removals that a task gathers before it sends them to the groups of their documents.
GATHERED = 2_000_000
#: The second polynomial's base (fixed value).
BASE_SECOND = np.uint64(0xA24BAED4963EE407)
SCAN = 1 << 21


def merged(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals (start, end) covered by windows of ``width`` at the sorted ``starts``."""
    if not len(starts):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(starts)]]) - 1
    return np.stack([starts[first], starts[last] + width], axis=1).astype(np.int32)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, 16 more bits, text, start) of every window of ``width`` words inside one text."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = first[text] + start
    one = mix64(run_hashes(hashes, BASE_WORD, at, at + width))
    two = mix64(run_hashes(mix64(hashes ^ BASE_SECOND), BASE_SECOND, at, at + width))
    return one, (two >> np.uint64(48)).astype(np.uint16), text, start.astype(np.int32)


def earliest(one: np.ndarray, two: np.ndarray, ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted entries without repetitions, and which of them start no later than any other of their hash.

    Rows that share an id may start at the same place; neither of them is earlier.
    """
    order = np.lexsort((*([rows] if rows.any() else []), starts, ids, two, one))
    one, two, ids, rows, starts = one[order], two[order], ids[order], rows[order], starts[order]
    head = np.ones(len(one), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    again = np.zeros(len(one), bool)
    again[1:] = ~head[1:] & (ids[1:] == ids[:-1]) & (starts[1:] == starts[:-1]) & (rows[1:] == rows[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    least = (ids == ids[first]) & (starts == starts[first])
    if again.any():
        one, two, ids, rows, starts, least = (x[~again] for x in (one, two, ids, rows, starts, least))
    return one, two, ids, rows, starts, least


def local_windows(width: int, buckets: int, groups: int):
    """Windows of many documents at once.

    Of equal windows only the earliest place here goes on, so that a passage of any number of documents
    sends one entry from each task (one for each text that its id has there); the others certainly start
    later than some window and are removed.
    Kind 0: a bucket's entries (hashes, document, row key, start), packed.  Kind 1: removed windows of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            *entries, least = earliest(*(np.concatenate([x[i] for x in held]) for i in range(5)))
            held.clear()
            yield from removed(*(x[~least] for x in entries[2:]), groups)
            one, two, ids, texts, starts = (x[least] for x in entries)
            bucket = (one % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((starts, texts, ids, bucket))  # by place, which makes the places small once compressed
            bucket, one, two, ids, texts, starts = (x[order] for x in (bucket, one, two, ids, texts, starts))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            for part in np.array_split(some, max(1, len(some) // 64)):
                yield rows(0, part, [packed(*(x[cuts[i] : cuts[i + 1]] for x in (one, two, ids, texts, starts))) for i in part])

        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b in slices(offsets, SCAN):
                hashes, _, _, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], False)
                if len(hashes) < width:
                    continue
                one, two, text, start = windows(hashes, first, width)
                held.append((one, two, ids[a:b][text], texts[a:b][text], start))
                size += offsets[b] - offsets[a]
                if size >= LOCAL_BYTES:
                    yield from flush()
        if held:
            yield from flush()

    return run


def rows(kind: int, keys, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(blobs), kind, np.int32)), "key": pa.array(np.asarray(keys, np.int64)), "body": pa.array(blobs, pa.binary())})


def packed(one: np.ndarray, two: np.ndarray, ids: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> bytes:
    """Entries of one bucket in order of place: 10 bytes of hash each, and compressed steps of ids and starts."""
    head = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])]))
    steps = starts.copy()
    steps[1:] -= starts[:-1]
    steps[head] = starts[head]
    wide = steps >= 255
    short = np.where(wide, 255, steps).astype(np.uint8)
    counts = np.diff(np.concatenate([head, [len(ids)]])).astype(np.int32)
    first = ids[head].astype(np.int64)
    first[1:] -= ids[head][:-1]
    lead = np.array([len(one), len(head), int(wide.sum())], np.int64)
    place = b"".join(x.tobytes() for x in (short, steps[wide].astype(np.int32), first, texts[head].astype(np.int64), counts))
    return b"".join([lead.tobytes(), one.tobytes(), two.tobytes(), np.int64(len(place)).tobytes(), pa.compress(place, "zstd", asbytes=True)])


def unpacked(body: bytes) -> tuple[np.ndarray, ...]:
    n, runs, wide = np.frombuffer(body, np.int64, 3)
    at = 24

    def take(kind, count) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    one, two, size = take(np.uint64, n), take(np.uint16, n), take(np.int64, 1)[0]
    body, at = pa.decompress(body[at:], int(size), "zstd", asbytes=True), 0
    short, far, ids, texts, counts = take(np.uint8, n), take(np.int32, wide), np.cumsum(take(np.int64, runs)), take(np.int64, runs), take(np.int32, runs)
    steps = short.astype(np.int64)
    steps[short == 255] = far
    total = np.cumsum(steps)
    head = np.cumsum(counts) - counts
    base = np.concatenate([[0], total])[head]
    return one, two, np.repeat(ids, counts), np.repeat(texts, counts), (total - np.repeat(base, counts)).astype(np.int32)


def removed(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Removed windows (kind 1), packed for the group of their documents."""
    if not len(ids):
        return
    group = (mix64(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((starts, texts, ids, group))
    group, ids, texts, starts = group[order], ids[order], texts[order], starts[order]
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(ids)]])
    for a in range(0, len(cuts) - 1, 256):
        part = cuts[a : a + 257]
        yield rows(1, group[part[:-1]], [steps(ids[x:y], texts[x:y], starts[x:y]) for x, y in zip(part[:-1], part[1:], strict=True)])


def steps(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> bytes:
    raw = b"".join(np.diff(x, prepend=0).astype(kind).tobytes() for x, kind in ((ids, np.int64), (texts, np.int64), (starts, np.int32)))
    return np.int64(len(ids)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def from_steps(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    raw = pa.decompress(body[8:], 20 * n, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.cumsum(np.frombuffer(raw, np.int64, n, 8 * n)), np.cumsum(np.frombuffer(raw, np.int32, n, 16 * n), dtype=np.int32)


def bucket_removals(groups: int):
    """Rows sorted by bucket: every entry that starts later than the earliest of its hash is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, gathered = None, [], []

        def close() -> None:
            _, _, ids, texts, starts, least = earliest(*(np.concatenate(x) for x in zip(*map(unpacked, held), strict=True)))
            held.clear()
            gathered.append((ids[~least], texts[~least], starts[~least]))

        def flush() -> Iterator[pa.RecordBatch]:
            if gathered:
                yield from removed(*(np.concatenate(x) for x in zip(*gathered, strict=True)), groups)
                gathered.clear()

        for batch in batches:
            for kind, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:  # removals that the first pass was sure of
                    gathered.append(from_steps(body.as_py()))
                else:
                    if held and key != now:
                        close()
                    now = key
                    held.append(body.as_py())
                if sum(len(x) for x, *_ in gathered) >= GATHERED:
                    yield from flush()
        if held:
            close()
        yield from flush()

    return run


def intervals(width: int):
    """Rows sorted by group: the maximal intervals of each text of a group, one row for each text."""

    def take(_: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [from_steps(x.as_py()) for b in batches for x in b.column(1)]
        ids, texts, starts = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((starts, texts, ids))
        ids, texts, starts = ids[order], texts[order], starts[order]
        cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])) + 1, [len(ids)]])
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[cuts[:-1]]), "row": pa.array(texts[cuts[:-1]]), "spans": pa.array([merged(starts[x:y], width).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return in_runs(take)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each document's intervals to its whole text."""
    for batch in batches:
        data, offsets = arrow_bytes(batch.column(1))
        spans = batch.column(2)
        for a, b in slices(offsets, SCAN):
            piece = data[offsets[a] : offsets[b]]
            raw = piece.tobytes()
            _, starts, ends, first = words(piece, offsets[a : b + 1] - offsets[a], False)
            total, gone, kept = [], [], []
            for i in range(a, b):
                lo, hi = first[i - a], first[i - a + 1]
                keep = np.ones(hi - lo, bool)
                for x, y in np.frombuffer(spans[i].as_py() or b"", np.int32).reshape(-1, 2):
                    keep[x:y] = False
                at = np.flatnonzero(keep) + lo
                total.append(int(hi - lo))
                gone.append(int(hi - lo - len(at)))
                kept.append(b" ".join([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_words": pa.array(total, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "kept_text": pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
            )


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Remove every word covered by a window of ``width`` words whose word sequence also starts earlier.

    Earlier means in a document with a smaller id, or in the same document at a smaller place; windows are
    judged on the input.  Returns one row per input row: ``doc_id, n_words, n_removed, kept_text,
    kept_sha256`` (kept words joined by one space; words are runs without space and 0x09-0x0D).

    Rows with the same id and text start at the same places, so none makes another lose anything.  Different
    texts under one id are told apart by a row key, a 64-bit hash of the text that only such ids carry: each row
    gets only its own intervals, and where both hold a window, the one at the larger place is later.

    Windows are told apart by 80 bits of two polynomial hashes.  One shuffle deals packed hashes to buckets
    sized by the input, a second one brings the intervals to their documents.

    A null text has no words.  Rows with a null id lose nothing and make no other row lose anything.  Other
    columns are ignored.  An empty table stays empty.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    one = F.xxhash64("text")
    several = materialize(docs.where("id is not null").groupBy("id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("id", F.lit(True).alias("several")), "several")
    row = F.lit(0).cast("long")
    if not several.isEmpty():
        docs, row = docs.join(several, "id", "left"), F.when(F.col("several"), one).otherwise(row)
    docs = docs.select("id", "text", row.alias("row"))
    buckets = max(16, chars // 6 // BUCKET_WINDOWS)
    parts = min(buckets, 20_000)
    groups = max(64, parts)
    entries = docs.where("id is not null").mapInArrow(tidy(local_windows(width, buckets, groups)), "kind int, key long, body binary")
    dealt = entries.repartition(parts, "kind", "key").sortWithinPartitions("kind", "key")
    gone = dealt.mapInArrow(tidy(bucket_removals(groups)), "kind int, key long, body binary").select("key", "body")
    spans = gone.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(intervals(width)), "id long, row long, spans binary")
    return docs.join(spans, ["id", "row"], "left").select("id", "text", "spans").mapInArrow(tidy(cut_out), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
