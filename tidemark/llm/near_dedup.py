"""MinHash near-duplicate detection with circulant signatures and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, materialize, tidy
from .vectors import column_of, in_runs
from .words import BASE_WORD, arrow_bytes, mix64, slices, words

#: Signature: BANDS bands of ROWS coordinates.  A pair with Jaccard similarity s shares no band
#: with probability (1 - s**ROWS)**BANDS: 7e-9 at 0.85, 7e-7 at 0.8.
BANDS, ROWS = 36, 5
COORDINATES = BANDS * ROWS
#: Documents whose band keys are reduced together, and members of a block of a family.
LOCAL_DOCS, BLOCK = 50_000, 128
#: Columns of an incidence matrix.
COLUMNS = 1 << 15
#: Candidates that may be broadcast to the scan of the texts.
BROADCAST_ROWS = 200_000
SCAN = 1 << 20


CHUNK = 512


def mix32(x: np.ndarray, spare: np.ndarray) -> None:
    """A bijection of 32-bit words, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (lower-cased A-Z)."""
    hashes, _, _, first = words(data, offsets, True)
    n = np.diff(first)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            rolled = rolled * BASE_WORD + hashes[i : i + len(rolled)]
        rolled = mix64(rolled)
    out = []
    for i in range(len(n)):
        if n[i] >= k:
            out.append(np.unique(rolled[first[i] : first[i] + n[i] - k + 1]))
        elif n[i]:  # fewer words than a shingle: the whole sequence is one
            whole = np.uint64(n[i])
            with np.errstate(over="ignore"):
                for h in hashes[first[i] : first[i + 1]]:
                    whole = whole * BASE_WORD + h
            out.append(mix64(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return tuple(int(x) for x in np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ BASE_WORD).sum(dtype=np.uint64)]).view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """Circulant MinHash: one permutation scatters the elements, and coordinate j is the least value of
    a second permutation after a circular shift by j (both act on the 2**32 residues)."""
    low = (s >> np.uint64(16)).astype(np.uint32)
    mix32(low, np.empty_like(low))
    shift = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        values = low[at : at + CHUNK] + shift
        mix32(values, np.empty_like(values))
        np.minimum(best, values.min(axis=1), out=best)
    return best


def sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            n, keys, bands = [], [], []
            for a, b in slices(offsets, SCAN):
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
                    n.append(len(s))
                    if not len(s):
                        keys.append((0, 0)), bands.append(None)
                        continue
                    sig = signature(s)
                    rolled = np.arange(BANDS, dtype=np.uint64)
                    for row in sig.reshape(BANDS, ROWS).T:
                        rolled = mix64(rolled * BASE_WORD + row)
                    keys.append(set_key(s)), bands.append(rolled.tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "n": pa.array(n, pa.int64()),
                    "k1": pa.array([x for x, _ in keys], pa.int64()),
                    "k2": pa.array([x for _, x in keys], pa.int64()),
                    "bands": pa.array(bands, pa.binary()),
                }
            )

    return run


def sets(k: int):
    """Shingle sets of candidate documents; rows whose text is not that of the candidate go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            ids, wanted = batch.column(0).to_pylist(), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for a, b in slices(offsets, 8 * SCAN):
                found = [(i, s) for i, s in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k), a) if set_key(s) == wanted[i]]
                yield pa.RecordBatch.from_pydict({"id": pa.array([ids[i] for i, _ in found], pa.int64()), "shingles": pa.array([s.tobytes() for _, s in found], pa.binary())})

    return run


def buckets(num: int, den: int, heads: bool):
    """Band keys of many documents at once.

    With ``heads``: rows (key, least document here, its size), which go on to other tasks, so that a bucket of any
    size sends one row from each task.  Without: rows (1 if the sizes admit the similarity, a, b) of a document
    and the least one of its bucket here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            ids, n = (table.column(i).to_numpy() for i in (0, 1))
            data, _ = arrow_bytes(table.column(2))
            keys = data.view(np.int64)
            of = np.repeat(np.arange(len(ids)), BANDS)
            order = np.lexsort((ids[of], keys))
            keys, of = keys[order], of[order]
            head = np.ones(len(keys), bool)
            head[1:] = keys[1:] != keys[:-1]
            at = np.flatnonzero(head)
            if heads:
                columns = keys[at], ids[of[at]], n[of[at]]
            else:
                lead = of[at[np.cumsum(head) - 1]]
                of, lead = np.unique(np.stack([of[~head], lead[~head]]), axis=1)
                fits = np.minimum(n[of], n[lead]) * den >= np.maximum(n[of], n[lead]) * num
                columns = fits.astype(np.int64), ids[of], ids[lead]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(len(x) for x in held) >= LOCAL_DOCS:
                yield from flush()
        if held:
            yield from flush()

    return run


def as_block(key: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block: its documents' ids, components and shingle sets."""
    ids, component = column_of(rows, 1).to_numpy(), column_of(rows, 2).to_numpy()
    order = np.argsort(ids, kind="stable")
    sets = [x.as_py() for x in column_of(rows, 3)]
    sizes = np.array([len(x) // 8 for x in sets], np.int64)[order]
    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "body": pa.array([b"".join([np.int64(len(ids)).tobytes(), ids[order].tobytes(), component[order].tobytes(), sizes.tobytes(), *(sets[i] for i in order)])], pa.binary())})


def from_block(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    ids, component, sizes = np.frombuffer(body, np.int64, 3 * n, 8).reshape(3, n)
    return ids, component, sizes, np.frombuffer(body, np.uint64, -1, 8 + 24 * n)


def shared_counts(a: tuple, b: tuple) -> np.ndarray:
    """Intersection sizes of all sets of one block with all of another, as products of incidence matrices."""
    _, column = np.unique(np.concatenate([a[3], b[3]]), return_inverse=True)
    left, right = column[: len(a[3])], column[len(a[3]) :]
    rows_a, rows_b = np.repeat(np.arange(len(a[0])), a[2]), np.repeat(np.arange(len(b[0])), b[2])
    out = np.zeros((len(a[0]), len(b[0])))
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        parts = []
        for rows, columns, n in ((rows_a, left, len(a[0])), (rows_b, right, len(b[0]))):
            some = (columns >= at) & (columns < at + COLUMNS)
            x = np.zeros((n, COLUMNS), np.float32)
            x[rows[some], columns[some] - at] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def linked(num: int, den: int):
    """Rows by (key, kind): a block, then the blocks to compare it with.  Yields confirmed links between
    components, no more than connect them."""

    def links(a: tuple, b: tuple) -> list[tuple[int, int]]:
        common = shared_counts(a, b)
        fits = (den * common >= num * (a[2][:, None] + b[2] - common)) & (a[1][:, None] != b[1])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(fits), strict=True):
            p, q = root(int(a[1][i])), root(int(b[1][j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(max(a[0][i], b[0][j])), int(min(a[0][i], b[0][j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            found = []
            for key, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = from_block(body.as_py())
                if kind == 0:
                    now, at = block, key
                elif key == at:
                    found += links(now, block)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the classes in ``wanted`` (id, k1, k2)."""
    few = wanted.count() <= BROADCAST_ROWS  # 24 bytes a row; beyond, the texts are shuffled
    texts = docs.join(F.broadcast(wanted) if few else wanted.hint("merge"), "id").select("id", "text", "k1", "k2")
    return materialize(texts.mapInArrow(tidy(sets(k)), "id long, shingles binary"), "shingles")


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full shingle sets are similar enough."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(classes.join(ids, "id").select("id", "k1", "k2"), "candidates")
    full = shingles_of(docs, wanted, k)
    x, y = (full.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    with arrow_rows(docs, 200):
        links = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(verified(num, den)), "a long, b long").distinct(), "links")
    discard(pairs, wanted, full)
    return links


@contextmanager
def arrow_rows(df: DataFrame, rows: int):
    """Fewer rows to an Arrow batch for what is run inside, so that large rows stay within memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        yield
    finally:
        conf.set(name, before)


def between_components(docs: DataFrame, classes: DataFrame, families: DataFrame, components: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Confirmed links between the components of a family (documents that share buckets, directly or not).

    A family with several components is cut into blocks of about BLOCK documents: hashes deal the documents of a large
    component, and the small components whole, so no task sees a family.  Each block meets those after it, except where
    both lie in one and the same component.  All sets of two
    blocks are compared at once, in a task that holds two blocks; only links between components come out.
    """
    of = families.select(F.col("node").alias("id"), F.col("component").alias("family")).join(components.withColumnRenamed("node", "id"), "id", "left").select("id", "family", F.coalesce("component", "id").alias("component"))
    of = materialize(of, "of-family")
    sizes = materialize(of.groupBy("family", "component").agg(F.count("*").alias("n")), "component-sizes")
    rest = F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).alias("rest")
    mixed = materialize(sizes.groupBy("family").agg(F.count("*").alias("components"), rest).where("components > 1").select("family", "rest"), "mixed")
    large = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
    block = F.when(F.col("n") >= BLOCK, large).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK))))
    placed = of.join(mixed, "family").join(sizes, ["family", "component"]).select("id", "family", "component", block.alias("block"))
    members = materialize(placed.withColumn("key", F.xxhash64("family", "block")), "members")
    discard(of, sizes, mixed)
    full = shingles_of(docs, materialize(classes.join(members.select("id"), "id").select("id", "k1", "k2"), "candidates"), k)
    bounds = members.groupBy("family", "block", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = bounds.select("family", F.col("block").alias("block2"), F.col("key").alias("key2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meets = materialize(bounds.join(other, "family").where("block <= block2 and not (low = high and low2 = high2 and low = low2)").select("key", "key2"), "meetings")
    with arrow_rows(docs, 16):
        rows = members.select("id", "key", "component").join(full, "id").select("key", "id", "component", "shingles")
        blocks = materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(in_runs(as_block)), "key long, body binary"), "blocks")
        first = blocks.join(meets.select("key").distinct(), "key", "left_semi").select("key", F.lit(0).alias("kind"), "body")
        second = meets.join(blocks.withColumnRenamed("key", "key2"), "key2").select("key", F.lit(1).alias("kind"), "body")
        both = first.unionByName(second).repartition("key").sortWithinPartitions("key", "kind")
        links = materialize(both.mapInArrow(tidy(linked(num, den)), "a long, b long").distinct(), "links")
    discard(members, full, meets, blocks)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Group documents whose word-shingle sets have Jaccard similarity of ``similarity`` (a ratio of integers) or more.

    Returns one row per input row: ``doc_id long, n_shingles long, component_id long, kept boolean``, where
    component_id is the smallest doc_id reachable over links and kept says that it is the row's own.

    1. Circulant MinHash signatures, band keys and a 128-bit key of each whole set.
    2. Equal sets form a class; only its least id goes on, so copies never meet in pairs.
    3. Stars: each document against the least one of each of its buckets, reduced inside a task first.
    4. Confirmed stars give components.  Documents that share buckets, directly or through others, form a
       family; families of several components are compared block against block on full sets, skipping what
       is connected already, so that no candidate pair between components is lost.

    A null text, or one without words, has an empty set and is linked with nothing.  A null id takes no part
    in links: its component_id is null and the row is kept.  Repeated rows are each returned, and texts under
    one id are one node: their links are those of all of them (``one_of_each`` tells them apart).  Other columns are
    ignored whatever their names.  An empty table gives an empty result.
    """
    num, den = similarity
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialize(docs.mapInArrow(tidy(sketch(shingle)), "id long, n long, k1 long, k2 long, bands binary"), "sketches")
    known = rows.where("n > 0 and id is not null")
    classes = materialize(known.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    bands, kinds = classes.select("id", "n", "bands"), "key long, a long, b long"
    local = materialize(bands.mapInArrow(tidy(buckets(num, den, False)), kinds), "stars")
    bucket = W.partitionBy("key")
    heads = bands.mapInArrow(tidy(buckets(num, den, True)), kinds).select("a", F.col("b").alias("n"), F.min(F.struct("a", "b")).over(bucket).alias("least")).where("a != least.a")
    wide = heads.select((F.least("n", "least.b") * den >= F.greatest("n", "least.b") * num).cast("long").alias("key"), "a", F.col("least.a").alias("b"))
    stars = materialize(local.unionByName(wide).distinct(), "all-stars")
    discard(local)
    links = confirm(docs, classes, stars.where("key = 1"), shingle, num, den)
    components = materialize(connected_components(links), "components")
    families = materialize(connected_components(stars), "families")
    late = between_components(docs, classes, families, components, shingle, num, den)
    final = connected_components(links.unionByName(late))

    of_class = classes.join(final, classes["id"] == final["node"], "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    wordless = rows.where("n = 0 or id is null").select("id", "n", F.when(F.col("id").isNotNull(), F.col("id")).alias("component"))
    linked = known.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2"]).select("id", "n", "component")
    return linked.unionByName(wordless).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def one_of_each(df: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``df`` (doc_id, text and any others) with one row of each group of near duplicates: that with the smallest id.

    Rows whose id is null or repeated are documents of their own: each goes by a hash of its id and text instead of
    its id, of rows that agree in both one stays, and which row of a group with such rows stays is not told by ids.
    Rows without words stay.
    """
    several = materialize(df.groupBy(F.col("doc_id").cast("long").alias("several")).agg(F.count("*").alias("n")).where("n > 1 or several is null").select("several"), "several")
    if several.isEmpty():
        gone = near_duplicates(df, shingle=shingle, similarity=similarity).where("not kept").select("doc_id")
        return df.join(gone, "doc_id", "left_anti").select(df.columns)
    node = next(f"node{i}" for i in range(len(df.columns) + 1) if f"node{i}" not in df.columns)
    of = several.withColumn(node, F.lit(True))
    marked = df.join(of, F.col("doc_id").cast("long").eqNullSafe(F.col("several")), "left").select(*df.columns, node)
    alike = marked.where(F.col(node)).dropDuplicates(["doc_id", "text"])
    marked = marked.where(F.col(node).isNull()).unionByName(alike)
    own = F.when(F.col(node), F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(F.col("doc_id").cast("long"))
    marked = materialize(marked.withColumn(node, own), "marked")
    gone = near_duplicates(marked, node, "text", shingle, similarity).where("not kept").select(F.col("doc_id").alias(node))
    return marked.join(gone, node, "left_anti").select(df.columns)
