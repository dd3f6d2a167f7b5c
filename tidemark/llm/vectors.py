"""Parts that both vector searches use: valid rows, packs of rows, and streams that bring packs to an index."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Queries of one pack.
PACK = 32


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of rows whose id is known and whose vector has only finite components."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as rows of ``width``, shorter lists with zeros behind."""
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), np.float64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(x) for x in lengths])] = values
    return out


def in_runs(take: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gathers runs of rows with an equal first column and hands each run to ``take``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and keys[a] != now:
                    yield from take(now, held)
                    held = []
                now = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from take(now, held)

    return run


def column_of(batches: list[pa.RecordBatch], i: int):
    return pa.chunked_array([x.column(i) for x in batches]).combine_chunks()


def best(df: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, vec_id, score) rows of each query, ties to the smaller vec_id; cut in each task before the shuffle."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def own_tasks(spark: SparkSession, parts: int) -> Column:
    """For a number column ``shard`` below ``parts``: a key that repartition(parts, key) deals to that partition."""
    chosen = spark.range(40 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
    found = {r["part"]: r["id"] for r in chosen.collect()}  # at most ``parts`` rows
    return F.get(F.from_json(F.lit(json.dumps([found.get(i, i) for i in range(parts)])), "array<long>"), F.col("shard").cast("int"))
