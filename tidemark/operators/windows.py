"""Latest, first, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import cut


def first_by(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key by a total order; Spark prunes to k rows before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    return first_by(attempts, ["portal_id"], F.desc("scan_run_id"), F.desc("id"))


def latest_observations(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """The latest observation of each canonical job, over all its sources."""
    of = sources.where("canonical_job_id is not null").select(F.col("id").alias("source_job_row_id"), "canonical_job_id")
    return first_by(observations.join(of, "source_job_row_id"), ["canonical_job_id"], F.desc("id"))


def latest_analyses(analyses: DataFrame, valid_only: bool = True, skip_triage: bool = False) -> DataFrame:
    """The analysis with the highest id of each job."""
    rows = analyses.where("valid") if valid_only else analyses
    rows = rows.where("prompt_version not like 'triage:%'") if skip_triage else rows
    return first_by(rows, ["source_job_row_id"], F.desc("id"))


def keep_first(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    return first_by(df, keys, F.col(ordinal))


def keep_last(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    return first_by(df, keys, F.desc(ordinal))


def two_stage_top(df: DataFrame, n: int, first: list[Column], score: Column, second: list[Column]) -> DataFrame:
    """The best 4n rows by one order, scored, then the best n of them by another order; both stages count."""
    return df.orderBy(*first).limit(4 * n).withColumn("priority_score", score).orderBy(*second).limit(n)


def batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """A batch number from 0 for rows in order.

    Range partitioning sorts the rows, which are written once; of them only the partitions' sizes go through the
    driver, so that no task holds them all.  Use it for queues, whose order is by an id.
    """
    if size < 1:
        raise ValueError("size must be positive")
    sorted_rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}))
    counts = {r["_part"]: r["n"] for r in sorted_rows.groupBy("_part").agg((F.max("_at") + 1).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if not before:
        return df.withColumn("batch", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part"))
    return sorted_rows.withColumn("batch", F.floor((start + F.col("_at")) / size)).drop("_part", "_at")


def with_group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    return df.withColumn(name, F.count("*").over(W.partitionBy(*keys)))


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties by lower-case, then raw spelling."""
    return first_by(df.groupBy(*keys, value).agg(F.count("*").alias("n")), keys, F.desc("n"), F.lower(value), F.col(value))


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def set_parity(left: DataFrame, right: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """One row: sizes of both sets, of intersection and union, the percentage shared, and the first differences."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full").select(key, F.coalesce("in_left", F.lit(False)).alias("l"), F.coalesce("in_right", F.lit(False)).alias("r"))
    sides = both.agg(F.count_if("l").alias("left_size"), F.count_if("r").alias("right_size"), F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count("*").alias("united"))
    lists = [both.where(test).orderBy(key).limit(shown).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ", ").alias(name)) for test, name in (("l and not r", "only_left"), ("r and not l", "only_right"))]
    out = sides.withColumn("percent", F.round(F.when(F.col("united") > 0, 100.0 * F.col("shared") / F.col("united")).otherwise(100.0), 1))
    for one in lists:
        out = out.crossJoin(one)  # single rows
    return out


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, old, new, delta) of two rows of counters."""
    names = before.columns
    long = lambda df, v: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias(v)) for c in names])))
    return long(before, "old").join(long(after, "new"), "metric").withColumn("delta", F.col("new") - F.col("old"))
