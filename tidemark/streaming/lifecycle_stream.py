"""Streaming twin of the lifecycle: run files arrive in a folder, and each run is folded into the state once, in order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lifecycle

#: One row per portal result or observed job of a run: kind says which.
RUN = "run_id long, kind string, portal_id long, status string, complete boolean, jobs int, source string, source_job_id string, payload_sha256 string, ordinal long, at timestamp"


class SnapshotStore:
    """State snapshots ``v=N`` under a folder, and a pointer file that names the current one.

    A version is written whole before the pointer moves, so a lost executor or driver leaves the last good state.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def pointer(self) -> dict:
        """Version and last run of the newest version that was written to its end; version -1 before the first."""
        fs, newest = self._fs(), {"version": -1, "run_id": -1}
        for found in fs.globStatus(self._path("v=*/committed.json")) or ():
            stream = fs.open(found.getPath())
            try:
                told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # the writer was stopped inside it
                continue
            finally:
                stream.close()
            newest = max(newest, told, key=lambda x: x["version"])
        return newest

    def read(self) -> tuple[DataFrame, DataFrame]:
        now = self.pointer()["version"]
        if now < 0:
            return self.spark.createDataFrame([], lifecycle.STATE), self.spark.createDataFrame([], lifecycle.PORTALS)
        base = f"{self.folder}/v={now}"
        return self.spark.read.schema(lifecycle.STATE).parquet(f"{base}/sources"), self.spark.read.schema(lifecycle.PORTALS).parquet(f"{base}/portals")

    def write(self, sources: DataFrame, portals: DataFrame, run_id: int) -> None:
        """The next version: its tables, and last the file that makes it count.  Nothing older is touched, so that a
        crash at any point leaves the version before."""
        version = self.pointer()["version"] + 1
        sources.write.mode("overwrite").parquet(f"{self.folder}/v={version}/sources")
        portals.write.mode("overwrite").parquet(f"{self.folder}/v={version}/portals")
        out = self._fs().create(self._path(f"v={version}/committed.json"), True)
        out.write(bytearray(json.dumps({"version": version, "run_id": run_id}).encode()))
        out.close()


def fold_runs(store: SnapshotStore, rows: DataFrame, misses: int = 2) -> int:
    """Fold the runs of ``rows`` into the store in the order of their ids; runs already folded are skipped."""
    rows = rows.persist()
    done, folded = store.pointer()["run_id"], 0
    for run in sorted(r[0] for r in rows.where(F.col("run_id") > done).select("run_id").distinct().collect()):
        one = rows.where(F.col("run_id") == run)
        results = one.where("kind = 'result'").select("portal_id", "status", "complete", "jobs", F.col("at").alias("finished_at"))
        jobs = one.where("kind = 'job'").select("portal_id", "source", "source_job_id", "payload_sha256", "ordinal", "at")
        sources, portals = store.read()
        known = portals.unionByName(results.select(F.col("portal_id").alias("id")).distinct().join(portals, "id", "left_anti").select("id", F.lit(0).alias("empty_scans"), F.lit("UNKNOWN").alias("health")))
        step = lifecycle.process_run(sources, known, results, jobs, misses)
        store.write(step.sources, step.portals, run)
        folded += 1
    rows.unpersist()
    return folded


def start(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, misses: int = 2) -> StreamingQuery:
    """Follow a folder of JSON run files.  Late files of folded runs are ignored: run order wins."""
    stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 100).json(folder)
    return stream.writeStream.foreachBatch(lambda rows, _: fold_runs(store, rows, misses)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of job rows with the number of observations per source and ten-minute window,
    with a watermark so that its state stays bounded."""
    rows = spark.readStream.schema(RUN).json(folder).where("kind = 'job'").withWatermark("at", "1 hour")
    return rows.groupBy(F.window("at", "10 minutes"), "source").agg(F.count("*").alias("observations"), F.approx_count_distinct("source_job_id").alias("jobs"))
