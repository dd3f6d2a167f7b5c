import datetime as dt
import json

from tidemark.operators import lifecycle
from tidemark.streaming import lifecycle_stream as stream


def run_rows(run, jobs, complete=True):
    at = (dt.datetime(2026, 1, 1) + dt.timedelta(days=run)).isoformat()
    yield {"run_id": run, "kind": "result", "portal_id": 1, "status": "SUCCESS", "complete": complete, "jobs": len(jobs), "at": at}
    for i, j in enumerate(jobs):
        yield {"run_id": run, "kind": "job", "portal_id": 1, "source": "s", "source_job_id": j, "payload_sha256": j, "ordinal": i, "at": at}


def test_stream_equals_the_batch_fold(spark, tmp_path):
    store = stream.SnapshotStore(spark, f"file://{tmp_path}/state")
    (tmp_path / "in").mkdir()
    runs = {0: ["a", "b"], 1: ["a"], 2: ["a"], 3: ["a", "b"]}
    write = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    for part in ((0, 1), (2, 3)):
        for run in part:
            write(run, run_rows(run, runs[run]))
        stream.start(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    write("late", run_rows(1, ["zzz"]))  # a run that was folded before
    stream.start(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert store.pointer() == {"version": 3, "run_id": 3}
    got = {r["source_job_id"]: (r["is_active"], r["missing"]) for r in store.read()[0].collect()}
    assert got == {"a": (True, 0), "b": (True, 0)}
    base = spark.read.schema(lifecycle.STATE).parquet(f"{tmp_path}/state/v=2/sources")
    assert {r["source_job_id"]: r["is_active"] for r in base.collect()} == {"a": True, "b": False}
