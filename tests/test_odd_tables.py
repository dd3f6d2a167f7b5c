"""Queries against their SQL over small tables with what the driver's lack."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import lifecycle, resolve


def agree(spark, name, folder, **tables):
    """The query and its SQL give the same rows over these tables (name to DataFrame)."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    cursor = connection.execute(__spark_entry__.oracle_sql()[name])
    columns, rows = [c[0] for c in cursor.description], cursor.fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    return rows


def test_sections_keep_repeated_lines(spark, tmp_path):
    turns = [(1, 0, "user", "a\na\n b  c"), (1, 1, "user", "a"), (1, 2, "user", "a\n\na\nb c"), (2, 0, "user", " \n"), (2, 1, "user", None), (3, None, "user", "last"), (3, 4, "user", "first")]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert (1, "a\na\nb c\n\na") in agree(spark, "n8_join_sections", tmp_path, conversations=conversations)


def test_portals_of_many_clusters_keep_their_arrays_out_of_the_join(spark):
    """What a caller drops is not built: each job would carry all ids of its portal."""
    plan = __spark_entry__.queries()["j10_portal_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(corporate_cluster_id" in plan and "collect_set(corporate_cluster_id" not in plan


def test_boards_that_evidence_cannot_tell_apart_are_one_group(spark):
    """Links do not grow with copies of boards, and expand to every pair once."""
    companies = spark.createDataFrame([(i, "jobs.acme.com", ["https://board.example/7"] if i == 1 else [], [f"Acme {i}"]) for i in range(3)], "company_id long, domain string, portals array<string>, names array<string>")
    rows = [("f", "acme", f"https://board.example/{i}", "Acme-1", "Jobs.acme.com" if i % 2 else "") for i in range(50)]
    rows += [("f", "other", "https://board.example/n", "ACME 2", ""), ("f", "acme", "https://board.example/0", "Unlike", ""), ("f", "none", "https://board.example/7/", "acme1", "")]
    boards = spark.createDataFrame(rows, "family string, slug string, url string, name string, domain string")
    links, members = resolve.overlap_groups(companies, boards)
    assert links.count() <= 15
    got = sorted(tuple(r) for r in resolve.overlap(companies, boards).collect())
    want = [(c, "f", "acme", f"https://board.example/{i}", "HIGH_CONFIDENCE", "DOMAIN_EXACT") for c in range(3) for i in range(1, 50, 2)]
    want += [(c, "f", "acme", f"https://board.example/{i}", *(("HIGH_CONFIDENCE", "SLUG_PLUS_NAME") if c == 1 else ("CANDIDATE", "SLUG"))) for c in range(3) for i in range(50)]
    want += [(1, "f", "acme", "https://board.example/7", "HIGH_CONFIDENCE", "URL_EXACT"), (1, "f", "none", "https://board.example/7/", "HIGH_CONFIDENCE", "URL_EXACT"), (2, "f", "other", "https://board.example/n", "CANDIDATE", "NAME_EXACT")]
    assert got == sorted(want)


def test_full_runs_fold_as_they_do_one_by_one(spark):
    """Sources that move between portals, too; and days do not come to the driver as jobs of their own."""
    at = lambda day, n: dt.datetime(2026, 1, 1 + day, n // 3600, n // 60 % 60, n % 60)
    rng = random.Random(5)
    rows = [(n // 20, f"s{rng.randrange(3)}", rng.choice("abcd"), rng.randrange(3), f"h{rng.randrange(2)}", n, at(n // 20, n)) for n in range(120) if rng.random() < 0.4]
    frame = spark.createDataFrame(rows, "run int, source string, source_job_id string, portal_id long, payload_sha256 string, ordinal long, at timestamp")
    state, portals = spark.createDataFrame([], lifecycle.STATE), spark.createDataFrame([(i, 0, "UNKNOWN") for i in range(3)], lifecycle.PORTALS)
    for run in sorted({r[0] for r in rows}):
        jobs = frame.where(F.col("run") == run).drop("run")
        results = jobs.groupBy("portal_id").agg(F.lit("SUCCESS").alias("status"), F.lit(True).alias("complete"), F.count("*").cast("int").alias("jobs"), F.max("at").alias("finished_at"))
        state = spark.createDataFrame(lifecycle.process_run(state, portals, results, jobs).sources.collect(), lifecycle.STATE)
    want = sorted(state.collect(), key=str)
    got = lifecycle.fold_full_runs(frame).select(state.columns)
    assert sorted(got.collect(), key=str) == want and any(not r["is_active"] for r in want)
