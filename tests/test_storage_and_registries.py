"""Components, normal forms of keys, registry imports, facet subdivision, and versions of the snapshot store."""

from __future__ import annotations

import json
import random
import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators import components, lifecycle
from tidemark.sources import parsers, registries
from tidemark.streaming.lifecycle_stream import SnapshotStore


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    chain = list(zip(names[:150], names[1:151], strict=True))
    edges = [*chain, *[(names[200], x) for x in names[201:300]], (names[310], names[310]), *chain[:20], *[(b, a) for a, b in chain[:20]]]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "v long, u long").repartition(4)).collect()}
    assert got == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert components.connected(spark.createDataFrame([], "v long, u long")).collect() == []


def test_keys_are_exact_beyond_ascii(spark):
    rows = spark.createDataFrame([("Straße  23", "STRASSE 23"), ("Ｆｕｌｌ width", "full WIDTH"), ("ﬁne-Café", "FINE CAFÉ"), ("a_b c", "A_B c"), (None, " ")], "a string, b string")
    assert all(r["x"] == r["y"] for r in rows.select(text.normalize(F.col("a")).alias("x"), text.normalize(F.col("b")).alias("y")).collect())
    titles = spark.createDataFrame([("<b>R&amp;D</b> Lead", "r d lead"), ("Söhne &ouml;", "söhne ö")], "a string, b string")
    assert all(r["x"] == r["b"] for r in titles.select(text.normalize_title(F.col("a")).alias("x"), "b").collect())


def by_library(value):
    """The canonical URL by the standard library's parts."""
    u = urlsplit(value)
    keep = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in urls.TRACKING and not k.lower().startswith("utm_"))
    port = f":{u.port}" if u.port and u.port != {"http": 80, "https": 443}[u.scheme] else ""
    path = re.sub("/+", "/", u.path).rstrip("/") or "/"
    return f"{u.scheme}://{u.hostname}{port}{path}{'?' if keep else ''}{urlencode(keep)}"


def test_canonical_urls(spark):
    hosts, paths = ("https://A.example.com", "http://b.example.com:8080", "https://c.example.com:443"), ("", "/", "/a//b/", "/x%20y/z")
    queries = ("", "?", "?a=1", "?b=2&a=1", "?a=%7Eq&utm_source=x", "?q=a+b&q=a%20b", "?flag", "?a-b=2&a=1", "?ref=x", "?x=ü", "?a=1&&b=", "?A=1&a=2#top", "?src=1&gh_jid=7")
    values = [h + p + q for h in hosts for p in paths for q in queries]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", urls.canonical_url(F.col("v")).alias("c")).collect()
    assert {r["v"]: r["c"] for r in got} == {v: by_library(v) for v in values}
    odd = spark.createDataFrame([(" mailto:x@y ",), ("",), (None,), ("ftp://a/b?c=d&e",)], "v string").select(urls.canonical_url(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in odd] == ["mailto:x@y", "", "", "ftp://a/b?c=d&e"]


def master(spark, **change):
    row = dict.fromkeys(registries.MASTER, "") | {"Record ID": "r1", "Corporate Cluster ID": "c1", "Canonical Employer": "Acme"} | change
    return spark.createDataFrame([tuple(row[c] for c in registries.MASTER)], ", ".join(f"`{c}` string" for c in registries.MASTER))


def test_a_master_is_imported_once_and_only_whole(spark):
    none = spark.createDataFrame([], "kind string, source_sha256 string")
    done = spark.createDataFrame([("master", "s1")], "kind string, source_sha256 string")
    assert registries.import_master(master(spark), none, "s1")["corporate_clusters"].first()["representative"] == "Acme"
    assert registries.import_master(master(spark), done, "s1") is None
    with pytest.raises(ValueError, match="different master"):
        registries.import_master(master(spark), done, "s2")
    for change in ({"Record ID": " "}, {"Resolution Wave": "W1"}, {"Resolved Jobs Search URL": "https://x.example"}, {"Portal Verified Date": "2024-02-30"}, {"Canonical Name Occurrences": "x"}):
        with pytest.raises(ValueError, match="bad rows"):
            registries.import_master(master(spark, **change), none, "s1")


def test_subdivided_records_count_once(spark):
    facets = [{"facetParameter": "timeType", "values": [{"id": "x", "count": 1}, {"id": "y", "count": 2}]}]
    job = lambda n: {"title": f"t{n}", "externalPath": f"/job/{n}", "bulletFields": [f"R-{n}"]}
    page = lambda total, *jobs, facets=(): json.dumps({"total": total, "facets": list(facets), "jobPostings": list(jobs)})
    rows = [(1, 5, "https://w", page(2000, job(1), facets=facets), []), (2, 5, "https://w", page(2, job(1), job(2)), ["timeType=x"]), (3, 5, "https://w", page(2, job(2), job(3)), ["timeType=y"]), (4, 6, "https://w", page(1, job(9)), [])]
    branches = spark.createDataFrame(rows, "payload_id long, portal_id long, url string, body string, applied array<string>")
    got = sorted((r["portal_id"], r["source_job_id"], r["payload_id"]) for r in parsers.subdivided_jobs(branches).collect())
    assert got == [(5, "R-1", 1), (5, "R-2", 2), (5, "R-3", 3), (6, "R-9", 4)]


def test_a_version_counts_once_it_is_whole(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/state")
    assert store.pointer() == {"version": -1, "run_id": -1}
    empty = spark.createDataFrame([], lifecycle.STATE), spark.createDataFrame([], lifecycle.PORTALS)
    store.write(*empty, 3)
    for name, body in (("v=1", None), ("v=2", '{"version": 2, "ru')):  # stopped before and inside the last file
        folder = tmp_path / "state" / name
        folder.mkdir()
        if body:
            (folder / "committed.json").write_text(body)
    assert store.pointer() == {"version": 0, "run_id": 3}
    store.write(*empty, 4)
    assert store.pointer() == {"version": 1, "run_id": 4} and store.read()[0].count() == 0
