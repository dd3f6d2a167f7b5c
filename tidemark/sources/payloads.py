"""Landed payloads: a table keyed by the URL's hash, and a Python data source that reads folders of saved bodies."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "payload_id string, url string, status int, body string, problem string"
#: Headers that may be kept with a cached body (fixed values).
SAFE_HEADERS = ("content-type", "etag", "last-modified", "cache-control")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_File]:
        return [_File(str(p)) for p in sorted(Path(self.folder).rglob("*.json.gz"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            entry = json.loads(gzip.decompress(Path(partition.path).read_bytes()))
            yield (Path(partition.path).name.removesuffix(".json.gz"), entry["url"], int(entry.get("status_code", 200)), entry.get("body", ""), None)
        except (OSError, ValueError, KeyError, EOFError) as e:  # an unreadable entry is a row with a problem
            yield (Path(partition.path).name.removesuffix(".json.gz"), None, None, None, type(e).__name__)


class CachedPayloads(DataSource):
    """``spark.read.format("cached_payloads").option("path", folder)``: one gzip JSON file per URL."""

    @classmethod
    def name(cls) -> str:
        return "cached_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(CachedPayloads)
    return spark.read.format("cached_payloads").option("path", folder).load()


def write_entry(folder: str, url: str, body: str, status: int = 200, headers: dict | None = None) -> str:
    """Save one body; returns its key."""
    import hashlib

    key = hashlib.sha256(url.encode()).hexdigest()
    kept = {k.lower(): v for k, v in (headers or {}).items() if k.lower() in SAFE_HEADERS}
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / f"{key}.json.gz").write_bytes(gzip.compress(json.dumps({"url": url, "status_code": status, "headers": kept, "body": body}).encode()))
    return key


def latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Payloads after conditional requests: a 304 keeps the stored body, another status replaces it."""
    stored = old.select("url", F.struct("status", "body").alias("o"))
    fresh = new.select("url", F.struct("status", "body").alias("n"))
    both = stored.join(fresh, "url", "full")
    keep = F.col("n").isNull() | ((F.col("n.status") == 304) & F.col("o").isNotNull())
    body = F.when(keep, F.col("o.body")).otherwise(F.col("n.body"))
    return both.select("url", F.when(keep, F.col("o.status")).otherwise(F.col("n.status")).alias("status"), body.alias("body"), F.sha2(body, 256).alias("body_sha256"))
