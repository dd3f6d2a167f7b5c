"""Exact multi-key deduplication: index lookups against stored state, and the order-dependent fold inside a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ats_key, conflicts, fingerprint, source_key, variant_id
from ..functions.text import normalize_location, normalize_title
from ..functions.urls import canonical_url
from ..storage import cut
from .components import connected
from .windows import keep_first, keep_last

#: Keys in the order in which they are tried, and the method that a hit on each is named by.
PROBES = (("k_source", "source_job_id"), ("k_url", "canonical_apply_url"), ("k_ats", "ats_job_id"), ("k_print", "normalized_fingerprint"))
FIELDS = ("n_title", "n_location", "k_url")


def keyed(df: DataFrame) -> DataFrame:
    """Add the four keys and the normal forms of rows with source, source_job_id, apply_url, corporate_cluster_id,
    title, location, ats_job_id and requisition_id."""
    c = F.col
    url = canonical_url(c("apply_url"))
    return df.withColumns(
        {
            "k_source": source_key(c("source"), c("source_job_id")),
            "k_url": F.nullif(url, F.lit("")),
            "k_ats": ats_key(c("corporate_cluster_id"), c("ats_job_id")),
            "k_print": fingerprint(c("corporate_cluster_id"), c("title"), c("location"), c("requisition_id")),
            "n_title": normalize_title(c("title")),
            "n_location": normalize_location(c("location")),
        }
    )


def match_state(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Match keyed candidates against keyed state rows (canonical_job_id, ordinal): adds canonical_job_id and method.

    Of several state rows with a key the last one owns it.  A hit on one of the first three keys counts only
    if title, location and URL do not conflict, else the next key is tried.
    """
    rows = candidates.drop("canonical_job_id", "method")
    compatible = {}
    for key, _ in PROBES:
        owner = keep_last(state.where(f"{key} is not null"), [key]).select(F.col(key), F.col("canonical_job_id").alias(f"{key}_id"), *[F.col(f).alias(f"{key}_{f}") for f in FIELDS if f != key])
        if key == "k_url":
            owner = owner.withColumn("k_url_k_url", F.col("k_url"))
        rows = rows.join(owner, key, "left")
        clash = conflicts(F.col(f"{key}_n_title"), F.col(f"{key}_n_location"), F.col(f"{key}_k_url"), F.col("n_title"), F.col("n_location"), F.col("k_url"))
        compatible[key] = F.col(f"{key}_id").isNotNull() & (F.lit(True) if key == "k_print" else ~clash)
    hit = method = None
    for key, name in PROBES:
        hit = F.when(compatible[key], F.col(f"{key}_id")) if hit is None else hit.when(compatible[key], F.col(f"{key}_id"))
        method = F.when(compatible[key], name) if method is None else method.when(compatible[key], name)
    kept = [F.col(x) for x in candidates.columns if x not in ("canonical_job_id", "method")]
    return rows.select(*kept, hit.alias("canonical_job_id"), method.alias("method"))


def component_labels(rows: DataFrame) -> DataFrame:
    """Add ``component``: rows that share any key, directly or through others, get one label (their least ordinal)."""
    pairs = None
    for i, (key, _) in enumerate(PROBES):
        one = rows.where(f"{key} is not null").select("ordinal", F.concat(F.lit(f"{i}:"), F.col(key)).alias("key"))
        pairs = one if pairs is None else pairs.unionByName(one)
    pairs = cut(pairs)
    least = cut(pairs.groupBy("key").agg(F.min("ordinal").alias("u")))
    found = connected(pairs.join(least, "key").select(F.col("ordinal").alias("v"), "u"))
    return rows.join(found.withColumnRenamed("node", "ordinal"), "ordinal", "left").withColumn("component", F.coalesce("component", "ordinal"))


def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The exact order-dependent fold of components whose rows come in order: match each row against those before it,
    then register it.  Only the owners of the present component's keys are held, never its rows."""
    owners: dict[tuple[str, str], dict] = {}
    now = None
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            if row["component"] != now:
                owners, now = {}, row["component"]
            chosen = method = None
            if row["is_new"]:
                for key, name in PROBES:
                    old = owners.get((key, row[key])) if row[key] else None
                    if old and (key == "k_print" or not any(old[f] and row[f] and old[f] != row[f] for f in FIELDS)):
                        chosen, method = old["canonical_job_id"], name
                        break
                row["canonical_job_id"] = chosen or row["new_id"]
                out.append((row["ordinal"], row["canonical_job_id"], method))
            held = {f: row[f] for f in (*FIELDS, "canonical_job_id")}
            owners.update(((key, row[key]), held) for key, _ in PROBES if row[key])
        yield pd.DataFrame(out, columns=["ordinal", "canonical_job_id", "method"])


FOLDED = "ordinal long, canonical_job_id string, method string"


def assign(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """(ordinal, canonical_job_id, method) of keyed candidates in order, each seeing the state and those before it.

    ``candidates`` has new_id, the id that a row gets if nothing matches.  Matches need a shared key, so that
    they never leave a component of rows that share keys; components are folded apart and in parallel, each as a
    stream of its rows.
    """
    need = ["ordinal", *[k for k, _ in PROBES], "n_title", "n_location"]
    # Stored rows come before all new ones: their ordinals are moved below any of a batch.
    stored = state.select((F.col("ordinal") - (1 << 62)).alias("ordinal"), *need[1:], "canonical_job_id", F.lit(None).cast("string").alias("new_id"), F.lit(False).alias("is_new"))
    fresh = candidates.select(*need, F.lit(None).cast("string").alias("canonical_job_id"), "new_id", F.lit(True).alias("is_new"))
    rows = component_labels(stored.unionByName(fresh))
    return rows.repartition("component").sortWithinPartitions("component", "is_new", "ordinal").mapInPandas(fold, FOLDED)


def drop_repeated_keys(jobs: DataFrame) -> DataFrame:
    """The first row of each (source, source_job_id) in a batch."""
    return keep_first(jobs, ["source", "source_job_id"])


def preserve_collisions(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Storage ids that keep rows apart which share a native id: a blank native id, or a conflict with the stored
    base row, gives a variant id; both sides have title, location, apply_url and requisition_id."""
    c = F.col
    base = stored.select("source", F.col("source_job_id"), normalize_title(c("title")).alias("b_title"), normalize_location(c("location")).alias("b_location"), canonical_url(c("apply_url")).alias("b_url"))
    rows = jobs.join(base, ["source", "source_job_id"], "left")
    clash = conflicts(c("b_title"), c("b_location"), c("b_url"), normalize_title(c("title")), normalize_location(c("location")), canonical_url(c("apply_url")))
    variant = variant_id(c("source_job_id"), c("title"), c("location"), c("apply_url"), c("requisition_id"))
    own = F.trim(F.coalesce("source_job_id", F.lit("")))
    return rows.withColumns({"native_source_job_id": c("source_job_id"), "is_variant": (own == "") | clash}).withColumn("source_job_id", F.when(c("is_variant"), variant).otherwise(c("source_job_id"))).drop("b_title", "b_location", "b_url")


def new_candidates(candidates: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Candidates of identities not stored yet, the first of each."""
    return keep_first(candidates, identity).join(stored.select(*identity).distinct(), identity, "left_anti")
