"""Mixing to target weights with soft domain membership; DataFrame and SQL functions only."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, text_key

#: Domains of the labelled table: 2 * quality + toxic.
DOMAINS = {0: "low", 1: "low_toxic", 2: "good", 3: "good_toxic"}
BINS, STEPS, STAT_BINS = 1 << 20, 24, 64
#: A fit whose step has been halved below this has come as near as it can.
LEAST_STEP = 1 / 64
#: Of bounded rates: how often the interval of the budget is halved, what share of it a total may miss, and the steps of each fit.
HALVINGS, MISSED, BOUNDED_STEPS = 5, 1e-4, 10
#: Labelled rows that the classifier is fitted on: those with the least hashes of their ids.
TRAIN_ROWS = 20_000
#: Rows' worth of the rate over all domains in each domain's counts.
SHRINK = 20.0
#: Words that tell: their count in a domain lies so many standard deviations off what all domains would give, with at
#: least so many rows seen or expected.
DEVIATIONS, LEAST_ROWS = 4.0, 5
#: Statistics of a text.
STATS = 7
UPPER, DIGITS, SIGNS, CALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*|=~^<>{}[]_", "!?"


def share_bin(chars: str) -> Column:
    """Which of 12 logarithmic bins the share of ``chars`` in the text falls in; ``marks`` has the text's, and few others."""
    share = (F.length("marks") - F.length(F.translate("marks", chars, ""))) / F.greatest(F.col("chars"), F.lit(1))
    return F.least(F.lit(11), F.floor(F.log2(share * 1024 + 1))).cast("int")


def plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_key(text_col).alias("text_key"))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, bins, stats, and other columns but the text): hashed words and binned statistics of whole texts."""
    # Translating looks up each character as a string of its own, so one pass leaves only those that are counted.
    marks = F.regexp_replace("text", f"[^{re.escape(UPPER + DIGITS + SIGNS + CALLS)}]+", "")
    words = F.filter(F.split(F.lower("text"), r"[ \t-\r]+"), lambda w: w != "")
    bins = F.transform("words", lambda w: F.pmod(F.hash(w), F.lit(BINS)))
    fresh = F.size(F.array_distinct("bins")) / F.greatest(F.size("bins"), F.lit(1))
    stats = [
        F.least(F.lit(19), F.floor(F.log2(F.size("bins") + F.lit(1)))).cast("int"), share_bin(UPPER), share_bin(DIGITS), share_bin(SIGNS), share_bin(CALLS),
        F.floor(fresh * 20).cast("int"), F.least(F.lit(20), F.floor(F.col("chars") / F.greatest(F.size("bins"), F.lit(1)))).cast("int"),
    ]
    numbered = F.array(*[s + F.lit(STAT_BINS * i) for i, s in enumerate(stats)])
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.withColumns({"words": words, "marks": marks, "chars": F.length("text")}).withColumn("bins", bins).select("doc_id", F.size("bins").cast("long").alias("tokens"), "bins", numbered.alias("stats"), *rest)


def constant(values: list, kind: str) -> Column:
    """A constant array column."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def summed(features: str, values: np.ndarray) -> Column:
    """Sum of the values at the features' numbers."""
    table = constant([round(float(x), 6) for x in values], "double")
    return F.aggregate(features, F.lit(0.0), lambda a, b: a + F.get(table, b))


def numbered(bins: str, telling: np.ndarray) -> Column:
    """The places, from 0, of those ``bins`` that are among the sorted numbers ``telling``.

    A bitmap over all bins says which are, and counts of set bits before each of its words give their places, so that
    the constants stay small and each lookup is of constant cost.
    """
    bits = np.zeros(BINS // 64, np.uint64)
    np.bitwise_or.at(bits, telling // 64, np.uint64(1) << (telling % 64).astype(np.uint64))
    before = np.searchsorted(telling, np.arange(0, BINS, 64))
    words, counts = constant(bits.view(np.int64).tolist(), "bigint"), constant(before.tolist(), "int")
    word = lambda b: F.get(words, F.shiftright(b, 6))
    at = lambda b: b.bitwiseAND(F.lit(63))
    below = lambda b: F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), at(b)))
    found = F.filter(bins, lambda b: F.getbit(word(b), at(b)) == 1)
    return F.transform(found, lambda b: F.get(counts, F.shiftright(b, 6)) + F.bit_count(word(b).bitwiseAND(below(b))))


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of at most TRAIN_ROWS labelled rows; repeated labels count once, conflicting ones not at all."""
    known = labels.where("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (2 * F.col("quality") + F.col("toxic")).cast("int").alias("domain"))
    single = known.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).where("domain = other")
    return single.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def posteriors(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """(doc_id, text_key, tokens, p array<double>): domain probabilities by naive Bayes over words and statistics.

    ``docs`` has doc_id, text and text_key; ``labels`` has doc_id, quality and toxic.  At most TRAIN_ROWS labelled rows are
    broadcast to the scan and fitted on, written first so that only their texts are described; every document is
    scored.  At most BINS telling words and STATS * STAT_BINS counts of statistics for each domain come to the
    driver.  A domain without rows is absent.
    """
    known = materialize(described(docs.join(F.broadcast(marked(labels)), "doc_id")), "labelled")
    rows = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    docs, domains = described(docs), sorted(rows)
    if not domains:
        return docs.select("doc_id", "text_key", "tokens", F.array(F.lit(1.0)).alias("p")), [2]
    total = sum(rows.values())
    counts = known.select("domain", F.explode(F.array_distinct("bins")).alias("f")).groupBy("f").agg(*[F.count_if(F.col("domain") == d).alias(f"c{d}") for d in domains])
    base = (sum((F.col(f"c{d}") for d in domains), F.lit(0.5))) / (total + 1)
    off = [F.abs(F.col(f"c{d}") - rows[d] * base) / F.sqrt(rows[d] * base * (1 - base)) * (F.greatest(F.col(f"c{d}"), rows[d] * base) >= LEAST_ROWS).cast("int") for d in domains]
    telling = counts.withColumns({"base": base, "off": F.array(*off)}).where(F.array_max("off") >= DEVIATIONS).collect()
    seen = known.select("domain", F.explode("stats").alias("f")).groupBy("domain", "f").agg(F.count("*").alias("n")).collect()
    table = np.zeros((len(domains), STATS * STAT_BINS))
    for r in seen:
        table[domains.index(r["domain"]), r["f"]] = r["n"]
    # Shrunk towards the rate over all domains, so that what a small domain has not shown yet tells nothing.
    per = np.array([rows[d] for d in domains], float)
    common = (table.sum(axis=0) + 0.5) / (total + 1)
    logs = np.log((table + SHRINK * common) / (per[:, None] + SHRINK)) - np.log(common)
    telling = sorted(telling, key=lambda r: r["f"])
    words = np.zeros((len(domains), len(telling)))
    for n, r in enumerate(telling):
        for i, d in enumerate(domains):
            if r["off"][i] >= DEVIATIONS:
                words[i, n] = np.log((r[f"c{d}"] + SHRINK * r["base"]) / (rows[d] + SHRINK)) - np.log(r["base"])
    hits = F.array_distinct(numbered("bins", np.array([r["f"] for r in telling], np.int64))) if telling else F.array().cast("array<int>")
    docs = docs.withColumn("hits", hits)
    scores = [F.lit(float(np.log(rows[d] / total))) + summed("hits", words[i]) + summed("stats", logs[i]) for i, d in enumerate(domains)]
    scored = docs.select("doc_id", "text_key", "tokens", F.array(*scores).alias("s"))
    powers = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("e", powers).select("doc_id", "text_key", "tokens", F.transform("e", lambda x: x / whole).alias("p")), domains


def fit_rates(soft: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = 1e-6, p: Column | None = None) -> Column:
    """The rate column of ``fitted`` without an upper bound."""
    return fitted(soft, targets, steps, tolerance, p)[0]


def fitted(soft: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = 1e-6, p: Column | None = None, most: float | None = None, have: np.ndarray | None = None) -> tuple[Column, float]:
    """The rate column that makes the domains' expected token totals meet ``targets``, by projected gradient,
    and the largest share of all targets by which a total misses its own.

    Minimises the least-squares residual of the totals over rates >= 0 and at most ``most``.  They start at the posterior mean of
    each domain's target over its total.  The gradient is taken in the metric that weighs each document by its tokens and preconditioned by the Gram matrix of the
    documents whose rate is between the bounds; a step that makes the residual worse is halved.  A step is one aggregation
    that brings a few sums for each domain to the driver; the rate is an expression of the steps' sums, over the
    column p or ``p``.  ``have`` are the domains' totals, where they are known already.
    """
    d = len(targets)
    top = lambda rate: rate if most is None else F.least(F.lit(float(most)), rate)
    p = [F.element_at("p" if p is None else p, i + 1) for i in range(d)]

    def sums(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        live = F.when((rate > 0) if most is None else (rate > 0) & (rate < most), F.col("tokens")).otherwise(0)
        row = soft.agg(*[F.sum(F.col("tokens") * rate * x) for x in p], *[F.sum(live * p[i] * p[j]) for i in range(d) for j in range(d)]).first()
        row = np.array([x or 0.0 for x in row], float)
        return row[:d] - targets, row[d:].reshape(d, d)

    have = sums(F.lit(1.0))[0] + targets if have is None else have
    ratios = np.where(have > 0, targets / np.maximum(have, 1e-9), 0)
    rate = top(sum((float(m) * x for m, x in zip(ratios, p, strict=True)), F.lit(0.0)))
    gap, gram = sums(rate)
    size = 1.0
    for _ in range(steps):
        if np.abs(gap).max() <= tolerance * max(targets.sum(), 1) or size < LEAST_STEP:
            break
        move = size * (np.linalg.pinv(gram, rcond=1e-9) @ gap)
        new = top(F.greatest(F.lit(0.0), rate - sum((float(m) * x for m, x in zip(move, p, strict=True)), F.lit(0.0))))
        new_gap, new_gram = sums(new)
        if np.linalg.norm(new_gap) < np.linalg.norm(gap):
            rate, gap, gram, size = new, new_gap, new_gram, 1.0
        else:
            size /= 2
    return rate, float(np.abs(gap).max() / max(targets.sum(), 1))


def bounded_rates(soft: DataFrame, wanted: np.ndarray, have: np.ndarray, budget: float, rate: Column, p: Column, most: float) -> Column:
    """Rates of at most ``most`` that meet the shares ``wanted`` with as much of ``budget`` as that bound allows.

    ``rate`` meets them with the whole budget but has no bound; scaled down to the bound it still does, with less.
    HALVINGS of the way from there to the budget find more.
    """
    top = soft.agg(F.max(rate)).first()[0] or 0.0
    if top <= most:
        return rate
    low, high, rate = budget * most / top, budget, rate * F.lit(float(most / top))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        more, missed = fitted(soft, wanted * middle, BOUNDED_STEPS, MISSED, p, most, have)
        if missed <= MISSED:
            low, rate = middle, more
        else:
            high = middle
    return rate


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", most: float | None = None) -> DataFrame:
    """Rates for every document so that the domains' expected shares of the tokens meet ``weights``.

    Returns doc_id, tokens (words), p_low, p_low_toxic, p_good, p_good_toxic, rate, text_key and copies; copies is the rate
    rounded up or down by a hash of the id, so that it has the rate as its mean.  ``budget`` is the wanted total;
    None takes the largest one that needs no domain more than once.  Since memberships are soft, single rates may
    still exceed 1; ``most`` bounds them and lowers the budget until the shares are met under the bound.  Domains without rows, without tokens or without a positive
    weight have no target: their documents follow what they share with the others, whose targets hold among themselves.

    A null text has no tokens and is rated by what its prior gives; null ids round by one common hash;
    repeated rows are rated alike; a label counts once however often it is repeated, and not at all if its document has
    another one too; other columns are ignored.  Without labels all belong to "good".  An empty
    table gives an empty result.
    """
    soft, domains = posteriors(plain(df, id_col, text_col), labels)
    soft = materialize(soft, "posteriors")
    named = [i for i in domains if weights.get(DOMAINS[i], 0.0) > 0]
    of = [F.element_at("p", domains.index(i) + 1) for i in named]
    have = np.array([x or 0.0 for x in soft.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * p) for p in of]).first()][1:], float)
    some = np.flatnonzero(have > 0)
    rate = F.lit(1.0)
    if len(some):
        kept, have = F.array(*[of[i] for i in some]), have[some]
        wanted = np.array([weights[DOMAINS[named[i]]] for i in some])
        wanted = wanted / wanted.sum()
        if budget is None:
            budget = float((have / wanted).min())
        rate = fit_rates(soft, wanted * budget, p=kept)
        if most is not None:
            rate = bounded_rates(soft, wanted, have, budget, rate, kept, most)
    columns = [(F.element_at("p", domains.index(i) + 1) if i in domains else F.lit(0.0)).alias(f"p_{name}") for i, name in DOMAINS.items()]
    rated = soft.select("doc_id", "tokens", *columns, rate.alias("rate"), "text_key")
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
