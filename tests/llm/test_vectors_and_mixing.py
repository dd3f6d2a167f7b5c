"""Vector searches against brute force; mixing against its targets; the pipeline against its stages."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, mixing, topk_search
from tidemark.llm.queries import WEIGHTS
from tidemark.llm.shared import leave_out, text_key
from tidemark.llm.vectors import own_tasks, valid_vectors

DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, id string").repartition(5)


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]


def brute(rows, every, k, whole):
    rows = [(i, np.floor(256 * v) if whole else v) for i, v in usable(rows)]
    rows = rows if whole else [(i, v) for i, v in rows if v.any()]
    width, out = max((len(v) for _, v in rows), default=0), {}
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    for i, v in rows:
        if i % every == 0:
            found = sorted(((-float((v * w).sum()), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def clustered(seed, n, d):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    v = centers[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def odd_rows():
    v = clustered(1, 700, 16)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[3].tolist()) for i in range(400)]  # one vector of a third of all rows
    rows += [(2000, None), (2001, []), (2002, [None] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, [0.0] * 16), (2006, [1.0, -2.0]), (None, v[0].tolist()), (2050, (3 * v[5]).tolist())]
    return rows


def ranked(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_exact_search_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk_search, "BLOCK", 32)
        monkeypatch.setattr(topk_search, "STEP", 8)
    rows = odd_rows()
    vectors = topk_search.quantized(valid_vectors(frame(spark, rows), "vec_id", "embedding"))
    assert ranked(topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)) == brute(rows, 50, 5, True)


def test_exact_search_of_few_rows(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (50, [2.0]), (7, [0.0])]):
        vectors = topk_search.quantized(valid_vectors(frame(spark, rows), "vec_id", "embedding"))
        assert ranked(topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)) == {k: v for k, v in brute(rows, 50, 5, True).items() if v}


def test_exact_search_on_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    vectors = topk_search.quantized(valid_vectors(df, "vec_id", "embedding"))
    assert ranked(topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)) == brute(rows, 50, 5, True)


def test_hnsw_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 900)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(2, 2500, 64))]
    rows += [(5000 + i, rows[9][1]) for i in range(1200)]
    vectors = valid_vectors(frame(spark, rows), "vec_id", "embedding")
    found, want = ranked(hnsw.nearest(vectors, vectors.where("id % 20 = 0"), 20)), brute(rows, 20, 20, False)
    assert set(found) == set(want)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    by = dict(usable(rows))
    for q, answers in found.items():
        assert answers == sorted(answers, key=lambda x: (-x[1], x[0])) and len(answers) == 20
        assert all(abs(s - float(by[q] @ by[j])) < 1e-9 and j != q for j, s in answers)


def test_large_components_score_exactly(spark):
    rows = [(0, [70000.5, 1.0]), (1, [80000.25, -3.0]), (2, [1e6, 2.0]), (50, [-1e6, 1.0 / 3]), (51, [1e6, 2.0078125]), (52, [70000.5, 1.0])]
    vectors = topk_search.quantized(valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    assert max(sum(x * x for x in v) for v in whole.values()) > 1 << 53
    want = {}
    for q in (0, 50):
        found = sorted((-sum(x * y for x, y in zip(whole[q], w, strict=True)), j) for j, w in whole.items() if j != q)
        want[q] = [(j, -s) for s, j in found[:5]]
    assert ranked(topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)) == want
    with pytest.raises(ValueError, match="may not fit"):
        far = topk_search.quantized(spark.createDataFrame([(1, [1e9, 1.0])], "id long, v array<double>"))
        topk_search.exact_top_k(far, far, 5)


def repeated_rows():
    """One id in six rows, another of a query, and few other candidates."""
    v = clustered(4, 30, 8)
    rows = [(7, v[i].tolist()) for i in range(6)] + [(100, v[6].tolist())] + [(100 + i, v[6 + i].tolist()) for i in range(1, 7)]
    return rows + [(7, v[0].tolist())] * 3 + [(201, v[6].tolist())] * 2


def every_row(rows, q, k, whole):
    """Brute force with every row as a candidate; the query's vector is the least under its id."""
    own = min(v for i, v in rows if i == q)
    score = lambda v: float(np.dot(*(np.floor(256 * np.array(x, np.float32).astype(float)) if whole else np.array(x, np.float32).astype(float) for x in (own, v))))
    return [(j, -s) for s, j in sorted((-score(v), j) for j, v in rows if j != q)[:k]]


def test_repeated_ids_are_candidates_of_their_own(spark):
    rows = repeated_rows()
    vectors = valid_vectors(frame(spark, rows), "vec_id", "embedding")
    whole = topk_search.quantized(vectors)
    asked = whole.where("id in (7, 100)")
    got = ranked(topk_search.exact_top_k(whole, asked, 5))
    assert got[100] == every_row(rows, 100, 5, True) and len(got[7]) == 5 and all(j != 7 for j, _ in got[7])
    near = ranked(hnsw.nearest(vectors, vectors.where("id in (7, 100)"), 20))
    want = every_row(rows, 100, 20, False)
    assert [j for j, _ in near[100]] == [j for j, _ in want] and np.allclose([s for _, s in near[100]], [s for _, s in want])
    assert sorted(j for j, _ in near[7]) == sorted(j for j, _ in rows if j != 7)


def test_shards_have_tasks_of_their_own(spark):
    key = own_tasks(spark, 13)
    parts = spark.range(13).withColumnRenamed("id", "shard").repartition(13, key).select("shard", F.spark_partition_id().alias("p")).collect()
    assert {r["shard"]: r["p"] for r in parts} == {i: i for i in range(13)}


def test_hnsw_recall_on_the_table(spark):
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet")
    vectors = valid_vectors(df, "vec_id", "embedding").where("exists(v, x -> x <> 0)")
    found = ranked(hnsw.nearest(vectors, vectors.where("id % 20 = 0"), 20))
    rows = vectors.orderBy("id").collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len(set(want.tolist()) & {j for j, _ in found[ids[at]]}), total + 20
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * total


def test_hnsw_of_odd_rows(spark):
    rows = odd_rows()
    vectors = valid_vectors(frame(spark, rows), "vec_id", "embedding").where("exists(v, x -> x <> 0)")
    found, want = ranked(hnsw.nearest(vectors, vectors.where("id % 20 = 0"), 20)), brute(rows, 20, 20, False)
    assert set(found) == set(want)
    assert sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    few = valid_vectors(frame(spark, [(0, [1.0, 2.0]), (20, [2.0, 1.0])]), "vec_id", "embedding")
    assert ranked(hnsw.nearest(few, few, 20)) == {0: [(20, 4.0)], 20: [(0, 4.0)]}
    assert hnsw.nearest(few.where("false"), few.where("false"), 20).collect() == []


def test_mixing_meets_its_targets(spark):
    root = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = mixing.mix(docs, labels, WEIGHTS).collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    names = list(WEIGHTS)
    totals = np.array([sum(r["tokens"] * r["rate"] * r[f"p_{n}"] for r in rows) for n in names])
    assert np.abs(totals / totals.sum() - np.array([WEIGHTS[n] for n in names])).max() < 1e-4
    assert all(abs(sum(r[f"p_{n}"] for n in mixing.DOMAINS.values()) - 1) < 1e-9 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["tokens"] == len(re.findall(r"[^\x20\x09-\x0d]+", texts[r["doc_id"]] or "")) for r in rows)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    marks = {r["doc_id"]: 2 * r["quality"] + r["toxic"] for r in labels.collect()}
    known = [r for r in rows if r["doc_id"] in marks]
    assert sum(r[f"p_{mixing.DOMAINS[marks[r['doc_id']]]}"] > 0.5 for r in known) >= 0.9 * len(known)


def test_rates_meet_targets_at_the_bound(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4] * 3, 300)
    t = rng.integers(1, 500, 300)
    soft = spark.createDataFrame([(i, int(x), q.tolist()) for i, (x, q) in enumerate(zip(t, p, strict=True))], "doc_id long, tokens long, p array<double>")
    targets = np.array([0.03, 0.92, 0.05]) * t.sum()
    got = np.array([r["r"] for r in soft.select("doc_id", mixing.fit_rates(soft, targets).alias("r")).orderBy("doc_id").collect()])
    assert (got >= 0).all() and (got == 0).any()
    assert np.abs((t * got) @ p - targets).max() < 1e-5 * t.sum()


def test_mixing_stage_writes_the_wanted_shares(spark, monkeypatch):
    import corpus_pipeline as c

    root = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    monkeypatch.setattr(c, "WEIGHTS", {"good": 0.5, "good_toxic": 0.5})
    rows = {r["doc_id"]: r for r in mixing.mix(docs, labels, c.WEIGHTS).collect()}
    assert max(r["rate"] for r in rows.values()) > 1.2
    stays = [rows[r["doc_id"]] for r in c.mixed(spark, docs, root).select("doc_id").collect()]
    assert len({r["doc_id"] for r in stays}) == len(stays)
    totals = np.array([sum(r["tokens"] * r[f"p_{n}"] for r in stays) for n in c.WEIGHTS])
    assert np.abs(totals / totals.sum() - 0.5).max() < 0.02
    bounded = mixing.mix(docs, labels, c.WEIGHTS, most=1.0).collect()
    assert max(r["rate"] for r in bounded) <= 1 and {r["copies"] for r in bounded} <= {0, 1}
    totals = np.array([sum(r["tokens"] * r["rate"] * r[f"p_{n}"] for r in bounded) for n in c.WEIGHTS])
    assert np.abs(totals / totals.sum() - 0.5).max() < 1e-3
    top = max(r["rate"] for r in rows.values())
    assert totals.sum() >= sum(r["tokens"] * r["rate"] * (r["p_good"] + r["p_good_toxic"]) for r in rows.values()) / top


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "some words here", 3), (4, "word " * 9, 4), (4, "word " * 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    assert len(mixing.mix(docs, labels, WEIGHTS).collect()) == 5
    assert {r["p_good"] for r in mixing.mix(docs, labels.where("false"), WEIGHTS).collect()} == {1.0}
    assert mixing.mix(docs.where("false"), labels, WEIGHTS).collect() == []


def test_posteriors_and_rates_equal_a_recomputation(spark):
    """Naive Bayes and the rates by plain Python from the same hashes of words."""
    texts = ["good calm prose of the sea", "BUY NOW!!! $$$ cheap cheap", "the sea is calm and good", "cheap pills $$$ NOW", "hate you all", "you hate the sea"]
    rows = [(i, texts[i % 6] + f" word{i % 7}") for i in range(180)]
    marks = [(i, int(i % 6 in (0, 2, 5)), int(i % 6 in (4, 5))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + marks[:9] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    described = {r["doc_id"]: r for r in mixing.described(mixing.plain(docs, "doc_id", "text")).collect()}
    domain = {i: 2 * q + t for i, q, t in marks if i != 3}
    kinds = sorted(set(domain.values()))
    size = {d: sum(x == d for x in domain.values()) for d in kinds}
    total = len(domain)

    def logs(count: dict[int, int], base: float, weighs: bool) -> dict[int, float]:
        return {d: math.log((count[d] + mixing.SHRINK * base) / (size[d] + mixing.SHRINK)) - math.log(base) if weighs else 0.0 for d in kinds}

    tables = {"bins": {}, "stats": {}}
    for what, table in tables.items():
        for f in {f for r in described.values() for f in r[what]}:
            count = {d: sum(f in described[i][what] for i, x in domain.items() if x == d) for d in kinds}
            base = (sum(count.values()) + 0.5) / (total + 1)
            table[f] = logs(count, base, True)
            if what == "bins":
                for d in kinds:
                    off = abs(count[d] - size[d] * base) / math.sqrt(size[d] * base * (1 - base))
                    if off < mixing.DEVIATIONS or max(count[d], size[d] * base) < mixing.LEAST_ROWS:
                        table[f][d] = 0.0
    weights = {"good": 0.5, "low": 0.5}
    got = {r["doc_id"]: r for r in mixing.mix(docs, labels, weights).collect()}
    for i, r in described.items():
        score = np.array([math.log(size[d] / total) + sum(tables["bins"][f][d] for f in set(r["bins"])) + sum(tables["stats"][f][d] for f in r["stats"]) for d in kinds])
        want = np.exp(score - score.max())
        want /= want.sum()
        assert np.allclose(want, [got[i][f"p_{mixing.DOMAINS[d]}"] for d in kinds], atol=1e-4)
    tokens, rates = np.array([r["tokens"] for r in got.values()], float), np.array([r["rate"] for r in got.values()])
    p = np.array([[r["p_good"], r["p_low"]] for r in got.values()])
    reached = (tokens * rates) @ p
    assert abs(reached[0] / reached.sum() - 0.5) < 1e-4 and (rates >= 0).all()
    assert abs(reached.min() * 2 - 2 * ((tokens @ p).min())) < 1e-3 * tokens.sum()


def test_pipeline_decides_row_by_row(spark):
    """One id with two texts, repeated rows and null ids: each decision hits its own row."""
    import corpus_pipeline as c

    good, other, junk = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "zz"))
    rows = [(1, good), (1, other), (2, good), (None, good), (None, junk), (3, junk), (3, junk), (4, other + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["text"].split()[0], r["doc_id"]) for r in c.deduplicated(spark, docs, DATA).collect() for _ in (0,))
    assert [x for x, _ in left] == ["alpha0", "beta0", "zz0"]
    gone = spark.createDataFrame([(1, good), (None, junk)], "doc_id long, text string").select("doc_id", text_key().alias("text_key"))
    rest = [tuple(r) for r in leave_out(docs, gone).collect()]
    assert sorted(rest, key=str) == sorted([r for r in rows if r not in ((1, good), (None, junk))], key=str)
    assert leave_out(docs.where("false"), gone).collect() == [] and c.deduplicated(spark, docs.where("false"), DATA).collect() == []


def test_mixing_runs_no_python(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    plan = mixing.mix(docs, labels, WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes, columns, now = [docs.count()], docs.columns, docs
    for _, stage in c.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == columns
        now = now.cache()
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0] and sizes[2] == sizes[3]
    ends = c.run(spark, DATA).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in ends} == {r["doc_id"] for r in now.select("doc_id").collect()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in ends)
    extra = docs.limit(20).selectExpr("*", "'x' as id", "1 as copies", "text as stats")
    for _, stage in c.STAGES[:-1]:
        extra = stage(spark, extra, DATA)
        assert extra.columns == [*columns, "id", "copies", "stats"]


def test_shares_of_characters_are_counted_on_what_is_left_of_a_text(spark):
    """The bins are those of the whole text, and no whole text is translated, which is slow."""
    import math

    from pyspark.sql import functions as F

    from tidemark.llm import mixing

    texts = ["", "AB cd 09 #$%&*|=~^<>{}[]_ !?", "é😀Z]" * 9, "a\\b-c.d", "x" * 3000 + "Q1[?", " \n\t", "ßÀ１Ⅷ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = mixing.described(docs)
    for r in got.collect():
        t = texts[r["doc_id"]]
        share = lambda chars: min(11, math.floor(math.log2(sum(c in chars for c in t) / max(len(t), 1) * 1024 + 1)))
        assert [s - mixing.STAT_BINS * i for i, s in enumerate(r["stats"])][1:5] == [share(c) for c in (mixing.UPPER, mixing.DIGITS, mixing.SIGNS, mixing.CALLS)]
    plan = got.select(F.col("stats"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(marks" in plan and "translate(text" not in plan
