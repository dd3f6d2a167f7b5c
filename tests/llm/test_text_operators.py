"""Text operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import chat, near_dedup, packing, pii, quality, substring_dedup, token_codes
from tidemark.llm.components import connected_components
from tidemark.llm.tokens import Encoder, tokenizer_path

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, "one", "en", "s", 3),
    (5, "One two", "en", "s", 7),
    (6, "one TWO", "en", "s", 7),
    (None, "a text without an id " * 30, "en", "s", 600),
    (7, "very long " * 40_000, None, None, None),
    (8, "tie " * 60, "en", "s", 240),
    (8, "tie " * 60, "en", "s", 240),
    (9, "tie " * 60, "en", "s", 240),
    (10, "naïve ÀÉ \x1c x y \U0001f600 joe@example.com", "fr", "s", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    extra = "id long, words string, key long, bands string, n int, stats string"
    rows = [(*r, 1, "w", 2, "b", 3, "s") for r in ODD]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_components_follow_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(500, 560)] + [(5, 5), (None, 3), (7, 6)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0}
    assert {found[i] for i in (*range(500, 560), 1000)} == {500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * den >= max(len(sets[i]), len(sets[j])) * num and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min(v) for r, v in groups.items()}
    return {rows[i][0]: (len(sets[i]), least[root(i)]) for i in range(len(rows))}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_equal_brute_force(spark, docs, k, num, den):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(220)]
    for n in range(90):  # a chain and a cloud of near copies, some on either side of the threshold
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + n, " ".join(words)))
        base[n] = f"y{n}" if n % 2 else base[n]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, shingle=k, similarity=(num, den)).collect()}
    assert found == brute_groups(rows, k, num, den)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd, shingle=3, similarity=(85, 100)).collect()
    assert len(rows) == len(ODD)
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[5, 1] == (5, True) and got[6, 1] == (5, False)
    assert got[9, 1] == (8, False)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_copies_in_one_bucket_lose_no_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.035 else f"z{rng.randrange(10**6)}" for w in base)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, shingle=3, similarity=(80, 100)).collect()}
    assert found == brute_groups(rows, 3, 80, 100)


def brute_removal(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = WORD.findall(text or "")
        keep = [True] * len(w)
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            if key in seen:
                keep[a : a + width] = [False] * width
            seen.add(key)
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out[doc] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages_equal_brute_force(spark, docs, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(-5, "again " * 50), (9_000_000_000, "again " * 25 + "and more"), (77_777, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(frame, width=20).collect()}
    assert found == brute_removal(rows, 20)
    for width in (3, 50):
        found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(frame, width=width).collect()}
        assert found == brute_removal(rows, width)


def test_repeated_passages_of_odd_rows(odd, empty):
    rows = substring_dedup.remove_repeated(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_words"] == 0 and got[4]["n_removed"] == 0
    assert got[9]["n_removed"] == 60 and got[9]["kept_text"] == ""
    assert got[7]["n_words"] == 80_000 and got[7]["n_removed"] == 79_998
    assert got[None]["n_removed"] == 0
    assert substring_dedup.remove_repeated(empty).collect() == []


def test_repeated_rows_keep_a_copy_and_their_own_places(spark):
    words = [f"w{i}" for i in range(40)]
    whole, moved = " ".join(words), " ".join(["x", "y", *words[:25], "z"])
    rows = [(8, whole), (8, whole), (9, whole), (11, moved), (12, "other " + " ".join(f"v{i}" for i in range(30))), (12, " ".join(f"v{i}" for i in range(30)) + " end"), (12, "short")]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeated(frame, width=20).collect())
        assert found == [(8, 40, 0, whole), (8, 40, 0, whole), (9, 40, 40, ""), (11, 28, 25, "x y z"), (12, 1, 0, "short"), (12, 31, 0, rows[5][1]), (12, 31, 30, "other")]


PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_the_patterns(docs):
    rng = random.Random(1)
    texts = [r["text"] for r in docs.collect()]
    alphabets = ("0123456789.", "0123 -+()", "ab@.%-", "a1@.+ 9(-)é", "4 1-", "+1 2.3")
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(50))) for _ in range(5000)]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(50))) for a in alphabets for _ in range(3000)]
    for text in texts:
        assert [x for x in pii.spans(text) if x[2] < 4] == brute_spans(text), text


def test_added_spans_and_redaction(spark):
    text = 'mailto:joe@x.org https://a.b/c?d=1. @handle iban: GB29NWBK60161331926819 token = "24be64439e3e49cf" +1 (212) 555-0199'
    found = pii.spans(text)
    assert {(pii.KINDS[k], text[a:b]) for a, b, k in found} == {
        ("url", "mailto:joe@x.org"), ("email", "joe@x.org"), ("url", "https://a.b/c?d=1"), ("account", "@handle"),
        ("account", "GB29NWBK60161331926819"), ("account", "24be64439e3e49cf"), ("phone", "+1 (212) 555-0199"),
    }
    assert pii.redacted(text, found) == '[URL] [URL]. [ACCOUNT] iban: [ACCOUNT] token = "[ACCOUNT]" [PHONE]'
    for clean in ("a token of thanks", "the account: none", "3 @ 5", "see section 1.2.3", ""):
        assert pii.spans(clean) == []
    frame = spark.createDataFrame([(1, text, 5, "x"), (2, None, 7, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.redact(frame).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None and got[2]["n_chars"] == 7


def test_accounts_reach_their_end():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    cases = [("token: ", "a1" * 120), ("Token=", jwt), ("IBAN: ", "DE89 3704 0044 0532 0130 00"), ("my iban is ", "GB29 NWBK 6016 1331 9268 19"), ("IBAN ", "DE89370400440532013000"), ("User ID: ", "abc12345"), ("Customer ID = ", "C-998877"), ("aCCount: ", "a.b.c.12")]
    for before, value in cases:
        for after in ("", ". Then more", " and more", "\nnext", '" x'):
            text = f"İ {before}{value}{after}"
            assert pii.redacted(text, [x for x in pii.spans(text) if x[2] == 5]) == f"İ {before}[ACCOUNT]{after}", text
    for clean in ("IBAN DE88 3704 0044 0532 0130 00", "iban is DE89 3704", "a token is DE89", "token: ab1....", "iban DE8937040044053201300\u212a"):
        assert [x for x in pii.spans(clean) if x[2] == 5] == []


def test_pii_query_columns(odd, empty):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["base_sha256"] for r in rows if r["doc_id"] == 1} == {hashlib.sha256(b"").hexdigest()}
    assert next(r for r in rows if r["doc_id"] == 10)["n_email"] == 1
    assert pii.find_pii(empty).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piecewise_encoding_is_exact(docs, name):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    assert own.cut is not None
    rng = random.Random(2)
    signs = "ab 'sté\n\n\t\r\x0b\x0c\x1c\x85   　İΣς́<|endoftext|>1½!?"
    texts = [r["text"] for r in docs.limit(150).collect()] + ["", " ", "a ", "\n", *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000))]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_codes_round_trip():
    rng = np.random.default_rng(4)
    for top in (1, 200, 256, 49_408, 1 << 20, 1 << 31):
        counts = rng.integers(0, 900, 12)
        ids = rng.integers(0, top, counts.sum()).astype(np.uint32)
        codes = token_codes.Codes(token_codes.write_codes([5, None, *range(10)], counts, ids))
        assert codes.doc_ids[:2] == [5, None]
        at = rng.integers(0, len(ids), 300)
        assert (codes.access(at) == ids[at]).all()
        for i, (a, b) in enumerate(zip(codes.starts[:-1], codes.starts[1:], strict=True)):
            assert (codes.document(i) == ids[a:b]).all()


def test_token_files_equal_direct_encoding(docs, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got, start = by_id(token_codes.token_file_digests(docs.repartition(4), path)), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got[r["doc_id"]] == {"doc_id": r["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    rows = token_codes.token_file_digests(odd, path).collect()
    assert len(rows) == len(ODD) and min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert sorted(r["start"] for r in rows)[1:] == np.cumsum([r["n_tokens"] for r in sorted(rows, key=lambda r: r["start"])])[:-1].tolist()
    assert token_codes.token_file_digests(empty, path).collect() == []


def check_packing(rows, texts, whole, length):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids, at = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == length or at & (at - 1) == 0 and at < length


def test_packing_places_every_id_once(docs, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.repartition(3), path).collect()
    check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, whole, 2048)
    single = odd.where("doc_id <> 8 and doc_id is not null")
    check_packing(packing.pack_documents(single, path).collect(), {r[0]: r[1] for r in ODD if r[0] not in (8, None)}, whole, 2048)
    assert sum(r["length"] for r in packing.pack_documents(odd.where("doc_id = 8"), path).collect()) == 2 * (len(whole.encode("tie " * 60).ids) + 1)
    assert packing.pack_documents(empty, path).collect() == []


def test_bm25_scores_equal_the_formula(monkeypatch):
    monkeypatch.setattr(packing, "FEW", 5)
    rng = np.random.default_rng(7)
    docs = [rng.zipf(1.4, rng.integers(5, 60)) % 300 for _ in range(80)]
    index, n = packing.Bm25(docs), len(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    mean = np.mean([len(d) for d in docs])

    def weight(t, d):
        tf = int((d == t).sum())
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0.0

    for seed in range(0, n, 9):
        asks = sorted((t for t in set(docs[seed].tolist()) if df[t] <= max(packing.LEAST_COMMON, n * packing.COMMON)), key=lambda t: -weight(t, docs[seed]))[: packing.QUERY_TERMS]
        want = np.array([sum(weight(t, d) for t in asks) for d in docs])
        assert np.allclose(index.scores(seed), want)
        used = rng.random(n) < 0.3
        found = list(index.unused(seed, used))
        assert sorted(found) == np.flatnonzero(~used).tolist()
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(found[:-1], found[1:], strict=True))


def test_packing_prefers_related_documents():
    topics = [np.arange(100 * t, 100 * t + 60) for t in range(4)]
    docs = [np.concatenate([topics[i % 4], [900 + i]]) for i in range(16)]
    whole = [s for s in packing.pack(docs, 244) if len(s) == 4]
    assert len(whole) == 4
    assert all(len({d % 4 for d, _, _ in s}) == 1 for s in whole)


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_of_chains_and_hubs(spark, monkeypatch, few):
    """In rounds over written tables with joins that can be split, and in one task."""
    from tidemark.llm import components

    monkeypatch.setattr(components, "FEW_EDGES", few)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "LOCAL_EDGES", 7)
    names = np.random.default_rng(2).permutation(300).tolist()
    edges = [*zip(names[:80], names[1:81], strict=True), *[(names[100], x) for x in names[101:180]], (5000, 5000), (names[0], None), (names[3], names[2])]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pii_counts_and_digests_equal_the_patterns(spark):
    """Every count and digest of the query over a whole table, by the patterns themselves."""
    import hashlib

    from tidemark.llm.queries import op2_pii

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def digits(x):
        return re.sub("[^0-9]", "", x)

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    root = DATA.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    found = 0
    for r in op2_pii(spark, root).collect():
        spans = [(m.start(), i, m.end()) for i, (_, p, fits) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]]) if fits(m.group())]
        assert [r[f"n_{k}"] for k, _, _ in kinds] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kinds[i][0]}:{a}:{b}" for a, i, b in sorted(spans)).encode()).hexdigest()
        found += len(spans)
    assert found > 20


def test_quality_scores_equal_a_recomputation(spark):
    """The discriminant from all labelled statistics by inverses and determinants instead of factors."""
    root = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet").collect(), spark.read.parquet(f"{root}/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    raw = [(r["text"] or "").encode() for r in docs]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y = np.array([marks.get(r["doc_id"], -1) for r in docs])
    center, scale = x[y >= 0].mean(axis=0), np.sqrt(np.maximum(x[y >= 0].var(axis=0), 1e-12)) + 1e-6
    z = (x - center) / scale
    own = [np.cov(z[y == k].T, ddof=1) for k in (0, 1)]
    sizes = np.array([(y == k).sum() for k in (0, 1)])
    both = sum(c * (n - 1) for c, n in zip(own, sizes, strict=True)) / (sizes.sum() - 2)
    logs, bound = [], np.clip(z, -8, 8)
    for k in (0, 1):
        cov = 0.7 * own[k] + 0.3 * both
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        gap = bound - z[y == k].mean(axis=0)
        logs.append(np.log((sizes[k] + 1) / (sizes.sum() + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("nd,de,ne->n", gap, np.linalg.inv(cov), gap))
    want = 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / 3.0, -500, 500)))
    got = {r["doc_id"]: r for r in quality.classify(spark.read.parquet(f"{root}/documents.parquet"), labels).collect()}
    assert np.allclose([got[r["doc_id"]]["score"] for r in docs], want, atol=1e-6)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    twice = quality.classify(spark.read.parquet(f"{root}/documents.parquet"), labels.unionByName(labels)).collect()
    assert all(abs(r["score"] - got[r["doc_id"]]["score"]) < 1e-9 for r in twice)


def test_quality_on_the_held_out_fold(spark):
    root = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.98 * len(rows)
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.99 * len(good)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (9, 1, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("false")
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.classify(empty, labels).collect() == []


def test_chat_digests_equal_brute_force(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, "tool <s>", "\\m1; \\\\ [IN[INST]ST] <<SYS>>"), (-2, 1, "assistant", None), (-2, 2, None, "x")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    found = {r["conv_id"]: r for r in chat.chat_digests(frame).collect()}
    want: dict = {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(found) == set(want)
    for conv, turns in want.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.formatted(a, b)[0]) for a, b in turns)
    assert chat.chat_digests(frame.where("false")).collect() == []


def test_marks_in_texts_never_reach_the_template():
    rng = random.Random(6)
    bits = [*chat.MARKS, "\\", "m1;", "[", "<", ">", "INST]", " x "]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        assert chat.MARK.search(chat.escaped(text)) is None and chat.unescaped(chat.escaped(text)) == text
        for role in ("user", "assistant", "system", text):
            assert chat.parsed(chat.formatted(role, text)[0]) == (role, text)


def test_layouts_by_fingerprint(spark):
    records = [
        (1, json.dumps({"prompt": "p", "response": "r", "score": 3})),
        (2, json.dumps({"instruction": "i", "input": "", "output": "o"})),
        (3, json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}], "id": "z"})),
        (4, json.dumps({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]})),
        (5, "not json"), (6, None), (7, json.dumps({"unknown": 1})), (8, json.dumps({"system": "be", "messages": [{"role": "user", "content": "u"}]})),
    ]
    rows = chat.canonical_json_turns(spark.createDataFrame(records, "conv_id long, record string"), "record").orderBy("conv_id", "turn").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got[1] == [(0, "user", "p"), (1, "assistant", "r")] and got[2] == [(0, "user", "i"), (1, "assistant", "o")]
    assert got[3] == [(0, "system", "s"), (1, "user", "")] and got[4] == [(0, "user", "h"), (1, "assistant", "g")]
    assert got[5] == [(None, None, "not json")] and got[6] == [(None, None, None)] and got[7][0][0] is None
    assert got[8] == [(0, "system", "be"), (1, "user", "u")]
    table = spark.createDataFrame([(1, [("user", "a"), ("bot", "b")], 0)], "conv_id long, messages array<struct<role string, content string>>, lang int")
    assert [tuple(r) for r in chat.canonical_turns(table).collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    plain = spark.createDataFrame([(1, "q", "a")], "conv_id long, question string, answer string")
    assert [tuple(r) for r in chat.canonical_turns(plain).collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other int"))
