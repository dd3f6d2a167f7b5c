"""The opN_ queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import chat, hnsw, mixing, near_dedup, packing, pii, quality, substring_dedup, token_codes, topk_search
from .tokens import tokenizer_path
from .vectors import valid_vectors

#: Rows of an Arrow batch, so that a batch of very long texts stays small.
ARROW_ROWS = "2000"
#: Wanted shares of the tokens by domain.
WEIGHTS = {"good": 0.8, "good_toxic": 0.12, "low": 0.08}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantized(valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS)


def op5_ann_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    return hnsw.nearest(vectors, vectors.where("id % 20 = 0"), k=20)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048, keep_ids=False).drop("ids")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", say), (-1, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(rows.unionByName(more))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_topk_search, op2_pii, op3_token_codes, op4_mixing, op5_ann_hnsw, op6_near_dedup, op7_quality, op8_packing, op9_substring_dedup, op10_chat)
    return {f.__name__: f for f in found}


TOP_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select a.vec_id as query_id, b.vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id
    where a.vec_id % 50 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored
)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 5"""

NEAR_SQL = """
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as (
    select distinct doc_id, case when len(ws) >= 3 then array_to_string(ws[i:i + 2], ' ') else array_to_string(ws, ' ') end as k
    from w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) where len(ws) > 0
), n as (
    select doc_id, count(*) as size from s group by 1
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2
), links as (
    select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.size + y.size - shared)
), reach as (
    select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), least as (
    select a, min(b) as low from reach group by 1
)
select d.doc_id, coalesce(size, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id <= coalesce(low, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least on least.a = d.doc_id"""

REPEATS_SQL = """
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), windows as (
    select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from w, unnest(range(1, len(ws) - 18)) t(i) where len(ws) >= 20
), again as (
    select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as place from windows) where place > 1
), gone as (
    select distinct doc_id, p from again, unnest(range(i, i + 20)) t(p)
), each as (
    select doc_id, p, ws[p] as word from w, unnest(range(1, len(ws) + 1)) t(p)
), kept as (
    select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from each where not exists (select 1 from gone g where g.doc_id = each.doc_id and g.p = each.p) group by 1
)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""


def chat_sql() -> str:
    escaped = "replace(text, chr(92), chr(92) || chr(92))"
    for i, mark in enumerate(chat.MARKS):
        escaped = f"replace({escaped}, '{mark}', chr(92) || 'm{i};')"
    frames = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b) in chat.FRAMES.items())
    other = len("<<ROLE>><</ROLE>>[INST][/INST]")
    return f"""
with r as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f as (
    select *, length({escaped}) + case role {frames} else {other} + length({escaped.replace('text', 'role', 1)}) end as size from r
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256, cast(sum(size) as bigint) as formatted_chars
from f group by 1"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are held against brute force in the tests."""
    return {"op1_topk_search": TOP_SQL, "op6_near_dedup": NEAR_SQL, "op9_substring_dedup": REPEATS_SQL, "op10_chat": chat_sql()}
