"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm import cube, exactdedup, htmldiff, langid, license, packing, repeats, simhash, tokencount, topk
from tidyloom.llm._shared import UPPER, table

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.main_text(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents"))


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text is what remains; a character that a cut divides is replaced."""
    found = repeats.cut_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.vocabulary(PIECES))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokencount.vocabulary(PIECES))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokencount.vocabulary(WORDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_topk_search, op2_license_scan, op3_exact_dedup, op4_html_extraction, op5_source_mixing, op6_repeat_removal, op7_simhash_near_dedup, op8_token_counts, op9_language_id, op10_best_fit_packing)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP1_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
  from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]::hugeint * z[2]::hugeint)) as score
  from v q join v c on c.r <> q.r and len(c.v) = len(q.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5"""

OP3_SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256 from d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op2_license_scan": license.oracle_sql(), "op3_exact_dedup": OP3_SQL}
