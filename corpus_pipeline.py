"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) with the rows its predecessor kept and
returns what stays, columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidyloom.llm import cube, exactdedup, langid, packing, similar
from tidyloom.llm._shared import discard, scratch_path
from tidyloom.llm.tokencount import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, texts that no learned language fits, and texts
    that another language than their label's fits far better."""
    return langid.keep_identified(docs, vocabulary("piece_bpe_32k.model"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles one stays."""
    return similar.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Executors that ran the other stages have less memory left: keep fewer words.
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), words_kept=100_000)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, fingerprints and tokenizers are beyond SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs, before = spark.read.parquet(path), written
            written = docs
            if before is not None:
                discard(before)  # what the next stage has read and replaced
    return docs
