"""From documents to token ids: quality rules, near-duplicates, benchmark decontamination, mixing, binary output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saithong.llm.common import cut
from saithong.llm.decontam import drop_contaminated
from saithong.llm.hyperminhash import keep_one
from saithong.llm.mixing import mixed_documents
from saithong.llm.quality import keep_good
from saithong.llm.repair import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares four fifths of its shingles of five words."""
    return keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages of note."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, as often as their source's target takes them."""
    return mixed_documents(docs, length_col="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the written shards: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("token_ids", token_ids)]

#: SQL can express neither the tokenizer nor the shards; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
