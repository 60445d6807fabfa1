"""The registered queries of this subpackage: thin calls that apply each operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat_format import conversation_nodes, format_trees, read_back
from .common import shared_folder, table
from .exact_dedup import exact_groups
from .merkle import lower_cased_fifth, merkle_manifest
from .mixing import mix
from .packing import pack
from .pii import replace_personal_data
from .quality_fm import score_quality, train
from .simhash import near_groups
from .suffix_dedup import cut_repeats
from .token_align import with_counts
from .token_counts import count_tokens
from .token_files import digests, read_tokens, write_tokens
from .vector_topk import top_k


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_trees(conversation_nodes(rows.unionByName(extra))))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), spark.conf.get("letterlens.pii.key", "key of the registered query"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle_manifest(table(spark, sf_dir, "documents"), *lower_cased_fifth())
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return digests(read_tokens(spark, folder))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_fm": op4_quality_fm,
    "op5_token_counts": op5_token_counts,
    "op6_exact_topk": op6_exact_topk,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_simhash": op8_simhash,
    "op9_suffix_array": op9_suffix_array,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_files": op13_token_files,
}
ORACLES = sql.ORACLES
