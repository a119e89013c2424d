"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.alignment import align_documents
from pairloom.llm.bpe import encode_documents
from pairloom.llm.common import table
from pairloom.llm.copies_sql import COPIES_SQL
from pairloom.llm.embedding_dedup import near_equal_vectors
from pairloom.llm.html_extract import extract_pages
from pairloom.llm.line_rules import score_rules
from pairloom.llm.katz import score_documents
from pairloom.llm.manifest_sql import FIELDS, MANIFEST_SQL
from pairloom.llm.merkle import LETTERS, merkle_manifest
from pairloom.llm.minhash import near_copies
from pairloom.llm.packing import pack_documents
from pairloom.llm.pii import KINDS, find_personal_data, span_list
from pairloom.llm.quality import classify_documents
from pairloom.llm.repeats import remove_repeats
from pairloom.llm.repeats_sql import REPEATS_SQL
from pairloom.llm.rules_sql import RULES_SQL
from pairloom.llm.sharding import shard_documents


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_equal_vectors(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
    ]
    both = F.sort_array(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(both).alias("spans"))


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = score_rules(table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    text = F.when(changed, F.translate("text", LETTERS, LETTERS.lower())).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), FIELDS, tampered={"text": text})


def op12_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_katz": op2_katz,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii": op7_pii,
    "op8_minhash": op8_minhash,
    "op9_line_rules": op9_line_rules,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_bwt_merge": op12_bwt_merge,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {
    "op8_minhash": COPIES_SQL,
    "op9_line_rules": RULES_SQL,
    "op11_merkle": MANIFEST_SQL,
    "op12_bwt_merge": REPEATS_SQL,
}
