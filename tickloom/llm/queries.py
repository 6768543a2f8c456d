"""One query per operator, over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    bpe,
    lexical,
    licenses,
    negatives,
    packing,
    pivots,
    quality,
    records,
    sentencepieces,
    sharding,
    simhash,
    substring,
    tokens,
    wrappers,
)
from tickloom.llm.common import Scratch, ship


def vocabulary(name: str) -> str:
    """The file of a public tokenizer on this machine and its workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    passed = quality.judged(quality.judged(rows, quality.BASE, "base"), quality.WEB)
    return passed.withColumn("base_failed", ~F.col("base")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "fail_bits",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), tokens.BYTE_LEVEL)


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeated(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op6_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), Scratch(spark, "records").path("ids")
    records.write_records(docs, folder, vocabulary("word_bpe_49k.json"), tokens.SPACE_DROPPED)
    return records.read_records(spark, folder)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), every=100)


def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), every=100)


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"), tokens.SPACE_DROPPED).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rule_ledger,
        op2_best_fit_packing,
        op3_golay_simhash,
        op4_repeated_windows,
        op5_host_wrappers,
        op6_prefix_sum_shards,
        op7_framed_records,
        op8_sentencepiece,
        op9_license_templates,
        op10_pivot_permutations,
        op11_strassen_negatives,
        op12_trie_bpe,
        op13_bit_sliced_search,
    )
}

SQL: dict[str, str] = {
    "op1_rule_ledger": quality.SQL,
    "op9_license_templates": licenses.sql(),
    "op11_strassen_negatives": negatives.SQL,
    "op13_bit_sliced_search": lexical.SQL,
}
