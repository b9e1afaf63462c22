"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spreadlens.llm import hnsw, kneser_ney, license_scan, minhash_forest, mixing, oracle, phrase_mining, piece_viterbi, quality_rules, suffix_dedup, suffix_tree_lm, token_files, turn_repair, url_filter
from spreadlens.llm.common import table
from spreadlens.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {**oracle.ORACLE, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_minhash_forest(spark: SparkSession, d: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, d, "documents"), width=2)


@query
def op3_suffix_tree_lm(spark: SparkSession, d: str) -> DataFrame:
    return suffix_tree_lm.score_texts(table(spark, d, "documents"))


@query
def op4_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    return kneser_ney.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op5_piece_viterbi(spark: SparkSession, d: str) -> DataFrame:
    return piece_viterbi.encode_pieces(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


@query
def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, d, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.read_digests(spark, path)


@query
def op7_hnsw(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return hnsw.search(hnsw.build_index(vectors), vectors.where("vec_id % 100 = 0"))


@query
def op8_url_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, d, "pages").select("page_id", "url"), rules)


@query
def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(table(spark, d, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, d, "documents"))


@query
def op11_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.license_digest(table(spark, d, "documents"))


@query
def op12_phrase_mining(spark: SparkSession, d: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, d, "documents"))


@query
def op13_turn_repair(spark: SparkSession, d: str) -> DataFrame:
    conversations = table(spark, d, "conversations")
    return turn_repair.repair_summary(turn_repair.damage(conversations), conversations)


@query
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)
