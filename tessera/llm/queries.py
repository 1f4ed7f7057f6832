"""The registered queries opN_<name>: thin digests of the operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ann import nearest
from tessera.llm.chat import format_chats
from tessera.llm.kneser_ney import classify
from tessera.llm.license_scan import license_digest, scan_licenses
from tessera.llm.mixing import mix
from tessera.llm.near_dup import near_duplicates
from tessera.llm.oracles import ORACLE_SQL
from tessera.llm.packing import cut, pack
from tessera.llm.quality_rules import judge
from tessera.llm.support import read_table
from tessera.llm.toxicity import held_out, toxicity
from tessera.llm.url_filter import RULES, filter_urls, fixed_rule, host_and_path

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def vocabulary() -> str:
    """The place of the tokenizer's file, which every node has."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text")))


@_query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), read_table(spark, sf_dir, "labels")).drop("url")


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, m = classify(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))
    power = lambda n: F.pow(F.lit(2.0), F.col(m[n]))
    return judged.select("doc_id", "lang", m["n_bytes"], power("bits").alias("perplexity"), power("threshold_bits").alias("threshold"), m["kept"])


@_query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array_join(F.transform("slots", lambda x: F.concat_ws(":", x["slot"], x["words"])), ",")
    return mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", slots.alias("slots"))


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary()))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, score = toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.3).cast("int").alias("predicted"))


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@_query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, m = judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", *(m[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.array_join(m["failed_rules"], ",").alias("failed_rules"))


# Parts of the queries above that SQL can express, on their own.


@_query
def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's base columns; -1 stands for no place."""
    scanned = license_digest(scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    none = lambda n: F.coalesce(n, F.lit(-1)).cast("long").alias(n)
    return scanned.select("doc_id", "n_words", "n_base", none("first_word"), none("last_word"), "base_labels")


@_query
def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's hosts, paths and fixed rules, with those rules' verdicts."""
    host, path = host_and_path(F.col("url"))
    parts = read_table(spark, sf_dir, "pages", "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), RULES)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


@_query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's sizes and targets."""
    return mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target")
