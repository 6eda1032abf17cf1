"""The queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontam, langid, line_dedup, mixing, ngram_join, packing, pii, prefix_trie, quality_lm, quality_rules, substring_dedup, token_alignment, tokens, warc
from quarrykit.llm.store import scratch, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify_language(docs, docs.where(~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"), F.sha2("text", 256).alias("text_sha256"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages"))).withColumnRenamed("source_id", "page_id").drop("block")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.digested(table(spark, sf_dir, "conversations"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing_to_targets": op8_mixing_to_targets,
    "op9_personal_data": op9_personal_data,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.LINES_SQL,
    "op3_quality_rules": quality_rules.rules_sql(),
    "op6_warc_derivatives": warc.derivatives_sql(),
}
