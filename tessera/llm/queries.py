"""The thin ``opN_*`` queries: each applies its operator to the whole of its table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, maxent_lm, preference_chat, quality_classifier, quality_rules, secret_scan, simhash, source_mix
from .common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans")
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.edits", F.col("l.start").alias("start_word"), F.col("l.end").alias("end_word"))


def op6_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference_chat.pair_by_last_turn(read_table(spark, sf_dir, "conversations"))
    said = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(mask)
    return preference_chat.format_preferences(turns).select(
        "pair_id", "n_prompt", "prompt", "chosen", "rejected", said("chosen_mask"), said("rejected_mask"), "usable"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_host_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_watched"
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    at = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ",")
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_notices"),
        F.size(F.filter("licenses", lambda x: x["confirmed"])).cast("bigint").alias("n_confirmed"), families.alias("families"), at.alias("notices"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_source_mix, op3_simhash, op4_maxent_lm, op5_decontaminate, op6_preference_chat, op7_language_id, op8_quality_rules,
        op9_quality_classifier, op10_license_scan,
    )
}
