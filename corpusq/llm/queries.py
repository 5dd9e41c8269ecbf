"""The dealt operators as queries over the whole tables, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_rotation, covering_simhash, decontaminate, fertility, fuzzy_lines, lattice_lm, poisson_mix, suffix_dedup, token_attribution, weak_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.render(table(spark, sf_dir, "conversations"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(table(spark, sf_dir, "documents"))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.token_counts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_fertility_rules": op4_fertility_rules,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_weak_toxicity": op7_weak_toxicity,
    "op8_covering_simhash": op8_covering_simhash,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_token_attribution": op10_token_attribution,
}
#: Left out where SQL has no counterpart (XXH64, tokenisers, alignments, fitted models); tests compare those with plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_perspectives": chat_rotation.ORACLE,
    "op5_poisson_mix": poisson_mix.ORACLE.format(docs="documents", columns="doc_id, text, lang, source, n_chars"),
}
