"""Queries that apply the operators, with production parameters, to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgcube.llm import op1_quality, op2_counts, op3_simhash, op4_lm, op5_toxicity, op6_decontaminate, op7_revisits, op8_pack, op9_substrings, op10_secrets, op11_cover_tree, op12_zone_maps, op13_orchard
from kgcube.llm.store import new_folder, stored
from kgcube.llm.tables import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.quality(read(spark, sf_dir, "documents"), stored)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_counts.maintained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), new_folder(spark))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_simhash.near_duplicates(read(spark, sf_dir, "documents"), stored)
    return found.select("doc_id", op3_simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lm.score(read(spark, sf_dir, "documents"))


def op5_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_revisits.resolved_pages(read(spark, sf_dir, "pages"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_pack.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets.scan(read(spark, sf_dir, "documents"))


def op11_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_cover_tree.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_zone_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_zone_maps.clusters(read(spark, sf_dir, "embeddings"))


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_orchard.codes(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_simhash_near_dedup, op4_lm_scoring, op5_toxicity_scores, op6_benchmark_decontamination, op7_revisit_resolution, op8_harmonic_packing, op9_repeated_passages, op10_secret_scans, op11_cover_tree_links, op12_zone_map_clusters, op13_orchard_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": op2_counts.SQL, "op7_revisit_resolution": op7_revisits.SQL, "op11_cover_tree_links": op11_cover_tree.SQL, "op12_zone_map_clusters": op12_zone_maps.SQL, "op13_orchard_codes": op13_orchard.SQL}
