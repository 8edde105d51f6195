"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, language_id, lattice, license_passages, license_scan, minhash_forest, mixing, oracles, quality_rules, substring_dedup, suffix_family, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs).unionByName(license_passages.passages(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("_mix")
    return mixed.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_family.remove_repeats(_table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = language_id.fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language_id.fold(F.col("doc_id"), 5) == 0
    known = language_id.profiles(docs.filter(~held), lang_col="lang", id_col="doc_id", text_col="text")
    return language_id.identify(docs, known).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "_rules.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_lattice_dedup": op8_lattice_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
}

def _license_sql() -> str:
    known = license_scan.template_bigrams(license_scan.TEMPLATES)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, grams in known.items())
    return f"""
WITH templates(license, grams) AS (VALUES {rows}),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, coalesce(text, '') AS whole FROM documents),
units AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS unit, unnest(parts) AS u FROM lines
  UNION ALL SELECT doc_id, 0, whole FROM lines WHERE len(parts) > 1),
words AS (SELECT doc_id, unit, list_filter(string_split_regex(lower(u), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
own AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS o FROM words WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, license, 2 * len(list_intersect(o, grams)) / (len(o) + len(grams)) AS d FROM own, templates
  WHERE len(o) BETWEEN len(grams) * {license_scan.LEAST_DICE} / (2 - {license_scan.LEAST_DICE}) AND len(grams) * (2 - {license_scan.LEAST_DICE}) / {license_scan.LEAST_DICE}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY d DESC, license) AS rn FROM scored)
SELECT doc_id, unit::INT AS unit, license, round(d, 6) AS dice FROM best WHERE rn = 1 AND round(d, 6) >= {license_scan.LEAST_DICE}
"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING,
    "op2_license_scan": _license_sql(),
    "op4_minhash_forest": oracles.NEAR,
    "op5_suffix_dedup": oracles.SUFFIX,
    "op8_lattice_dedup": oracles.LATTICE,
}
