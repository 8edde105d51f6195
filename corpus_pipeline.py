"""A training-data pipeline of five operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's `docs`. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, minhash_forest, mixing, quality_rules, suffix_family
from postmill.llm.storage import materialize


#: Bytes of a string that substring removal looks for, so that a repeated passage of over 50 words has one: words of four letters on average.
PASSAGE_BYTES = 250
#: Text bytes that are encoded at a time, few, as workers share an executor with what earlier stages left.
SLICE_BYTES = 1 << 19


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return judged.filter(F.col("_rules.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id."""
    return minhash_forest.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE_BYTES that recur anywhere; characters cut in the middle go whole. n_chars follows the text."""
    removed = suffix_family.remove_repeats(docs, match=PASSAGE_BYTES, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    text = F.col("kept").cast("string")
    swap = lambda x, *pairs: swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else x
    # Replacement characters of the text itself are written \1b meanwhile, so those that are dropped are of cut characters.
    own = F.make_valid_utf8(swap(text, ("\1", "\1a"), ("�", "\1b")))
    texts = removed.withColumn("text", F.when(F.size("spans") > 0, swap(own, ("�", ""), ("\1b", "�"), ("\1a", "\1"))).otherwise(F.make_valid_utf8(text)))
    return texts.select(*(F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("carried")[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, a row for each copy."""
    return mixing.mixed_rows(mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, slice_bytes=SLICE_BYTES))


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("mix_sources", mix_sources), ("byte_bpe", tokens)]

#: The verdicts of near dedup, sampling and merges have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
