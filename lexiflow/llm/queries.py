"""The registered queries of the corpus operators, over whole tables, with their contract columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import lang_id, quality, sql, toxicity
from lexiflow.llm.ann import nearest
from lexiflow.llm.common import remainder, table
from lexiflow.llm.decontaminate import leaks
from lexiflow.llm.divergence import with_verdicts
from lexiflow.llm.lexical import search
from lexiflow.llm.mixing import mix_sources
from lexiflow.llm.near_dups import near_duplicates
from lexiflow.llm.phrases import collocations
from lexiflow.llm.suffix_repeats import remove_repeated_bytes
from lexiflow.llm.token_counts import count_tokens
from lexiflow.llm.word_repeats import remove_repeated_words

#: a score from which on a document counts as label 1, and the tokens over which a document is long
CUT, TOKEN_LIMIT = 0.3, 4096


def _held(mod: int, rest: int) -> Column:
    """Rows kept out of learning; a row without an id is one of them."""
    return F.coalesce(remainder("doc_id", mod) == rest, F.lit(True))


def _scored(df: DataFrame, mod: int, rest: int) -> DataFrame:
    return df.select("doc_id", _held(mod, rest).alias("held_out"), F.col("__lf_score").alias("score"),
                     (F.col("__lf_score") >= CUT).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), "quality", ~_held(5, 0))
    return _scored(quality.with_quality(docs, model), 5, 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeated_words(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", ~_held(4, 2))
    return _scored(toxicity.with_toxicity(docs, model), 4, 2)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.learn(docs.where(~_held(4, 2)))
    got = lang_id.with_language(docs.select("doc_id", "text"), model)
    return got.select("doc_id", _held(4, 2).alias("held_out"), F.col("__lf_lang").alias("lang_pred"), F.col("__lf_score").alias("score"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers   # only this query needs it
    got = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_substring_dedup, op3_toxicity, op4_near_dedup, op5_nearest, op6_suffix_dedup, op7_mixing, op8_decontamination,
    op9_language_id, op10_token_counts, op11_quality_rules, op12_collocations,
    op13_lexical_search)}
SQL: dict[str, str] = {"op11_quality_rules": sql.quality_rules(), "op12_collocations": sql.collocations(),
                       "op13_lexical_search": sql.lexical_search()}
