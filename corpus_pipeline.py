"""The corpus pipeline: five stages from ``documents`` to a mixed training set.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; ``run`` writes each result as Parquet to the shared folder and rereads it
as the next stage's input.  All but the last return the columns of ``documents``.

1. language_id: a byte PPM model learned from the stage's own input; documents without
   a language (null text, no letter) go.
2. near_dedup: one document of each group of near copies stays.
3. suffix_dedup: every 50-byte string that a smaller doc_id has too is cut out
   of the text (n_chars follows); texts of which nothing is left go.
4. decontamination: documents that hold a benchmark item go.
5. mixing: documents are taken to the sources' targets; a document that is not taken goes, the
   others carry size, source_size, target and taken (the words the mix takes).

Defined cases, beside those of the operators: null text has no language and goes, an empty text too; a null id is kept and
ranks after every id; of rows equal in id and text one stays (near_dedup); equal ids with different texts are documents of their
own; a null lang teaches nothing, a null source is a source of its own, last in the order; an empty table gives an empty result;
other columns are carried through all stages, except that columns named size, source_size, target or taken
give way to those of the last stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiflow.llm import lang_id  # noqa: E402
from lexiflow.llm.common import remainder, table, written  # noqa: E402
from lexiflow.llm.decontaminate import with_leaks  # noqa: E402
from lexiflow.llm.mixing import mixed  # noqa: E402
from lexiflow.llm.near_dups import without_near_copies  # noqa: E402
from lexiflow.llm.suffix_repeats import without_repeats  # noqa: E402
from lexiflow.session import ship_package  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = lang_id.learn(docs.where(remainder("doc_id", 4) != 2))
    return lang_id.with_language(docs, model).where("__lf_lang <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_leaks(docs, table(spark, sf_dir, "benchmark")).where("size(__lf_items) = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    own = {"__lf_size": "size", "__lf_source_size": "source_size", "__lf_target": "target", "__lf_taken": "taken"}
    return mixed(docs.drop(*own.values())).where("__lf_taken > 0").withColumnsRenamed(own)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: none of the stages can be said in SQL on whole tables (a learned model, sets of shingles, 50-byte strings); the
#: tests hold run() against a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
