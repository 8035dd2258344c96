"""Inputs derived from the given tables, the same way in Spark and in SQL.

No given table holds a character of the source script, so text is derived
with one ``translate`` that maps accented Latin letters to kanji; the mock
model maps those kanji to ASCII letters.  Every query reads the whole table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_context
from ..models import FIXTURE_ACCENTS, MOCK_DST, MOCK_SRC


TABLE_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id"], "pages": ["page_id"],
              "part": ["p_partkey"], "benchmark": ["item_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.tables import read_table
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"), TABLE_KEYS.get(name))


def to_jp(c) -> F.Column:
    # no target is a source, so one replacement after the other is the simultaneous one; ``translate`` looks every character up
    col = F.col(c) if isinstance(c, str) else c
    for accent, char in zip(FIXTURE_ACCENTS, MOCK_SRC):
        col = F.replace(col, F.lit(accent), F.lit(char))
    return col


def mock_en(c) -> F.Column:
    """The mock model's answer as an expression (for checks only)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("<en>"), F.translate(col, MOCK_SRC, MOCK_DST))


def jp_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with derived Japanese text; context names a file per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "lang", "source",
        to_jp("text").alias("text"),
        document_context(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("source")).alias("context"),
    )


def jp_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", to_jp("role").alias("role"), to_jp("text").alias("text"))


def jp_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", to_jp("html").alias("html"))


# ---------------------------------------------------------------------------
# A file tree derived from ``documents`` (fixed values of the derivation):
#   root folder name:  corpus
#   folders:           <source>/<lang>_資料
#   file stem:         <first word of the lower-cased text, source script derived>_<doc_id>
#                      (first word = leading run without space . , ; : ! ? ' " or newline;
#                       empty -> "doc")
#   routed extensions: by doc_id % 8 -> .txt .md .csv .docx .xlsx .pdf .png .TXT
# ---------------------------------------------------------------------------
ROOT_NAME = "corpus"
FOLDER_SUFFIX = "_資料"
ROUTE_EXTS = [".txt", ".md", ".csv", ".docx", ".xlsx", ".pdf", ".png", ".TXT"]
FIRST_WORD = r"""^[^ .,;:!?'"\n]+"""


def jp_files(spark: SparkSession, sf_dir: str, routed: bool = False) -> DataFrame:
    """Documents as files: ``path, rel_dir, name, stem, suffix, ext, text``."""
    from ..functions.text import name_ext, name_stem, name_suffix
    d = table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.lower("text"), FIRST_WORD, 0)
    stem = F.concat(to_jp(F.when(word == "", F.lit("doc")).otherwise(word)), F.lit("_"),
                    F.col("doc_id").cast("string"))
    ext = (F.element_at(F.array(*[F.lit(e) for e in ROUTE_EXTS]), (F.col("doc_id") % 8 + 1).cast("int"))
           if routed else F.lit(".txt"))
    f = d.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(FOLDER_SUFFIX)).alias("rel_dir"),
                 F.concat(stem, ext).alias("name"), to_jp("text").alias("text"))
    return f.select("doc_id", F.concat("rel_dir", F.lit("/"), "name").alias("path"), "rel_dir", "name",
                    name_stem("name").alias("stem"), name_suffix("name").alias("suffix"),
                    name_ext("name").alias("ext"), "text")
