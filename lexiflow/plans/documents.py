"""Translate a table of documents (one text per row), line by line.

This is the minimum end-to-end slice: S4 -> F1/F2 -> A1 -> W1 -> T2/T3 ->
J1 -> R1.  The scope of dedup is one document, as for a text file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.apply import apply_translations
from ..operators.batch import BatchResult, batch_translate
from ..operators.rebuild import apply_and_rebuild
from ..session import WorkDir, work_dir
from ..sources.text import explode_lines


@dataclass
class DocumentsResult:
    documents: DataFrame     # scope, text (rebuilt), status
    lines: DataFrame         # scope, ord, text, ending, context, how, text_out
    batch: BatchResult


def document_lines(docs: DataFrame, scope: str | Column, text: str = "text",
                   context: Column | None = None) -> DataFrame:
    """Units of a documents table: ``scope, ord, text, ending, context``."""
    scope_c = F.col(scope) if isinstance(scope, str) else scope
    ctx = context if context is not None else F.lit("")
    base = docs.select(scope_c.alias("scope"), F.col(text).alias("__text"), ctx.alias("context"))
    return explode_lines(base, "__text", keep=["scope", "context"])


def translate_documents(docs: DataFrame, translator, settings: Settings = DEFAULT,
                        scope: str | Column = "doc_id", text: str = "text",
                        context: Column | None = None, work: WorkDir | None = None,
                        name: str = "documents") -> DocumentsResult:
    work = work or work_dir(docs.sparkSession)
    lines = document_lines(docs, scope, text, context)
    batch = batch_translate(lines, translator, settings, work, name)
    applied = apply_translations(lines, batch.translations)   # line-level view (lazy)
    rebuilt = apply_and_rebuild(lines, batch.translations, "scope", "text")
    failed = batch.errors.select("scope").distinct().withColumn("failed", F.lit(True))
    # a document with an empty text has no line; it comes back empty (narrow, no join)
    scope_c = F.col(scope) if isinstance(scope, str) else scope
    empty = docs.filter(F.length(F.col(text)) == 0).select(scope_c.alias("scope"), F.lit("").alias("text"))
    out = (rebuilt.unionByName(empty)
           .join(failed, "scope", "left")
           .select("scope", "text", F.when(F.col("failed"), "error").otherwise("ok").alias("status")))
    return DocumentsResult(out, applied, batch)
