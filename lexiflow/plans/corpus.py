"""translate_corpus (T8) with per-file isolation.

Three model stages, each written before the next reads it:

A. folder names (context: original parent name)
B. file names (context: translated folder path)
C. contents, per handler's unit source, as one ``batch_translate`` with
   ``scope = path`` and the document context built from stage B.

A file whose content stage fails keeps its original text and goes out
under its *original* name in the translated folder (K7); the failure is a
row of ``errors``.  Text formats are handled here in table form; packaged
formats (docx/xlsx) are in :mod:`lexiflow.plans.packages`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import document_context
from ..operators.apply import apply_translations
from ..operators.batch import BatchResult, batch_translate
from ..operators.layout import layout_lines, layout_style, layout_units
from ..operators.names import translate_dir_paths, translate_file_names, translate_folders, unique_paths
from ..operators.rebuild import apply_and_rebuild, csv_text, rebuild_csv_rows
from ..operators.routing import TEXT_HANDLERS, handler_of, text_handlers
from ..session import WorkDir, work_dir
from ..sources.csv_cells import cell_units, csv_cells, csv_errors
from ..sources.text import explode_lines


@dataclass
class CorpusResult:
    files: DataFrame        # path, path_out, handler, status, text
    names: DataFrame        # stage B output (one row per file)
    folders: DataFrame      # stage A output
    batch: BatchResult
    errors: DataFrame       # path, stage, error
    name_calls: DataFrame   # one row per name call made (stages A and B), with tokens
    failed: DataFrame       # path (distinct) of the files whose content stage failed
    layout: DataFrame | None = None   # styled lines of the span table, when one was given


def translate_corpus(files: DataFrame, root_name: str, translator, settings: Settings = DEFAULT,
                     work: WorkDir | None = None, spans: DataFrame | None = None, max_pages: int | None = None,
                     input_errors: DataFrame | None = None, more_dirs: DataFrame | None = None) -> CorpusResult:
    """``files``: ``path, rel_dir, name, stem, suffix, ext, text`` (decoded text).

    ``spans``: the layout path's span table (S8); its lines, ``max_pages`` pages of each file, are
    translated with the rest and come back as ``layout`` (styled lines).
    ``input_errors``: ``path, stage, error`` of files that could not be read; they count as failed.
    ``more_dirs``: folders without files (``rel_dir``).
    """
    work = work or work_dir(files.sparkSession)
    # metadata is read by every stage: write it once (small); the text is scanned only for content
    meta = work.materialize(files.drop("text"), "corpus/meta")
    # stage A's model calls are written inside translate_folders; the folder rows
    # around them are a cheap recomputation from written inputs
    folders = translate_folders(meta, root_name, translator, settings, work, more_dirs=more_dirs)
    dirs = translate_dir_paths(folders, root_name, work)
    named = work.materialize(translate_file_names(meta, dirs, translator, settings, work), "corpus/files")

    # the texts stay where they are: names and contexts are joined to what is small, the distinct units and the results
    src = files.select("path", "text", handler_of("ext").alias("handler"))
    contexts = named.select(F.col("path").alias("scope"), document_context("name_en", "folder_context").alias("context"))
    lines = explode_lines(src.filter(F.col("handler") == "lines").select("path", "text"), "text", keep=["path"]).withColumn("scope", F.col("path"))
    # the parse is read by the units, the errors and the rebuild: written once
    cells = work.materialize(csv_cells(src.filter(F.col("handler") == "csv").select("path", "text")), "corpus/cells")
    bad_parse = csv_errors(cells)
    own = {}
    for h in TEXT_HANDLERS.values():
        rows = work.materialize(h.units(src.filter(F.col("handler") == h.name).select("path", "text")), f"corpus/units-{h.name}")
        own[h.name] = rows
        if "error" in rows.columns:
            bad_parse = bad_parse.unionByName(rows.filter(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("error"))
                                              .select("path", F.lit("parse").alias("stage"), "error"))
    whole = lambda df: df.join(bad_parse.select("path"), "path", "left_anti").withColumn("scope", F.col("path"))
    units = lines.select("scope", "ord", "text").unionByName(whole(cell_units(cells)).select("scope", "ord", "text"))
    for rows in own.values():
        units = units.unionByName(whole(rows).filter(F.col("text").isNotNull()).select("scope", F.col("ord").cast("bigint").alias("ord"), "text"))
    lay = None
    if spans is not None:
        ctx = named.select("path", document_context("name_en", "folder_context").alias("__ctx"))
        laid = layout_lines(spans, max_pages=max_pages).join(ctx, "path")
        lay = work.materialize(layout_units(laid, F.col("__ctx")), "corpus/layout")
        units = units.unionByName(lay.select("scope", "ord", "text"))
        contexts = contexts.unionByName(lay.groupBy("scope").agg(F.min("context").alias("context")))
    batch = batch_translate(units, translator, settings, work, "corpus/content", contexts=contexts)

    rebuilt = apply_and_rebuild(lines, batch.translations, "scope", "text").withColumnRenamed("scope", "path")
    csv_out = (rebuild_csv_rows(apply_translations(whole(cells), batch.translations).withColumn(
        "text_out", F.coalesce("text_out", "text")), "path")
        .select("path", csv_text("rows").alias("text")))
    rebuilt = rebuilt.unionByName(csv_out)
    for name, rows in own.items():
        rebuilt = rebuilt.unionByName(TEXT_HANDLERS[name].rebuild(apply_translations(whole(rows), batch.translations).drop("how", "scope"))
                                      .select("path", "text"))

    # a layout scope is path#page
    of = F.col("scope") if spans is None else F.regexp_replace("scope", r"#\d+$", "")
    failed = batch.errors.select(of.alias("path"), "stage", "error").unionByName(bad_parse)
    if input_errors is not None:
        failed = failed.unionByName(input_errors.select("path", "stage", "error"))
    bad = work.materialize(failed.select("path").distinct().withColumn("failed", F.lit(True)), "corpus/failed")
    # the original text is fetched again only for failed files (K7); others carry the rebuilt text
    originals = files.select("path", F.col("text").alias("original")).join(bad.select("path"), "path", "left_semi")
    out = (named.select("path", handler_of("ext").alias("handler"))
           .join(rebuilt, "path", "left")
           .join(bad, "path", "left")
           .join(originals, "path", "left")
           .join(final_paths(named, bad, work), "path"))
    is_text = F.col("handler").isin(text_handlers())
    out = out.select(
        "path", "path_out", "handler",
        F.when(F.col("failed"), "error").when(is_text, "ok").otherwise(F.col("handler")).alias("status"),
        F.when(F.col("failed"), F.col("original")).when(is_text, F.coalesce("text", F.lit(""))).alias("text"))
    name_errors = (folders.filter(F.col("how") == "error").select(F.col("dir").alias("path"), F.lit("folder_name").alias("stage"),
                                                                  F.col("name_error").alias("error"))
                   .unionByName(named.filter(F.col("how") == "error").select("path", F.lit("file_name").alias("stage"),
                                                                             F.col("name_error").alias("error"))))
    calls = work.replies["names/folders"].unionByName(work.replies["names/files"])
    layout = None if lay is None else layout_style(apply_translations(lay, batch.translations))
    return CorpusResult(out, named, folders, batch, failed.unionByName(name_errors), calls, bad, layout)


def final_paths(named: DataFrame, failed: DataFrame, work: WorkDir | None = None) -> DataFrame:
    """``path, path_out`` of all files: failed ones keep their own names in the translated
    folder (K7), and no two outputs share a path."""
    f = named.select("path", "dir_en", "stem", "stem_en", "suffix").join(
        failed.select("path").distinct().withColumn("__bad", F.lit(True)), "path", "left")
    return unique_paths(f.select("path", "dir_en", F.when(F.col("__bad"), F.col("stem")).otherwise(F.col("stem_en")).alias("stem"),
                                 "suffix"), work)


def corpus_usage(result: CorpusResult, settings: Settings = DEFAULT) -> DataFrame:
    """A8 for a whole run: content chunks, single fallbacks and every name call."""
    from ..operators.estimate import usage_totals
    return usage_totals(result.batch, result.name_calls.select("input_tokens", "output_tokens"), settings=settings)


def error_summary(errors: DataFrame) -> DataFrame:
    """Number of failed files per stage; the messages stay in the error rows."""
    return errors.groupBy("stage").agg(F.countDistinct("path").alias("n_files"))
