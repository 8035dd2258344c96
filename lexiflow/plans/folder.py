"""translate_folder: a folder tree in, its translated mirror out (T8 on storage).

listing (S1) -> bytes (read once, written) -> routing (F4) -> text decode (S3)
-> names and text contents (:func:`translate_corpus`) -> packages
(:func:`translate_packages`) -> writers (K1-K3, K5-K7) and empty folders.
A file whose content stage fails is copied under its original name into the
translated folder (K7); so is one whose output can't be written, or into its original folder where that can't be
made either.  What can't be listed or read is an error row and never an empty output.  The output is put in place
when all is written (:mod:`lexiflow.sinks.files`).  PDF decoding is not rebuilt, so ``.pdf`` files are
copied and reported; their layout work runs on a ``spans`` table.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import document_context, name_stem, name_suffix
from ..operators.routing import TEXT_HANDLERS, handler_of, text_handlers
from ..session import WorkDir, work_dir
from ..sinks.files import FileTree, files as plain_files, folders as plain_folders, packages as zip_members
from ..sources.files import archive_parts, files_of, folders_of, list_tree, listing_errors, read_bytes
from ..sources.text import decode_files
from ..operators.names import translate_dir_paths, unique_paths
from .corpus import CorpusResult, final_paths, translate_corpus
from .packages import PackageResult, translate_packages


@dataclass
class FolderResult:
    written: DataFrame      # path_out, bytes, error (one row per file or folder written)
    corpus: CorpusResult
    errors: DataFrame       # path, stage, error
    packages: PackageResult


def folder_usage(result: FolderResult, settings: Settings = DEFAULT) -> DataFrame:
    """A8 for a whole folder: text and package chunks, single fallbacks and every name call."""
    from ..operators.estimate import usage_totals
    return usage_totals(result.corpus.batch, result.packages.batch,
                        result.corpus.name_calls.select("input_tokens", "output_tokens"), settings=settings)


def translate_folder(spark: SparkSession, src: str, dst: str, translator, settings: Settings = DEFAULT,
                     mode: str = "errorifexists", work: WorkDir | None = None, spans: DataFrame | None = None,
                     max_pages: int | None = None) -> FolderResult:
    """``spans``, ``max_pages``: the layout path, see :func:`translate_corpus`."""
    with FileTree(spark, dst, mode) as tree:     # nothing is in place before all is written
        return _translate_into(tree, spark, src, translator, settings, work or work_dir(spark), spans, max_pages)


def _translate_into(tree: FileTree, spark: SparkSession, src: str, translator, settings: Settings, work: WorkDir,
                    spans: DataFrame | None, max_pages: int | None) -> FolderResult:
    root_name = os.path.basename(os.path.abspath(src))
    entries = list_tree(spark, src, work)
    files = files_of(entries)
    blobs = work.materialize(read_bytes(files, src).withColumn("handler", handler_of("ext")), "folder/bytes")
    unread = blobs.filter(F.col("read_error").isNotNull()).select("path", F.lit("read").alias("stage"),
                                                                  F.col("read_error").alias("error"))
    # charset detection is the slowest step and its result is read several times: written once
    known = ["path", "rel_dir", "name", "stem", "suffix", "ext"]
    decoded = F.col("handler").isin(text_handlers()) & F.col("read_error").isNull()
    texts = decode_files(blobs.filter(decoded).select(*known, "content"), keep=known).select(*known, "text")
    meta = work.materialize(texts.unionByName(blobs.filter(~decoded).select(*known, F.lit(None).cast("string").alias("text"))), "folder/texts")
    corpus = translate_corpus(meta, root_name, translator, settings, work, spans, max_pages, unread,
                              folders_of(entries).select(F.col("path").alias("rel_dir")))

    # packages
    named = corpus.names.select("path", "name", "dir_en", "folder_context", "name_en", "stem", "stem_en", "suffix")
    pk = (blobs.filter(F.col("handler").isin("docx", "xlsx") & F.col("read_error").isNull()).select("path", "ext", "content")
          .join(named.select("path", "folder_context", "name_en"), "path")
          .withColumn("context", document_context("name_en", "folder_context")))
    parts = archive_parts(pk.select("path", "content"))
    pres = translate_packages(pk.select("path", "ext", "context"), parts, translator, settings, work)
    bad_pk = work.materialize(pres.errors.select("path").distinct(), "folder/bad_packages")
    # one uniqueness pass over every output, failed files under their own names included
    failed = corpus.failed.select("path").unionByName(bad_pk)
    paths = work.materialize(final_paths(corpus.names, failed, work), "folder/paths")

    text_out = (corpus.files.filter(F.col("handler").isin(text_handlers()) & (F.col("status") == "ok"))
                .select("path", F.encode("text", "UTF-8").alias("data")))
    built_in = F.col("handler").isin(*text_handlers(), "docx", "xlsx")
    # copies: other handlers, and every file whose content stage failed; never a file that could not be read
    copies = (blobs.filter(F.col("read_error").isNull()).select("path", "handler", F.col("content").alias("data"))
              .join(failed.distinct().withColumn("__bad", F.lit(True)), "path", "left")
              .filter(F.col("__bad") | ~built_in).select("path", "data"))
    tree.write(plain_files(text_out.unionByName(copies).join(paths, "path")))
    tree.write(zip_members(pres.parts.join(bad_pk, "path", "left_anti").join(paths, "path")))
    dirs = translate_dir_paths(corpus.folders, root_name, work).filter(F.col("rel_dir") != "")
    tree.write(plain_folders(dirs, "rel_dir", "dir_en", "rel_dir"))
    first = work.materialize(tree.results(), "folder/first_writes")
    lost = first.filter(~F.col("written") & F.col("kind").isin("file", "package"))
    if lost.limit(1).count():       # K7 for writes: the original under its own name, in the translated folder or else in its own
        tree.write(_rescued(first, lost, corpus.names, blobs, work))
    last = Window.partitionBy("path", F.col("kind") == "dir").orderBy(F.desc("written"), "error")
    written = work.materialize(tree.results().withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r"), "folder/written")
    tree.commit()
    unwritten = (first.filter(F.col("error").isNotNull()).select("path", F.lit("write").alias("stage"), "error")
                 .unionByName(written.filter(~F.col("written") & (F.col("kind") != "dir")).select("path", F.lit("lost").alias("stage"), "error")))
    written = written.select("path_out", "bytes", F.when(~F.col("written"), F.col("error")).alias("error"))
    note = (corpus.files.filter(F.col("handler") == "layout")
            .select("path", F.lit("layout").alias("stage"), F.lit("pdf decoding not available; copied").alias("error")))
    if spans is not None:
        note = note.join(spans.select("path").distinct(), "path", "left_anti")
    errors = (corpus.errors.unionByName(pres.errors).unionByName(listing_errors(entries)).unionByName(unwritten)
              .unionByName(note))
    return FolderResult(written, corpus, errors, pres)


def _rescued(first: DataFrame, lost: DataFrame, names: DataFrame, blobs: DataFrame, work: WorkDir) -> DataFrame:
    """Members of the files that could not be written: their original bytes, and two names that no output has."""
    split = lambda c: [F.regexp_extract(c, "(?s)^(.*)/[^/]*$", 1).alias("dir_en"), F.regexp_extract(c, "[^/]*$", 0).alias("n")]
    own = lost.select("path").distinct().join(names.select("path", "dir_en", "rel_dir", "name"), "path")
    taken = first.filter(F.col("written") & (F.col("kind") != "dir")).select(F.concat(F.lit("0"), "path_out").alias("path"), *split("path_out"))
    asked = (taken.unionByName(own.select(F.concat(F.lit("1"), "path").alias("path"), "dir_en", F.col("name").alias("n")))
             .unionByName(own.select(F.concat(F.lit("2"), "path").alias("path"), F.col("rel_dir").alias("dir_en"), F.col("name").alias("n"))))
    given = unique_paths(asked.select("path", "dir_en", name_stem("n").alias("stem"), name_suffix("n").alias("suffix")), work)
    given = given.filter(~F.col("path").startswith("0")).select(F.substring("path", 1, 1).alias("o"), F.expr("substring(path, 2)").alias("path"), "path_out")
    targets = given.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("o", "path_out"))).alias("t")).select("path", F.col("t.path_out").alias("targets"))
    return (blobs.select("path", F.col("content").alias("data")).join(targets, "path")
            .select(F.lit("file").alias("kind"), "path", "targets", "data"))


@dataclass
class EstimateResult:
    breakdown: DataFrame   # path, name, ext, jp_chars (largest first)
    totals: DataFrame      # one row: chars, name calls, tokens, dollars, nothing_to_do
    unique: DataFrame      # one row: strings and characters that the run would send, and the estimate's error (Q12)


def estimate_folder(spark: SparkSession, src: str, settings: Settings = DEFAULT, work: WorkDir | None = None,
                    spans: DataFrame | None = None, max_pages: int | None = None) -> EstimateResult:
    """T11 on a folder: no model call, one pass over the supported files.

    Uses the run's own unit sources (charset detection included, Q13) and
    counts every occurrence (Q12).  Name calls: distinct source-script
    folder names and file stems over the tree, plus every source-script
    ``name="..."`` of each workbook part without dedup (Q15).
    """
    from ..operators.estimate import breakdown, corpus_estimate, file_char_totals, name_calls, unique_chars
    from ..operators.routing import is_supported
    from ..sources.csv_cells import csv_cells
    from ..sources.text import explode_lines
    from .packages import package_units, prepare_parts, scope_path

    work = work or work_dir(spark)
    entries = list_tree(spark, src, work)
    files = files_of(entries).withColumn("handler", handler_of("ext"))
    read = F.col("handler").isin(*text_handlers(), "docx", "xlsx")      # no other file's bytes are looked at
    blobs = work.materialize(read_bytes(files.filter(is_supported("ext") & read), src), "estimate/bytes")
    texts = decode_files(blobs.filter(F.col("handler").isin(text_handlers())).select("path", "content")) \
        .join(blobs.select("path", "handler"), "path")
    u_lines = explode_lines(texts.filter(F.col("handler") == "lines"), "text", keep=["path"]).select("path", "text")
    u_csv = csv_cells(texts.filter(F.col("handler") == "csv").select("path", "text")) \
        .filter(F.col("col") >= 0).select("path", "text")
    pk = blobs.filter(F.col("handler").isin("docx", "xlsx")).select("path", "ext", F.lit("").alias("context"))
    p, _ = prepare_parts(pk, archive_parts(blobs.join(pk.select("path"), "path", "left_semi")), work)
    pu = package_units(p, settings)
    u_pk = pu.units.filter(~F.col("scope").endswith("\u0001tabs")).select(scope_path("scope").alias("path"), "scope", "text")
    units = u_lines.unionByName(u_csv)
    for h in TEXT_HANDLERS.values():
        units = units.unionByName(h.units(texts.filter(F.col("handler") == h.name).select("path", "text"))
                                  .filter(F.col("text").isNotNull()).select("path", "text"))
    if spans is not None:   # the layout lines that the run would read, within the page limit (Q16)
        from ..operators.layout import layout_lines
        pages = layout_lines(spans, max_pages=max_pages).select("path", F.concat_ws("#", "path", "page").alias("scope"), "text")
    # a package's scopes are its parts, a layout's its pages: the run sends a string once in each
    units = units.withColumn("scope", F.col("path")).unionByName(u_pk)
    if spans is not None:
        units = units.unionByName(pages)
    tabs = (p.filter(F.col("kind") == "workbook")
            .select(F.explode(F.regexp_extract_all("xml", F.lit(r'name="([^"]+)"'), 1)).alias("name")))
    calls = name_calls(folders_of(entries), files, tabs, settings)
    totals = file_char_totals(units, settings)
    return EstimateResult(breakdown(files, totals), corpus_estimate(units, calls, settings), unique_chars(units, ["scope"], settings=settings))
