"""Folder and file names.

Stage A translates folder names (context: the *original* parent name),
stage B file stems (context: the *translated* folder path).  Each stage is
written before the next reads it.  Path rebuild (J4) is computed per
distinct folder, not per file, then joined to files on ``rel_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.script import has_script
from ..functions.text import file_name_context, folder_context, folder_name_context
from ..session import WorkDir, work_dir
from .call import call_names, reply_tag
from .numbering import free_numbers, with_numbers


def folder_table(files: DataFrame, root_name: str) -> DataFrame:
    """Every folder that holds a file, and all its ancestors.

    ``files`` has ``rel_dir`` ('' at the top, parts joined by '/').  Output:
    ``dir, name, level (1 = top), parent_name, context``.  Folders without
    files are passed in as ``rel_dir`` rows by the folder job.
    """
    dirs = files.select("rel_dir").filter(F.col("rel_dir") != "").distinct()
    parts = dirs.select(F.split("rel_dir", "/").alias("p"))
    ex = parts.select("p", F.posexplode("p").alias("i", "name"))
    out = ex.select(
        F.array_join(F.slice("p", 1, F.col("i") + 1), "/").alias("dir"),
        "name", (F.col("i") + 1).alias("level"),
        F.when(F.col("i") == 0, F.lit(root_name)).otherwise(F.element_at("p", F.col("i"))).alias("parent_name"),
    ).distinct()
    return out.withColumn("context", folder_name_context("parent_name"))


def _needs_call(name_col: str, settings: Settings):
    return F.lit(True) if settings.translate_all_names else has_script(name_col, settings.profile)


def translate_names(names: DataFrame, translator, settings: Settings, work: WorkDir, table: str) -> DataFrame:
    """T5 over distinct ``(name, context)``; names without source script keep
    their text unless ``translate_all_names`` (Q14).  Output adds ``name_en``,
    ``how`` ('model' | 'kept' | 'error'), tokens and ``error``.
    """
    todo = names.select("name", "context").filter(_needs_call("name", settings)).distinct()
    called = work.paid(todo, lambda t, n: call_names(t, translator, settings, n), table, ["name", "context"], settings.calls_per_wave,
                       {"spark.sql.execution.arrow.maxRecordsPerBatch": settings.call_batch_rows}, tag=reply_tag(settings))
    kept = (names.select("name", "context").filter(~_needs_call("name", settings)).distinct()
            .select("name", "context", F.col("name").alias("name_en"), F.lit("kept").alias("how"),
                    F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
                    F.lit(None).cast("string").alias("error")))
    model = called.select("name", "context", safe_name(F.col("name_en"), F.col("name")).alias("name_en"),
                          F.when(F.col("status") == "ok", "model").otherwise("error").alias("how"),
                          "input_tokens", "output_tokens", "error")
    return model.unionByName(kept)


def translate_folders(files: DataFrame, root_name: str, translator, settings: Settings = DEFAULT,
                      work: WorkDir | None = None, table: str = "names/folders",
                      more_dirs: DataFrame | None = None) -> DataFrame:
    """Stage A: ``dir, name, level, context, name_en, how, name_error``.  The calls are
    written to ``table`` in the work folder (one table per stage).  ``more_dirs``: folders
    without files (``rel_dir``), named in the same stage, so no ancestor is asked for twice."""
    work = work or work_dir(files.sparkSession)
    dirs = files.select("rel_dir") if more_dirs is None else files.select("rel_dir").unionByName(more_dirs.select("rel_dir"))
    folders = folder_table(dirs, root_name)
    names = translate_names(folders, translator, settings, work, table)
    return folders.join(names.select("name", "context", "name_en", "how", F.col("error").alias("name_error")),
                        ["name", "context"], "left")


def translate_dir_paths(folders_en: DataFrame, root_name: str, work: WorkDir | None = None) -> DataFrame:
    """Every folder's translated path, each ancestor replaced by its own
    translation.  Output ``rel_dir, dir_en, folder_context`` (+ top level '').

    Pointer jumping: a folder knows its names from an ancestor down to itself, and each round joins it to that
    ancestor, which doubles the distance; log2(depth) rounds, each written.  No path is cut into all its prefixes.
    """
    work = work or work_dir(folders_en.sparkSession)
    name = f"paths-{uuid.uuid4().hex[:8]}"
    step = F.split("dir", "/")
    above = F.when(F.size(step) > 1, F.array_join(F.slice(step, 1, F.size(step) - 1), "/"))
    state = work.materialize(folders_en.select("dir", above.alias("up"), F.size(step).alias("depth"),
                                               F.array(F.coalesce("name_en", "name")).alias("parts")), f"{name}/round0")
    depth, reach = state.agg(F.max("depth")).first()[0] or 0, 1
    while reach < depth:
        upper = state.select(F.col("dir").alias("up"), F.col("up").alias("__up"), F.col("parts").alias("__parts"))
        none = F.array().cast("array<string>")
        state = state.join(upper, "up", "left").select("dir", F.col("__up").alias("up"), F.concat(F.coalesce("__parts", none), "parts").alias("parts"))
        reach *= 2
        if reach < depth:
            state = work.materialize(state, f"{name}/round{reach}")
    top = folders_en.sparkSession.createDataFrame([("",)], "rel_dir string").select(
        "rel_dir", F.array().cast("array<string>").alias("parts"))
    return (state.select(F.col("dir").alias("rel_dir"), "parts").unionByName(top)
            .select("rel_dir", F.array_join("parts", "/").alias("dir_en"),
                    folder_context("parts", F.lit(root_name)).alias("folder_context")))


def translate_file_names(files: DataFrame, dir_paths: DataFrame, translator, settings: Settings = DEFAULT,
                         work: WorkDir | None = None, table: str = "names/files") -> DataFrame:
    """Stage B: files + ``folder_context, stem_en, name_en, path_en, how, name_error``.

    ``path_en`` is unique over these files (:func:`unique_paths`); a job that lets some
    files keep their names makes the final paths unique over all of them.
    """
    work = work or work_dir(files.sparkSession)
    f = files.join(dir_paths, "rel_dir", "left")
    f = f.withColumn("name_context", file_name_context("folder_context"))
    names = translate_names(f.select(F.col("stem").alias("name"), F.col("name_context").alias("context")),
                            translator, settings, work, table)
    f = (f.join(names.select(F.col("name").alias("stem"), F.col("context").alias("name_context"),
                             F.col("name_en").alias("stem_en0"), "how", F.col("error").alias("name_error")),
                ["stem", "name_context"], "left")
         .withColumn("stem_en0", F.coalesce("stem_en0", "stem")))
    f = f.withColumnRenamed("stem_en0", "stem_en")
    f = f.withColumn("name_en", F.concat("stem_en", "suffix"))
    return f.join(unique_paths(f.select("path", "dir_en", F.col("stem_en").alias("stem"), "suffix"), work)
                  .withColumnRenamed("path_out", "path_en"), "path")


def safe_name(name, original) -> F.Column:
    """A model's answer as one path step: separators and control characters become '-', and
    an answer that is empty, ``.`` or ``..`` leaves the original name."""
    n = F.regexp_replace(name, r"[/\\\x00-\x1F]", "-")
    return F.when(n.isNull() | F.trim(n).isin("", ".", ".."), original).otherwise(n)


#: files of one name up to which one task numbers them
HOT_NAME = 10_000


def unique_paths(files: DataFrame, work: WorkDir | None = None) -> DataFrame:
    """Q11 over final names: ``path, dir_en, stem, suffix`` -> ``path, path_out``, no two alike whatever the case.

    The first path of a name keeps it; the others take ``_2``, ``_3``..., passing over numbers that
    another file of the folder has by its own name.  A name with a given number has one base only,
    so given names can't meet.

    Only names that collide are numbered: by a window where a name has up to ``HOT_NAME`` files, else by
    :func:`with_numbers`; taken numbers are passed over by :func:`free_numbers`.  The work is linear in the files.
    """
    work = work or work_dir(files.sparkSession)
    name = f"unique-{uuid.uuid4().hex[:8]}"
    key = ["d", "s", "x"]
    low = {"d": F.coalesce(F.lower("dir_en"), F.lit("")), "s": F.coalesce(F.lower("stem"), F.lit("")), "x": F.coalesce(F.lower("suffix"), F.lit(""))}
    f = work.materialize(files.select("path", "dir_en", "stem", "suffix").withColumns(low), f"{name}/names")
    out = lambda df: df.select("path", F.concat_ws("/", F.when(F.col("dir_en") != "", F.col("dir_en")),
                                                   F.concat("stem", F.coalesce("suffix", F.lit("")))).alias("path_out"))
    alike = work.materialize(f.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where("held > 1"), f"{name}/alike")
    most = alike.agg(F.max("held")).first()[0]
    if most is None:
        return out(f)
    calm, hot = alike.where(F.col("held") <= HOT_NAME), alike.where(F.col("held") > HOT_NAME)
    w = Window.partitionBy(*key).orderBy("path")
    ranked = f.join(calm.select(*key), key, "left_semi").withColumn("k", F.row_number().over(w).cast("long") - 1)
    if most > HOT_NAME:
        ranked = ranked.unionByName(with_numbers(f.join(hot.select(*key), key, "left_semi"), key, ["path"], work, f"{name}/hot", "k"))
    ranked = work.materialize(ranked, f"{name}/ranked")
    # names that look numbered, by the base they would be numbers of
    m = r"^(.*)_([1-9][0-9]{0,8})$"
    base = f.where(F.col("s").rlike(m)).select("d", F.regexp_extract("s", m, 1).alias("s"), "x", F.regexp_extract("s", m, 2).try_cast("int").alias("n"))
    again = free_numbers(ranked.where("k > 0"), base, key, "k", "number", work, f"{name}/free")
    named = again.withColumn("stem", F.concat("stem", F.lit("_"), F.col("number").cast("string")))
    same = ["path", "dir_en", "stem", "suffix"]
    return out(f.join(alike.select(*key), key, "left_anti").select(*same).unionByName(ranked.where("k = 0").select(*same))
               .unionByName(named.select(*same)))
