"""File-system sources: corpus listing (S1), file bytes, archive members.

The listing is a level-wise distributed walk: each round is one Spark job
that lists a DataFrame of directories with ``os.scandir`` inside
``mapInPandas`` and writes the level before the next round reads it, so
lineage never grows with depth.  A folder is one stream of names that leaves its task in batches, however many
it holds; sizes are asked for afterwards, by tasks that share all files evenly.  Hidden names, empty files, empty folders
and symlinked folders (listed, not followed) are all kept, which
``binaryFile`` + ``recursiveFileLookup`` would drop.
"""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_ext, name_stem, name_suffix
from ..session import WorkDir, work_dir

ENTRY_SCHEMA = T.StructType([
    T.StructField("rel_dir", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("is_link", T.BooleanType()),
    T.StructField("length", T.LongType()),
    T.StructField("error", T.StringType()),
])
#: folders that one listing task takes on, entries that leave it at once, and files whose size one task asks for
DIRS_PER_TASK, LIST_BATCH, SIZES_PER_TASK = 200, 10_000, 50_000


def list_tree(spark: SparkSession, root: str, work: WorkDir | None = None) -> DataFrame:
    """Every entry under ``root``: ``path, rel_dir, name, is_dir, is_link, length, error``.

    ``path`` and ``rel_dir`` are relative to ``root`` with '/' separators.  An entry
    whose state can't be read (a dangling link, say) is a file of length 0 with
    ``error``; a folder that can't be listed has ``error`` and no entries.  Levels are
    listed until one is empty, however deep.
    """
    work = work or work_dir(spark)
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such folder: {root}")

    def entry(rel, e):
        try:
            return rel, e.name, e.is_dir(follow_symlinks=True), e.is_symlink(), 0, None
        except OSError as exc:
            return rel, e.name, False, e.is_symlink(), 0, f"{type(exc).__name__}: {exc}"

    names = ENTRY_SCHEMA.fieldNames()

    def scan(batches):
        for pdf in batches:
            out = []
            for rel in pdf["rel"]:
                full = os.path.join(root, rel) if rel else root
                try:
                    with os.scandir(full) as it:
                        for e in it:
                            out.append(entry(rel, e))
                            if len(out) >= LIST_BATCH:
                                yield pd.DataFrame(out, columns=names)
                                out = []
                except OSError as exc:   # the folder's own row is in the level above; this one carries the reason
                    out.append((rel, None, True, False, 0, f"{type(exc).__name__}: {exc}"))
            if out:
                yield pd.DataFrame(out, columns=names)

    def sized(batches):
        for pdf in batches:
            size, error = [], []
            for rel, name in zip(pdf["rel_dir"], pdf["name"]):
                try:
                    size.append(os.stat(os.path.join(root, rel, name)).st_size)
                    error.append(None)
                except OSError as exc:
                    size.append(0)
                    error.append(f"{type(exc).__name__}: {exc}")
            yield pdf.assign(length=size, error=error)

    level, n_dirs, depth = spark.createDataFrame([("",)], "rel string"), 1, 0
    while n_dirs:
        n_tasks = -(-n_dirs // DIRS_PER_TASK)
        found = work.materialize(level.repartition(n_tasks).mapInPandas(scan, ENTRY_SCHEMA), f"listing/level={depth}")
        # descend into real folders only (a symlinked folder is listed, not followed)
        level = found.filter(F.col("is_dir") & ~F.col("is_link") & F.col("name").isNotNull()).select(
            F.concat_ws("/", F.when(F.col("rel_dir") != "", F.col("rel_dir")), F.col("name")).alias("rel"))
        n_dirs, depth = level.count(), depth + 1
    # one table for all levels, however many there are
    found = spark.read.schema(ENTRY_SCHEMA).parquet(work.table("listing")).select(*names)
    files = found.filter(~F.col("is_dir") & F.col("error").isNull())
    n_tasks = max(1, -(-files.count() // SIZES_PER_TASK))
    files = work.materialize(files.repartition(n_tasks, "rel_dir", "name").mapInPandas(sized, ENTRY_SCHEMA), "listing-sizes")
    out = found.filter(F.col("is_dir") | F.col("error").isNotNull()).unionByName(files)
    return out.select(F.concat_ws("/", F.when(F.col("rel_dir") != "", F.col("rel_dir")), F.col("name")).alias("path"),
                      "rel_dir", "name", "is_dir", "is_link", "length", "error")


def listing_errors(entries: DataFrame) -> DataFrame:
    """``path, stage, error`` of what the listing could not read."""
    return entries.filter(F.col("error").isNotNull()).select("path", F.lit("list").alias("stage"), "error")


def files_of(entries: DataFrame) -> DataFrame:
    """Files of a listing with C5 parts: ``path, rel_dir, name, stem, suffix, ext, length``."""
    return (entries.filter(~F.col("is_dir") & F.col("name").isNotNull())
            .select("path", "rel_dir", "name", name_stem("name").alias("stem"),
                    name_suffix("name").alias("suffix"), name_ext("name").alias("ext"), "length"))


def folders_of(entries: DataFrame) -> DataFrame:
    """Folders (including empty ones): ``path, rel_dir, name``."""
    return entries.filter(F.col("is_dir") & F.col("name").isNotNull()).select("path", "rel_dir", "name")


#: bytes that leave a reading task at once, and that one task reads
READ_BYTES, READ_TASK_BYTES = 8 << 20, 256 << 20


def read_bytes(files: DataFrame, root: str) -> DataFrame:
    """Adds ``content BINARY`` read by path inside tasks (empty files included)."""
    root = os.path.abspath(root)
    schema = T.StructType(list(files.schema.fields) + [T.StructField("content", T.BinaryType()),
                                                       T.StructField("read_error", T.StringType())])

    def run(batches):
        for pdf in batches:
            at, data, errs, size = 0, [], [], 0
            for i, p in enumerate(pdf["path"]):
                try:
                    with open(os.path.join(root, p), "rb") as fh:
                        data.append(fh.read())
                    errs.append(None)
                    size += len(data[-1])
                except OSError as exc:
                    data.append(None)
                    errs.append(f"{type(exc).__name__}: {exc}")
                if size >= READ_BYTES:      # some MB leave at a time, however many paths a batch has
                    yield pdf.iloc[at:i + 1].assign(content=data, read_error=errs)
                    at, data, errs, size = i + 1, [], [], 0
            if at < len(pdf):
                yield pdf.iloc[at:].assign(content=data, read_error=errs)

    # listing tables are small and would be read by few tasks: tasks follow the bytes to read
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // READ_TASK_BYTES), min(files.sparkSession.sparkContext.defaultParallelism, 1 + int(total) // READ_BYTES))
    return files.repartition(n, "path").mapInPandas(run, schema)


PART_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("part", T.StringType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("error", T.StringType()),
    T.StructField("date_time", T.ArrayType(T.IntegerType())),
    T.StructField("compress_type", T.IntegerType()),
])


def archive_parts(packages: DataFrame, content_col: str = "content") -> DataFrame:
    """Every zip member as ``path, ord, part, data``, order kept.

    A package that cannot be read yields one row with ``part`` null and the
    error, so it is isolated (T7) instead of failing the job.
    """
    def run(batches):
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf[content_col]):
                out = []           # one package at a time
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
                        for i, info in enumerate(z.infolist()):
                            out.append((path, i, info.filename, z.read(info.filename), None,
                                        list(info.date_time), info.compress_type))
                except Exception as exc:  # noqa: BLE001
                    out = [(path, -1, None, None, f"{type(exc).__name__}: {exc}", None, None)]
                yield pd.DataFrame(out, columns=PART_SCHEMA.fieldNames())

    return packages.select("path", content_col).mapInPandas(run, PART_SCHEMA)
