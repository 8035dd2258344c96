"""File sinks (K1, K2, K5, K6, K7) and the package writer (K3) as one Spark data source with a commit protocol.

``df.write.format("lexiflow_files")`` takes *members*: one row per plain file (``part`` null), one per member of a
package, one per folder (``kind`` = ``dir``), rows of one package together and in order.  Tasks write into a mirror
of the output beside it, ``.<name>.lexiflow-<id>/tree``, each file under a temporary name outside the mirror and
then renamed into it, so a retried attempt rewrites the same file and a failed one leaves nothing in the mirror.
A package is streamed member by member.  What each row came to is a line of the task's result file, which counts once the
driver has committed that task.

:class:`FileTree` holds the protocol of a whole output: jobs write into the mirror, files that could not be written get
another attempt under other names, and ``commit`` puts the mirror in place, by one rename where nothing is there yet.
A run that fails before that leaves the output as it was.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "lexiflow_files"
MEMBER_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),                        # file | package | dir
    T.StructField("path", T.StringType()),                        # what the row came from
    T.StructField("targets", T.ArrayType(T.StringType())),        # relative output paths: the first that can be written is taken
    T.StructField("part", T.StringType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("changed", T.BooleanType()),
    T.StructField("date_time", T.ArrayType(T.IntegerType())),
    T.StructField("compress_type", T.IntegerType()),
])
RESULT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("path_out", T.StringType()),                    # the target taken, or the first one that failed
    T.StructField("bytes", T.LongType()),
    T.StructField("error", T.StringType()),                       # of the first target, also where a later one was taken
    T.StructField("written", T.BooleanType()),
])


def check_target(dst_root: str, mode: str = "errorifexists") -> None:
    """K6: refuse to write into an existing non-empty output unless ``overwrite``."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be 'errorifexists' or 'overwrite'")
    if mode == "errorifexists" and os.path.isdir(dst_root) and os.listdir(dst_root):
        raise FileExistsError(f"output exists: {dst_root} (use mode='overwrite')")


class _Task:
    """One attempt of a task: temporary files of its own, results line by line."""

    def __init__(self, staging: str):
        self.tree = os.path.join(staging, "tree")
        self.own = os.path.join(staging, "tasks", uuid.uuid4().hex)
        os.makedirs(self.own)
        self.log = open(os.path.join(self.own, "results"), "w", encoding="utf-8")

    def said(self, row, out: str | None, size: int, error: str | None, written: bool) -> None:
        self.log.write(json.dumps(dict(zip(RESULT_SCHEMA.fieldNames(), (row.kind, row.path, out, size, error, written)))) + "\n")

    def placed(self, row, temp: str | None) -> None:
        """Put the temporary file (None: a folder) at the first target that takes it."""
        first = None
        size = os.path.getsize(temp) if temp else 0
        for target in row.targets:
            full = os.path.join(self.tree, target)
            try:
                if temp is None:
                    os.makedirs(full, exist_ok=True)
                else:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    os.replace(temp, full)
                self.said(row, target, size, first, True)
                return
            except (OSError, ValueError) as exc:
                first = first or f"{type(exc).__name__}: {exc}"
        if temp:
            os.remove(temp)
        self.said(row, row.targets[0] if row.targets else None, 0, first or "no target", False)

    def file(self, row) -> None:
        temp = os.path.join(self.own, "file")
        try:
            with open(temp, "wb") as fh:
                fh.write(bytes(row.data) if row.data is not None else b"")
        except OSError as exc:
            self.said(row, row.targets[0], 0, f"{type(exc).__name__}: {exc}", False)
            return
        self.placed(row, temp)

    def package(self, rows) -> None:
        """Members as they come: rewritten ones get fresh metadata and are deflated, others keep theirs (K3)."""
        temp, bad, first = os.path.join(self.own, "package"), None, None
        try:
            with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
                for row in rows:
                    first = first or row
                    if row.changed or row.date_time is None:
                        info = zipfile.ZipInfo(row.part)
                        info.compress_type = zipfile.ZIP_DEFLATED
                    else:
                        info = zipfile.ZipInfo(row.part, date_time=tuple(row.date_time))
                        info.compress_type = row.compress_type
                    z.writestr(info, bytes(row.data))
        except Exception as exc:  # noqa: BLE001 - one package is isolated
            bad = f"{type(exc).__name__}: {exc}"
        for _ in rows:                                            # what is left of a package that failed
            pass
        if bad is None:
            self.placed(first, temp)
        else:
            self.said(first, first.targets[0], 0, bad, False)


def _by_package(rows):
    """(first row, rows) of consecutive rows of one file."""
    from itertools import groupby
    for _, group in groupby(rows, key=lambda r: (r.kind, r.path)):
        yield group


@dataclass
class _Done(WriterCommitMessage):
    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator):
        task = _Task(self.staging)
        for group in _by_package(iterator):
            first = next(group)
            if first.kind == "package":
                from itertools import chain
                task.package(chain([first], group))
                continue
            for row in [first, *group]:
                if row.kind == "dir":
                    task.placed(row, None)
                else:
                    task.file(row)
        task.log.close()
        return _Done(task.own)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.rename(os.path.join(m.folder, "results"), os.path.join(self.staging, "results", os.path.basename(m.folder) + ".json"))

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)           # the whole output: nothing of it was in place yet


class FilesSource(DataSource):
    """``format("lexiflow_files")``; option ``staging``: the folder of a :class:`FileTree`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return MEMBER_SCHEMA

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["staging"])


class FileTree:
    """An output tree in the making; a context manager that aborts on an exception."""

    def __init__(self, spark: SparkSession, dst: str, mode: str = "errorifexists"):
        check_target(dst, mode)
        self.spark, self.dst = spark, os.path.abspath(dst)
        parent = os.path.dirname(self.dst)
        self.staging = os.path.join(parent, f".{os.path.basename(self.dst)}.lexiflow-{uuid.uuid4().hex[:12]}")
        for d in ("tree", "tasks", "results"):
            os.makedirs(os.path.join(self.staging, d))
        spark.dataSource.register(FilesSource)

    def __enter__(self) -> "FileTree":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.abort()

    def write(self, members: DataFrame) -> None:
        """One job: rows of :data:`MEMBER_SCHEMA` (missing columns are null), packages sorted within partitions."""
        cols = [F.col(f.name).cast(f.dataType) if f.name in members.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MEMBER_SCHEMA.fields]
        members.select(*cols).write.format(FORMAT).mode("append").option("staging", self.staging).save()

    def results(self) -> DataFrame:
        """What committed tasks have written so far, and what they could not."""
        return self.spark.read.schema(RESULT_SCHEMA).json("file://" + os.path.join(self.staging, "results"))

    def commit(self) -> None:
        """Put the mirror in place: one rename, or file by file in tasks where the output has files already."""
        tree = os.path.join(self.staging, "tree")
        if not os.path.isdir(self.dst) or not os.listdir(self.dst):
            os.rename(tree, self.dst)                             # onto nothing or an empty folder
        else:
            dst = self.dst

            def move(batches):
                for pdf in batches:
                    for kind, out in zip(pdf["kind"], pdf["path_out"]):
                        a, b = os.path.join(tree, out), os.path.join(dst, out)
                        if kind == "dir":
                            os.makedirs(b, exist_ok=True)
                        else:
                            os.makedirs(os.path.dirname(b), exist_ok=True)
                            if os.path.exists(a):                 # a retried task finds what it has moved already
                                os.replace(a, b)
                    yield pdf[["path_out"]].iloc[:0]
            self.results().where("written").select("kind", "path_out").mapInPandas(move, "path_out string").count()
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def files(df: DataFrame, path_col: str = "path", target_col: str = "path_out", data_col: str = "data") -> DataFrame:
    """K1 / K2 / K5 / K7: members of plain files."""
    return df.select(F.lit("file").alias("kind"), F.col(path_col).alias("path"), F.array(target_col).alias("targets"), F.col(data_col).alias("data"))


def folders(df: DataFrame, path_col: str, *target_cols: str) -> DataFrame:
    """Members of folders (empty source folders stay in the mirror)."""
    return df.select(F.lit("dir").alias("kind"), F.col(path_col).alias("path"), F.array(*target_cols).alias("targets"))


def packages(parts: DataFrame) -> DataFrame:
    """K3: parts (``path, path_out, ord, part, data, changed, date_time, compress_type``) as members, a package in one task."""
    return (parts.select(F.lit("package").alias("kind"), "path", F.array("path_out").alias("targets"), "ord", "part", "data", "changed",
                         "date_time", "compress_type")
            .repartition("path").sortWithinPartitions("path", "ord"))
