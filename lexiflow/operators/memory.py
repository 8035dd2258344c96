"""Translation memory (beyond parity): a stored table of past translations.

The original forgets everything between calls; here a run may read a memory
table so that a re-run pays only for new text, and append what it learned.
Keyed by ``(context, text)`` by default, or ``text`` alone for a
corpus-wide memory.  Appends are per run id with ``overwrite`` of that run's
folder, so a retried run never duplicates rows.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY_SCHEMA = T.StructType([
    T.StructField("context", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_en", T.StringType()),
])


def read_memory(spark: SparkSession, path: str, except_run: str | None = None) -> DataFrame:
    """The memory table, or an empty one when nothing was stored yet.

    ``except_run``: leaves that run's own rows out, so that a replayed run learns, and
    writes, the same rows again.  Spark itself looks the path up, on any file system.
    """
    try:
        got = spark.read.schema(T.StructType([*MEMORY_SCHEMA.fields, T.StructField("run", T.StringType())])).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MEMORY_SCHEMA)
    if except_run is not None:
        got = got.filter(~F.col("run").eqNullSafe(F.lit(except_run)))
    return got.drop("run")


def learned(translations: DataFrame) -> DataFrame:
    """New rows of a run: model answers only (memory hits are already stored)."""
    return (translations.filter(F.col("how") != "memory")
            .select("context", "text", "text_en").dropDuplicates(["context", "text"]))


def append_memory(translations: DataFrame, path: str, run_id: str) -> None:
    learned(translations).write.mode("overwrite").parquet(os.path.join(path, f"run={run_id}"))
