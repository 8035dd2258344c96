"""CSV cell source.

``spark.read.csv`` drops empty rows and forces one width, so the decoded
text of each file is parsed with the standard ``csv`` module inside
``mapInPandas``: comma dialect, quoted newlines, ragged rows, empty rows
kept, header not special, fields of any size.  Cells leave in batches, so a task
holds one file's text and a few thousand cells.
"""

from __future__ import annotations

import csv
import io
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("n", T.LongType()),
])
#: the marker rows of ``col``: an empty row, and a file that can't be parsed (its text is the reason)
EMPTY_ROW, BAD_FILE = -1, -2
CELLS_PER_BATCH = 10_000


def parse_csv_text(text: str):
    csv.field_size_limit(sys.maxsize)
    return csv.reader(io.StringIO(text, newline=""))


def csv_cells(files: DataFrame, text_col: str = "text") -> DataFrame:
    """``path, text`` -> ``path, row, col, text, n``; ``n`` numbers a file's cells row by row.

    An empty row is one marker row with ``col = -1`` and a null text, so the rebuild
    can put it back; a file that the parser refuses is one marker row with ``col = -2``
    at the place where it stopped (:func:`csv_errors`); :func:`cell_units` drops both.
    """
    def run(batches):
        out: list = []

        def flush():
            done, out[:] = pd.DataFrame(out, columns=CELL_SCHEMA.fieldNames()), []
            return done
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf[text_col]):
                at, n = 0, 0
                try:
                    for at, row in enumerate(parse_csv_text(text or "")):
                        out += [(path, at, c, cell, n + c) for c, cell in enumerate(row)] or [(path, at, EMPTY_ROW, None, n)]
                        n += max(1, len(row))
                        if len(out) >= CELLS_PER_BATCH:
                            yield flush()
                except csv.Error as exc:
                    out.append((path, at, BAD_FILE, f"{type(exc).__name__}: {exc}", n))
        if out:
            yield flush()

    return files.select("path", text_col).mapInPandas(run, CELL_SCHEMA)


def csv_errors(cells: DataFrame) -> DataFrame:
    """``path, stage, error`` of the files that can't be parsed."""
    return cells.filter(F.col("col") == BAD_FILE).select("path", F.lit("parse").alias("stage"), F.col("text").alias("error"))


def cell_units(cells: DataFrame, context=None) -> DataFrame:
    """Cells as translation units: ``scope = path``, ``ord`` row-major (the cell's number)."""
    ctx = context if context is not None else F.lit("")
    return (cells.filter(F.col("col") >= 0)
            .select(F.col("path").alias("scope"), "path", "row", "col", F.col("n").alias("ord"), "text", ctx.alias("context")))
