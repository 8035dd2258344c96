"""Rebuild documents from translated units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild_text(lines: DataFrame, key: str | list[str] = "scope", text_col: str = "text_out",
                 out_col: str = "text") -> DataFrame:
    """Lines (``key, ord, text_out, ending``) back into one text per key.

    The group of a key is the lines of one input row, so it is bounded by the
    largest input document; ``ord`` sorting restores the order byte for byte.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = F.array_sort(F.collect_list(F.struct("ord", F.col(text_col).alias("t"), "ending")))
    return (lines.groupBy(*keys)
            .agg(F.array_join(F.transform(parts, lambda x: F.concat(x["t"], x["ending"])), "").alias(out_col)))


def rebuild_csv_rows(cells: DataFrame, key: str | list[str] = "path", text_col: str = "text_out") -> DataFrame:
    """R2: cells (``key, row, col, text_out``) into ordered rows of cells.

    Returns ``key, rows ARRAY<ARRAY<STRING>>`` ordered by row then column;
    empty rows are kept by the source as a row with no cells.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # the empty-row marker (col = -1, text null) yields a row with no cells
    per_row = (cells.groupBy(*keys, "row")
               .agg(F.array_sort(F.collect_list(F.struct("col", F.col(text_col).alias("t")))).alias("cs"))
               .select(*keys, "row", F.filter(F.col("cs"), lambda x: x["col"] >= 0)["t"].alias("cells")))
    return (per_row.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rs"))
            .select(*keys, F.col("rs.cells").alias("rows")))


def csv_field(c) -> "F.Column":
    """K2 minimal quoting: a field holding a comma, quote, CR or LF is quoted,
    inner quotes doubled."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
                  ).otherwise(col)


def csv_text(rows) -> "F.Column":
    """K2: ``ARRAY<ARRAY<STRING>>`` rows -> CSV text with ``\\r\\n`` after every row.

    A row made of one empty field is written ``""`` (as the standard
    writer does) so it is not read back as an empty row.
    """
    col = F.col(rows) if isinstance(rows, str) else rows

    def one(r):
        return F.when((F.size(r) == 1) & (F.element_at(r, 1) == F.lit("")), F.lit('""')).otherwise(
            F.array_join(F.transform(r, lambda x: csv_field(x)), ","))
    return F.array_join(F.transform(col, lambda r: F.concat(one(r), F.lit("\r\n"))), "")


def apply_and_rebuild(lines: DataFrame, translations: DataFrame, key: str = "scope",
                      out_col: str = "text") -> DataFrame:
    """J1 + F9 + R1 for whole documents: one join by ``(scope, text)``, one ordered aggregate.

    Cost is linear in the lines (a per-document map is searched once per line and entry).
    Where the session lets a join be satisfied by a partitioning on part of its keys
    (``spark.sql.requireAllClusterKeysForCoPartition=false``, as :func:`build_session`
    sets it), both sides are dealt by the document and the regroup needs no second
    exchange of the lines; else Spark adds that exchange.
    """
    spark = lines.sparkSession
    own = lines.select(F.col(key).alias("scope"), "ord", "text", "ending")
    t = translations.select("scope", "text", "text_en")
    if spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "false":
        own, t = own.repartition("scope"), t.repartition("scope")
    out = own.join(t, ["scope", "text"], "left").select("scope", "ord", F.coalesce("text_en", "text").alias("text_out"), "ending")
    return rebuild_text(out, "scope", "text_out", out_col).withColumnRenamed("scope", key)
