"""translate_columns (T10): translate chosen string columns of any DataFrame.

The rule is the CSV one: every cell is one unit, all cells of the table form
one dedup scope (unless ``scope_cols`` splits it), order = row order then
column order.  Only cells that are translatable leave the table, only their
distinct strings are ordered and packed, and one join brings the answers
back to the rows that have such a cell; other rows are not moved, and other columns never go through Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.script import is_translatable
from ..session import WorkDir, work_dir
from .batch import BatchResult, batch_translate


@dataclass
class ColumnsResult:
    table: DataFrame
    batch: BatchResult


def translate_columns(df: DataFrame, cols: list[str], translator, order_by: list[str],
                      settings: Settings = DEFAULT, context: str = "", scope_cols: list[str] | None = None,
                      work: WorkDir | None = None, name: str = "columns", status_col: str | None = None) -> ColumnsResult:
    """Translate ``cols`` of ``df``; ``order_by`` gives the row order (any types, ties allowed).

    A failed call leaves its own strings as they are, no others.  ``status_col`` adds a
    column: ``none`` (nothing to translate in the row), ``ok``, or ``kept`` (a cell kept its original).
    Rows are numbered as the table is written once, which no order or key width can
    overflow; the packing order of the distinct strings is that of their first cells.
    Scopes are compared as structs, so a null is a value of its own.
    """
    work = work or work_dir(df.sparkSession)
    texts = [F.col(c).cast("string") for c in cols]
    some = F.exists(F.array(*texts), lambda x: F.coalesce(is_translatable(x, settings.profile), F.lit(False)))
    stored = work.materialize(df.withColumns({"__uid": F.monotonically_increasing_id(), "__some": some}), f"{name}/keyed")
    # rows without a candidate are read and given back; only the others are looked at, joined and grouped
    keyed, rest = stored.filter("__some").drop("__some"), stored.filter("not __some").select(*df.columns)
    scope = (F.to_json(F.struct(*[F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(scope_cols)]))
             if scope_cols else F.lit("table"))
    cells = (keyed.select("__uid", scope.alias("scope"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)]).alias("__k"),
                          F.posexplode(F.array(*texts)).alias("col", "text"))
             .filter(F.col("text").isNotNull() & is_translatable("text", settings.profile)))
    first = cells.groupBy("scope", "text").agg(F.min(F.struct("__k", "col")).alias("__at"))
    ordered = work.materialize(first.orderBy("scope", "__at", "text").select(
        "scope", "text", F.lit(context).alias("context"), F.monotonically_increasing_id().alias("ord")), f"{name}/ordered")
    batch = batch_translate(ordered, translator, settings, work, name, isolate="chunk", distinct=True)
    t = batch.translations.select("scope", "text", "text_en")
    news = (cells.select("__uid", "col", "scope", "text").join(t, ["scope", "text"], "left")
            .groupBy("__uid").agg(F.map_from_entries(F.collect_list(F.struct("col", "text_en"))).alias("__new")))
    out = keyed.join(news, "__uid", "left")
    for i, c in enumerate(cols):
        out = out.withColumn(c, F.coalesce(F.try_element_at("__new", F.lit(i)), F.col(c)))
    keep = [*df.columns]
    if status_col:
        out = out.withColumn(status_col, F.when(F.exists(F.map_values("__new"), lambda x: x.isNull()), "kept").otherwise("ok"))
        rest = rest.withColumn(status_col, F.lit("none"))
        keep.append(status_col)
    for c in cols:      # translated columns are strings, in every row
        rest = rest.withColumn(c, F.col(c).cast(out.schema[c].dataType))
    out = out.select(*keep).unionByName(rest.select(*keep))
    return ColumnsResult(out, batch)
