"""Layout lines from span records.

The PDF decoder is not rebuilt; its output shape is a ``spans`` table
(``path, page, block, line, span, block_type, text, size, color, x0..y1``).
Lines are assembled with native aggregates: concatenated span text (A6),
dominant size with ties to the smallest (A7), colour of the first span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.script import PY_WHITESPACE_CLASS
from ..functions.text import color_hex, font_size_out, page_context, styled_paragraph

LINE_KEYS = ["path", "page", "block", "line"]


def py_strip(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")


def page_limit(spans: DataFrame, max_pages: int | None) -> DataFrame:
    """first N pages (0-based ``page``); None or 0 = all; negative is an error (Q20)."""
    if max_pages is None or max_pages == 0:
        return spans
    if max_pages < 0:
        raise ValueError("max_pages must be positive, 0 or None")
    return spans.filter(F.col("page") < max_pages)


STYLE = ["size", "color", "x0", "y0", "x1", "y1"]


def _adjacent_runs(b: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Spans of one batch to runs: adjacent spans of a line, in the order of ``span`` (then text), as one row."""
    n = b.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in LINE_KEYS:
        code = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    span = b.column("span")
    at = span.to_numpy(zero_copy_only=False)
    steady = not span.null_count and bool(np.all((at[1:] == at[:-1] + 1) | new[1:]))
    if not steady and (span.null_count or not bool(np.all((at[1:] > at[:-1]) | new[1:]))):
        t = pa.table({"run": run, "span": span, "text": b.column("text")})
        b = b.take(pc.sort_indices(t, sort_keys=[("run", "ascending"), ("span", "ascending"), ("text", "ascending")], null_placement="at_start"))
        span = b.column("span")
    cut = pa.array(np.append(first, n), pa.int32())
    # texts of a run lie side by side: the joined text is their bytes under fewer offsets
    text = pc.fill_null(b.column("text").cast(pa.string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset: text.offset + n + 1]
    end = np.cumsum(pc.utf8_length(text).to_numpy())
    begin = np.append(0, end[:-1])
    lead = np.minimum.reduceat(np.where(pc.is_valid(span).to_numpy(zero_copy_only=False), np.arange(n), n), first)
    lead = pa.array(lead, mask=lead == n)
    out = {k: b.column(k).take(pa.array(first)) for k in LINE_KEYS}
    out["joined"] = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets[cut.to_numpy()].copy()), text.buffers()[2] or pa.py_buffer(b""))
    out["starts"] = pa.ListArray.from_arrays(cut, pa.array(begin - begin[first][run] + 1, pa.int32()))
    out["spans"] = pa.nulls(len(first), pa.list_(span.type)) if steady else pa.ListArray.from_arrays(cut, span)
    out["first"] = span.take(lead)
    if "sizes" in names:
        size = b.column("size")
        held = pa.table({"run": run, "v": size}).filter(pc.is_valid(size)).group_by(["run", "v"], use_threads=False).aggregate([([], "count_all")])
        held = held.sort_by("run").combine_chunks()
        own = pa.array(np.searchsorted(held["run"].to_numpy(), np.arange(len(first) + 1)), pa.int32())
        for c, name in (("v", "sizes"), ("count_all", "held")):
            out[name] = pa.ListArray.from_arrays(own, pa.concat_arrays(held[c].chunks) if held[c].num_chunks else pa.array([], held[c].type))
        out["color"] = b.column("color").take(lead)
        for c in STYLE[2:]:
            v, least = b.column(c), c in ("x0", "y0")
            x = v.to_numpy(zero_copy_only=False)
            none = np.zeros(len(first), bool)
            if v.null_count:
                there = pc.is_valid(v).to_numpy(zero_copy_only=False)
                none = np.add.reduceat(there.astype(np.int64), first) == 0
                x = np.where(there, x, np.nan if least else -np.inf)
            got = np.fmin.reduceat(x, first) if least else np.maximum.reduceat(x, first)   # NaN is the largest, as in Spark
            out[c] = pa.array(np.where(none, 0, got), mask=none).cast(v.type, safe=False)
    return pa.RecordBatch.from_arrays([out[c] for c in names], names)


def line_runs(spans: DataFrame, style: bool = True) -> DataFrame:
    """Spans to runs before any shuffle: ``LINE_KEYS, joined, starts, spans, first`` and, with ``style``, ``sizes, held, color, x0..y1``.

    A decoder hands out the spans of a line side by side, so nearly every line becomes one run here; spans in any other order
    make more runs and the same lines.  Nothing is sorted or kept beyond an Arrow batch.  ``joined``: the texts in a row, the
    i-th begins at character ``starts[i]``; ``spans``: their numbers, null where they go up by one from ``first``; ``held``: spans of
    each of the ``sizes``.
    """
    t = {f.name: f.dataType for f in spans.schema.fields}
    fields = [*((k, t[k]) for k in LINE_KEYS), ("joined", T.StringType()), ("starts", T.ArrayType(T.IntegerType())), ("spans", T.ArrayType(t["span"])),
              ("first", t["span"])]
    if style:
        fields += [("sizes", T.ArrayType(t["size"])), ("held", T.ArrayType(T.LongType())), *((c, t[c]) for c in STYLE[1:])]
    schema = T.StructType([T.StructField(c, x) for c, x in fields])
    names = schema.fieldNames()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _adjacent_runs(b, names)
    return spans.select(*LINE_KEYS, "span", "text", *(STYLE if style else [])).mapInArrow(run, schema)


def _line_text(runs: F.Column) -> F.Column:
    """The text of a single run, else the pieces of all in the order of ``span``, then text."""
    def pieces(r):
        def piece(start, i):
            end = F.coalesce(F.try_element_at(r["starts"], i + 2), F.length(r["joined"]) + 1)
            span = F.when(r["spans"].isNull(), r["first"] + i).otherwise(F.try_element_at(r["spans"], i + 1))
            return F.struct(span.alias("span"), r["joined"].substr(start, end - start).alias("text"))
        return F.transform(r["starts"], piece)
    merged = F.array_join(F.transform(F.array_sort(F.flatten(F.transform(runs, pieces))), lambda x: x["text"]), "")
    return F.when(F.size(runs) == 1, runs[0]["joined"]).otherwise(merged)


def _dominant_size(runs: F.Column, size_type) -> F.Column:
    """The most frequent size, the smallest of equals, in one pass over the sorted counts."""
    counts = F.array_sort(F.flatten(F.transform(runs, lambda r: F.zip_with(r["sizes"], r["held"], lambda v, n: F.struct(v.alias("v"), n.alias("n"))))))
    none, zero = F.lit(None).cast(size_type), F.lit(0).cast("bigint")

    def step(a, x):
        n = F.when(a["v"] == x["v"], a["n"] + x["n"]).otherwise(x["n"])
        return F.struct(x["v"].alias("v"), n.alias("n"), F.when(n > a["most"], x["v"]).otherwise(a["best"]).alias("best"),
                        F.greatest(a["most"], n).alias("most"))
    start = F.struct(none.alias("v"), zero.alias("n"), none.alias("best"), zero.alias("most"))
    return F.when((F.size(runs) == 1) & (F.size(runs[0]["sizes"]) == 1), runs[0]["sizes"][0]).otherwise(
        F.aggregate(counts, start, step, lambda a: a["best"]))


def layout_lines(spans: DataFrame, max_pages: int | None = None, style: bool = True) -> DataFrame:
    """F6 + A6 + A7: one row per text line with content.

    Output: ``path, page, block, line, text, size, color, x0, y0, x1, y1``; without ``style`` the keys and the text (Spark can't see
    that the others are not read).  Runs, not spans, are shuffled (:func:`line_runs`), and the aggregation stands behind
    the shuffle only: in front of it Spark would sort every span of a task on disk.
    """
    s = page_limit(spans, max_pages).filter(F.col("block_type") == 0)
    held = ["joined", "starts", "spans", "first"]
    runs = F.collect_list(F.struct(*held, *(["sizes", "held"] if style else [])))
    out = [py_strip(_line_text(runs)).alias("text")]
    if style:
        out += [_dominant_size(runs, s.schema["size"].dataType).alias("size"), F.min_by("color", "first").alias("color"),
                F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return line_runs(s, style).repartition(*LINE_KEYS).groupBy(*LINE_KEYS).agg(*out).filter(F.col("text") != "")


def layout_units(lines: DataFrame, context=None) -> DataFrame:
    """Lines as translation units; the scope is one page, the context names it."""
    ctx = context if context is not None else F.lit("")
    return lines.select(
        F.concat_ws("#", "path", F.col("page").cast("string")).alias("scope"),
        *LINE_KEYS,
        (F.shiftleft(F.col("block").cast("bigint"), 31) + F.col("line")).alias("ord"),
        "text", page_context(ctx, F.col("page")).alias("context"), "size", "color",
        "x0", "y0", "x1", "y1")


def layout_style(lines: DataFrame, text_col: str = "text_out") -> DataFrame:
    """C12 + C13: font size, colour and the HTML paragraph of every line (Q23)."""
    return lines.select(
        *LINE_KEYS, font_size_out("size").alias("font_size"), color_hex("color").alias("color_hex"),
        styled_paragraph(F.col(text_col), F.col("size"), F.col("color")).alias("html"))
