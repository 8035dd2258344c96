"""Cost estimate before a run and usage after it.

One Spark job, no model call: unit sources -> per-file totals -> one global
aggregate.  Every step is a native aggregate with map-side partial
aggregation; the breakdown is per file and never collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.cost import cost_usd, est_input_tokens, est_output_tokens
from ..functions.script import has_script, is_translatable, script_char_count


def file_char_totals(units: DataFrame, settings: Settings = DEFAULT, with_unique: bool = False) -> DataFrame:
    """A3: source-script characters per file over every occurrence (no dedup).

    ``units`` has ``path, text``; only ``path`` and a number cross the shuffle.
    ``with_unique`` adds the deduplicated count the run will actually send
    (Q12) as ``unique_chars``; that needs the text in the shuffle.
    """
    c = units.select("path", "text", script_char_count("text", settings.profile).alias("c"))
    if not with_unique:
        return c.groupBy("path").agg(F.sum("c").cast("bigint").alias("jp_chars"))
    per_text = c.groupBy("path", "text").agg(F.sum("c").alias("c_all"), F.max("c").alias("c_one"))
    return per_text.groupBy("path").agg(F.sum("c_all").cast("bigint").alias("jp_chars"),
                                        F.sum("c_one").cast("bigint").alias("unique_chars"))


def _least_hashes(size: int):
    """Task: (h, c) -> the ``size`` smallest different hashes and their c; memory is a few times that."""
    def settle(h, c):
        h, first = np.unique(h, return_index=True)
        return h[:size], c[first][:size]

    def run(batches):
        held_h, held_c, n = [], [], 0
        for batch in batches:
            h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held_h and len(held_h[0]) == size:            # settled before: nothing over its largest can come in
                keep = h < held_h[0][-1]
                h, c = h[keep], c[keep]
            held_h.append(h)
            held_c.append(c)
            n += len(h)
            if n > 4 * size:
                h, c = settle(np.concatenate(held_h), np.concatenate(held_c))
                held_h, held_c, n = [h], [c], len(h)
        if held_h:
            h, c = settle(np.concatenate(held_h), np.concatenate(held_c))
            for at in range(0, len(h), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at: at + 10_000]), pa.array(c[at: at + 10_000])], ["h", "c"])
    return run


def unique_chars(units: DataFrame, keys: list[str], size: int | None = 65_536, settings: Settings = DEFAULT) -> DataFrame:
    """Q12: what the run will send, one row: ``unique_strings, unique_chars, error``.

    ``units``: ``keys`` (the scope of deduplication) and ``text``; only translatable strings count.
    A bottom-k sketch: of the 64-bit hashes of ``(keys, text)`` each task keeps the ``size`` smallest different ones with
    their characters, and so does the merge.  With the largest kept hash at share u of all hashes, k - 1 smaller ones
    stand for ``(k - 1) / u`` strings and their characters for ``sum / u``.  ``error`` is the relative standard
    error of the characters, ``sqrt((1 + cv**2) / (k - 2))`` with cv that of the kept strings' lengths; with fewer than ``size``
    different strings nothing is estimated and it is 0.  ``size`` None: the exact aggregation of all hashes.
    """
    rows = units.filter(is_translatable("text", settings.profile)).select(
        F.xxhash64(*keys, "text").alias("h"), script_char_count("text", settings.profile).cast("bigint").alias("c"))
    if size is None:
        kept = rows.groupBy("h").agg(F.max("c").alias("c"))
        return kept.agg(F.count(F.lit(1)).alias("unique_strings"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("unique_chars"),
                        F.lit(0.0).alias("error"))
    kept = (rows.mapInArrow(_least_hashes(size), "h long, c long").groupBy("h").agg(F.max("c").alias("c")).orderBy("h").limit(size))
    got = kept.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("c"), F.lit(0)).cast("double").alias("s"), F.max(F.struct("h", "c")).alias("last"),
                   F.coalesce(F.avg("c"), F.lit(1.0)).alias("m"), F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("d"))
    full = F.col("k") >= size
    u = (F.col("last.h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return got.select(
        F.when(full, F.round((F.col("k") - 1) / u)).otherwise(F.col("k")).cast("bigint").alias("unique_strings"),
        F.when(full, F.round((F.col("s") - F.col("last.c")) / u)).otherwise(F.col("s")).cast("bigint").alias("unique_chars"),
        F.when(full, F.sqrt((1 + F.pow(F.col("d") / F.col("m"), F.lit(2.0))) / F.greatest(F.col("k") - 2, F.lit(1)))).otherwise(F.lit(0.0)).alias("error"))


def breakdown(files: DataFrame, totals: DataFrame) -> DataFrame:
    """F7 + O1: files with content, largest first (path breaks ties)."""
    return (files.select("path", "name", "ext").join(totals.select("path", "jp_chars"), "path")
            .filter(F.col("jp_chars") > 0)
            .orderBy(F.desc("jp_chars"), "path"))


def name_calls(folder_names: DataFrame, stems: DataFrame, tab_names: DataFrame | None = None,
               settings: Settings = DEFAULT) -> DataFrame:
    """A4: distinct source-script folder names and file stems (one shared set),
    plus every source-script tab name without dedup.  One row: ``name_calls``.

    One aggregation over a tagged union (no join between the two counts).
    """
    names = (folder_names.select(F.col("name").alias("n"), F.lit(0).alias("tab"))
             .unionByName(stems.select(F.col("stem").alias("n"), F.lit(0).alias("tab"))))
    if tab_names is not None:
        names = names.unionByName(tab_names.select(F.col("name").alias("n"), F.lit(1).alias("tab")))
    names = names.filter(has_script("n", settings.profile))
    return names.agg((F.countDistinct(F.when(F.col("tab") == 0, F.col("n")))
                      + F.count(F.when(F.col("tab") == 1, F.lit(1)))).cast("bigint").alias("name_calls"))


def _estimate_columns(total: DataFrame, s: Settings) -> DataFrame:
    return (total
            .withColumn("est_input_tokens", est_input_tokens("total_chars", "name_calls", s))
            .withColumn("est_output_tokens", est_output_tokens("total_chars", "name_calls", s))
            .withColumn("est_input_cost", F.col("est_input_tokens") / F.lit(1_000_000.0) * F.lit(s.price_input_per_m))
            .withColumn("est_output_cost", F.col("est_output_tokens") / F.lit(1_000_000.0) * F.lit(s.price_output_per_m))
            .withColumn("est_cost", F.col("est_input_cost") + F.col("est_output_cost"))
            .withColumn("est_cost_with_overhead", F.col("est_cost") * F.lit(s.overhead_factor))
            .withColumn("nothing_to_do", (F.col("total_chars") == 0) & (F.col("name_calls") == 0)))


def corpus_estimate(units: DataFrame, name_calls: DataFrame | int | None = None,
                    settings: Settings = DEFAULT) -> DataFrame:
    """A5 + C14: one row with totals, token estimates and dollars.

    ``nothing_to_do`` is true for a corpus without source-script content or
    names (the reference prints a message and stops there).  The character
    total and the name-call count come out of one aggregation over a tagged
    union, so no join is needed.
    """
    chars = units.select(script_char_count("text", settings.profile).cast("bigint").alias("c"),
                         F.lit(None).cast("bigint").alias("k"))
    if isinstance(name_calls, DataFrame):
        chars = chars.unionByName(name_calls.select(F.lit(None).cast("bigint").alias("c"),
                                                    F.col("name_calls").cast("bigint").alias("k")))
        k = F.coalesce(F.max("k"), F.lit(0))
    else:
        k = F.lit(int(name_calls or 0))
    total = chars.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("total_chars"),
                      k.cast("bigint").alias("name_calls"))
    return _estimate_columns(total, settings)


def usage_totals(*results, settings: Settings = DEFAULT) -> DataFrame:
    """Tokens and dollars actually used, summed over model-stage tables.

    Accepts BatchResult objects and/or DataFrames with token columns.
    """
    parts = []
    for r in results:
        if isinstance(r, DataFrame):
            parts.append(r.select("input_tokens", "output_tokens"))
        else:
            parts.append(r.responses.select("input_tokens", "output_tokens"))
            parts.append(r.singles.select("input_tokens", "output_tokens"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = u.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("input_tokens"),
                F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"))
    return agg.withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", settings))


def usage_report(units: DataFrame, *results, name_calls: DataFrame | int | None = None,
                 settings: Settings = DEFAULT) -> DataFrame:
    """The estimate of a corpus next to the usage of its run, one row.

    Estimate inputs and usage rows are one tagged union and one aggregation.
    """
    parts = [units.select(script_char_count("text", settings.profile).cast("bigint").alias("c"),
                          F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("i"),
                          F.lit(None).cast("bigint").alias("o"))]
    if isinstance(name_calls, DataFrame):
        parts.append(name_calls.select(F.lit(None).cast("bigint").alias("c"), F.col("name_calls").cast("bigint").alias("k"),
                                       F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("o")))
    for r in results:
        frames = [r] if isinstance(r, DataFrame) else [r.responses, r.singles]
        for f in frames:
            parts.append(f.select(F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("k"),
                                  F.col("input_tokens").cast("bigint").alias("i"),
                                  F.col("output_tokens").cast("bigint").alias("o")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    k = F.coalesce(F.max("k"), F.lit(0)) if isinstance(name_calls, DataFrame) else F.lit(int(name_calls or 0))
    agg = u.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("total_chars"),
                k.cast("bigint").alias("name_calls"),
                F.coalesce(F.sum("i"), F.lit(0)).cast("bigint").alias("input_tokens"),
                F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("output_tokens"))
    return (_estimate_columns(agg, settings)
            .withColumn("cost_usd", cost_usd("input_tokens", "output_tokens", settings)))
