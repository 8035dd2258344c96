"""batch_translate (T1) as a DataFrame plan, plus J2, J3 and A10.

::

    units --F1/F2--> A1 dedup --C2 est--> [unique_units]            (written)
      --W1 pack (carrying text)--> [chunks]                          (written)
      --T2 model stage--> [responses]                                (written, paid)
      --J3 zip--> chunk translations ; missing positions (J2)
      --T3 model stage--> [singles]                                  (written, paid)
      --> translations(scope, context, text, text_en, how)

Every model stage is written to the shared work folder, in waves, before
anything joins it: re-planning never calls the model again, a lost executor
repeats the calls of its running tasks, a lost driver those of one wave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.script import est_tokens
from ..session import WorkDir, work_dir
from .call import call_chunks, call_singles, reply_tag
from .dedup import dedup_units
from .pack import pack_chunk_rows


@dataclass
class BatchResult:
    unique_units: DataFrame   # scope, text, ord, context, occurrences, est
    assignments: DataFrame    # scope, ord, chunk_id, chunk_no, pos
    chunks: DataFrame         # scope, chunk_id, chunk_no, context, items
    responses: DataFrame      # chunk rows + attempts, out_items, status, tokens, error
    singles: DataFrame        # scope, text, text_en, status, tokens, error
    translations: DataFrame   # scope, context, text, text_en, how
    errors: DataFrame         # scope, stage, error


def chunk_assignments(chunks: DataFrame) -> DataFrame:
    """W2 from chunk rows: ``scope, ord, chunk_id, chunk_no, pos`` (narrow)."""
    return (chunks.select("scope", "chunk_id", "chunk_no", F.posexplode("ords").alias("i", "ord"))
            .select("scope", "ord", "chunk_id", "chunk_no", (F.col("i") + 1).alias("pos")))


def zip_responses(responses: DataFrame) -> DataFrame:
    """I-th input with i-th accepted output, one row per position."""
    return (responses
            .select("scope", "chunk_id", "context", "status",
                    F.posexplode(F.arrays_zip("items", "out_items")).alias("i", "z"))
            .select("scope", "chunk_id", "context", "status", (F.col("i") + 1).alias("pos"),
                    F.col("z.items").alias("text"), F.col("z.out_items").alias("text_en")))


def missing_positions(zipped: DataFrame) -> DataFrame:
    """Strings of a chunk that got no usable translation.

    Equivalent to ``chunk_units LEFT ANTI JOIN chunk_translations`` on
    ``(scope, text)`` but narrow: the zip already has both sides.
    """
    return (zipped.filter(F.col("text_en").isNull() & F.col("status").isin("partial", "failed"))
            .select("scope", "text", "context"))


def batch_translate(units: DataFrame, translator, settings: Settings = DEFAULT,
                    work: WorkDir | None = None, name: str = "batch",
                    memory: DataFrame | None = None, memory_key: tuple[str, ...] = ("context", "text"),
                    isolate: str = "scope", contexts: DataFrame | None = None,
                    distinct: bool = False) -> BatchResult:
    """T1 over a units table (``scope, ord, text, context``).

    ``contexts`` (optional): ``scope, context``, one row per scope; the units then need no context, and it is joined
    to the distinct units only.  ``distinct``: the units are a stored table of translatable strings, each once in its scope.

    ``memory`` (optional): stored translations (``context, text, text_en``).
    Unique units found there are answered from it (``how = 'memory'``) and
    never reach the model; only new strings are packed and sent.

    ``isolate``: what a failed call takes with it. ``scope``: all translations of its scope
    (the caller's unit is a file, copied as a whole).  ``chunk``: only its own strings.
    """
    work = work or work_dir(units.sparkSession)
    if distinct:
        uu_all = units.select("scope", "text", "ord", "context", F.lit(1).cast("long").alias("occurrences"), est_tokens("text", settings).alias("est"))
    else:
        own = units if contexts is None else units.select("scope", "ord", "text", F.lit(None).cast("string").alias("context"))
        unique = dedup_units(own, settings)
        if contexts is not None:
            cols = unique.columns
            unique = unique.drop("context").join(contexts.select("scope", "context"), "scope", "left").select(*cols)
        uu_all = unique if memory is not None else work.materialize(unique, f"{name}/unique_units")
    known = None
    uu = uu_all
    if memory is not None:
        # several answers for one key: the least, so that runs agree
        mem = memory.groupBy(*memory_key).agg(F.min("text_en").alias("text_en")).withColumn("__held", F.lit(True))
        # looked up once and written with what was found: both halves, and every later use of them, read that table
        cols = uu_all.columns
        found = work.materialize(uu_all.join(mem, list(memory_key), "left").select(*cols, "text_en", "__held"), f"{name}/unique_units")
        uu_all = found.select(*cols)
        known = (found.where("__held")
                 .select("scope", "context", "text", "text_en", F.lit("memory").alias("how")))
        uu = found.where("__held is null").select(*cols)
    # packing carries the text, so chunks come out assembled (no join back to the
    # texts); the paid stage's exact input is written first: packing runs with
    # normal Arrow batches, and a retried model stage re-reads fixed chunks
    chunks = work.materialize(pack_chunk_rows(uu, settings, work),
                              f"{name}/chunks")
    assignments = chunk_assignments(chunks)
    call_conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": settings.call_batch_rows}
    responses = work.paid(chunks, lambda c, n: call_chunks(c, translator, settings, n), f"{name}/responses", ["scope", "chunk_id"],
                          settings.calls_per_wave, call_conf, stored=True, tag=reply_tag(settings))

    failed = work.queues[-1].errors()
    zipped = zip_responses(responses)
    chunk_errors = (responses.filter(F.col("status") == "error")
                    .select("scope", F.lit("chunk").alias("stage"), "error"))
    missing = missing_positions(zipped)
    if isolate == "scope" and failed:   # a scope that is lost anyway pays for no fallback
        missing = missing.join(chunk_errors.select("scope").distinct(), "scope", "left_anti")
    singles = work.paid(missing, lambda m, n: call_singles(m, translator, settings, n), f"{name}/singles", ["scope", "text"],
                        settings.calls_per_wave, call_conf, tag=reply_tag(settings))
    failed += work.queues[-1].errors()
    single_errors = (singles.filter(F.col("status") == "error")
                     .select("scope", F.lit("single").alias("stage"), "error"))
    errors = chunk_errors.unionByName(single_errors)

    from_chunks = (zipped.filter(F.col("text_en").isNotNull())
                   .select("scope", "context", "text", "text_en",
                           F.when(F.col("status") == "ok", "chunk").otherwise("partial").alias("how")))
    from_singles = (singles.filter(F.col("status") == "ok")
                    .select("scope", "context", "text", "text_en", F.lit("single").alias("how")))
    translations = from_chunks.unionByName(from_singles)
    if known is not None:
        translations = translations.unionByName(known)
    if isolate == "scope" and failed:   # where no call failed, no translation is moved to look for its scope
        translations = translations.join(errors.select("scope").distinct(), "scope", "left_anti")
    return BatchResult(uu_all, assignments, chunks, responses, singles, translations, errors)


def batch_stats(result: BatchResult) -> DataFrame:
    """A10: unique strings, chunks and single fallbacks per scope."""
    u = result.unique_units.groupBy("scope").agg(F.count(F.lit(1)).alias("unique_strings"))
    c = result.responses.groupBy("scope").agg(F.count(F.lit(1)).alias("chunks"))
    s = result.singles.groupBy("scope").agg(F.count(F.lit(1)).alias("fallbacks"))
    return (u.join(c, "scope", "left").join(s, "scope", "left")
            .select("scope", "unique_strings",
                    F.coalesce("chunks", F.lit(0)).alias("chunks"),
                    F.coalesce("fallbacks", F.lit(0)).alias("fallbacks")))
