"""Model calls inside Spark tasks.

The functions here run in Python workers via Arrow batches: one input row
is one request, the translator object is built once per task iterator, and a
failed request becomes a row with ``status='error'`` instead of a failed
Spark job.  Usage is returned as columns and summed later (accumulators
over-count on task retries).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions.script import is_nonblank
from ..functions.prompt import batch_prompt, name_prompt, parse_array, single_prompt
from ..functions.text import py_clean_name
from ..models import ModelCallFailed, ModelRequest, Throttled


def invoke(translator, req: ModelRequest, settings: Settings = DEFAULT):
    """Retry throttled calls with waits, fail at once on other errors."""
    for i in range(settings.call_attempts):
        try:
            return translator(ModelRequest(req.kind, req.prompt, req.items, req.context,
                                           req.attempt, i, req.max_tokens))
        except Throttled:
            waits = settings.throttle_waits
            wait = waits[min(i, len(waits) - 1)] if waits else 0
            if wait:
                time.sleep(wait)
    raise ModelCallFailed(f"model call failed after {settings.call_attempts} throttled attempts")


@dataclass
class ChunkOutcome:
    attempts: int
    out_items: list          # accepted translation per input position, None = missing
    status: str              # ok | partial | failed | error
    input_tokens: int
    output_tokens: int
    error: str | None


@dataclass
class Reply:
    """One attempt at a chunk: its parsed items (None = unusable) or its error, and its cost."""

    items: list | None
    input_tokens: int = 0
    output_tokens: int = 0
    error: str | None = None

    def fits(self, n: int, reject_blank: bool) -> bool:
        """Exactly ``n`` items; with ``reject_blank`` (Q6) none of them blank."""
        return self.items is not None and len(self.items) == n and not (
            reject_blank and any(not x.strip() for x in self.items))


def chunk_replies(translator, items: list[str], context: str, settings: Settings = DEFAULT) -> Iterator[Reply]:
    """The attempts at a chunk, lazily: the caller stops when one satisfies it."""
    prompt = batch_prompt(items, context)
    for number in range(settings.chunk_attempts):
        req = ModelRequest("batch", prompt, tuple(items), context, number, 0, settings.text_reply_cap)
        try:
            rep = invoke(translator, req, settings)
        except Exception as exc:  # noqa: BLE001 - any model failure isolates the scope
            yield Reply(None, error=f"{type(exc).__name__}: {exc}")
            return
        yield Reply(parse_array(rep.text), rep.input_tokens, rep.output_tokens)


def fill_positions(reply: list[str] | None, n: int) -> list:
    """A partial reply by position: cut to ``n``, blank items left missing."""
    said = [x if x.strip() else None for x in (reply or [])[:n]]
    return said + [None] * (n - len(said))


def translate_chunk(translator, items: list[str], context: str, settings: Settings = DEFAULT) -> ChunkOutcome:
    """Attempts until a reply fits; else the longest reply, the earliest of equals."""
    n, seen, whole = len(items), [], None
    for reply in chunk_replies(translator, items, context, settings):
        seen.append(reply)
        if reply.fits(n, settings.reject_blank):
            whole = reply.items
            break
    cost = sum(r.input_tokens for r in seen), sum(r.output_tokens for r in seen)
    error = next((r.error for r in seen if r.error), None)
    if error:
        return ChunkOutcome(len(seen), [None] * n, "error", *cost, error)
    if whole is not None:
        return ChunkOutcome(len(seen), list(whole), "ok", *cost, None)
    out = fill_positions(max((r.items for r in seen), key=lambda x: len(x or []), default=None), n)
    return ChunkOutcome(len(seen), out, "partial" if any(out) else "failed", *cost, None)


def parse_replies(replies: DataFrame, text_col: str = "reply", out_col: str = "items") -> DataFrame:
    """C9 over a table of raw replies: adds ``items ARRAY<STRING>``, null where the reply is unusable."""
    schema = T.StructType([*replies.schema.fields, T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{out_col: [parse_array(x) for x in pdf[text_col]]})
    return replies.mapInPandas(run, schema)


def _best_of_batches(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The attempts that may be best, by the order of :func:`best_partial`: one per key and Arrow batch, with ``__last``, the
    largest attempt it stands for.  No items are sorted, copied into Python or kept beyond their batch."""
    own = attempts.select(*keys, "attempt", "n", "items")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in own.schema.fields), T.StructField("__last", own.schema["attempt"].dataType)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            group = np.zeros(b.num_rows, np.int64)
            for k in [*keys, "n"]:
                code = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
            size = pc.fill_null(pc.list_value_length(b.column("items")), -1).to_numpy(zero_copy_only=False)
            number = b.column("attempt").to_numpy(zero_copy_only=False)
            whole = size == pc.fill_null(b.column("n"), -2).to_numpy(zero_copy_only=False)
            order = np.lexsort((-number, np.where(whole, -number, size), whole, group))
            last = np.flatnonzero(np.append(np.diff(group[order]) != 0, True))
            most = np.maximum.reduceat(number[order], np.append(0, last[:-1] + 1))
            best = b.take(pa.array(order[last]))
            yield pa.RecordBatch.from_arrays([*best.columns, pa.array(most, best.column("attempt").type)], schema.fieldNames())
    return own.mapInArrow(run, schema)


def best_partial(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """W3 over a table of attempts: ``keys..., attempt, n, items`` (null items = unusable reply).

    One row per key: ``attempts, status, out_items`` by the rule of :func:`translate_chunk`:
    the first reply of exactly ``n`` items wins, else the longest (the earliest of
    equals), cut to ``n`` with blank items missing.  Each batch keeps the best of its own attempts before the shuffle
    (:func:`_best_of_batches`), and the aggregation stands behind it: in front Spark would sort the items of every attempt on disk.
    """
    size = F.coalesce(F.size("items"), F.lit(-1))
    whole = size == F.col("n")
    best = F.max_by(F.struct("items", "attempt"), F.struct(whole, F.when(whole, -F.col("attempt")).otherwise(size),
                                                            -F.col("attempt")))
    few = _best_of_batches(attempts, keys).repartition(*keys, "n")
    got = few.groupBy(*keys, "n").agg(best.alias("b"), F.max("__last").alias("last"), F.max(whole).alias("ok"))
    cut = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.try_element_at(F.coalesce("b.items", F.array().cast("array<string>")), i))
    out = F.when(F.col("ok"), cut).otherwise(F.transform(cut, lambda x: F.when(is_nonblank(x), x)))
    return (got.withColumn("out_items", out)
            .select(*keys, F.when(F.col("ok"), F.col("b.attempt")).otherwise(F.col("last")).alias("attempts"),
                    F.when(F.col("ok"), "ok").when(F.exists("out_items", lambda x: x.isNotNull()), "partial")
                    .otherwise("failed").alias("status"), "out_items"))


def translate_text(translator, text: str, context: str, settings: Settings = DEFAULT):
    """T4 + T3: blank text comes back as is; a blank answer keeps the original."""
    if not text or not text.strip():
        return text, 0, 0
    rep = invoke(translator, ModelRequest("single", single_prompt(text, context), (text,), context,
                                          0, 0, settings.text_reply_cap), settings)
    out = rep.text.strip() if rep.text else rep.text
    return (out if out and out.strip() else text), rep.input_tokens, rep.output_tokens


def translate_name_py(translator, name: str, context: str, settings: Settings = DEFAULT):
    """T5: short call, quotes stripped."""
    if not name or not name.strip():
        return name, 0, 0
    rep = invoke(translator, ModelRequest("name", name_prompt(name, context), (name,), context,
                                          0, 0, settings.name_reply_cap), settings)
    return py_clean_name(rep.text or ""), rep.input_tokens, rep.output_tokens


# --- DataFrame stages --------------------------------------------------------

#: tasks of a model stage for each core: a lost task repeats this share of what its core pays in the stage, at most
TASKS_PER_CORE = 16


def call_tasks(calls: int, cores: int, settings: Settings = DEFAULT) -> int:
    """Tasks of a stage of so many calls: by ``calls_per_task``, but no more than ``TASKS_PER_CORE`` for each core.

    A task costs the driver a result of some 20 KB and its core a start and a file, whatever it calls; tasks by the number
    of calls alone are tens of thousands on a large corpus.  A small stage still uses all cores.
    """
    if settings.call_partitions:
        return settings.call_partitions
    return max(1, min(-(-calls // settings.calls_per_task), TASKS_PER_CORE * cores), min(calls, cores))


def _call_partitions(df: DataFrame, settings: Settings, calls: int | None) -> int:
    n = df.count() if calls is None and not settings.call_partitions else calls
    return call_tasks(n or 0, df.sparkSession.sparkContext.defaultParallelism, settings)


def reply_tag(settings: Settings) -> str:
    """The settings that change what a call answers or whether it is accepted."""
    return f"{settings.chunk_attempts},{settings.call_attempts},{settings.text_reply_cap},{settings.name_reply_cap},{settings.reject_blank}"


_ADDED = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
_SPARK = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "array<string>": T.ArrayType(T.StringType())}


def _call_rows(requests: DataFrame, tasks: int, key: list[str], args: list[str], answer, added: list[tuple[str, str]]) -> DataFrame:
    """``requests`` with the columns ``added`` (name, type) that ``answer(*args)`` gives for each row.

    The requests' own columns are handed on as they came; only what a call needs becomes Python objects.
    """
    own = requests.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in requests.schema.fields), *(T.StructField(n, _SPARK[t]) for n, t in added)])
    types = [_ADDED[t] for _, t in added]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            said = zip(*(answer(*row) for row in zip(*(b.column(c).to_pylist() for c in args))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(pa.array(v, t) for v, t in zip(said, types))], schema.fieldNames())
    return requests.repartition(tasks, *key).mapInArrow(run, schema)


def call_chunks(chunks: DataFrame, translator, settings: Settings = DEFAULT, calls: int | None = None) -> DataFrame:
    """One row per chunk in (``scope, chunk_id, context, items``), one out.

    Output adds ``attempts, out_items ARRAY<STRING>, status, input_tokens,
    output_tokens, error``.  The chunks are spread over an explicit number of
    tasks first: AQE would otherwise coalesce a small input to one task and
    serialise every call.
    """
    def answer(items, context):
        o = translate_chunk(translator, [str(x) for x in items], context or "", settings)
        return o.attempts, o.out_items, o.status, o.input_tokens, o.output_tokens, o.error

    return _call_rows(chunks.select("scope", F.col("chunk_id").cast("bigint").alias("chunk_id"), "context", "items"),
                      _call_partitions(chunks, settings, calls), ["scope", "chunk_id"], ["items", "context"], answer,
                      [("attempts", "int"), ("out_items", "array<string>"), ("status", "string"), *_COST])


_COST = [("input_tokens", "bigint"), ("output_tokens", "bigint"), ("error", "string")]


def call_singles(missing: DataFrame, translator, settings: Settings = DEFAULT, calls: int | None = None) -> DataFrame:
    """One call per missing string (``scope, text, context``).

    Output: ``scope, context, text, text_en, status, input_tokens, output_tokens, error``.
    """
    def answer(text, context):
        try:
            out, i, o = translate_text(translator, text, context or "", settings)
            return out, "ok", i, o, None
        except Exception as exc:  # noqa: BLE001
            return None, "error", 0, 0, f"{type(exc).__name__}: {exc}"

    return _call_rows(missing.select("scope", "context", "text"), _call_partitions(missing, settings, calls), ["scope", "text"],
                      ["text", "context"], answer, [("text_en", "string"), ("status", "string"), *_COST])


def call_names(names: DataFrame, translator, settings: Settings = DEFAULT, calls: int | None = None) -> DataFrame:
    """T5 over distinct ``(name, context)`` rows.

    Output: ``name, context, name_en, status, input_tokens, output_tokens, error``;
    a failed call keeps the original name (Q10) and reports the error.
    """
    def answer(name, context):
        try:
            out, i, o = translate_name_py(translator, name, context or "", settings)
            return out, "ok", i, o, None
        except Exception as exc:  # noqa: BLE001
            return name, "error", 0, 0, f"{type(exc).__name__}: {exc}"

    return _call_rows(names.select("name", "context"), _call_partitions(names, settings, calls), ["name", "context"],
                      ["name", "context"], answer, [("name_en", "string"), ("status", "string"), *_COST])
