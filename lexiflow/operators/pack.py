"""Budgeted next-fit chunk packing (W1) and chunk positions.

Semantics, per scope, walking units in ``ord`` order: a new chunk opens when
the current one is non-empty and either adding the unit would exceed the
token budget or the chunk already has the maximum number of strings.  An
oversize string gets a chunk of its own.  ``chunk_id`` is the ``ord`` of the
chunk's first unit, ``chunk_no`` counts chunks from 1 within the scope and
``pos`` counts units from 1 within the chunk.

A scope within ``pack_segment_units`` units and ``pack_segment_bytes`` bytes of text (a document, usually) is
walked by one task: one exchange by scope, one pass.

Next-fit is a running sum with reset, so it is not a window function, and a
scope can be arbitrarily large (one table translated as one scope).  Larger scopes are packed exactly *and* split:

1. *Numbers.*  Units are range-partitioned and sorted by ``(scope, ord)`` and written with their place in their
   partition; the sizes of a scope's pieces (one row per partition) give every unit its number in the scope.
   Numbers cut the scope into segments of exactly ``S`` units, however sparse ``ord`` is.
2. *Maps.*  The next chunk starts within ``K = max_strings`` units, so all that a segment needs to know of those before it
   is at which of its first K units a chunk starts.  A task holds the estimates of a segment and of the K units
   after it, and computes for each such entry the exit (the entry of the next segment) and the chunks in between.
   Runs that meet share their tail: O(S + K) steps.
3. *Tree.*  Maps compose associatively: ``FAN`` neighbours become one map, in log(segments) rounds, and the entries come
   down the same way.  No task reads all segments of a scope.
4. *Text.*  With its entry known a segment is walked again (numbers only), which gives the entry of each of its text
   segments: as many units as fit ``pack_segment_bytes`` at the scope's longest text.  Text meets its entries by one
   exchange, and chunks that cross a border are merged.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..session import WorkDir, work_dir
from .numbering import with_numbers


class _Greedy:
    """Chunk starts of one segment, from any start position.

    Plain lists and ``bisect``: segments are usually a few dozen units, where
    per-call numpy overhead would dominate.
    """

    def __init__(self, ests, budget: int, max_strings: int):
        self.n = len(ests)
        P = [0] * (self.n + 1)
        acc = 0
        for i, e in enumerate(ests):
            acc += int(e)
            P[i + 1] = acc
        self.P = P
        self.B = budget
        self.K = max_strings

    def next_start(self, p: int) -> int:
        # first k with P[k] > P[p] + B; unit k-1 is the first that no longer fits
        k = bisect_right(self.P, self.P[p] + self.B)
        return max(p + 1, min(k - 1, p + self.K))

    def starts_from(self, p: int) -> list[int]:
        out = []
        while p < self.n:
            out.append(p)
            p = self.next_start(p)
        return out


def _assign_schema(scope_type) -> T.StructType:
    return T.StructType([
        T.StructField("scope", scope_type),
        T.StructField("ord", T.LongType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
    ])


def iter_groups(batches, keys: list[str], cols: list[str]):
    """Complete groups of a stream of pandas batches sorted by ``keys``.

    Yields ``dict[col -> list]`` per group.  A group may span Arrow batches;
    its head is carried to the next batch.  Memory is one batch plus one group.
    """
    carry: dict | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        data = {c: pdf[c].tolist() for c in cols}
        if carry is not None:
            data = {c: carry[c] + data[c] for c in cols}
        n = len(data[cols[0]])
        kv = [data[k] for k in keys]
        starts = [0] + [i for i in range(1, n) if any(a[i] != a[i - 1] for a in kv)]
        for a, b in zip(starts, starts[1:]):
            yield {c: data[c][a:b] for c in cols}
        carry = {c: data[c][starts[-1]:] for c in cols}
    if carry is not None and carry[cols[0]]:
        yield carry


#: neighbouring maps that one task composes
FAN = 64


class _Map:
    """What a run of segments does with a chunk that starts at one of its first units.

    By entry: the entry behind the run, the chunks that start in it, and the number and ``ord`` of the last of them.
    An entry behind the last unit of a scope's last segment starts nothing there.
    """

    FIELDS = ("exit", "chunks", "last", "last_ord")

    def __init__(self, exit, chunks, last, last_ord):
        self.exit, self.chunks, self.last, self.last_ord = (np.asarray(x, np.int64) for x in (exit, chunks, last, last_ord))

    @classmethod
    def of_units(cls, ests: list, ords: list, n: int, first: int, budget: int, most: int) -> "_Map":
        """Of a segment: the estimates and orders of its ``n`` units and of those after it; ``first``: its first unit's number."""
        gr = _Greedy(ests, budget, most)
        info: dict[int, tuple[int, int, int]] = {}            # start -> (exit, chunks from here, last start)
        out = []
        for b in range(min(most, n)):
            path, p = [], b
            while p < n and p not in info:
                path.append(p)
                p = gr.next_start(p)
            got = info[p] if p < n else (p - n, 0, -1)
            for q in reversed(path):
                got = (got[0], got[1] + 1, got[2] if got[2] >= 0 else q)
                info[q] = got
            out.append((info[b][0], info[b][1], first + info[b][2], ords[info[b][2]]))
        return cls(*zip(*out))

    def then(self, other: "_Map") -> "_Map":
        """This run and the one behind it."""
        inside = self.exit < len(other.exit)
        at = np.where(inside, self.exit, 0)
        pick = lambda mine, theirs: np.where(inside, theirs[at], mine)
        return _Map(pick(self.exit, other.exit), self.chunks + np.where(inside, other.chunks[at], 0),
                    pick(self.last, other.last), pick(self.last_ord, other.last_ord))

    def at(self, b: int):
        return tuple(int(x[b]) for x in (self.exit, self.chunks, self.last, self.last_ord))


_MAP_DDL = "exit array<long>, chunks array<long>, last array<long>, last_ord array<long>"


def _stored(units: DataFrame, settings: Settings, work: WorkDir, text: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Units of scopes that one task may walk, and the sizes of the others (None: there are none)."""
    long = F.octet_length(F.col(text[0])) if text else F.lit(0)
    sizes = units.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(long).alias("bytes"), F.max(long).alias("longest"))
    unit = max(settings.pack_segment_units, settings.chunk_max_strings)
    large = sizes.where((F.col("n") > settings.pack_segment_units) | (F.col("bytes") > settings.pack_segment_bytes))
    fit = F.expr(f"int({settings.pack_segment_bytes} div greatest(longest, 1))")
    large = work.materialize(large.select("scope", "n", F.lit(unit).alias("unit"), F.greatest(F.lit(1), F.least(F.lit(unit), fit)).alias("each")),
                             f"pack-{uuid.uuid4().hex[:8]}/large")
    if large.limit(1).count() == 0:
        return units, None
    return units.join(large.select("scope"), "scope", "left_anti"), large


def _numbered(units: DataFrame, large: DataFrame, work: WorkDir, name: str) -> DataFrame:
    """The units of large scopes with ``g`` (number in the scope from 0), ``unit``, ``each`` and ``total``."""
    own = units.join(large.select("scope"), "scope", "left_semi")
    got = with_numbers(own, ["scope"], ["ord"], work, name, "g")
    return got.join(large.withColumnRenamed("n", "total"), "scope")


def _grouped(df: DataFrame, keys: list[str], order: list[str], solve, schema: str) -> DataFrame:
    """``solve(group)`` -> rows, for each group of ``keys`` sorted by ``order``; streams, a group at a time."""
    cols = df.columns
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        rows = []
        for g in iter_groups(batches, keys, cols):
            rows += solve(g)
            if len(rows) >= 5_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _maps_of(g: dict) -> list[_Map]:
    return [_Map(*(g[f][i] for f in _Map.FIELDS)) for i in range(len(g["node"]))]


def _tree(maps: DataFrame, scopes: DataFrame, segments: int, work: WorkDir, name: str, scope: str) -> DataFrame:
    """(scope, node, b, before, last, last_ord): the entry of every segment from the maps of all."""
    levels = [maps]

    def combined(g):
        whole = _maps_of(g)
        m = whole[0]
        for x in whole[1:]:
            m = m.then(x)
        return [(g["scope"][0], int(g["parent"][0]), *(getattr(m, f).tolist() for f in _Map.FIELDS))]

    def handed_down(g):
        b, before, last, last_ord = (g[c][0] for c in ("b", "before", "last_in", "ord_in"))
        out, b, before = [], int(b), int(before)
        none = last is None or last != last
        last, last_ord = (-1, 0) if none else (int(last), int(last_ord))
        for node, exit, chunks, lasts, ords in zip(*(g[c][1:] for c in ("node", *_Map.FIELDS))):
            out.append((g["scope"][0], int(node), b, before, last, last_ord))
            if b < len(exit):
                b, before, last, last_ord = int(exit[b]), before + int(chunks[b]), int(lasts[b]), int(ords[b])
        return out

    while segments > FAN:
        up = _grouped(levels[-1].withColumn("parent", F.expr(f"node div {FAN}")), ["scope", "parent"], ["node"], combined,
                      f"scope {scope}, node long, {_MAP_DDL}")
        levels.append(work.materialize(up, f"{name}/level{len(levels)}"))
        segments = -(-segments // FAN)
    entries = scopes.select("scope", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("before"),
                            F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("last_ord"))
    for number in range(len(levels) - 1, -1, -1):
        nothing = [F.lit(None).cast("array<long>").alias(f) for f in _Map.FIELDS]
        top = entries.select("scope", F.col("node").alias("parent"), F.lit(-1).cast("long").alias("node"), *nothing, "b", "before",
                             F.col("last").alias("last_in"), F.col("last_ord").alias("ord_in"))
        below = levels[number].select("scope", F.expr(f"node div {FAN}").alias("parent"), "node", *_Map.FIELDS,
                                      *[F.lit(None).cast("long").alias(c) for c in ("b", "before", "last_in", "ord_in")])
        entries = _grouped(top.unionByName(below), ["scope", "parent"], ["node"], handed_down,
                           f"scope {scope}, node long, b long, before long, last long, last_ord long")
        entries = work.materialize(entries, f"{name}/entries{number}")
    return entries


def _text_segment():
    """Number of the text segment of a unit: text segments don't cross segments."""
    per = F.expr("(unit + each - 1) div each")
    return F.expr("g div unit") * per + F.expr("(g % unit) div each")


def _entries(numbered: DataFrame, large: DataFrame, settings: Settings, work: WorkDir, name: str) -> DataFrame:
    """One row per text segment of the large scopes: ``ENTRY_COLS``."""
    B, K = settings.chunk_token_budget, settings.chunk_max_strings
    scope = numbered.schema["scope"].dataType.simpleString()
    light = numbered.select("scope", "g", F.col("ord").cast("long").alias("ord"), F.col("est").cast("long").alias("est"),
                            F.col("unit").cast("long").alias("unit"), F.col("each").cast("long").alias("each"), F.col("total").cast("long").alias("total"))

    # a segment's first K units are also what its predecessor looks ahead to
    seg = F.expr("g div unit")
    near = F.when((F.expr("g % unit") < K) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))

    def mapped(g):
        first, unit = g["node"][0] * g["unit"][0], g["unit"][0]
        n = min(unit, g["total"][0] - first)
        m = _Map.of_units(g["est"], g["ord"], int(n), int(first), B, K)
        return [(g["scope"][0], int(g["node"][0]), *(getattr(m, f).tolist() for f in _Map.FIELDS))]

    maps = work.materialize(_grouped(light.select("*", F.explode(near).alias("node")).drop("each"), ["scope", "node"], ["g"], mapped,
                                     f"scope {scope}, node long, {_MAP_DDL}"), f"{name}/maps")
    most = large.agg(F.max(F.expr("(n + unit - 1) div unit"))).first()[0]
    entries = _tree(maps, large, int(most), work, name, scope)

    def split(g):
        b, before, last, last_ord = (int(g[c][0]) for c in ("b", "before", "last", "last_ord"))
        ests, ords, numbers = g["est"][1:], g["ord"][1:], g["g"][1:]
        if not ests:
            return []
        n, first, unit, each, total = len(ests), int(numbers[0]), int(g["unit"][1]), int(g["each"][1]), int(g["total"][1])
        starts = _Greedy(ests, B, K).starts_from(min(b, n))
        per, out = -(-unit // each), []
        for t, at in enumerate(range(0, n, each)):
            i = bisect_left(starts, at)                        # chunks of this segment that start before
            open_g, open_ord = (first + starts[i - 1], ords[starts[i - 1]]) if i else (last, last_ord)
            end = min(at + each, n)
            nxt = starts[i] if i < len(starts) else n
            out.append((g["scope"][0], first // unit * per + t, min(nxt, end) - at, int(open_ord), first + at - open_g if open_g >= 0 else 0,
                        before + i, first + end >= total))
        return out

    unit_rows = light.select("scope", F.expr("g div unit").alias("node"), F.lit(1).alias("kind"), "g", "ord", "est", "unit", "each", "total",
                             *[F.lit(None).cast("long").alias(c) for c in ("b", "before", "last", "last_ord")])
    entry_rows = entries.select("scope", "node", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("g", "ord", "est", "unit", "each", "total")],
                                "b", "before", "last", "last_ord")
    return _grouped(unit_rows.unionByName(entry_rows), ["scope", "node"], ["kind", "g"], split,
                    f"scope {scope}, seg long, entry_b long, open_id long, open_cnt long, chunks_before long, is_last boolean")


def _large_segments(units: DataFrame, large: DataFrame, settings: Settings, work: WorkDir, text: list[str]) -> DataFrame:
    """Entry and units of each text segment of the large scopes, one sorted stream (see :func:`_tagged`)."""
    name = f"pack-{uuid.uuid4().hex[:8]}"
    numbered = _numbered(units, large, work, name)
    entries = _entries(numbered, large, settings, work, name)
    seg = numbered.withColumn("seg", _text_segment()).select(
        "scope", F.col("ord").cast("bigint").alias("ord"), F.col("est").cast("bigint").alias("est"), "seg", *text)
    return _tagged(seg, entries, text)


def _whole_scopes(units: DataFrame, text: list[str]) -> DataFrame:
    """Units of scopes of one segment, in the form of :func:`_tagged` without entry rows."""
    return (units.select("scope", F.col("ord").cast("bigint").alias("ord"), F.col("est").cast("bigint").alias("est"), *text)
            .repartition("scope").sortWithinPartitions("scope", "ord"))


_NO_ENTRY = {"entry_b": 0, "open_id": None, "open_cnt": 0, "chunks_before": 0, "is_last": True}


def _segment_groups(batches, cols: list[str], whole: bool):
    """Groups with their entry row first; a whole scope starts at its first unit."""
    if not whole:
        yield from iter_groups(batches, ["scope", "seg"], cols)
        return
    own = [c for c in cols if c not in _NO_ENTRY and c not in ("seg", "kind")]
    for g in iter_groups(batches, ["scope"], own):
        yield {"scope": g["scope"][:1] + g["scope"], **{c: [None] + g[c] for c in own if c != "scope"}, **{c: [v] for c, v in _NO_ENTRY.items()}}


def _tagged(seg: DataFrame, entries: DataFrame, unit_cols: list[str]) -> DataFrame:
    """Entry row (kind 0) first, then the segment's units (kind 1), one sorted stream."""
    utypes = dict(seg.dtypes)
    units = seg.select("scope", "seg", F.lit(1).alias("kind"), "ord", "est", *unit_cols,
                       *[F.lit(None).cast("bigint").alias(c) for c in ("entry_b", "open_id", "open_cnt", "chunks_before")],
                       F.lit(None).cast("boolean").alias("is_last"))
    ents = entries.select("scope", "seg", F.lit(0).alias("kind"),
                          F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("est"),
                          *[F.lit(None).cast(utypes[c]).alias(c) for c in unit_cols],
                          "entry_b", "open_id", "open_cnt", "chunks_before", "is_last")
    return (units.unionByName(ents).repartition("scope", "seg")
            .sortWithinPartitions("scope", "seg", "kind", "ord"))


def _walk(g: dict, B: int, K: int):
    """Chunk pieces of one segment group (row 0 = entry row).

    Yields ``(lo, hi, chunk_id, chunk_no, first_pos, is_head)`` over unit
    indices ``[lo, hi)`` of the group's units.
    """
    n = len(g["ord"]) - 1
    if n <= 0:
        return
    ests, ords = g["est"][1:], g["ord"][1:]
    gr = _Greedy(ests, B, K)
    b = min(int(g["entry_b"][0]), n)
    k = int(g["chunks_before"][0])
    if b > 0:
        yield 0, b, int(g["open_id"][0]), k, int(g["open_cnt"][0]) + 1, True
    p = b
    while p < n:
        k += 1
        q = min(gr.next_start(p), n)
        yield p, q, int(ords[p]), k, 1, False
        p = q


def _packed(units: DataFrame, settings: Settings, work: WorkDir | None, text: list[str], assign, schema) -> DataFrame:
    """``assign`` over the groups of both ways: scopes of one segment, and segments of the large ones."""
    work = work or work_dir(units.sparkSession)
    whole, large = _stored(units, settings, work, text)
    out = _whole_scopes(whole, text).mapInPandas(lambda b: assign(b, True), schema)
    if large is None:
        return out
    return out.unionByName(_large_segments(units, large, settings, work, text).mapInPandas(lambda b: assign(b, False), schema))


def pack_chunks(units: DataFrame, settings: Settings = DEFAULT, work: WorkDir | None = None) -> DataFrame:
    """Assign chunks to deduplicated units (a stored table: it is read more than once).

    ``units`` needs ``scope`` (any type), ``ord`` (BIGINT, unique in the
    scope) and ``est`` (INT).  Returns ``scope, ord, chunk_id, chunk_no, pos``.

    Python is entered once per Arrow batch, not once per group.
    """
    B, K = settings.chunk_token_budget, settings.chunk_max_strings
    out_cols = ["scope", "ord", "chunk_id", "chunk_no", "pos"]
    cols = ["scope", "seg", "kind", "ord", "est", "entry_b", "open_id", "open_cnt", "chunks_before"]

    def assign(batches, whole):
        acc = {c: [] for c in out_cols}
        for g in _segment_groups(batches, cols, whole):
            ords = g["ord"][1:]
            for lo, hi, cid, cno, first, _ in _walk(g, B, K):
                acc["scope"] += g["scope"][1 + lo:1 + hi]
                acc["ord"] += ords[lo:hi]
                acc["chunk_id"] += [cid] * (hi - lo)
                acc["chunk_no"] += [cno] * (hi - lo)
                acc["pos"] += list(range(first, first + hi - lo))
            if len(acc["ord"]) >= 10_000:   # one Arrow batch per ~10k rows, not per group
                yield pd.DataFrame(acc, columns=out_cols)
                acc = {c: [] for c in out_cols}
        if acc["ord"]:
            yield pd.DataFrame(acc, columns=out_cols)

    return _packed(units.select("scope", "ord", "est"), settings, work, [], assign, _assign_schema(units.schema["scope"].dataType))


def _whole_runs(batches, key: str):
    """Arrow batches of complete groups from a stream of them sorted by ``key``; a group cut by a batch's end waits for its rest."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.diff(code))
        last = int(new[-1]) + 1 if len(new) else 0            # where the last group starts
        if held and held[-1].column(key)[-1] != b.column(key)[0]:
            yield pa.concat_batches(held)
            held = []
        if last:
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.concat_batches(held)


def whole_chunk_rows(batches, budget: int, most: int):
    """Chunk rows of whole scopes from Arrow batches (``scope, ord, est, text, context``) sorted by ``(scope, ord)``.

    Units of a chunk are neighbours, so its lists are slices of the columns: no text becomes a Python object.
    """
    for b in _whole_runs(batches, "scope"):
        code = b.column("scope").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        heads = np.append(0, np.flatnonzero(np.diff(code)) + 1).tolist()
        total = np.append(0, np.cumsum(b.column("est").to_numpy(zero_copy_only=False).astype(np.int64))).tolist()
        starts, numbers, first = [], [], []
        for head, end in zip(heads, [*heads[1:], b.num_rows]):
            p, k = head, 0
            while p < end:
                k += 1
                starts.append(p)
                numbers.append(k)
                first.append(head)
                # the first unit that no longer fits; a chunk has one unit at least
                far = min(p + most, end)
                p = max(p + 1, bisect_right(total, total[p] + budget, p, far + 1) - 1)
        at, cuts = pa.array(starts, pa.int64()), pa.array([*starts, b.num_rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column("scope").take(at), b.column("ord").take(at), pa.array(numbers, pa.int32()), b.column("context").take(pa.array(first, pa.int64())),
             pa.ListArray.from_arrays(cuts, b.column("ord")), pa.ListArray.from_arrays(cuts, b.column("text"))],
            ["scope", "chunk_id", "chunk_no", "context", "ords", "items"])


def pack_chunk_rows(units: DataFrame, settings: Settings = DEFAULT, work: WorkDir | None = None) -> DataFrame:
    """Pack and assemble in one pass: chunk rows with their texts.

    ``units``: ``scope, ord, est, text, context``, stored.  Returns ``scope,
    chunk_id, chunk_no, context, ords ARRAY<BIGINT>, items ARRAY<STRING>``.

    The assign pass carries the text, so a chunk lying inside one segment
    leaves it complete; only pieces that may cross a segment boundary (the
    head continuing an open chunk, the last chunk of a segment that is not
    its scope's last) meet again in a small ``groupBy``.  An ordinary
    document is one segment, so its chunks never shuffle a second time.
    """
    B, K = settings.chunk_token_budget, settings.chunk_max_strings
    schema = T.StructType([
        T.StructField("scope", units.schema["scope"].dataType), T.StructField("chunk_id", T.LongType()),
        T.StructField("chunk_no", T.IntegerType()), T.StructField("context", T.StringType()),
        T.StructField("first_pos", T.IntegerType()), T.StructField("ords", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("open", T.BooleanType())])
    cols = ["scope", "seg", "kind", "ord", "est", "text", "context", "entry_b", "open_id", "open_cnt",
            "chunks_before", "is_last"]

    def assign(batches):
        rows = []
        for g in _segment_groups(batches, cols, False):
            n = len(g["ord"]) - 1
            last_seg = bool(g["is_last"][0])
            ords, texts, ctx = g["ord"][1:], g["text"][1:], (g["context"][1] if n > 0 else None)
            for lo, hi, cid, cno, first, head in _walk(g, B, K):
                is_open = head or (hi == n and not last_seg)
                rows.append((g["scope"][0], cid, cno, ctx, first, ords[lo:hi], texts[lo:hi], is_open))
            if len(rows) >= 2_000:
                yield pd.DataFrame(rows, columns=schema.fieldNames())
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    text = ["text", "context"]
    own = units.select("scope", "ord", "est", *text)
    work = work or work_dir(units.sparkSession)
    whole, large = _stored(own, settings, work, text)
    columns = ["scope", "chunk_id", "chunk_no", "context", "ords", "items"]
    done = _whole_scopes(whole, text).mapInArrow(lambda b: whole_chunk_rows(b, B, K), T.StructType([schema[c] for c in columns]))
    if large is None:
        return done
    # read twice, by the two halves below; the walk is cheaper than a copy of the texts
    pieces = _large_segments(own, large, settings, work, text).mapInPandas(assign, schema)
    merged = (pieces.filter(F.col("open"))
              .groupBy("scope", "chunk_id")
              .agg(F.min("chunk_no").alias("chunk_no"), F.min("context").alias("context"),
                   F.array_sort(F.collect_list(F.struct("first_pos", "ords", "items"))).alias("p"))
              .select("scope", "chunk_id", "chunk_no", "context",
                      F.flatten(F.col("p.ords")).alias("ords"), F.flatten(F.col("p.items")).alias("items")))
    return done.unionByName(pieces.filter(~F.col("open")).select(*columns)).unionByName(merged)
