"""Suffix-array dedup on bytes: remove what a 50-byte string repeats (hash-compared suffix sort).

The suffixes that may share a 50-byte start meet in the bucket of their
minimiser.  There they are sorted: by their first eight bytes, then by a
mergesort whose comparison finds the common extension of two suffixes by binary
search over prefix polynomial hashes (one probe for all 50 bytes, six more if
they differ; eight bytes and less are their own hash) and looks at the first byte after it.  Merges of all groups run in step, as numpy passes.
Neighbours that the hashes call equal are compared byte by byte; if any pair
differs (a collision), the bucket's strings are told apart by their bytes.

Defined cases: null text counts as empty; a null id ranks after all ids (two
null ids repeat nothing of each other); rows with the same id don't repeat each
other; rows equal in id and text have equal results, each its own row; an empty
table gives an empty result; other columns are passed by or ignored.  Removal
is by bytes, so ``kept`` is binary; ``kept_text`` drops the halves of characters
that a cut leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

from lexiflow.llm import kernels as K
from lexiflow.llm.repeats import Unit, equal_bytes, spans_of, with_spans

WINDOW = 50


def _grams(byte, s, most):
    """{length: a number of the string of that length at each place}: hashes; up to eight bytes, the bytes themselves.

    Lengths are ``most`` and the powers of two under it; at the end of the bytes the numbers mean nothing.
    """
    _, inv = K.powers(len(s))
    padded = np.append(byte, np.zeros(8, np.uint8))
    out, step = {}, 1
    while step < most:
        out[step] = np.ndarray(len(byte), f"<u{step}", padded, strides=(1,)) if step <= 8 else None
        step *= 2
    for e in [most, *(e for e, x in out.items() if x is None)]:
        n = max(len(byte) - e + 1, 0)
        h = np.zeros(len(byte), np.uint64)
        np.subtract(s[e: e + n], s[:n], out=h[:n])
        h *= inv[: len(h)]
        out[e] = h
    return out


def _common(grams, a, b, most):
    """Length of the common start of the suffixes a and b, up to ``most`` bytes, by hashes."""
    whole = grams[most]
    got = np.full(len(a), most)
    i = np.flatnonzero(whole[a] != whole[b])
    x, y, n = a[i], b[i], np.zeros(len(i), np.int64)
    step = 1 << ((most - 1).bit_length() - 1) if most > 1 else 0
    while step:
        h = grams[step]
        # what lies beyond the string isn't part of it (and a longer common start would have made it whole)
        same = (n + step < most) & (h[x + n] == h[y + n])
        n += same * step
        step >>= 1
    got[i] = n
    return got


def _less(byte, grams, a, b, most, equal_too):
    """Whether suffix a sorts before suffix b (or is equal, where ``equal_too``)."""
    n = _common(grams, a, b, most)
    full = n == most
    n = np.minimum(n, most - 1)
    return np.where(full, equal_too, byte[a + n] < byte[b + n])


def _merge_sort(byte, grams, pos, group_start, group_end, most):
    """Sorts pos within each group (given per element by its bounds); all merges of a pass run in step."""
    n = len(pos)
    at = np.arange(n)
    local = at - group_start
    width, largest = 1, int((group_end - group_start).max(initial=1))
    while width < largest:
        left = (local // width) % 2 == 0
        own = group_start + (local // width) * width                   # start of the element's run
        other = np.where(left, own + width, own - width)
        other_end = np.minimum(other + width, group_end)
        other = np.minimum(other, group_end)
        lo, hi = other.copy(), np.maximum(other_end, other)
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            # elements of the right run go before this one if less; those of the left run if less or equal
            before = _less(byte, grams, pos[mid], pos[act], most, ~left[act])
            lo[act] = np.where(before, mid + 1, lo[act])
            hi[act] = np.where(before, hi[act], mid)
            act = act[lo[act] < hi[act]]
        to = np.where(left, own, other) + (at - own) + (lo - other)
        out = np.empty_like(pos)
        out[to] = pos
        pos = out
        width *= 2
    return pos


def _label_bytes(window: int):
    def solve(byte, s, at, ln, size, key):
        pos = K.ranges(at, size)
        _, group = np.unique(key, return_inverse=True)
        group = np.repeat(group, size).astype(np.uint64)
        if window >= 8:
            lead = np.ndarray(len(byte), ">u8", np.append(byte, np.zeros(8, np.uint8)), strides=(1,))[pos].astype(np.uint64)
        else:
            lead = np.zeros(len(pos), np.uint64)
            for i in range(window):
                lead = (lead << np.uint64(8)) | byte[pos + i]
        o = np.lexsort((lead, group))
        p, g, l = pos[o], group[o], lead[o]
        new = np.append(True, (g[1:] != g[:-1]) | (l[1:] != l[:-1]))
        first = np.flatnonzero(new)
        size_of = np.diff(np.append(first, len(p)))
        many = np.repeat(size_of > 1, size_of)
        start, end = np.repeat(first, size_of), np.repeat(first + size_of, size_of)
        # only suffixes with company are merged; their bounds are renumbered
        idx = np.flatnonzero(many)
        shift = np.cumsum(~many) if len(many) else many
        grams = _grams(byte, s, window)
        q = _merge_sort(byte, grams, p[idx], start[idx] - shift[idx], end[idx] - shift[idx], window)
        p = p.copy()
        p[idx] = q
        near = np.flatnonzero(~new)                       # has a neighbour before it in its group
        a, b = p[near - 1], p[near]
        alike = grams[window][a] == grams[window][b]
        if not equal_bytes(byte, a[alike], b[alike], np.full(int(alike.sum()), window)).all():
            own: dict[bytes, int] = {}                    # a collision: tell the strings apart by their bytes
            return np.array([own.setdefault(byte[i: i + window].tobytes(), len(own)) for i in pos], np.int64)
        fresh = np.ones(len(p), bool)
        fresh[near[alike]] = False
        label = np.empty(len(p), np.int64)
        where = np.empty(int(len(byte)), np.int64)
        where[p] = np.cumsum(fresh) - 1
        label[:] = where[pos]
        return label
    return solve


def _cut(raw: bytes, blob: bytes) -> bytes:
    a, e = spans_of(blob)
    edge = np.concatenate([[0], np.ravel(np.column_stack([a, e])), [len(raw)]])
    return b"".join(raw[i:j] for i, j in edge.reshape(-1, 2).tolist())


def _results(batches):
    """(id, text, spans) -> (id, n_bytes, kept, spans)."""
    for batch in batches:
        for part in K.slices(batch, batch.schema.names[1]):
            buf, off = K.utf8(part.column(1))
            blobs, edge = K.utf8(part.column(2))
            a, e = spans_of(blobs.tobytes())
            n = np.diff(edge) // 8                        # spans of each row
            row = np.repeat(np.arange(len(n)), n)
            step = np.zeros(len(buf) + 1, np.int8)
            np.add.at(step, off[row] + a, 1)
            np.add.at(step, off[row] + e, -1)
            left = buf[np.cumsum(step[:-1], dtype=np.int8) == 0]
            size = np.diff(off)
            kept = np.append(0, np.cumsum(size - np.bincount(row, e - a, len(n)).astype(np.int64)))
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(a), pa.array(e)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.Array.from_buffers(pa.binary(), len(n), [
                None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(left)]), spans], ["doc_id", "n_bytes", "kept", "spans"])


def _replaced(text: int):
    """All columns and the spans -> all columns with the text cut, and whether nothing is left of it."""
    def run(batches):
        for batch in batches:
            new, gone = [], []
            for x, b in zip(batch.column(text), batch.column(batch.num_columns - 1)):
                blob = b.as_py()
                if blob:
                    new.append(_cut(x.as_py().encode(), blob).decode(errors="ignore"))
                    gone.append(not new[-1])
                else:
                    new.append(x.as_py())
                    gone.append(False)
            cols = batch.columns[:-1]
            cols[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone)], [*batch.schema.names[:-1], "__lf_gone"])
    return run


def unit(window: int = WINDOW, gram: int = 20, **limits) -> Unit:
    return Unit(False, window, min(gram, window), _label_bytes(window), **limits)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          window: int = WINDOW, gram: int = 20, **limits) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans (the removed byte ranges, maximal)."""
    own = docs.select(id_col, text_col)
    got = with_spans(own, unit(window, gram, **limits), id_col, text_col).select(id_col, text_col, "__lf_spans")
    kind = dict(docs.dtypes)[id_col]
    return got.mapInArrow(_results, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut out of the text; rows of which nothing is left go.

    A text that was null or empty before stays as it is; halves of characters at a cut are dropped.
    """
    got = with_spans(docs, unit(window), id_col, text_col).select(*docs.columns, "__lf_spans")
    schema = StructType([*docs.schema.fields, StructField("__lf_gone", BooleanType())])
    return got.mapInArrow(_replaced(docs.columns.index(text_col)), schema).where("not __lf_gone").drop("__lf_gone")
