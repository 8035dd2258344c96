"""Find windows (of bytes or of words) that also start in a row with a smaller id.

Shared by the two substring operators; each brings its unit and the way it
compares the windows of one bucket.

1. *Runs.*  The minimiser of a window is the least gram hash inside it.
   Consecutive windows with the same minimiser form a run.  Equal windows have
   equal minimisers, so a run whose minimiser no other row has needs no further
   look.  Each chunk of rows (some MB) sends every minimiser once to its bucket.
   A minimiser that several rows of the chunk hold is known to be shared, and
   its addresses travel to any bucket, so a passage that a third of the rows
   hold costs a bucket one entry per chunk.
2. *Fragments.*  Rows get their shared runs back (one join by row) and cut the
   text of each run.  Equal fragments of one chunk are settled there: all but
   those of the smallest id are repeats.  One travels on to the bucket of its
   minimiser.  A minimiser with very many holders (``hot``) is dealt by longer strings: windows at
   about the same distance from it (``NEAR``) have all but some units in common, so its bucket splits.
3. *Buckets.*  Windows are compared exactly and each gets the smallest id.  A bucket is compared in
   runs of whole minimisers of some MB, so memory follows that size and not the bucket's; a single minimiser over
   it (periodic texts) is compared by its distinct windows, fragment by fragment.
4. *Rows.*  Spans go back to their rows (the second join, on the same exchange).

Addresses and spans travel as packs: a task sends one to each group of rows (by a hash of the row), where they are
sorted into one record per row before the join.  So their records follow the rows and tasks, not the buckets a row meets.

Rows are told apart by id and a 32-bit hash of the text: rows equal in both have
equal results.  A null id ranks after every other id.  Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import LAST_ID, let_go, pack, partitions, unpack, written

#: so many hot minimisers at most are named (8 bytes each), those with the most holders first
MOST_HOT = 1_000_000
#: distances from a hot minimiser that go together: equal windows have equal distances, so only the bucket changes
NEAR = 8
ID, TH = "__lf_id", "__lf_th"


@dataclass(frozen=True)
class Unit:
    """What a window counts."""

    words: bool
    window: int
    gram: int
    solve: Callable      # (bytes, prefix hash, place, length, windows, key) of fragments -> a label of each window
    #: bytes of text that a task gathers before it sends, and bytes that one numpy pass covers; limits of memory only
    chunk: int = 8 << 20
    piece: int = 1 << 20
    #: bytes of fragments that a bucket compares at once (whole minimisers, or classes of windows of a larger one)
    part: int = 2 << 20
    #: from this number of holders on, a minimiser is dealt by longer strings; only the bucket changes, never the result
    hot: int = 2000


def _find_runs(unit: Unit, buf: np.ndarray, off: np.ndarray):
    """Row, first window, window count and minimiser of each run; the word table for words; each window's minimiser's place."""
    with np.errstate(over="ignore"):
        s = K.prefix_hash(buf)
        if unit.words:
            ws, we, first = K.words(buf, off)
            gram = K.shingle_hash(K.span_hash(s, ws, we), unit.gram)
            tab = (ws, we, first)
        else:
            first, tab = off, None
            n = max(len(buf) - unit.gram + 1, 0)
            gram = s[unit.gram: unit.gram + n] - s[:n]
            gram *= K.powers(len(s))[1][:n]          # mixed only where it is a minimiser
        order = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        place = K.window_min(order, unit.window - unit.gram + 1).astype(np.uint32)
        count = np.maximum(np.diff(first) - unit.window + 1, 0)
        held = np.flatnonzero(count)
        # windows of one minimiser's place; what lies between the windows of two rows goes
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        new[first[held]] = True
        last = first[held] + count[held]
        new[last[last < len(new)]] = True
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        row = np.searchsorted(first, at, "right") - 1
        i = np.flatnonzero(at < (first[:-1] + count)[row])
        at, size, row = at[i], size[i], row[i]
        h = gram[place[at]]
        if not unit.words:
            h = K.mix(h)
        # a minimiser may come again at the next place
        i = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else at
        size = np.add.reduceat(size, i) if len(i) else size
    return row[i], at[i] - first[row[i]], size, h[i], first, tab, s, place


def _chunks(unit: Unit, batches: Iterator[pa.RecordBatch], column: str, take: Callable) -> Iterator[list]:
    """``take(slice)`` of consecutive slices, gathered up to ``chunk`` bytes of text."""
    got, size = [], 0
    let_go()
    for batch in batches:
        for part in K.slices(batch, column, unit.piece):
            one = take(part)
            got.append(one)
            size += one[-1]
            if size >= unit.chunk:
                yield got
                got, size = [], 0
    if got:
        yield got


def _join(parts: list, i: int) -> np.ndarray:
    return np.concatenate([p[i] for p in parts])


def _entries(unit: Unit, buckets: int):
    """Task: rows -> (bucket, payload) of minimisers, ids and addresses."""
    def take(part):
        buf, off = K.utf8(part.column(2))
        row, start, _, h, *_ = _find_runs(unit, buf, off)
        return part.column(0).to_numpy()[row], part.column(1).to_numpy()[row], start, h, len(buf) + 64 * part.num_rows

    return lambda batches: _send(_chunks(unit, batches, "t", take), buckets)


def _by_hash(h: np.ndarray) -> np.ndarray:
    """An order in which equal hashes lie together, each in the order it came (but for hashes equal in their leading 40 bits or so)."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    return (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)


def _by_bucket(dest: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, stable, and where each bucket begins."""
    o = np.argsort(dest.astype(np.uint16) if buckets < 1 << 16 else dest, kind="stable")
    return o, np.append(0, np.cumsum(np.bincount(dest, minlength=buckets)))


def _send(chunks: Iterator[list], buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks of (id, th, start, hash) -> (bucket, known, payload): every hash of a chunk once, to its bucket."""
    salt = 0
    for got in chunks:
        ids, th, start, h = (_join(got, i) for i in range(4))
        if not len(h):
            continue
        head = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]))
        row = np.cumsum(head) - 1
        num, rows = _numbers(ids[head], th[head])
        if rows < len(num):                         # a row (or its equal) comes in several places
            row = num[row]
            i = np.argsort(row, kind="stable")
            ids, th, start, h, row = ids[i], th[i], start[i], h[i], row[i]
        o = _by_hash(h)
        ids, th, start, h, row = ids[o], th[o], start[o].astype(np.uint32), h[o], row[o]
        new = np.append(True, h[1:] != h[:-1])
        doc = np.append(True, row[1:] != row[:-1]) | new
        g = np.cumsum(new) - 1
        rows = np.bincount(g, doc)                  # rows of the chunk that hold it
        many = rows[g] > 1
        dest = (h % np.uint64(buckets)).astype(np.int64)
        short = (h >> np.uint64(32)).astype(np.uint32)   # within a bucket these bits tell minimisers apart well enough
        # addresses of minimisers that are known to be shared go anywhere; those that may be, to their bucket
        lone, mark = np.flatnonzero(~many), np.flatnonzero(many & new)
        i, cuts = _by_bucket(dest[lone], buckets)
        lone = lone[i]
        i, mcut = _by_bucket(dest[mark], buckets)
        mark = mark[i]
        columns = [x[lone] for x in (short, ids, th, start)]
        marks = [short[mark], rows[g[mark]].astype(np.uint32)]
        out_b = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(mcut) > 0)).tolist()
        out_p = [pack(*(x[cuts[b]: cuts[b + 1]] for x in columns), *(x[mcut[b]: mcut[b + 1]] for x in marks)) for b in out_b]
        yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array([False] * len(out_b)),
                                          pa.array(out_p, pa.binary())], ["b", "known", "p"])
        i = np.flatnonzero(many)
        for at in range(0, len(i), 1 << 16):
            j, salt = i[at: at + (1 << 16)], salt + 1
            to = int((int(h[j[0]]) >> 17) + salt) % buckets
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([True]), pa.array(
                [pack(ids[j], th[j], start[j])], pa.binary())], ["b", "known", "p"])


def _numbers(ids: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, int]:
    """A dense number of each (id, th), in their order, and how many there are."""
    o = np.lexsort((th, ids))
    new = np.append(True, (ids[o][1:] != ids[o][:-1]) | (th[o][1:] != th[o][:-1]))
    num = np.empty(len(o), np.int64)
    num[o] = np.cumsum(new) - 1
    return num, int(new.sum())


#: values that a task gathers before it sends them to the groups of their rows; a limit of memory only
GATHER = 1 << 20
_PACK = pa.schema([("g", pa.int32()), ("p", pa.binary()), ("k", pa.int8())])


def _to_rows(found: Iterator[tuple], groups: int) -> Iterator[pa.RecordBatch]:
    """(ids, th, uint32 values ...) of rows, gathered and packed for the group of each row (k 0)."""
    got, size = [], 0

    def packed():
        ids, th, *values = (_join(got, i) for i in range(len(got[0])))
        with np.errstate(over="ignore"):
            to = (K.mix(ids.astype(np.uint64) * K.BASE ^ th.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        o = np.lexsort((ids, to))                     # a row's values together, for the packing
        cut = np.append(0, np.cumsum(np.bincount(to, minlength=groups)))
        columns = [ids[o], th[o].astype(np.uint32), *(v[o] for v in values)]
        out = np.flatnonzero(np.diff(cut)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(
            [pack(*(x[cut[g]: cut[g + 1]] for x in columns)) for g in out], pa.binary()), pa.array(np.zeros(len(out), np.int8))], schema=_PACK)

    for one in found:
        if not len(one[0]):
            continue
        got.append(one)
        size += len(one[0])
        if size >= GATHER:
            yield packed()
            got, size = [], 0
    if got:
        yield packed()


def _row_records(values: int):
    """Task: packs (group, payload), sorted by group -> (id, th, blob), one of each row: its sorted places, or its merged spans."""
    def run(batches):
        now, got = None, []
        for batch in batches:
            for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != now and got:
                    yield from group(got)
                    got = []
                now = g
                got.append(unpack(p, np.int64, np.uint32, *[np.uint32] * values))
        if got:
            yield from group(got)

    def group(got):
        ids, th, *x = (_join(got, i) for i in range(2 + values))
        o = np.lexsort((x[0], th, ids))
        ids, th, x = ids[o], th[o], [v[o] for v in x]
        new = np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]))
        own = np.flatnonzero(new)
        ids, th = ids[own], th[own].astype(np.int64)
        if values == 2:                               # each row's spans lie apart from the next row's
            base = (np.cumsum(new) - 1) << 32
            a, e = K.runs(base + x[0], base + x[1])
            own = np.searchsorted(a, np.arange(len(own)) << 32)
            x = [a & 0xFFFFFFFF, e & 0xFFFFFFFF]
        flat = np.column_stack(x).astype(np.uint32)
        cut = np.append(own, len(flat))
        for at in range(0, len(own), 20_000):
            c = cut[at: at + 20_001]
            blobs = pa.Array.from_buffers(pa.binary(), len(c) - 1, [None, pa.py_buffer(((c - c[0]) * (4 * values)).astype(np.int32)),
                                                                    pa.py_buffer(flat[c[0]: c[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at: at + 20_000]), pa.array(th[at: at + 20_000]), blobs], [ID, TH, "r"])
    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows (bucket, known, payload), sorted by bucket, as one list per bucket; known ones alone."""
    now, got = None, []
    for batch in batches:
        for b, known, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if known:
                yield [True, p]
                continue
            if b != now and got:
                yield [False, *got]
                got = []
            now = b
            got.append(p)
    if got:
        yield [False, *got]


def _shared(hot: int, groups: int):
    """Task: minimisers of a bucket -> addresses of the shared ones, for the groups of their rows (k 0), and the hot ones with their counts (k 1)."""
    def run(batches):
        very: list[pa.RecordBatch] = []
        yield from _to_rows(found(batches, very), groups)
        yield from very

    def found(batches, very):
        for known, *blobs in _buckets(batches):
            if known:
                yield tuple(unpack(blobs[0], np.int64, np.int64, np.uint32))
                continue
            got = [unpack(p, np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint32) for p in blobs]
            h, ids, th, start, mark, rows = (_join(got, i) for i in range(6))
            del got, blobs
            o = (np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            h, ids, th, start = h[o], ids[o], th[o], start[o]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            g, first = np.cumsum(new) - 1, np.flatnonzero(new)
            # shared, if a row other than the first one holds it
            other = np.bincount(g, (ids != ids[first][g]) | (th != th[first][g]), len(first))
            keep = other[g] > 0 if len(h) else new
            key = h[first]
            if len(mark):
                keep |= np.isin(key, mark)[g]
            yield ids[keep], th[keep], start[keep]
            both = np.concatenate([key, mark])
            many = np.concatenate([np.bincount(g, minlength=len(first)), rows])
            name, inv = np.unique(both, return_inverse=True)
            most = np.bincount(inv, many, len(name)) > hot       # entries of a row are counted each, so look again
            if not most.any():
                continue
            i = np.flatnonzero(most[inv[: len(first)]][g])
            num, _ = _numbers(ids[i], th[i]) if len(i) else (i, 0)
            i = i[np.unique((inv[g[i]] << 32) | num, return_index=True)[1]]
            total = (np.bincount(inv[g[i]], minlength=len(name)) + np.bincount(inv[len(first):], rows, len(name))).astype(np.int64)
            most = total > hot
            if most.any():
                very.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(
                    [name[most].astype(np.int64).tobytes() + total[most].tobytes()], pa.binary()), pa.array([1], pa.int8())], schema=_PACK))
    return run


def _hot_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            n = len(x) // 16
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64, n)), pa.array(
                np.frombuffer(x, np.int64, n, 8 * n))], ["h", "n"])


def _fragments(unit: Unit, buckets: int, hot, text: str):
    """Task: rows with their shared runs -> fragments by bucket, and spans settled here.

    ``hot``: broadcast of the sorted hot minimisers; their runs are cut where a window is NEAR places nearer to the minimiser,
    and each piece goes by the string that its windows have in common.
    """
    def take(part):
        own_id, own_th, own_text, shared = (part.column(part.schema.get_field_index(c)) for c in (ID, TH, text, "__lf_r"))
        buf, off = K.utf8(own_text)
        row, start, size, h, first, tab, s, place = _find_runs(unit, buf, off)
        want, edge = K.utf8(shared)
        want = (np.repeat(np.arange(len(edge) - 1), np.diff(edge) // 4) << 32) | want.view(np.uint32)
        picked = np.zeros(len(row), bool)
        picked[np.searchsorted((row << 32) | start, want)] = True
        i = np.flatnonzero(picked)
        row, start, size, h = row[i], start[i], size[i], h[i]
        very = np.isin(h >> np.uint64(32), hot.value)
        if very.any():
            n = np.where(very, size, 1)
            of, a = np.repeat(np.arange(len(n)), n), K.ranges(first[row] + start, n)
            far = place[a] - a                          # from the window to its minimiser
            new = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(place[a].astype(np.int64)) != 0) | (np.diff(far // NEAR) != 0)))
            of, a, far, n = of[new], a[new], far[new] // NEAR * NEAR, np.diff(np.append(new, len(a)))
            row, h, very, size = row[of], h[of], very[of], np.where(very[of], n, size[of])
            start = a - first[row]
            # what all windows of so near a place have in common, in units (words may stand apart by other spaces)
            units = s
            if unit.words:
                units = K.span_hash(s, *tab[:2])
                units = np.append(np.uint64(0), np.cumsum(units * K.powers(len(units) + 1)[0][: len(units)]))
            near = place[a].astype(np.int64)
            common = K.span_hash(units, near - far, near + unit.window - np.minimum(far + NEAR - 1, unit.window - unit.gram))
            h = np.where(very, common, h)
        a = first[row] + start
        if unit.words:
            ws, we, _ = tab
            frm, to = ws[a], we[a + size + unit.window - 2]
        else:
            frm, to = a, a + size + unit.window - 1
        fh = K.span_hash(s, frm, to)
        byte = _strings(buf, frm, to - frm)
        return (own_id.to_numpy()[row], own_th.to_numpy()[row], start.astype(np.uint32),
                size.astype(np.uint32), h, fh, (to - frm).astype(np.int64), byte, len(byte) + 64 * len(row))

    def run(batches):
        salt = 0
        for got in _chunks(unit, batches, text, take):
            ids, th, start, size, h, fh, ln, byte = (_join(got, i) for i in range(8))
            if not len(h):
                continue
            at = np.cumsum(ln) - ln
            with np.errstate(over="ignore"):
                o = _by_hash(K.mix((h ^ (fh >> np.uint64(1))) + fh * K.BASE + ln.astype(np.uint64)))
            ho, fo, lo, own = h[o], fh[o], ln[o], ids[o]
            new = np.append(True, (ho[1:] != ho[:-1]) | (fo[1:] != fo[:-1]) | (lo[1:] != lo[:-1]))
            g = np.cumsum(new) - 1
            i = np.flatnonzero(own == np.minimum.reduceat(own, np.flatnonzero(new))[g])
            rep = np.empty(int(g[-1]) + 1, np.int64)
            rep[g[i]] = o[i]                              # one of the least id
            rep = rep[g]
            same = equal_bytes(byte, at[o], at[rep], ln[o])
            settled = same & (ids[o] > ids[rep])
            i = o[settled]
            for a in range(0, len(i), 1 << 16):
                j, salt = i[a: a + (1 << 16)], salt + 1
                to = int((int(fh[j[0]]) >> 17) + salt) % buckets
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([True]), pa.array([pack(
                    ids[j], th[j], start[j], start[j] + size[j] + np.uint32(unit.window - 1))], pa.binary())], ["b", "known", "p"])
            rest = np.ones(len(h), bool)
            rest[i] = False
            i = np.flatnonzero(rest)
            o, cuts = _by_bucket((h[i] % np.uint64(buckets)).astype(np.int64), buckets)
            i = i[o]
            columns = [(h[i] >> np.uint64(32)).astype(np.uint32), *(x[i] for x in (ids, th, start, size, ln))]
            byte = _strings(byte, at[i], ln[i])
            edge = np.append(0, np.cumsum(ln[i]))
            out_b = np.flatnonzero(np.diff(cuts)).tolist()
            out_p = [pack(*(x[cuts[b]: cuts[b + 1]] for x in columns), byte[edge[cuts[b]]: edge[cuts[b + 1]]]) for b in out_b]
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array([False] * len(out_b)),
                                              pa.array(out_p, pa.binary())], ["b", "known", "p"])
    return run


def _strings(byte: np.ndarray, at: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """byte[at:at+ln] of each, one after another; some of them at a time, as places take eight times their room."""
    end = np.cumsum(ln)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    i = 0
    while i < len(ln):
        a = int(end[i] - ln[i])
        j = max(i + 1, int(np.searchsorted(end, a + (1 << 19), "right")))
        out[a: end[j - 1]] = byte[K.ranges(at[i:j], ln[i:j])]
        i = j
    return out


def equal_bytes(byte: np.ndarray, a: np.ndarray, b: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """Whether byte[a:a+ln] equals byte[b:b+ln], for each."""
    ok = np.ones(len(a), bool)
    todo = np.flatnonzero(a != b)
    for i in range(0, len(todo), 8192):
        j = todo[i: i + 8192]
        n = ln[j]
        diff = byte[K.ranges(a[j], n)] != byte[K.ranges(b[j], n)]
        bad = np.flatnonzero(diff)
        if len(bad):
            ok[j[np.searchsorted(np.cumsum(n), bad, "right")]] = False
    return ok


def _solve(unit: Unit, groups: int = 1):
    """Task: fragments of a bucket -> spans of the windows that a smaller id has too, for the groups of their rows."""
    def run(batches):
        yield from _to_rows(found(batches), groups)

    def found(batches):
        for known, *blobs in _buckets(batches):
            if known:
                yield tuple(unpack(blobs[0], np.int64, np.int64, np.uint32, np.uint32))
                continue
            got = [unpack(p, np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.int64, np.uint8) for p in blobs]
            h, ids, th, start, size, ln, byte = (_join(got, i) for i in range(7))
            del got, blobs
            at = np.cumsum(ln) - ln
            for large, i in _parts(h, ln, unit.part):
                if large:
                    yield from _solve_large(unit, ids[i], th[i], start[i], size[i], at[i], ln[i], byte)
                else:
                    yield from _solve_part(unit, h[i], ids[i], th[i], start[i], size[i], ln[i], _strings(byte, at[i], ln[i]))
    return run


def _parts(h: np.ndarray, ln: np.ndarray, most: int) -> Iterator[tuple[bool, np.ndarray]]:
    """Fragments of consecutive minimisers, about ``most`` bytes at a time; a minimiser with more comes alone (True)."""
    key, inv = np.unique(h, return_inverse=True)
    held = np.bincount(inv, ln, len(key))
    large = held > most
    calm = np.where(large, 0, held)
    part = ((np.cumsum(calm) - calm) // most).astype(np.int64)
    part[large] = int(part.max(initial=0)) + 1 + np.arange(int(large.sum()))
    of = part[inv]
    o = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.append(True, of[o][1:] != of[o][:-1])) if len(o) else o
    for a, b in zip(cut, np.append(cut[1:], len(o))):
        yield bool(large[inv[o[a]]]), o[a:b]


def _solve_part(unit: Unit, h, ids, th, start, size, ln, byte) -> Iterator[tuple]:
    """Spans of the rows (id, th, start, end) of fragments of whole minimisers."""
    with np.errstate(over="ignore"):
        at = np.cumsum(ln) - ln
        s = K.prefix_hash(byte)
        fh = K.span_hash(s, at, at + ln)
        o = np.lexsort((ids, (h.astype(np.uint64) << np.uint64(32)) | (K.mix(fh ^ ln.astype(np.uint64)) >> np.uint64(32))))
        h, ids, th, start, size, ln, fh, at = (x[o] for x in (h, ids, th, start, size.astype(np.int64), ln, fh, at))
        new = np.append(True, (h[1:] != h[:-1]) | (fh[1:] != fh[:-1]) | (ln[1:] != ln[:-1]))
        new |= ~equal_bytes(byte, at, at[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))], ln)
        rep = np.flatnonzero(new)                 # the least id of its class, as ids sort last
        cls = np.cumsum(new) - 1
        key_new = np.append(True, h[rep][1:] != h[rep][:-1])
        classes = np.bincount(np.cumsum(key_new) - 1)
        multi = (classes > 1)[np.cumsum(key_new) - 1]  # by class
        # one class: every window of it is in each of its rows
        best = ids[rep][cls]
        alone = ~multi[cls] & (ids > best)
        yield ids[alone], th[alone], start[alone], start[alone] + (size[alone] + unit.window - 1).astype(np.uint32)
        m = rep[multi]
        if not len(m):
            return
        label = unit.solve(byte, s, at[m], ln[m], size[m], h[m])
        # least id of each window, then of each window of each member
        least = np.full(int(label.max()) + 1, LAST_ID)
        np.minimum.at(least, label, np.repeat(ids[m], size[m]))
        win0 = np.zeros(len(rep), np.int64)
        win0[multi] = np.cumsum(size[m]) - size[m]
        mem = np.flatnonzero(multi[cls])
        for i in range(0, len(mem), 1 << 15):
            j = mem[i: i + (1 << 15)]
            w = K.ranges(win0[cls[j]], size[j])
            of = np.repeat(np.arange(len(j)), size[j])
            yield from _flagged(unit, least[label[w]] < ids[j][of], of, ids[j], th[j], start[j], size[j])


def _flagged(unit: Unit, flag, of, ids, th, start, size) -> Iterator[tuple]:
    """Spans of the rows from a flag for each window of consecutive fragments; ``of``: the fragment of each window."""
    k = np.flatnonzero(flag)
    if not len(k):
        return
    brk = np.append(True, (k[1:] != k[:-1] + 1) | (of[k][1:] != of[k][:-1]))
    a, b = k[brk], k[np.append(np.flatnonzero(brk)[1:] - 1, len(k) - 1)]
    f = of[a]
    size = size.astype(np.int64)
    shift = start[f].astype(np.int64) - (np.cumsum(size) - size)[f]
    yield ids[f], th[f], (a + shift).astype(np.uint32), (b + shift + unit.window).astype(np.uint32)


def _solve_large(unit: Unit, ids, th, start, size, at, ln, byte) -> Iterator[tuple]:
    """Spans of the rows of the fragments of one minimiser, whatever their size: each fragment's distinct windows are compared.

    A minimiser in many places of one text (a text that repeats itself) makes fragments as long as the text; their distinct
    windows are few.  Windows are known by hash and compared by bytes with the least row's and, in a fragment, with the first.
    """
    cuts = np.flatnonzero(np.append(True, np.diff(np.cumsum(ln) // unit.part) > 0))
    pieces = [np.arange(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(ln)))]
    exact: dict[bytes, int] | None = None

    def windows(i):
        """(fragment, first byte, bytes, identity) of each window of the fragments i."""
        for f in i:                                   # a fragment may be as long as a text: one at a time
            buf = byte[at[f]: at[f] + ln[f]]
            if unit.words:
                ws, we, _ = K.words(buf, np.array([0, len(buf)]))
                a, e = ws[: size[f]], we[unit.window - 1: unit.window - 1 + size[f]]
            else:
                a = np.arange(size[f])
                e = a + unit.window
            if exact is None:
                h = K.span_hash(K.prefix_hash(buf), a, e)
            else:
                h = np.array([exact.setdefault(buf[x:y].tobytes(), len(exact)) for x, y in zip(a, e)], np.uint64)
            yield f, a + at[f], e - a, h

    with np.errstate(over="ignore"):
        while True:
            hs, of, first, width, sound = [], [], [], [], True
            for i in pieces:
                for f, a, w, h in windows(i):
                    key, rep, inv = np.unique(h, return_index=True, return_inverse=True)
                    sound &= exact is not None or bool((w == w[rep][inv]).all() and equal_bytes(byte, a, a[rep][inv], w).all())
                    hs.append(key)
                    of.append(np.full(len(key), f))
                    first.append(a[rep])
                    width.append(w[rep])
            h, of, first, width = (np.concatenate(x) for x in (hs, of, first, width))
            o = np.lexsort((ids[of], h))
            new = np.append(True, h[o][1:] != h[o][:-1])
            rep = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
            if exact is None:
                sound &= bool((width[o] == width[rep]).all() and equal_bytes(byte, first[o], first[rep], width[o]).all())
            if sound:
                break
            exact = {}                                # two strings of one hash: numbers of the strings themselves
        late = ids[of[o]] > ids[of[rep]]
        flagged = np.zeros(len(o), bool)
        flagged[o] = late
        edge = np.searchsorted(of, np.arange(len(ln) + 1))   # fragments lie in order
        for i in pieces:
            for f, _, _, own in windows(i):
                x = slice(edge[f], edge[f + 1])
                flag = flagged[x][np.searchsorted(h[x], own)]   # a fragment's windows are sorted by identity
                one = slice(f, f + 1)
                yield from _flagged(unit, flag, np.zeros(len(own), np.int64), ids[one], th[one], start[one], size[one])


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "b").sortWithinPartitions("known", "b")


_PACKS = "g int, p binary, k byte"


def _records(packs: DataFrame, n: int, values: int) -> DataFrame:
    """One record of each row (``ID``, ``TH``, r) from the packs of its values."""
    return packs.select("g", "p").repartition(n, "g").sortWithinPartitions("g").mapInArrow(_row_records(values), f"{ID} long, {TH} long, r binary")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row key; the text as it is."""
    return docs.withColumns({ID: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)),
                             TH: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(0xFFFFFFFF)})


def with_spans(docs: DataFrame, unit: Unit, id_col: str, text_col: str) -> DataFrame:
    """All rows and columns of ``docs`` with ID, TH and ``__lf_spans``: a blob of the spans (see ``spans_of``), in
    units, that repeat a row with a smaller id (null where nothing repeats).

    Both joins read the same columns of the same rows, so one exchange of the texts serves both.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    rows = keyed(docs, id_col, text_col)
    blob = "b int, known boolean, p binary"
    entries = rows.select(ID, TH, F.col(text_col).alias("t")).mapInArrow(_entries(unit, buckets), blob)
    shared = written(_dealt(entries, n).mapInArrow(_shared(unit.hot, n), _PACKS), "shared")
    top = (shared.where("k = 1").select("p").mapInArrow(_hot_list, "h long, n long")
           .orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toPandas())
    hot = spark.sparkContext.broadcast(np.sort(top["h"].to_numpy(np.int64).astype(np.uint64)))
    of_row = _records(shared.where("k = 0"), n, 1).withColumnRenamed("r", "__lf_r")
    cut = rows.join(of_row, [ID, TH]).mapInArrow(_fragments(unit, buckets, hot, text_col), blob)
    spans = _records(_dealt(cut, n).mapInArrow(_solve(unit, n), _PACKS), n, 2).withColumnRenamed("r", "__lf_spans")
    return rows.join(spans, [ID, TH], "left")


def shared_values(rows: DataFrame, values: Callable) -> DataFrame:
    """(node, held): how many of a row's values another row holds too; rows with none are absent.

    ``rows``: node and one more column; ``values(batch)``: (node, 0, place, 64-bit value) of a batch.
    """
    spark = rows.sparkSession
    n = partitions(spark)

    def run(batches):
        def chunks():
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    yield [values(batch.slice(at, 8192))]
        yield from _send(chunks(), 4 * n)
    found = _dealt(rows.mapInArrow(run, "b int, known boolean, p binary"), n).mapInArrow(_shared(2**31, n), _PACKS)
    return _records(found.where("k = 0"), n, 1).select(F.col(ID).alias("node"), (F.length("r") / 4).cast("long").alias("held"))


def spans_of(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of one row's spans, which are sorted and apart."""
    x = np.frombuffer(blob or b"", np.uint32).reshape(-1, 2).astype(np.int64)
    return x[:, 0], x[:, 1]
