"""Substring dedup on words and on bytes against brute force."""

import hashlib
import random

import pytest

from lexiflow.llm.suffix_repeats import remove_repeated_bytes, without_repeats
from lexiflow.llm.word_repeats import remove_repeated_words

SCHEMA = "doc_id long, text string, lang string, __lf_x int"


def brute(rows, window, unit):
    """doc -> list of (units, removed flags)."""
    key = lambda d: 2**63 - 1 if d is None else d
    cut = [(key(d), unit(t or "")) for d, t in rows]
    first = {}
    for d, u in cut:
        for i in range(len(u) - window + 1):
            w = tuple(u[i:i + window])
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, u), (own, _) in zip(cut, rows):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[tuple(u[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((own, u, gone))
    return out


def spans(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéü") for _ in range(r.randint(1, 6)))
    vocab = [word() for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, other = text(80), text(120)
    rows = [(None, passage), (None, passage + " " + text(5)), (5, None), (6, ""), (7, " \t\n "), (8, "x" * 300), (9, "x" * 170 + "y"),
            (10, "la " * 200), (11, "le la " + "la " * 90), (12, "x" * 49), (13, "y " * 49 + "y")]
    for i in range(20, 60):
        k = r.randint(0, 5)
        t = text(r.randint(0, 90))
        if k == 1:
            t = t + " " + passage + " " + text(30)
        if k == 2:
            t = text(10) + "\n" + passage[: r.randint(200, len(passage))]
        if k == 3:
            w = other.split()
            w[r.randint(0, 119)] = "zz"
            t = " ".join(w)
        if k == 4:
            t = other + t
        rows.append((i, t))
    rows += [(30, rows[30][1]), (31, passage), (31, passage), (2**40, passage + " " + other)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1) for d, t in rows], SCHEMA).repartition(5)


LIMITS = [{}, {"hot": 2}, {"hot": 3, "chunk": 500, "piece": 200}, {"part": 1}, {"part": 600}, {"hot": 3, "part": 90}]


@pytest.mark.parametrize("limits", LIMITS)
def test_bytes(spark, limits):
    rows = corpus()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                 for r in remove_repeated_bytes(frame(spark, rows), **limits).collect())
    want = sorted((-1 if d is None else d, len(u), sum(g), spans(g), hashlib.sha256(bytes(x for x, k in zip(u, g) if not k)).hexdigest())
                  for d, u, g in brute(rows, 50, lambda t: t.encode()))
    assert got == want
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize("window,gram,limits", [(50, 8, {}), (6, 3, {"hot": 2}), (50, 8, LIMITS[2]), (50, 8, LIMITS[3]), (6, 3, LIMITS[4])])
def test_words(spark, window, gram, limits):
    rows = corpus()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept)
                 for r in remove_repeated_words(frame(spark, rows), window=window, gram=gram, **limits).collect())
    want = sorted((-1 if d is None else d, len(u), sum(g), b" ".join(x for x, k in zip(u, g) if not k).decode())
                  for d, u, g in brute(rows, window, lambda t: t.encode().split()))
    assert got == want
    assert sum(x[2] for x in got) > 200


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(empty).collect() == []
    assert remove_repeated_words(empty).collect() == []


def test_text_is_cut_and_columns_stay(spark):
    rows = [(1, "é" * 60), (2, "é" * 60), (3, "a" + "é" * 60), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.lang, r["__lf_x"]) for r in without_repeats(frame(spark, rows)).collect()}
    assert got == {1: ("é" * 60, "en", 1), 3: ("a", "en", 1), 4: (None, "en", 1), 5: ("", "en", 1)}


def test_texts_that_repeat_themselves(spark):
    rows = [(1, "ab" * 700), (2, "x" + "ab" * 900 + "y"), (3, "c" * 5000), (4, "c" * 60 + "d" + "c" * 60), (5, ("q" * 30 + "r") * 60), (6, ("q" * 30 + "r") * 9)]
    for limits in ({"part": 100}, {}):
        got = {r.doc_id: (r.n_bytes, len(r.kept), len(r.spans)) for r in remove_repeated_bytes(frame(spark, rows), **limits).collect()}
        assert got == {d: (len(u), len(u) - sum(g), spans(g)) for d, u, g in brute(rows, 50, lambda t: t.encode())}


BUCKET = """
import resource, sys
import numpy as np
from lexiflow.llm import repeats, suffix_repeats, word_repeats
from lexiflow.llm.common import pack
import pyarrow as pa
unit, kind = (suffix_repeats, 80) if sys.argv[1] == "bytes" else (word_repeats, 400)
unit, r = unit.unit(), np.random.default_rng(1)
n = (64 << 20) // kind
base = r.integers(97, 123, (n // 4, kind)).astype(np.uint8)
if unit.words:
    base[:, 4::5] = 32
byte = base[r.integers(0, n // 4, n)]
byte[np.arange(n), r.integers(0, kind // 5, n) * 5] = 65
size = 31 if not unit.words else kind // 5 - 49
h = r.integers(0, 40_000, n).astype(np.uint32)
blob = pack(h, np.arange(n, dtype=np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint32), np.full(n, size, np.uint32), np.full(n, kind, np.int64), byte.ravel())
batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([False]), pa.array([blob], pa.binary())], ["b", "known", "p"])
del byte, base, h, blob
print(sum(x.num_rows for x in repeats._solve(unit)(iter([batch]))), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_a_bucket_of_64_mb_is_solved_in_bounded_memory(kind):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", BUCKET, kind], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    rows, peak = map(int, out.stdout.split()[-2:])
    assert rows > 0 and peak < 700, (rows, peak, out.stderr[-500:])


@pytest.mark.parametrize("window", [5, 8, 9, 17, 50])
def test_labels_of_byte_windows(window):
    import numpy as np

    from lexiflow.llm import kernels as K
    from lexiflow.llm.suffix_repeats import _label_bytes
    r = random.Random(window)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(window, window + 12))) for _ in range(60)] + [b"a" * (window + 40), b"ab" * window]
    texts += [t[:window - 1] + b"c" + t[:window] for t in texts[:20]] + [b"z" * window] * 3
    ln = np.array([len(t) for t in texts])
    byte, at, size = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(ln) - ln, ln - window + 1
    for key in (np.zeros(len(texts), np.uint32), np.array([len(t) % 3 for t in texts], np.uint32)):
        with np.errstate(over="ignore"):
            got = _label_bytes(window)(byte, K.prefix_hash(byte), at, ln, size, key)
        want: dict = {}
        strings = [(k, t[i: i + window]) for k, t in zip(key.tolist(), texts) for i in range(len(t) - window + 1)]
        for label, x in zip(got.tolist(), strings, strict=True):
            assert want.setdefault(x, label) == label
        assert len(set(want.values())) == len(want)


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_records_follow_the_rows_not_the_buckets(kind):
    import numpy as np
    import pyarrow as pa

    from lexiflow.llm import repeats, suffix_repeats, word_repeats
    unit = (suffix_repeats if kind == "bytes" else word_repeats).unit(chunk=1)
    r = random.Random(2)
    texts = [" ".join(r.choice(["ab", "cde", "fgh", "ij", "klm"]) + str(r.randint(0, 99)) for _ in range(400)) for _ in range(10)]
    n = 40
    docs = pa.RecordBatch.from_pydict({repeats.ID: np.arange(n), repeats.TH: np.zeros(n, np.int64), "t": [texts[i % 10] + f" {i}" for i in range(n)]})
    blobs = pa.Table.from_batches(repeats._entries(unit, 256)(docs.slice(i, 1) for i in range(n))).sort_by([("known", "ascending"), ("b", "ascending")])
    records = sum(x.num_rows for x in repeats._shared(2000, 4)(iter(blobs.to_batches())))
    assert 0 < records <= 2 * n     # with a record of each row in each bucket: more than a thousand


def _fragments_of(repeats, unit, texts):
    """What the fragments of ``texts`` are sent as, if all their minimisers are shared and hot."""
    import numpy as np
    import pyarrow as pa

    from lexiflow.llm import kernels as K
    runs = [repeats._find_runs(unit, *K.utf8(pa.array([t]))) for t in texts]
    starts = [x[1].astype(np.uint32).tobytes() for x in runs]

    class hot:
        value = np.unique(np.concatenate([x[3] for x in runs]) >> np.uint64(32))

    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts), pa.array(starts, pa.binary())],
                                      [repeats.ID, repeats.TH, "t", "__lf_r"])
    blobs = [p for b in repeats._fragments(unit, 7, hot, "t")(iter([docs])) for k, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if not k]
    return [repeats.unpack(p, np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.int64, np.uint8) for p in blobs]


def test_hot_minimisers_are_dealt_by_more_than_windows():
    import numpy as np

    from lexiflow.llm import kernels as K
    from lexiflow.llm import repeats, suffix_repeats
    r = random.Random(4)
    got = _fragments_of(repeats, suffix_repeats.unit(), ["".join(r.choice("abcdefgh ") for _ in range(4000))])
    covered = np.sort(np.concatenate([K.ranges(x[3].astype(np.int64), x[4].astype(np.int64)) for x in got]))
    assert covered.tolist() == list(range(4000 - 49))              # every window once
    assert sum(len(x[6]) for x in got) < 20 * 4000                  # of single windows: 50 bytes each


def test_hot_words_meet_whatever_stands_between_them():
    from lexiflow.llm import repeats, word_repeats
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    got = _fragments_of(repeats, word_repeats.unit(), [" ".join(words), "\n".join(words)])
    keys = [{(int(k), int(a), int(n)) for x in got for k, i, a, n in zip(x[0], x[1], x[3], x[4]) if i == row} for row in (0, 1)]
    assert len(keys[0]) > 20 and keys[0] == keys[1]
