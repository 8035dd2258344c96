"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics (lengths, byte classes, repetition of
words, pairs and lines, entropy).  Trees are learned on at most ``MAX_ROWS``
labelled rows, those with the least hash of the id: statistics are cut into
quantile bins once, and each split is the best of the bins' gradient
histograms.  Trees are complete, so a model is three flat arrays (feature,
threshold, leaf value), and scoring is ``depth`` vectorised steps down all rows at once.

Defined cases: null text counts as empty, and an empty text has the statistics
of zero words; null ids are scored like others and teach nothing; rows without label or with a
null label teach nothing; without learning rows, or with one label only, the score is
the share of label 1 (0.5 without any); repeated rows have equal scores; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K

#: labelled rows that learning takes at most
MAX_ROWS = 20_000
_KIND = np.full(256, 5, np.int64)                 # punctuation and control bytes
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 4
_MARKS = [ord(c) for c in "!?.,;:|#@/<>{}[]()&=*-_\"'%$\n"]
NAMES = ["bytes", "words", "word_mean", "word_sd", "word_max", "upper", "lower", "digit", "other", "blank", "punct", "entropy",
         "distinct_bytes", "distinct_words", "top_word", "next_same", "distinct_pairs", "top_pair", "distinct_lines", "lines",
         "one_byte_words", "long_words", "capital_starts", "mark_ends", *(f"mark_{c}" for c in _MARKS)]


def _repeats(h: np.ndarray) -> tuple[float, float]:
    """Share of different values, and share of the most frequent."""
    if not len(h):
        return 1.0, 0.0
    s = np.sort(h)
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return len(cut) / len(s), float(np.diff(np.append(cut, len(s))).max()) / len(s)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x NAMES."""
    n = len(off) - 1
    x = np.zeros((n, len(NAMES)))
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    hist = np.bincount(row * 256 + buf, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)[:, None]
    share = hist / some
    ws, we, first = K.words(buf, off)
    count = np.diff(first)
    ln = (we - ws).astype(np.float64)
    of = np.repeat(np.arange(n), count)
    words = np.maximum(count, 1)
    mean = np.bincount(of, ln, n) / words
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(size), np.log1p(count), mean
    x[:, 3] = np.sqrt(np.maximum(np.bincount(of, ln * ln, n) / words - mean**2, 0))
    np.maximum.at(x[:, 4], of, ln)
    x[:, 4] = np.log1p(x[:, 4])
    for k in range(6):
        x[:, 5 + k] = share[:, _KIND == k].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x[:, 11] = -np.nansum(np.where(share > 0, share * np.log2(share), 0.0), 1)
    x[:, 12] = (hist > 0).sum(1)
    if len(ws):
        with np.errstate(over="ignore"):
            s = K.prefix_hash(buf)
            wh = K.span_hash(s, ws, we)
            pair = K.shingle_hash(wh, 2)
            same = np.append(wh[1:] == wh[:-1], False)
            same[first[1:][count > 0] - 1] = False
            x[:, 15] = np.bincount(of, same, n) / words
            for i in range(n):
                a, b = int(first[i]), int(first[i + 1])
                x[i, 13], x[i, 14] = _repeats(wh[a:b])
                x[i, 16], x[i, 17] = _repeats(pair[a: max(a, b - 1)])
        x[:, 20] = np.bincount(of, ln == 1, n) / words
        x[:, 21] = np.bincount(of, ln > 20, n) / words
        x[:, 22] = np.bincount(of, _KIND[buf[ws]] == 0, n) / words
        x[:, 23] = np.bincount(of, _KIND[buf[we - 1]] == 5, n) / words
    _lines(buf, off, x)
    x[:, 24:] = share[:, _MARKS]
    return x


def _lines(buf: np.ndarray, off: np.ndarray, x: np.ndarray) -> None:
    """Share of different lines and the number of lines."""
    stop = np.union1d(np.flatnonzero(buf == 10), off[1:])
    start = np.union1d(np.flatnonzero(buf == 10) + 1, off[:-1])
    start = start[start < len(buf)]
    if not len(start):
        x[:, 18] = 1.0
        return
    end = stop[np.searchsorted(stop, start, "left")]
    with np.errstate(over="ignore"):
        h = K.span_hash(K.prefix_hash(buf), start, end)
    h, of = h[end > start], (np.searchsorted(off, start, "right") - 1)[end > start]
    cut = np.searchsorted(of, np.arange(len(off)))
    for i in range(len(off) - 1):
        x[i, 18] = _repeats(h[cut[i]: cut[i + 1]])[0]
    x[:, 19] = np.log1p(np.diff(cut))


@dataclass
class Forest:
    """Complete trees: inner nodes in heap order (children of i: 2i + 1, 2i + 2), then the leaves' values."""

    base: float
    feature: np.ndarray      # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray        # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
          l2: float = 2.0, least: float = 3.0) -> Forest:
    """Histogram boosting of the logistic loss."""
    inner = 2**depth - 1
    p0 = (y.sum() + 0.5) / (len(y) + 1.0)
    if len(y) == 0 or y.min() == y.max():
        return Forest(float(np.log(p0 / (1 - p0))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    base = float(np.log(p0 / (1 - p0)))
    z = np.full(n, base)
    out = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            local = at - (nodes - 1)
            gain, where = np.full(nodes, 1e-6), np.full((nodes, 2), -1)
            for j in range(m):
                if not len(edges[j]):
                    continue
                cell = local * bins + code[:, j]
                gs = np.bincount(cell, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(cell, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                k = len(edges[j])
                gl, hl = gs[:, :k], hs[:, :k]
                hr = ht - hl
                got = gl**2 / (hl + l2) + (gt - gl) ** 2 / (hr + l2) - gt**2 / (ht + l2)
                got[(hl < least) | (hr < least)] = 0
                best = got.argmax(1)
                top = got[np.arange(nodes), best]
                better = top > gain
                gain[better] = top[better]
                where[better] = np.column_stack([np.full(nodes, j), best])[better]
            for i in np.flatnonzero(where[:, 0] >= 0):
                j, b = where[i]
                out.feature[t, nodes - 1 + i], out.threshold[t, nodes - 1 + i] = j, edges[j][b]
            f, c = where[local, 0], where[local, 1]
            right = (f >= 0) & (code[np.arange(n), np.maximum(f, 0)] > c)
            at = 2 * at + 1 + right
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        out.value[t] = -rate * gs / (hs + l2)
        z += out.value[t][leaf]
    return out


def _features(batches):
    for batch in batches:
        for part in K.slices(batch, "t", 1 << 20):
            x = statistics(*K.utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(
                pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])


def sample_of_labels(labels: DataFrame, label_col: str, learn, most: int) -> DataFrame:
    """(id, y): at most ``most`` labelled rows that ``learn`` admits, those with the least hash of the id."""
    return (labels.where(learn & F.col(label_col).isNotNull()).select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y"))
            .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most))


def learn(docs: DataFrame, labels: DataFrame, label_col: str, rows, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Forest:
    """Learns from the labelled rows that the condition ``rows`` (on ``labels``) admits, ``max_rows`` at most."""
    chosen = sample_of_labels(labels, label_col, rows, max_rows)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    got = (d.join(F.broadcast(chosen), "id")            # max_rows rows at most
           .select("y", "t").mapInArrow(_features, "y int, x array<double>").toArrow())
    y = got.column("y").to_numpy().astype(np.float64)
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(len(y), len(NAMES)) if len(y) else np.zeros((0, len(NAMES)))
    o = np.lexsort([*x.T, y])                         # rows arrive in any order; sums must not depend on it
    return boost(x[o], y[o])


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in K.slices(batch, "__lf_t", 1 << 20):
                buf, off = K.utf8(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(m.score(statistics(buf, off)))],
                                                 [*part.schema.names[:-1], "__lf_score"])
    return run


def with_quality(docs: DataFrame, model: Forest, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with __lf_score."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spark = docs.sparkSession
    return docs.select("*", F.col(text_col).alias("__lf_t")).mapInArrow(
        _score(spark.sparkContext.broadcast(model)), f"{ddl}, __lf_score double")
