"""Substring dedup on words: remove what a 50-word window repeats (super-k-mer partitioning).

Consecutive 50-word windows that share a minimiser (the least hash among their
8-word grams) travel as one packed string to the minimiser's bucket, where
sorting counts them exactly: words become dense numbers (equal hashes are
compared byte by byte), and the numbers of runs of 2, 4, 8, 16, 32 and 50 words
come from sorting pairs, so no window is judged by a hash.

Defined cases: null or empty text has no words; a null id ranks after all ids
(two null ids repeat nothing of each other); rows with the same id don't repeat
each other; rows equal in id and text have equal results, each its own row;
an empty table gives an empty result; other columns are passed by or ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiflow.llm import kernels as K
from lexiflow.llm.repeats import Unit, equal_bytes, spans_of, with_spans

WINDOW = 50


def _label_words(window: int):
    def solve(byte, s, at, ln, size, key):
        take = K.ranges(at, ln)
        buf = byte[take]
        off = np.concatenate([[0], np.cumsum(ln)])
        ws, we, first = K.words(buf, off)
        wh = K.span_hash(K.prefix_hash(buf), ws, we)
        rank = _codes(buf, wh, ws, we - ws)
        have = 1
        while have < window:
            step = min(have, window - have)
            pair = (rank[: len(rank) - step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
            _, rank = np.unique(pair, return_inverse=True)
            have += step
        return rank[K.ranges(first[:-1], size)]
    return solve


def _codes(buf, wh, ws, ln):
    """A dense number of each word; words of one hash are compared, and told apart if they differ."""
    _, rep, code = np.unique(wh, return_index=True, return_inverse=True)
    same = (ln == ln[rep][code])
    i = np.flatnonzero(same)
    same[i] = equal_bytes(buf, ws[i], ws[rep][code][i], ln[i])
    odd = np.flatnonzero(~same)
    if len(odd):
        own: dict[bytes, int] = {}
        code = code.copy()
        for j in odd:
            w = buf[ws[j]: ws[j] + ln[j]].tobytes()
            code[j] = len(rep) + own.setdefault(w, len(own))
    return code


def _results(batches):
    """(id, text, spans) -> (id, n_words, n_removed, kept text)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for t, b in zip(batch.column(1), batch.column(2)):
            w = (t.as_py() or "").encode().split()
            left, at = w, 0
            a, e = spans_of(b.as_py())
            if len(a):
                left = []
                for i, j in zip(a.tolist(), e.tolist()):
                    left += w[at:i]
                    at = j
                left += w[at:]
            n_words.append(len(w))
            n_removed.append(len(w) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def unit(window: int = WINDOW, gram: int = 8, **limits) -> Unit:
    return Unit(True, window, min(gram, window), _label_words(window), **limits)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          window: int = WINDOW, gram: int = 8, **limits) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    own = docs.select(id_col, text_col)
    got = with_spans(own, unit(window, gram, **limits), id_col, text_col).select(id_col, text_col, "__lf_spans")
    return got.mapInArrow(_results, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept string")
