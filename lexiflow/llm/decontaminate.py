"""Benchmark decontamination: an inverted index of the test items, queried with every passage.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters that are neither punctuation nor
blanks, A-Z lower-cased; in scripts written without blanks (``SINGLE``) each character is a term.  Items are indexed with BM25 weights, each divided by the item's own total,
so a passage that holds every term of an item scores 1 on it, whatever its length.
Every document is cut into passages of 2L terms, one starting every L terms, with L the
longest item: any copy of an item lies in one passage whole.

Block-max WAND runs for all passages of a slice at once.  A passage whose terms' upper
bounds don't sum to ``SCORE`` has no pivot and ends there.  For the others the bound on
a block of items is the sum of the terms' largest weights in that block; postings of blocks
that stay under the threshold are never read, and those of the others are scored
exactly.  Items are ordered by length, so the weights of a block, and its maxima, are
alike.  All items at or above the threshold come back.  Then question and answer (an item's first three quarters, and the rest) are verified apart: a share
``OVERLAP`` of the 3-term runs of each must lie in the passage.

The index of one pass takes at most ``INDEX_BYTES`` of item text (checked); a larger
benchmark is dealt over several passes by a hash of the item id, and their findings unite.

Items of fewer than ``LEAST_TERMS`` terms are found where a text has exactly their terms in a row (score 1), if these hold
``LEAST_BYTES`` bytes or more: a name or a common phrase alone is no evidence of a leak.  ``unsearchable`` lists the
items that are not searched.

Defined cases: null or empty text has no passages and is clean; items that are null
or have no term are not searched; a null
id stays null; repeated rows have equal results; items of equal text are all found;
with an empty benchmark all is clean; an empty table gives an empty result; other columns
are ignored (``with_leaks`` keeps them).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import partitions, written

#: item text of one index, the terms an indexed item has at least, items of a block at least, blocks at most
INDEX_BYTES, LEAST_TERMS, BLOCK, MAX_BLOCKS = 4 << 20, 5, 8, 64
SCORE, OVERLAP, RUN = 0.6, 0.6, 3
#: UTF-8 bytes that the terms of a short item hold at least: of one term, of more
LEAST_BYTES = (12, 7)
K1, B = 1.2, 0.75
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


#: Thai, Lao, Tibetan, Myanmar, Khmer, Tai Le to Khmer symbols, Tai Tham, Balinese, kana to Yi, Javanese and Myanmar B, Myanmar A to
#: Tai Viet, compatibility ideographs, half-width kana, further kana, rare ideographs; Hangul, which has blanks, is left out
SINGLE = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F),
          (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D),
          (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 between terms, 1 within a term, 2 a term of its own."""
    kind = np.ones(0x110000, np.uint8)
    for a, b in SINGLE:
        kind[a: b + 1] = 2
    for c in range(128, 0x20000):                        # planes 2 and 3 have ideographs only
        if unicodedata.category(chr(c))[0] in "PZ":
            kind[c] = 0
    return kind


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term, and the number of the first term of each row (rows + 1)."""
    low = K.lower(buf)
    if not len(low):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    apart, new = _APART[low], np.zeros(len(low) + 1, bool)        # new: a term does not go on over this place
    new[off] = True
    lead = np.flatnonzero(low >= 0xC0)
    if len(lead):
        b0 = low[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        b1, b2, b3 = (low[np.minimum(lead + j, len(low) - 1)].astype(np.int32) & 63 for j in (1, 2, 3))
        code = np.where(size == 2, (b0 & 31) << 6 | b1, np.where(size == 3, (b0 & 15) << 12 | b1 << 6 | b2,
                                                                 (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = _kinds()[code]
        for j in range(4):
            apart[lead[(kind == 0) & (size > j)] + j] = True
        new[lead[kind == 2]] = True
        new[(lead + size)[kind == 2]] = True
    begins = ~apart & (new[:-1] | np.append(True, apart[:-1]))
    ws = np.flatnonzero(begins)
    we = np.flatnonzero(~apart & (new[1:] | np.append(apart[1:], True))) + 1
    first = np.searchsorted(ws, off)
    if not len(ws):
        return np.zeros(0, np.uint64), first
    with np.errstate(over="ignore"):
        return K.span_hash(K.prefix_hash(low), ws, we), first


def _runs_of(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.shingle_hash(h, RUN)


@dataclass
class Index:
    vocab: np.ndarray         # sorted term hashes
    start: np.ndarray         # postings of term i: start[i] .. start[i + 1]
    item: np.ndarray          # place of the item, ascending within a term
    weight: np.ndarray
    upper: np.ndarray         # largest weight of each term
    size: int                 # items of a block
    block: np.ndarray         # terms x blocks: largest weight
    place: np.ndarray         # term * items + item of every posting
    ids: list                 # item id by place
    question: list[np.ndarray]
    answer: list[np.ndarray]
    longest: int


def build(ids: list, texts: list) -> Index | None:
    t = pa.array([x or "" for x in texts], pa.large_string())
    h, first = terms(*K.utf8(t))
    own = [h[first[i]: first[i + 1]] for i in range(len(ids))]
    keep = sorted((i for i in range(len(ids)) if len(own[i]) >= LEAST_TERMS), key=lambda i: (len(own[i]), str(ids[i])))
    if not keep:
        return None
    own, ids = [own[i] for i in keep], [ids[i] for i in keep]           # by length: a block's weights are alike
    size = np.array([len(x) for x in own])
    vocab, code = np.unique(np.concatenate(own), return_inverse=True)
    place = np.repeat(np.arange(len(own)), size)
    pair, tf = np.unique(code * len(own) + place, return_counts=True)
    term, item = pair // len(own), pair % len(own)
    df = np.bincount(term, minlength=len(vocab))
    idf = np.log1p((len(own) - df + 0.5) / (df + 0.5))
    w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / size.mean()))
    w /= np.bincount(item, w, len(own))[item]
    upper = np.zeros(len(vocab))
    np.maximum.at(upper, term, w)
    each = max(BLOCK, -(-len(own) // MAX_BLOCKS))
    block = np.zeros((len(vocab), -(-len(own) // each)), np.float32)
    np.maximum.at(block, (term, item // each), w)
    cut = [len(x) - max(RUN, len(x) - len(x) * 3 // 4) for x in own]          # the answer has RUN terms at least
    return Index(vocab, np.searchsorted(term, np.arange(len(vocab) + 1)), item, w, upper, each, block, pair, ids,
                 [np.unique(_runs_of(x[:max(RUN, c)])) for x, c in zip(own, cut)],
                 [np.unique(_runs_of(x[c:])) for x, c in zip(own, cut)], int(size.max()))


def _held_bytes(text: str) -> int:
    """Bytes of a text's terms: what is left without blanks and punctuation."""
    return len("".join(c for c in text if (c.isalnum() if c < "\x80" else unicodedata.category(c)[0] not in "PZ")).encode())


def _too_short(text: str, n: int) -> bool:
    return n < LEAST_TERMS and _held_bytes(text) < LEAST_BYTES[n > 1]


def build_short(ids: list, texts: list) -> dict[int, dict[int, list]]:
    """Items of fewer than ``LEAST_TERMS`` terms and of ``LEAST_BYTES`` at least, by number of terms and hash of their sequence."""
    h, first = terms(*K.utf8(pa.array([x or "" for x in texts], pa.large_string())))
    out: dict[int, dict[int, list]] = {}
    for i, t, a, b in zip(ids, texts, first[:-1].tolist(), first[1:].tolist()):
        if 0 < b - a < LEAST_TERMS and not _too_short(t, b - a):
            out.setdefault(b - a, {}).setdefault(int(_sequences(h[a:b], b - a)[0]), []).append(i)
    return out


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.shingle_hash(h, n)


def search_short(short: dict[int, dict[int, list]], h: np.ndarray, first: np.ndarray) -> list[list]:
    """For each row the ids of the short items whose terms it has in a row."""
    out: list[list] = [[] for _ in range(len(first) - 1)]
    for n, items in short.items():
        if len(h) < n:
            continue
        s = _sequences(h, n)
        at = np.flatnonzero(np.isin(s, np.array(list(items), np.uint64)))
        row = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[row + 1]
        for r, key in set(zip(row[inside].tolist(), s[at[inside]].tolist())):
            out[r] += items[key]
    return out


def wand(ix: Index, query: np.ndarray, term: np.ndarray, least: float = SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score) of all items that score ``least`` or more; block-max WAND over many queries.

    ``query`` (ascending) and ``term``: the distinct terms of each query.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(query):
        return none
    cut = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    size = np.diff(np.append(cut, len(query)))
    keep = np.repeat(np.add.reduceat(ix.upper[term], cut) >= least - 1e-6, size)
    query, term = query[keep], term[keep]
    if not len(query):
        return none
    cut = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    size = np.diff(np.append(cut, len(query)))
    bound = np.add.reduceat(ix.block[term], cut, axis=0)
    q, b = np.nonzero(bound >= least - 1e-4)
    # postings of each (query, block) that is left
    t = term[K.ranges(cut[q], size[q])]
    of = np.repeat(np.arange(len(q)), size[q])
    sel = ix.block[t, b[of]] > 0
    t, of = t[sel], of[sel]
    n = len(ix.ids)
    lo = np.searchsorted(ix.place, t * n + b[of] * ix.size)
    hi = np.searchsorted(ix.place, t * n + np.minimum((b[of] + 1) * ix.size, n))
    post = K.ranges(lo, hi - lo)
    cell = np.repeat(of, hi - lo) * ix.size + ix.item[post] % ix.size
    score = np.bincount(cell, ix.weight[post], len(q) * ix.size)
    hit = np.flatnonzero(score >= least - 1e-9)
    return query[cut[q[hit // ix.size]]], b[hit // ix.size] * ix.size + hit % ix.size, score[hit]


def search(ix: Index, h: np.ndarray, first: np.ndarray) -> list[dict[int, float]]:
    """For each row the verified items (place -> best score)."""
    out: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
    if not len(h):
        return out
    step = ix.longest
    at = np.minimum(np.searchsorted(ix.vocab, h), len(ix.vocab) - 1)
    hit = np.flatnonzero(ix.vocab[at] == h)
    count = np.diff(first)
    passages = np.maximum(-(-count // step) - 1, 1)        # starts at 0, L, 2L, ...; the last reaches the end
    row = np.searchsorted(first, hit, "right") - 1
    base = np.cumsum(passages) - passages
    k = (hit - first[row]) // step
    v = len(ix.vocab)
    own = np.concatenate([base[row] + np.minimum(k, passages[row] - 1), base[row] + np.maximum(np.minimum(k, passages[row]) - 1, 0)])
    pair = np.unique(own * v + np.concatenate([at[hit], at[hit]]))
    for p, item, score in zip(*(x.tolist() for x in wand(ix, pair // v, pair % v))):
        r = int(np.searchsorted(base, p, "right")) - 1
        a = int(first[r] + (p - base[r]) * step)
        have = _runs_of(h[a: min(a + 2 * step, int(first[r + 1]))])
        if np.isin(ix.question[item], have).mean() >= OVERLAP and np.isin(ix.answer[item], have).mean() >= OVERLAP:
            out[r][item] = max(score, out[r].get(item, 0.0))
    return out


def _find(index):
    def run(batches):
        ix, short = index.value
        for batch in batches:
            for part in K.slices(batch, "__lf_t", 1 << 20):
                h, first = terms(*K.utf8(part.column(part.num_columns - 1)))
                got: list[dict[int, float]] = [{} for _ in range(part.num_rows)] if ix is None else search(ix, h, first)
                brief = search_short(short, h, first)
                items = [sorted([ix.ids[i] for i in g] + b) for g, b in zip(got, brief)]
                best = [1.0 if b else max(g.values(), default=0.0) for g, b in zip(got, brief)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                                                 [*part.schema.names[:-1], "__lf_items", "__lf_best"])
    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_col: str = "text",
               text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with __lf_items (ids of the items that a text holds) and __lf_best (score)."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(item_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("i"), F.col(item_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // index_bytes))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def one(d: DataFrame, names: str, number: int) -> DataFrame:
        # at most about index_bytes of text come to the driver
        got = items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == number).toPandas()
        ids, texts = got["i"].tolist(), got["t"].tolist()
        index = spark.sparkContext.broadcast((build(ids, texts), build_short(ids, texts)))
        return (d.select("*", F.col(text_col).alias("__lf_t")).mapInArrow(
            _find(index), f"{names}, __lf_items array<long>, __lf_best double"))
    if passes == 1:
        return one(docs, ddl, 0)
    # more passes: rows get a number that lasts, and findings come together by it
    base = written(docs.withColumn("__lf_uid", F.monotonically_increasing_id()), "passes")
    text = base.select("__lf_uid", F.col(text_col))
    found = None
    for number in range(passes):
        got = one(text, f"__lf_uid long, `{text_col}` string", number).where("size(__lf_items) > 0").drop(text_col)
        found = got if found is None else found.unionAll(got)
    found = found.repartition(partitions(spark), "__lf_uid").groupBy("__lf_uid").agg(
        F.array_sort(F.flatten(F.collect_list("__lf_items"))).alias("__lf_items"), F.max("__lf_best").alias("__lf_best"))
    none = F.array().cast("array<bigint>")
    return (base.join(found, "__lf_uid", "left").drop("__lf_uid")
            .withColumns({"__lf_items": F.coalesce("__lf_items", none), "__lf_best": F.coalesce("__lf_best", F.lit(0.0))}))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, contaminated, n_items, items, best_score: one row per row of ``docs``."""
    got = with_leaks(docs.select(id_col, text_col), benchmark, text_col=text_col, **settings)
    return got.select(F.col(id_col).alias("doc_id"), (F.size("__lf_items") > 0).alias("contaminated"),
                      F.size("__lf_items").cast("long").alias("n_items"), F.col("__lf_items").alias("items"),
                      F.col("__lf_best").alias("best_score"))


def unsearchable(benchmark: DataFrame, id_col: str = "item_id", item_col: str = "text") -> DataFrame:
    """item_id, reason of the items that are not searched: ``null``, ``no term`` or ``too short``."""
    kind = dict(benchmark.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            _, first = terms(*K.utf8(pa.array([x or "" for x in texts], pa.large_string())))
            why = ["null" if t is None or i is None else "no term" if not n else "too short" if _too_short(t, n) else None
                   for i, t, n in zip(batch.column(0).to_pylist(), texts, np.diff(first).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(why, pa.string())], ["item_id", "reason"])
    return benchmark.select(id_col, item_col).mapInArrow(run, f"item_id {kind}, reason string").where("reason is not null")
