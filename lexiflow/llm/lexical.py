"""Ranked lexical search: every document scored for every item, term counts by an Aho-Corasick scan of the texts.

There is no index of the documents.  Items are taken in slices of about ``SLICE`` bytes of text (one, usually), and for
each slice:

1. its terms become one automaton, sent to all tasks (bounded by the slice).  A pattern is a term between two blanks,
   and a text is scanned with every byte that no term holds turned into a blank, so a match is a whole
   term; neighbours share a blank.  A task counts the matches of each text, which gives tf, and the rows that
   hold each term, which give df; what it writes is one short row per document that matches at all;
2. df, the number of documents and of terms are sums over tasks;
3. a match's term leads to the items that hold it, and its weight goes to each of them.  A task keeps
   the best ``most`` documents of an item, by (score, smaller id); the best of those are the item's best.

Integers are 64 bits wide throughout but for the logarithm.

Defined cases: null and empty texts have no terms and are not counted; a null id ranks after all ids among equal scores; rows
with one id are documents of their own; items equal in id and text are one item, items of one id and different
texts are ranked each for itself; an item without terms has no rows; an empty table on either side gives an empty result;
other columns are passed by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import LAST_ID, Scratch, written

#: bytes of item text that one automaton takes, and documents kept of an item
SLICE, MOST = 8 << 20, 20
#: products of (document, term, item) that one numpy pass holds
PASS = 1 << 21

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: a term's bytes as they are, A-Z in lower case; all others are blanks
_SCANNED = bytes(c + 32 if 65 <= c <= 90 else c if _TERM[c] else 32 for c in range(256))


def scanned(raw: bytes) -> bytes:
    return raw.translate(_SCANNED)


def terms_of(raw: bytes) -> list[bytes]:
    return scanned(raw).split()


class Slice:
    """The terms of some items, and for each term the items that hold it and how often."""

    def __init__(self, texts: list[str | None]):
        held = [Counter(terms_of((t or "").encode())) for t in texts]
        self.terms = sorted({t for c in held for t in c})
        number = {t: i for i, t in enumerate(self.terms)}
        triples = np.array([(number[t], i, n) for i, c in enumerate(held) for t, n in c.items()], np.int64).reshape(-1, 3)
        triples = triples[np.argsort(triples[:, 0], kind="stable")]
        self.at = np.searchsorted(triples[:, 0], np.arange(len(self.terms) + 1))
        self.item, self.times = triples[:, 1].copy(), triples[:, 2].copy()
        self.items = len(texts)

    def automaton(self):
        a = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            a.add_word((b" " + t + b" ").decode("latin-1"), i)
        a.make_automaton()
        return a


_COUNTED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("all", pa.int64())])


def _scan(sent):
    """Task: (id, text) -> a row for each document that matches; at the end one row with ``all`` documents, their terms n and df."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Slice = sent.value
        automaton, value = own.automaton(), itemgetter(1)
        df = np.zeros(len(own.terms), np.int64)
        documents = total = 0
        for batch in batches:
            for part in K.slices(batch, "t"):
                buf, off = K.utf8(part.column(1))
                raw = buf.tobytes()
                ids, sizes, terms, counts = [], [], [], []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    text = scanned(raw[off[i]: off[i + 1]])
                    n = len(text.split())
                    if not n:
                        continue
                    documents, total = documents + 1, total + n
                    got = Counter(map(value, automaton.iter(f" {text.decode('latin-1')} ")))
                    if got:
                        ids.append(doc)
                        sizes.append(n)
                        terms.append(list(got))
                        counts.append(list(got.values()))
                        df[terms[-1]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                                  pa.array(counts, pa.list_(pa.int64())), pa.nulls(len(ids), pa.int64())], schema=_COUNTED)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total]), pa.array([some.tolist()], pa.list_(pa.int32())),
                                          pa.array([df[some].tolist()], pa.list_(pa.int64())), pa.array([documents])], schema=_COUNTED)
    return run


class _Best:
    """The best ``most`` documents of each item so far, by score and then by id."""

    def __init__(self, items: int, most: int):
        self.items, self.most = items, most
        self.least = np.ones(items, np.int64)             # a score under this is of no use any more
        self.item = self.id = self.score = np.zeros(0, np.int64)
        self.new: list = []
        self.waiting = 0

    def add(self, item: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        i = np.flatnonzero(score >= self.least[item])
        if len(i):
            self.new.append((item[i], ids[i], score[i]))
            self.waiting += len(i)
        if self.waiting > 4 * self.items * self.most + 100_000:
            self.settle()

    def settle(self) -> None:
        item, ids, score = (np.concatenate([old, *(x[k] for x in self.new)]) for k, old in enumerate((self.item, self.id, self.score)))
        o = np.lexsort((ids, -score, item))
        item, ids, score = item[o], ids[o], score[o]
        first = np.searchsorted(item, np.arange(self.items))
        keep = np.arange(len(item)) - first[item] < self.most
        self.item, self.id, self.score = item[keep], ids[keep], score[keep]
        full = np.bincount(self.item, minlength=self.items) >= self.most
        last = np.searchsorted(self.item, np.arange(self.items), "right") - 1
        self.least[full] = self.score[last[full]]
        self.new, self.waiting = [], 0


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _rank(sent, stats, most: int):
    """Task: counted documents -> (item, id, score) of the best documents of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Slice = sent.value
        w, documents, total = stats.value
        best = _Best(own.items, most)
        fan = np.diff(own.at)
        for batch in batches:
            ids = batch.column(0).fill_null(LAST_ID).to_numpy()
            n = batch.column(1).to_numpy()
            lists, tf = batch.column(2), batch.column(3).flatten().to_numpy()
            term = lists.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            m = 75 + (25 * n * documents) // total
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            # runs of whole documents with at most PASS products
            products = np.cumsum(np.bincount(doc, fan[term], len(ids)).astype(np.int64))
            cut, at = [0], 0
            while at < len(ids):
                done = products[at - 1] if at else 0
                rows = max(1, PASS // max(1, own.items))
                at = min(at + rows, max(at + 1, int(np.searchsorted(products, done + PASS, "right"))))
                cut.append(at)
            edge = np.searchsorted(doc, cut)
            for a, b, i, j in zip(cut, cut[1:], edge, edge[1:]):
                reach = fan[term[i:j]]
                item = own.item[to := K.ranges(own.at[term[i:j]], reach)]
                score = np.zeros((b - a) * own.items, np.int64)
                np.add.at(score, np.repeat(doc[i:j] - a, reach) * own.items + item, np.repeat(value[i:j], reach) * own.times[to])
                k = np.flatnonzero(score)
                best.add(k % own.items, ids[a + k // own.items], score[k])
        best.settle()
        for at in range(0, len(best.item), 1 << 16):
            x = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(best.item[x].astype(np.int32)), pa.array(best.id[x]), pa.array(best.score[x])], ["item", "id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", most: int = MOST, slice_bytes: int = SLICE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``most`` best documents with a score above 0."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).distinct()
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    kind = dict(asked.dtypes)["item_id"]
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for k in range(slices):
        some = asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(slices)) == k).collect()   # about slice_bytes
        part = Slice([r.t for r in some])
        if part.terms:
            found = found.unionByName(_of_slice(own, part, [r.item_id for r in some], kind, most))
    return found


def _of_slice(own: DataFrame, part: Slice, names: list, kind: str, most: int) -> DataFrame:
    spark = own.sparkSession
    scratch = Scratch(spark)                                 # the counts, gone when the slice is ranked
    sent = spark.sparkContext.broadcast(part)
    counted = scratch.written(own.mapInArrow(_scan(sent), "id long, n long, terms array<int>, tf array<long>, all long"), "counted")
    sums = counted.where("all is not null")
    documents, total = sums.agg(F.sum("all"), F.sum("n")).first()
    if not documents:
        sent.unpersist()
        scratch.drop()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    df = np.zeros(len(part.terms), np.int64)                 # as many as the slice has terms
    for r in sums.select(F.explode(F.arrays_zip("terms", "tf")).alias("z")).groupBy("z.terms").agg(F.sum("z.tf").alias("df")).collect():
        df[r.terms] = r.df
    stats = spark.sparkContext.broadcast((weights(df, documents), documents, total))
    best = (counted.where("all is null").mapInArrow(_rank(sent, stats, most), "item int, id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = written(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most), "ranked")
    scratch.drop()
    sent.unpersist()
    stats.unpersist()
    name = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
    return ranked.join(name, "item").select("item_id", "rank", F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"), "score")
