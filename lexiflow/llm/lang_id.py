"""Language ID by prediction by partial matching (PPM) over bytes.

Each language has a context tree of order 3: the counts of the bytes that
follow each context of 3, 2, 1 and 0 bytes in its learning texts.  A byte is coded at the
longest context of the tree that has met it: P(byte) = n(byte) / (n + d), and
P(escape) = d / (n + d) for each longer context that has not, with n the bytes and
d the different bytes that followed (method C); below order 0 all 256 are equal.
Counts are frozen after learning, so the code length of a text is a sum over its
bytes, and the language with the shortest code wins.

Learning counts 4-byte strings over all learning rows (a map-side count, then
one native aggregation) into a written table; none is left out.  Strings of a language with the same
byte before the last hold all that the costs after this byte need, so a tree can be cut there: where the trees of all
languages have over ``MAX_CELLS`` costs or ``MAX_GRAMS`` strings, they are dealt into parts of whole languages, or
of one language and some of these bytes.  Each part is counts for the workers, which make its
costs; texts are scored against one part after the other, and code lengths are summed by text
and language.  A part is never less than one such byte of one language.  Scoring is
one gather of a precomputed cost per byte and language: a byte's history selects its
state (the deepest context met in learning), and state and byte select the cost.

Defined cases: null text, or text without a letter, is ``und`` with score 0; without
learning rows every text is ``und``; null ids and repeated rows are rows like others;
rows with null lang or text teach nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import kept, partitions, written

#: strings and costs of one part
MAX_GRAMS, MAX_CELLS = 1_000_000, 16_000_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _shift(v: np.ndarray, off: np.ndarray, pad) -> np.ndarray:
    """Each byte's predecessor in its row; ``pad`` before the first."""
    out = np.empty_like(v)
    out[1:] = v[:-1]
    out[off[:-1][off[:-1] < len(v)]] = pad
    return out


def _count(batches):
    """(lang, text) -> (lang, gram, n), one row per string and task."""
    total: dict[str, list] = {}

    def merged(parts):
        g = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        u, inv = np.unique(g, return_inverse=True)
        return u, np.bincount(inv, n).astype(np.int64)

    for batch in batches:
        for part in K.slices(batch, "t", 2 << 20):
            buf, off = K.utf8(part.column(1))
            if not len(buf):
                continue
            a = _shift(buf, off, 10)
            b = _shift(a, off, 10)
            c = _shift(b, off, 10)
            gram = (c.astype(np.uint32) << 24) | (b.astype(np.uint32) << 16) | (a.astype(np.uint32) << 8) | buf
            lang = np.asarray(part.column(0).dictionary_encode().indices)
            names = part.column(0).dictionary_encode().dictionary.to_pylist()
            of = np.repeat(lang, np.diff(off))
            for i, name in enumerate(names):
                g = np.sort(gram[of == i])
                if len(g):
                    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    got = total.setdefault(name, [])
                    got.append((g[cut], np.diff(np.append(cut, len(g)))))
                    if len(got) == 16:
                        total[name] = [merged(got)]
    for name, parts in total.items():
        g, n = merged(parts)
        for i in range(0, len(g), 50_000):
            m = len(g[i: i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(g[i: i + 50_000].astype(np.int64)),
                                              pa.array(n[i: i + 50_000])], ["lang", "gram", "n"])


class Model:
    """Costs in bits by (language, state, byte class), and the state of each history, of one part.

    ``root``: how often each of the 256 bytes comes in each language; ``seen``: the bytes that any language has;
    ``after``: the bytes after which this part has the costs (None: all).
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, root: np.ndarray, seen: np.ndarray,
                 after: np.ndarray | None = None):
        self.langs = langs
        self.cls = np.zeros(256, np.int32)            # class 0: bytes that learning never met
        self.cls[seen] = np.arange(1, seen.sum() + 1)
        a = self.size = int(seen.sum()) + 1
        self.own = None
        if after is not None:
            self.own = np.zeros(a, bool)
            self.own[self.cls[after]] = True
        g = [self.cls[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)]
        k = len(langs)
        zero = np.zeros((k, a))
        zero[:, self.cls[seen]] = root[:, seen]
        one = np.zeros((k, a, a))
        np.add.at(one, (lang, g[2], g[3]), n)
        two_key, three_key = g[1] * a + g[2], (g[0] * a + g[1]) * a + g[2]
        two, three = np.unique(two_key), np.unique(three_key)
        base = 1 + a
        cost = np.empty((k, base + len(two) + len(three), a), np.float32)
        cost[:, 0] = self._code(zero, np.full((k, a), 8.0))
        cost[:, 1: base] = self._code(one, cost[:, :1])
        map2 = np.tile(np.arange(1, 1 + a, dtype=np.int32), (a, 1)).ravel()       # by [second last, last]
        self._fill(cost, base, two, two_key, lang, g[3], n, 1 + two % a)
        map2[two] = base + np.arange(len(two))
        map3 = np.tile(map2, a)
        self._fill(cost, base + len(two), three, three_key, lang, g[3], n, map2[three % (a * a)])
        map3[three] = base + len(two) + np.arange(len(three))
        self.state, self.cost = map3, cost.reshape(k, -1)

    def _fill(self, cost, at: int, contexts, key, lang, byte, n, shorter) -> None:
        """Costs of the sorted ``contexts`` from state ``at`` on; ``shorter``: the state of each one's suffix."""
        hit = np.flatnonzero(np.isin(key, contexts))
        where = np.searchsorted(contexts, key[hit])
        o = np.argsort(where, kind="stable")
        hit, where = hit[o], where[o]
        for i in range(0, len(contexts), 512):
            m = min(512, len(contexts) - i)
            lo, hi = np.searchsorted(where, [i, i + m])
            count = np.zeros((cost.shape[0], m, self.size))
            np.add.at(count, (lang[hit[lo:hi]], where[lo:hi] - i, byte[hit[lo:hi]]), n[hit[lo:hi]])
            cost[:, at + i: at + i + m] = self._code(count, cost[:, shorter[i: i + m]])

    @staticmethod
    def _code(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Bits of each byte class (the last axis) after a context; ``below``: at the next shorter context."""
        n, d = count.sum(-1, keepdims=True), (count > 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(count / (n + d))
            escape = -np.log2(d / (n + d))
        return np.where(n == 0, below, np.where(count > 0, own, escape + below))

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row in each language (rows x languages), as far as this part has it."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(off) > 0)
        if not len(some):
            return out
        a, pad = self.size, int(self.cls[10])
        c = self.cls[buf]
        p1 = _shift(c, off, pad)
        other = None if self.own is None else np.flatnonzero(~self.own[p1])
        p2 = _shift(p1, off, pad)
        p3 = _shift(p2, off, pad)
        p3 *= a
        p3 += p2
        p3 *= a
        p3 += p1
        at = self.state[p3]
        at *= a
        at += c
        for i in range(len(self.langs)):
            bits = self.cost[i][at]
            if other is not None:
                bits[other] = 0
            out[some, i] = np.add.reduceat(bits, off[some], dtype=np.float64)
        return out


class Learned:
    """The table of all counted strings, and how it is dealt into parts: (numbers of languages, bytes or None for all)."""

    def __init__(self, counts: DataFrame, langs: list[str], root: np.ndarray, parts: list[tuple[list[int], list[int] | None]]):
        self.counts, self.langs, self.root, self.parts = counts, langs, root, parts

    def load(self, part) -> tuple:
        """What ``Model`` takes, for one part."""
        of, after = part
        d = self.counts
        if len(of) < len(self.langs):
            d = d.where(F.col("lang").isin([self.langs[i] for i in of]))
        if after is not None:
            d = d.where(F.expr("(gram div 256) % 256").isin(after))
        got = d.toArrow().combine_chunks()
        names = pa.array(got.column("lang").combine_chunks()).dictionary_encode()
        number = {self.langs[i]: j for j, i in enumerate(of)}
        place = np.array([number[x] for x in names.dictionary.to_pylist()], np.int32)
        seen = self.root.sum(0) > 0
        seen[10] = True
        return ([self.langs[i] for i in of], place[names.indices.to_numpy()], got.column("gram").to_numpy().astype(np.uint32),
                got.column("n").to_numpy().astype(np.float64), self.root[of], seen, None if after is None else np.array(after))

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row in each language (rows x languages), over all parts."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        for part in self.parts:
            out[:, part[0]] += Model(*self.load(part)).bits(buf, off)
        return out


def deal(units: dict[int, dict[int, tuple[int, int]]], size: int, whole: int, max_grams: int, max_cells: int) -> list:
    """Parts of the trees: ``units`` has (contexts, strings) by language and byte, ``size`` byte classes, ``whole`` contexts over
    all languages."""
    k = len(units)
    grams = {i: sum(g for _, g in u.values()) for i, u in units.items()}
    contexts = {i: sum(c for c, _ in u.values()) for i, u in units.items()}
    if whole * k * size <= max_cells and sum(grams.values()) <= max_grams:
        return [(list(range(k)), None)]
    parts: list = []
    now, c, g = [], 0, 0
    for i in range(k):
        if contexts[i] * size > max_cells or grams[i] > max_grams:       # the language alone is too large
            some, cc, gg = [], 0, 0
            for b, (x, y) in sorted(units[i].items()):
                if some and ((cc + x) * size > max_cells or gg + y > max_grams):
                    parts.append(([i], some))
                    some, cc, gg = [], 0, 0
                some, cc, gg = [*some, b], cc + x, gg + y
            rest = set(range(256)) - set(units[i])                       # bytes that nothing follows: the root's costs
            parts.append(([i], sorted({*some, *rest})))
            continue
        if now and ((c + contexts[i]) * (len(now) + 1) * size > max_cells or g + grams[i] > max_grams):
            parts.append((now, None))
            now, c, g = [], 0, 0
        now, c, g = [*now, i], c + contexts[i], g + grams[i]
    return [*parts, (now, None)] if now else parts


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Learned | None:
    """Model of the languages of ``rows`` (rows with null language or text teach nothing)."""
    d = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    counts = written(d.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    found = counts.groupBy("lang", (F.col("gram") % 256).alias("b")).agg(F.sum("n").alias("n")).collect()     # 256 rows a language at most
    if not found:
        return None
    langs = sorted({r.lang for r in found})
    number = {x: i for i, x in enumerate(langs)}
    root = np.zeros((len(langs), 256))
    for r in found:
        root[number[r.lang], r.b] = r.n
    contexts = counts.groupBy("lang", F.expr("gram div 256").alias("c")).agg(F.count(F.lit(1)).alias("g"))
    units: dict = {i: {} for i in range(len(langs))}
    for r in contexts.groupBy("lang", (F.col("c") % 256).alias("b")).agg(
            F.count(F.lit(1)).alias("three"), F.countDistinct(F.col("c") % 65536).alias("two"), F.sum("g").alias("g")).collect():
        units[number[r.lang]][r.b] = (r.three + r.two, r.g)
    whole = contexts.select("c").distinct().agg(F.count(F.lit(1)), F.countDistinct(F.col("c") % 65536)).first()
    seen = int((root.sum(0) > 0).sum()) + 2
    return Learned(counts, langs, root, deal(units, seen, sum(whole), MAX_GRAMS, MAX_CELLS))


def _ready(sent) -> Model | None:
    """The model of a broadcast part, made once in a worker."""
    return kept("language", sent, lambda: None if sent.value is None else Model(*sent.value))


def _letters(column: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    size = np.diff(off)
    letter = np.zeros(len(size), bool)
    some = np.flatnonzero(size > 0)
    if len(some):
        letter[some] = np.logical_or.reduceat(_LETTER[buf], off[some])
    for i in np.flatnonzero(~letter & (size > 0)):
        letter[i] = any(ch.isalpha() for ch in column[i].as_py())
    return letter


def _predict(sent):
    def run(batches):
        m = _ready(sent)
        for batch in batches:
            for part in K.slices(batch, "__lf_t", 1 << 20):
                column = part.column(part.num_columns - 1)
                buf, off = K.utf8(column)
                letter = _letters(column, buf, off)
                if m is None:
                    names, score = np.full(len(letter), "und", object), np.zeros(len(letter))
                else:
                    bits = m.bits(buf, off)
                    best = bits.argmin(1)
                    p = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0))
                    score = np.where(letter, 1.0 / p.sum(1), 0.0)
                    names = np.where(letter, np.array(m.langs, object)[best], "und")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names.tolist(), pa.string()), pa.array(score)],
                                                 [*part.schema.names[:-1], "__lf_lang", "__lf_score"])
    return run


def _lengths(sent, of: list[int]):
    """(uid, text) -> (uid, language, bits) of the texts with a letter, for one part."""
    def run(batches):
        m = _ready(sent)
        for batch in batches:
            for part in K.slices(batch, "__lf_t", 1 << 20):
                buf, off = K.utf8(part.column(1))
                hit = np.flatnonzero(_letters(part.column(1), buf, off))
                bits = m.bits(buf, off)[hit]
                uid = part.column(0).to_numpy()[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, len(of))), pa.array(np.tile(np.array(of, np.int32), len(hit))),
                                                  pa.array(bits.ravel())], ["__lf_uid", "i", "bits"])
    return run


def with_language(docs: DataFrame, model: Learned | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with __lf_lang and __lf_score (0 to 1: the share of the best code)."""
    spark = docs.sparkSession
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if model is None or len(model.parts) == 1:
        sent = spark.sparkContext.broadcast(None if model is None else model.load(model.parts[0]))
        return docs.select("*", F.col(text_col).alias("__lf_t")).mapInArrow(_predict(sent), f"{ddl}, __lf_lang string, __lf_score double")
    # rows get a number that lasts; one part at a time is with the driver and the workers
    base = written(docs.withColumn("__lf_uid", F.monotonically_increasing_id()), "languages")
    text = base.select("__lf_uid", F.col(text_col).alias("__lf_t"))
    found = None
    for number, part in enumerate(model.parts):
        sent = spark.sparkContext.broadcast(model.load(part))
        got = written(text.mapInArrow(_lengths(sent, part[0]), "__lf_uid long, i int, bits double").withColumn("p", F.lit(number)), "lengths")
        sent.destroy()
        found = got if found is None else found.unionAll(got)
    one = found.repartition(partitions(spark), "__lf_uid").groupBy("__lf_uid", "i").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("p", "bits"))), F.lit(0.0), lambda s, x: s + x["bits"]).alias("bits"))
    best = one.groupBy("__lf_uid").agg(F.array_sort(F.collect_list(F.struct("bits", "i"))).alias("all"))
    least = F.col("all")[0]["bits"]
    names = F.array(*[F.lit(x) for x in model.langs])
    best = best.select("__lf_uid", names[F.col("all")[0]["i"]].alias("__lf_lang"), (1.0 / F.aggregate(
        "all", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), -F.least(x["bits"] - least, F.lit(1000.0))))).alias("__lf_score"))
    return (base.join(best, "__lf_uid", "left").drop("__lf_uid")
            .withColumns({"__lf_lang": F.coalesce("__lf_lang", F.lit("und")), "__lf_score": F.coalesce("__lf_score", F.lit(0.0))}))
