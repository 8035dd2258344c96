"""Phrase collocations: counts of word runs by multikey three-way quicksort, and their scores.

A suffix is a place of a word; its key is that word and up to four more of its piece.  Phrases with fewer than
``least`` occurrences are of no use, and neither is anything that holds one.

1. *Slots.*  Every run of one, two and three words adds one to a slot of a table of fixed size (by hash, language
   included).  A slot under ``least`` in sum holds no frequent run; a slot of ``hot`` or more may hold a very frequent
   one.  The tables (bounded, see ``_bits``) only save work: what they let through is counted exactly.
2. *Routing.*  A task cuts each suffix where it stops being possibly frequent, counts equal ones of some MB of text as
   one record with a weight, and sends it to the bucket of its two leading words.  Where two words are hot, three lead,
   where three are hot, all five; the runs passed over so get records of their own, one of each kind per
   task and chunk, as do single words.  So no bucket gets more than about ``hot`` records of one beginning.
3. *Sorting.*  A bucket sorts its suffixes by multikey quicksort: smaller, equal and greater words around a pivot,
   equal ones at the next word, to the greatest depth.  The weight of an equal partition is the count of its
   phrase; a partition under ``least`` is abandoned.  Words are compared exactly, as dense numbers checked by bytes.
4. *Scores.*  Cuts and sub-phrases of the frequent phrases are joined to their counts; products are decimals of 38 digits.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
stand there; ids play no part; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import Scratch, pack, partitions, unpack
from lexiflow.llm.word_repeats import _codes

LEAST, LONGEST, TOP = 100, 5, 2000
#: occurrences from which on the beginning of a suffix is dealt by more words; only the bucket changes
HOT = 20_000
#: bytes of text whose suffixes a task sorts and counts at once (it takes some sixty times that)
CHUNK = 2 << 20
#: ranges in which a table of slots is summed
RANGES = 32
TABLES = 3
#: count at which a task's slot stops; over LEAST and HOT
MOST = 32_767

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _PIECE.copy()
_APART[[0x20, 0x09]] = True


def _bits(spark) -> int:
    """log2 of the slots of a table: 2**16 for each shuffle partition, but 2**22 at least and 2**25 (4 MB as bits) at most."""
    return min(25, max(22, 16 + (partitions(spark) - 1).bit_length()))


class _Text:
    """The words of a slice of rows: their codes and hashes, and the hash of each run of words in one piece."""

    def __init__(self, part: pa.RecordBatch):
        buf, off = K.utf8(part.column(1))
        buf = K.lower(buf)
        ws, we, first = K.words(buf, off, _APART)
        self.n = len(ws)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        names = ["und" if x is None else x for x in part.column(0).to_pylist()]
        self.langs = sorted(set(names))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in names], np.int64)[row]
        self.words = np.bincount(self.lang, minlength=len(self.langs))
        with np.errstate(over="ignore"):
            seed = np.array([_name_hash(x) for x in self.langs], np.uint64)
            self.wh = K.span_hash(K.prefix_hash(buf), ws, we) if self.n else np.zeros(0, np.uint64)
            # words left in the piece, this one included
            piece = np.cumsum(_PIECE[buf])[ws] if self.n else ws
            last = np.append((piece[1:] != piece[:-1]) | (row[1:] != row[:-1]), True)[: self.n]
            end = np.flatnonzero(last)
            self.left = np.repeat(end, np.diff(np.append(-1, end))) + 1 - np.arange(self.n)
            acc = seed[self.lang]
            self.gram = []
            for k in range(LONGEST):
                acc = acc * K.BASE
                acc[: max(0, self.n - k)] += self.wh[k:]
                self.gram.append(K.mix(acc.copy()))           # of no meaning where left <= k
        # the words with one blank behind each
        size = we - ws + 1
        self.at = np.append(0, np.cumsum(size))
        self.byte = np.append(buf, 0).astype(np.uint8)[K.ranges(ws, size)]
        self.byte[self.at[1:] - 1] = 32

    def codes(self) -> np.ndarray:
        return _codes(self.byte, self.wh, self.at[:-1], np.diff(self.at) - 1)


def _name_hash(name: str) -> np.uint64:
    h = 1469598103934665603
    for c in name.encode():
        h = ((h ^ c) * 1099511628211) & (2**64 - 1)
    return np.uint64(h)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Text]:
    """About ``most`` bytes of text at a time (one row at least), over batch borders."""
    held, size = [], 0
    for batch in batches:
        for part in K.slices(batch, "t", most):
            n = len(K.utf8(part.column(1))[0])
            if held and size + n > most:
                yield _Text(_one(held))
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _Text(_one(held))


def _one(parts: list) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _slots(bits: int):
    """Task: (lang, text) -> (g, lang, n, p): counts of each range of each table, and words by language (g -1)."""
    def run(batches):
        table = np.zeros((TABLES, 1 << bits), np.uint16)
        words: dict[str, int] = {}
        for text in _texts(batches, 1 << 20):
            for k in range(TABLES):
                slot = (text.gram[k][text.left > k] >> np.uint64(64 - bits)).astype(np.int64)
                for at in range(0, len(slot), MOST):       # a slot stops at MOST, so it never passes 16 bits
                    some = slot[at: at + MOST]
                    np.add.at(table[k], some, np.uint16(1))
                    table[k][some] = np.minimum(table[k][some], MOST)
            for name, n in zip(text.langs, text.words.tolist()):
                words[name] = words.get(name, 0) + n
        step = (1 << bits) // RANGES
        for g in range(TABLES * RANGES):
            k, r = divmod(g, RANGES)
            part = table[k, r * step: (r + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([None], pa.string()), pa.array([0], pa.int64()),
                                                  pa.array([pack(part)], pa.binary())], ["g", "lang", "n", "p"])
        if words:
            m = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * m, pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()),
                                              pa.nulls(m, pa.binary())], ["g", "lang", "n", "p"])
    return run


def _summed(bits: int, least: int, hot: int):
    """Task: the counts of whole ranges, sorted by range -> two bit sets of each: frequent perhaps, hot perhaps."""
    step = (1 << bits) // RANGES

    def out(g, total):
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary()),
                                           pa.array([np.packbits(total >= hot).tobytes()], pa.binary())], ["g", "some", "many"])

    def run(batches):
        now, total = None, None
        for batch in batches:
            for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = g, np.zeros(step, np.int64)
                total += unpack(p, np.uint16)[0]
        if now is not None:
            yield out(now, total)
    return run


class _Filter:
    """The bit sets of all tables."""

    def __init__(self, bits: int, rows: list):
        self.bits = bits
        wide = (1 << bits) // RANGES // 8
        self.some, self.many = (np.zeros((TABLES, RANGES * wide), np.uint8) for _ in range(2))
        for r in rows:
            k, at = divmod(r.g, RANGES)
            self.some[k, at * wide: (at + 1) * wide] = np.frombuffer(r.some, np.uint8)
            self.many[k, at * wide: (at + 1) * wide] = np.frombuffer(r.many, np.uint8)

    def _read(self, bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
        s = gram >> np.uint64(64 - self.bits)
        return (bits[(s >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (s & np.uint64(7)).astype(np.uint8))) & 1 > 0

    def reach(self, text: _Text) -> np.ndarray:
        """Words up to which the suffix of each place may be frequent, and all runs inside it."""
        reach = np.zeros(text.n, np.int64)
        able = np.ones(text.n + 1, bool)
        for k in range(LONGEST):
            nxt = able[:-1] & (able[1:] if k else True) & (text.left > k)
            if k < TABLES:
                i = np.flatnonzero(nxt)
                nxt[i] = self._read(self.some[k], text.gram[k][i])
            reach[nxt] = k + 1
            able = np.append(nxt, False)
        return reach

    def hot(self, text: _Text, k: int, places: np.ndarray) -> np.ndarray:
        return self._read(self.many[k - 1], text.gram[k - 1][places])


def _routed(text: _Text, reach: np.ndarray, sent: _Filter) -> list[tuple[int, int, np.ndarray]]:
    """(leading words, words at most, places): which places send a record, cut to how many words, dealt by how many."""
    out = [(1, 1, np.flatnonzero(reach >= 1))]
    two = np.flatnonzero(reach >= 2)
    hot = sent.hot(text, 2, two)
    out += [(2, LONGEST, two[~hot]), (2, 2, two[hot])]
    three = two[hot & (reach[two] >= 3)]
    hot = sent.hot(text, 3, three)
    out += [(3, LONGEST, three[~hot]), (3, 3, three[hot])]
    for k in range(4, LONGEST + 1):
        out.append((k, k, three[hot & (reach[three] >= k)]))
    return out


def _records(sent, buckets: int, chunk: int):
    """Task: (lang, text) -> (bucket, lang, payload): suffixes with weights."""
    def run(batches):
        bits: _Filter = sent.value
        for text in _texts(batches, chunk):
            if not text.n:
                continue
            reach = bits.reach(text)
            code = text.codes()
            got = [_counted(text, code, np.minimum(reach[places], most), places, lead, buckets)
                   for lead, most, places in _routed(text, reach, bits) if len(places)]
            if not got:
                continue
            place, words, lead, weight, dest = (np.concatenate([x[i] for x in got]) for i in range(5))
            o = np.lexsort((place, text.lang[place], dest))
            place, words, lead, weight, dest = (x[o] for x in (place, words, lead, weight, dest))
            lang = text.lang[place]
            cut = np.flatnonzero(np.append(True, (dest[1:] != dest[:-1]) | (lang[1:] != lang[:-1])))
            out_b, out_l, out_p = [], [], []
            for a, b in zip(cut, np.append(cut[1:], len(dest))):
                i = place[a:b]
                start, end = text.at[i], text.at[i + words[a:b]]
                out_b.append(int(dest[a]))
                out_l.append(text.langs[lang[a]])
                out_p.append(pack(words[a:b].astype(np.uint8), lead[a:b].astype(np.uint8), weight[a:b], (end - start).astype(np.uint32),
                                  text.byte[K.ranges(start, end - start)]))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_l, pa.string()), pa.array(out_p, pa.binary())], ["b", "lang", "p"])
    return run


def _counted(text: _Text, code: np.ndarray, words: np.ndarray, place: np.ndarray, lead: int, buckets: int):
    """One place for each distinct suffix, its words, leading words, weight and bucket.

    Suffixes are grouped by hash; one whose words differ from the first of its group stays a record of its own.
    """
    h = np.empty(len(place), np.uint64)
    for k in range(lead, LONGEST + 1):
        i = np.flatnonzero(words == k)
        h[i] = text.gram[k - 1][place[i]] + np.uint64(k)
    _, rep, group = np.unique(h, return_index=True, return_inverse=True)
    first = place[rep][group]
    same = words == words[rep][group]
    for j in range(LONGEST):
        i = np.flatnonzero(same & (words > j))
        same[i] = code[place[i] + j] == code[first[i] + j]
    same &= text.lang[place] == text.lang[first]
    odd = np.flatnonzero(~same)
    weight = np.append(np.bincount(group, same, len(rep)), np.ones(len(odd))).astype(np.uint32)
    at = np.append(rep, odd)
    dest = (text.gram[lead - 1][place[at]] >> np.uint64(20)) % np.uint64(buckets)
    return place[at], words[at], np.full(len(at), lead), weight, dest.astype(np.int64)


def multikey_quicksort(key: np.ndarray, words: np.ndarray, lead: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(record, depth, count) of every phrase of ``least`` occurrences or more: the first ``depth`` words of ``record``.

    ``key``: the words of each record as numbers, a row each; a record counts for the depths from ``lead`` to ``words``.
    """
    todo = [(np.arange(len(key)), 0)]
    while todo:
        part, depth = todo.pop()
        if weight[part].sum() < least:
            continue                                          # nothing in it can be frequent
        word = key[part, depth]
        pivot = np.sort(word[:: max(1, len(word) // 9)])
        pivot = pivot[len(pivot) // 2]
        equal = part[word == pivot]
        for other in (part[word < pivot], part[word > pivot]):
            if len(other):
                todo.append((other, depth))
        depth += 1
        count = int(weight[equal[lead[equal] <= depth]].sum())
        if count >= least:
            yield int(equal[0]), depth, count
        equal = equal[words[equal] > depth]
        if len(equal):
            todo.append((equal, depth))


def _sorted(least: int):
    """Task: records by bucket and language -> (lang, phrase, k, a) of the frequent phrases."""
    def solve(lang, blobs):
        got = [unpack(p, np.uint8, np.uint8, np.uint32, np.uint32, np.uint8) for p in blobs]
        words, lead, weight, size, byte = (np.concatenate([x[i] for x in got]) for i in range(5))
        words, weight = words.astype(np.int64), weight.astype(np.int64)
        at = np.append(0, np.cumsum(size.astype(np.int64)))
        with np.errstate(over="ignore"):
            ws, we, first = K.words(byte, at)
            code = _codes(byte, K.span_hash(K.prefix_hash(byte), ws, we), ws, we - ws)
        key = np.full((len(words), LONGEST), -1, np.int64)
        row = np.repeat(np.arange(len(words)), words)
        key[row, np.arange(len(row)) - np.repeat(first[:-1], words)] = code
        out: list[tuple] = [(byte[ws[first[i]]: we[first[i] + k - 1]].tobytes().decode(), k, a)
                            for i, k, a in multikey_quicksort(key, words, lead, weight, least)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array([x[0] for x in out], pa.string()),
                                           pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], ["lang", "phrase", "k", "a"])

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for b, lang, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (b, lang) != now:
                    if blobs:
                        yield solve(now[1], blobs)
                    now, blobs = (b, lang), []
                blobs.append(p)
        if blobs:
            yield solve(now[1], blobs)
    return run


def phrase_counts(docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                  hot: int = HOT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of all runs of 1 to ``LONGEST`` words with a >= ``least``; (lang, n) with all words."""
    spark = docs.sparkSession
    n, bits = partitions(spark), _bits(spark)
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    slots = scratch.written(own.mapInArrow(_slots(bits), "g int, lang string, n long, p binary"), "slots")
    sums = (slots.where("g >= 0").select("g", "p").repartition(min(n, TABLES * RANGES), "g").sortWithinPartitions("g")
            .mapInArrow(_summed(bits, least, hot), "g int, some binary, many binary").collect())      # 2**bits / 4 bytes a table
    sent = spark.sparkContext.broadcast(_Filter(bits, sums))
    records = own.mapInArrow(_records(sent, 4 * n, chunk), "b int, lang string, p binary")
    counts = scratch.written(records.repartition(n, "b", "lang").sortWithinPartitions("b", "lang")
                             .mapInArrow(_sorted(least), "lang string, phrase string, k int, a long"), "counts")
    sent.unpersist()
    return counts, slots.where("g < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _run_of(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every phrase of two words or more, by its lowest-scoring cut."""
    many = counts.where("k > 1")
    words = F.split("phrase", " ")
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cut = cut.withColumns({"head": _run_of(words, F.lit(1), F.col("j")), "tail": _run_of(words, F.col("j") + 1, F.col("k") - F.col("j"))})
    of = lambda name, part: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    got = cut.join(of("l", "head"), ["lang", "head"]).join(of("r", "tail"), ["lang", "tail"]).join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    got = got.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), "down": whole("l") * whole("r")})
    got = got.withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "j", "l", "r"))
    return got.groupBy("lang", "phrase", "k", "a", "n").agg(best.alias("x")).select(
        "lang", "phrase", "k", "a", "x.l", "x.r", "n", "x.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 share: int = 100, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase inside a longer frequent one with at least ``share`` per cent of its occurrences is left out.
    """
    scratch = Scratch(docs.sparkSession)
    counts, totals = phrase_counts(docs, scratch, text_col, lang_col, least, hot, chunk)
    words = F.split("phrase", " ")
    inner = (counts.where("k > 2").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
             .select("lang", "phrase", "k", "a", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
             .select("lang", _run_of(words, F.col("i"), F.col("m")).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = scored(counts, totals).join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
