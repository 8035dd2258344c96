"""Toxicity: a learned lexicon, Levenshtein automata for misspelled terms, context windows.

1. *Lexicon.*  On at most ``MAX_ROWS`` labelled rows (least hash of the id; equal texts once)
   words and word stems (prefixes of 4 to 6 letters) are counted by label; those that are
   frequent in toxic texts and rare in others are the lexicon.
2. *Matching.*  A word matches a term exactly or by a stem, or, if it has five letters or more, at
   edit distance 1: the word's Levenshtein automaton walks the lexicon's trie, and a branch
   ends where the automaton can't accept any more.  Forms that clean learning texts
   use are words of their own, not misspellings.
3. *Context.*  A match is seen in a window of ``WINDOW`` words on each side: inside quotation
   marks, near a word of reporting, near a word of address, near another match, near an
   exclamation mark.  The counts by these cues are what separates quotation from abuse.
4. *Score.*  A logistic regression over the counts, learned on the same rows.

Whole texts are read, word by word; each worker remembers words it has judged (bounded).

Defined cases: null or empty text has no match and gets the score of a text of no
words; null ids are scored like others and teach nothing; rows without label or with a null label teach
nothing; without learning rows, or with one label only, the score is the share of label 1
(0.5 without any); repeated rows have equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import kernels as K
from lexiflow.llm.common import written
from lexiflow.llm.quality import sample_of_labels

#: labelled rows that learning takes at most; they bound the terms that are counted, the lexicon and the forms that are excepted
MAX_ROWS = 20_000
STEMS, WINDOW, FUZZY_LENGTH, MEMO = (4, 5, 6), 5, 5, 300_000
_STRIP = string.punctuation + "“”„«»‘’‚…¡¿–—"
_QUOTE = set("\"“”„«»")
REPORTING = {"said", "says", "wrote", "quote", "quoted", "called", "word", "words", "term", "reported", "dijo", "dit", "sagte", "schrieb"}
ADDRESS = {"you", "your", "you're", "u", "tu", "te", "toi", "vous", "du", "dich", "sie", "usted"}
NAMES = ["exact", "stem", "fuzzy", "quoted", "reported", "addressed", "together", "loud", "weight", "density", "words", "any"]


class Automaton:
    """Accepts the words within ``most`` edits of ``word``; a state is the sparse row (place, edits)."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple:
        return tuple((i, i) for i in range(min(self.most, len(self.word)) + 1))

    def step(self, state: tuple, letter: str) -> tuple:
        best: dict[int, int] = {}
        for place, edits in state:
            if edits < self.most:                       # the letter is extra
                best[place] = min(best.get(place, 99), edits + 1)
            if place < len(self.word):                  # the letter stands for the next one
                cost = edits + (self.word[place] != letter)
                if cost <= self.most:
                    best[place + 1] = min(best.get(place + 1, 99), cost)
        if best:                                        # letters of the word that are left out
            for place in range(min(best), min(max(best) + self.most, len(self.word))):
                if best.get(place, 99) < self.most:
                    best[place + 1] = min(best.get(place + 1, 99), best[place] + 1)
        return tuple(sorted(best.items()))

    def accepts(self, state: tuple) -> bool:
        return bool(state) and state[-1][0] == len(self.word)


class Trie:
    """Letters to nodes; the term's number under the empty key."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for i, t in enumerate(terms):
            node = self.root
            for letter in t:
                node = node.setdefault(letter, {})
            node[""] = i

    def within(self, word: str, most: int = 1, head: str = "") -> list[int]:
        """Numbers of the terms within ``most`` edits, of those that start with ``head``: the automaton
        intersected with the trie."""
        automaton, found = Automaton(word, most), []
        node, state = self.root, automaton.start()
        for letter in head:
            node, state = node.get(letter), automaton.step(state, letter)
            if not node or not state:
                return []
        stack = [(node, state)]
        while stack:
            node, state = stack.pop()
            if "" in node and automaton.accepts(state):
                found.append(node[""])
            for letter, child in node.items():
                if letter:
                    after = automaton.step(state, letter)
                    if after:
                        stack.append((child, after))
        return sorted(found)


@dataclass
class Lexicon:
    words: list[str]
    word_weight: list[float]
    stems: dict[str, float]
    forms: set = field(default_factory=set)             # words of clean texts near a term

    def __post_init__(self):
        self.trie, self.back = Trie(self.words), Trie([w[::-1] for w in self.words])
        self.exact = dict(zip(self.words, self.word_weight))
        # a word at distance 1 has the first or the second half of its term unchanged, and nearly its length,
        # so the automaton walks only the branch of that half, forwards or backwards
        self.halves: dict[int, tuple[set, set]] = {}
        for w in self.words:
            if len(w) >= FUZZY_LENGTH:
                for n in (len(w) - 1, len(w), len(w) + 1):
                    heads, tails = self.halves.setdefault(n, (set(), set()))
                    heads.add(w[: len(w) // 2])
                    tails.add(w[len(w) // 2:])
        self.sizes = {n: (sorted({len(x) for x in h}), sorted({len(x) for x in t})) for n, (h, t) in self.halves.items()}

    def judge(self, token: str) -> tuple[str, float, str] | None:
        """(kind, weight, form) of a token, or None."""
        w = token.strip(_STRIP).lower()
        if w in self.exact:
            return "exact", self.exact[w], w
        best = max((self.stems[w[:n]] for n in STEMS if w[:n] in self.stems and len(w) >= n), default=None)
        if best is not None:
            return "stem", best, w
        if len(w) >= FUZZY_LENGTH and w not in self.forms:
            near = [self.word_weight[i] for i in self.near(w)]
            if near:
                return "fuzzy", max(near), w
        return None

    def near(self, w: str) -> set[int]:
        """Terms of five letters or more at edit distance 1 at most."""
        found: set[int] = set()
        if len(w) in self.halves:
            (heads, tails), (head_sizes, tail_sizes) = self.halves[len(w)], self.sizes[len(w)]
            for n in head_sizes:
                if w[:n] in heads:
                    found.update(self.trie.within(w, 1, w[:n]))
            for n in tail_sizes:
                if w[-n:] in tails:
                    found.update(self.back.within(w[::-1], 1, w[: -n - 1: -1]))
        return {i for i in found if len(self.words[i]) >= FUZZY_LENGTH}


class _Memo(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        got = self.lexicon.judge(token)
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[token] = got
        return got


def features(text: str, memo: _Memo) -> tuple[list[float], list[str]]:
    """The counts of one text, and its fuzzy forms."""
    tokens = text.split()
    judged = list(map(memo.__getitem__, tokens))
    at = [i for i, j in enumerate(judged) if j is not None]
    x = dict.fromkeys(NAMES, 0.0)
    x["words"] = math.log1p(len(tokens))
    if not at:
        return [x[n] for n in NAMES], []
    quotes = np.cumsum([sum(c in _QUOTE for c in t) for t in tokens])
    forms = []
    for k, i in enumerate(at):
        kind, weight, form = judged[i]
        if kind == "fuzzy":
            forms.append(form)
        near = tokens[max(0, i - WINDOW): i] + tokens[i + 1: i + 1 + WINDOW]
        bare = {t.strip(_STRIP).lower() for t in near}
        opened = int(quotes[i - 1]) if i else 0
        x[kind] += 1
        x["quoted"] += opened % 2 == 1 or any(c in _QUOTE for c in tokens[i][:1])
        x["reported"] += bool(bare & REPORTING)
        x["addressed"] += bool(bare & ADDRESS)
        x["together"] += (k > 0 and i - at[k - 1] <= WINDOW) or (k + 1 < len(at) and at[k + 1] - i <= WINDOW)
        x["loud"] += "!" in tokens[i] or any("!" in t for t in near)
        x["weight"] = max(x["weight"], weight)
    x["density"] = len(at) / math.sqrt(len(tokens))
    x["any"] = 1.0
    for n in ("exact", "stem", "fuzzy", "quoted", "reported", "addressed", "together", "loud"):
        x[n] = math.log1p(x[n])
    return [x[n] for n in NAMES], sorted(set(forms))


def _terms(text: str) -> set[str]:
    words = {t.strip(_STRIP).lower() for t in set(text.split())} - {""}
    return {"w" + w for w in words} | {"p" + w[:n] for w in words for n in STEMS if len(w) >= n}


def _count(only):
    """Texts -> (term, n): in how many texts, per task; ``only``: broadcast of the terms that count, or None."""
    def run(batches):
        total: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0):
                got = _terms(t.as_py() or "")
                for w in got if only is None else got & only.value:
                    total[w] = total.get(w, 0) + 1
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
    return run


def _describe(lexicon):
    def run(batches):
        memo = _Memo(lexicon.value)
        for batch in batches:
            got = [features(t.as_py() or "", memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.float64())),
                                              pa.array([g[1] for g in got], pa.list_(pa.string()))], ["y", "x", "forms"])
    return run


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def regress(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30):
    """Logistic regression by Newton steps on scaled columns: mean, scale, weights, bias."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label_col: str, rows, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Learns from the labelled rows that the condition ``rows`` (on ``labels``) admits, ``max_rows`` at most."""
    spark = docs.sparkSession
    chosen = sample_of_labels(labels, label_col, rows, max_rows)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sample = written(text.join(F.broadcast(chosen), "id").select("y", "t").dropDuplicates(), "labelled")   # max_rows rows at most
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    if not toxic or not clean:
        p = (toxic + 0.5) / (toxic + clean + 1.0)
        return Model(Lexicon([], [], {}), np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), math.log(p / (1 - p)))
    least = max(3, math.ceil(0.005 * toxic))
    frequent = (sample.where("y = 1").select("t").mapInArrow(_count(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
                .where(F.col("n") >= least).collect())          # each in ``least`` of the toxic rows
    terms = spark.sparkContext.broadcast({r.term for r in frequent})
    other = {r.term: r.n for r in (sample.where("y <> 1").select("t").mapInArrow(_count(terms), "term string, n long")
                                   .groupBy("term").agg(F.sum("n").alias("n")).collect())}       # of those only
    odds = {r.term: math.log((r.n + 0.5) / (toxic + 1)) - math.log((other.get(r.term, 0) + 0.5) / (clean + 1)) for r in frequent}
    strong = sorted(((w, t) for t, w in odds.items() if w >= math.log(10)), key=lambda p: (-p[0], p[1]))
    words = [(t[1:], w) for w, t in strong if t[0] == "w"]
    stems = {t[1:]: w for w, t in strong if t[0] == "p"}
    lexicon = Lexicon([t for t, _ in words], [w for _, w in words], stems)
    first = sample.mapInArrow(_describe(spark.sparkContext.broadcast(lexicon)), "y int, x array<double>, forms array<string>")
    forms = (first.where("y <> 1").select(F.explode("forms").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    lexicon.forms = {r.w for r in forms}
    got = sample.mapInArrow(_describe(spark.sparkContext.broadcast(lexicon)), "y int, x array<double>, forms array<string>").select("y", "x").toArrow()
    y = (got.column("y").to_numpy() == 1).astype(np.float64)
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(len(y), len(NAMES))
    o = np.lexsort([*x.T, y])                             # rows arrive in any order; sums must not depend on it
    return Model(lexicon, *regress(x[o], y[o]))


def _score(model):
    def run(batches):
        m = model.value
        memo = _Memo(m.lexicon)
        for batch in batches:
            for part in K.slices(batch, "__lf_t", 4 << 20):
                x = np.array([features(t.as_py() or "", memo)[0] for t in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(m.score(x))], [*part.schema.names[:-1], "__lf_score"])
    return run


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with __lf_score."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spark = docs.sparkSession
    return docs.select("*", F.col(text_col).alias("__lf_t")).mapInArrow(
        _score(spark.sparkContext.broadcast(model)), f"{ddl}, __lf_score double")
