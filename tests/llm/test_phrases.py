"""Phrase collocations against a plain count, with hot beginnings and small chunks, and the defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import phrases
from lexiflow.llm.phrases import collocations, multikey_quicksort


def plain(rows, least, top, share=100):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        got = []
        for p, a in cand.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        for rank, (s, _, p, a, le, r) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), a, le, r, n[lang], -s))
    return sorted(out)


def corpus():
    r = random.Random(11)
    vocab = "a b c D é 東京 x-y don't the The (z) 0 ß".split()
    rows = []
    for i in range(260):
        w = []
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(vocab))
            if r.random() < 0.3:
                w.append("very common pair" if r.random() < 0.5 else "Very Common pair of words here")
            if r.random() < 0.2:
                w[-1] += r.choice([".", ",", "\n", "\r", "\x0b", "\t", "  ", "!?", "\xa0", "\x1f"])
        rows.append((i, " ".join(w), r.choice(["en", "en", "fr", None, "und", "x y"])))
    rows += [(500, None, "en"), (501, "", "en"), (502, " .\n,", "fr"), (503, "word " * 3000, "en"), (504, "q" * 9000, "de"),
             (None, "a b c d e", "en"), (None, "a b c d e", "en"), (7, "once", None), (505, "very common pair tail%d " * 300, "en")]
    return rows


@pytest.mark.parametrize("least,hot,chunk,parts", [(4, 20_000, 8 << 20, 3), (4, 30, 2000, 7), (25, 100, 1, 2), (1, 2, 500, 4)])
def test_equals_a_plain_count(spark, least, hot, chunk, parts):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("clash") for c in ("phrase", "a", "l", "n", "t", "k", "score", "b")})
    got = collocations(df.repartition(parts), least=least, hot=hot, chunk=chunk, top=500)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, 500)


def test_share_top_and_empty(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations(df, least=6, share=60, top=5).collect())) == plain(corpus(), 6, 5, 60)
    assert collocations(df.limit(0)).collect() == []
    assert collocations(df.where("text is null")).collect() == []


def test_quicksort_counts_weights_by_depth():
    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 200)
        words = np.array([r.randint(1, 5) for _ in range(n)])
        lead = np.array([r.randint(1, w) for w in words])
        key = np.array([[r.randint(0, 2) if j < w else -1 for j in range(5)] for w in words])
        weight = np.array([r.randint(1, 9) for _ in range(n)])
        want = Counter()
        for w, d, x, k in zip(words, lead, weight, key.tolist()):
            for depth in range(d, w + 1):
                want[tuple(k[:depth])] += int(x)
        got = {tuple(key[i, :d].tolist()): a for i, d, a in multikey_quicksort(key, words, lead, weight, 20)}
        assert got == {p: a for p, a in want.items() if a >= 20}


def test_scores_pass_64_bits(spark):
    big = 2 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, a long")
    totals = spark.createDataFrame([("en", 9 * big + 5)], "lang string, n long")
    row = phrases.scored(counts, totals).collect()[0]
    assert row.score == 1000 * (big - 7) * (9 * big + 5) // (big * (big - 1))
