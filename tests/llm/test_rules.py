"""Quality rules: every number against plain Python, distances against the formula, the defined cases."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexiflow.llm import divergence as D

CLASS = [(k, re.compile(p[:-1])) for k, p in D.CLASSES.items()]


def plain_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) / 2 if a else 0
    return math.sqrt(max(0, sum(part(a, b) + part(b, a) for a, b in zip(p, q))))


def plain_distances(rows):
    def classes(t):
        out = []
        for _, p in CLASS:
            out.append(len(p.findall(t)))
        return [*out, len(t) - sum(out)]
    of = {}
    for _, t, lang in rows:
        g = of.setdefault(lang or "und", [[0] * 7, Counter()])
        g[0] = [a + b for a, b in zip(g[0], classes(t or ""))]
        g[1].update(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
    out = []
    for i, t, lang in rows:
        c, words = of[lang or "und"]
        total = sum(words.values())
        own = Counter(re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()))
        n = sum(own.values())
        if n < 50 or total < 2000:
            out.append((i, None, None))
            continue
        top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[:D.COMMON]]
        hist = lambda x, m: [x[w] / m for w in top] + [1 - sum(x[w] for w in top) / m]
        mine = classes(t or "")
        out.append((i, js([x / sum(mine) for x in mine], [x / sum(c) for x in c]), js(hist(own, n), hist(words, total))))
    return out


def corpus():
    r = random.Random(5)
    small = {"en": "the of and to in is it that a on".split(), "fr": "le la de et un été à où ça".split()}
    rows = []
    for i in range(60):
        lang = ["en", "fr"][i % 2]
        w = [r.choice(small[lang]) if r.random() < 0.5 else "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 200))]
        rows.append((i, " ".join(w).capitalize() + ".", lang))
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    line = "one two three four five six seven eight nine"
    rows += [(100, None, "en"), (101, "", "en"), (102, " \n\t\x0b\x0c\r ", None), (103, "a" * 5000, "en"), (104, long, "en"),
             (105, "\n".join([line, "x", line, " ", line + " "]) + " y" * 15, "fr"), (106, "a b c d e f g h a b c d e f g h", "en"),
             (107, "a " * 40, "en"), (108, " ".join("###!! $$%% ||".split() * 40), "en"), (109, "THE OF AND " * 30 + "x" * 9, "en"),
             (None, "the of " * 12, "en"), (None, "the of " * 12, "en"), (5, rows[5][1], rows[5][2]), (5, "other text here", "fr"),
             (110, "word  double\x0b space\x85not apart", "xx")]
    return rows


def test_numbers_distances_and_verdicts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"n_words": F.lit("clash"), "bins": F.lit(1), "share": F.lit(2), "word": F.lit("w"), "digest": F.lit(0), "left": F.lit("")})
    got = D.with_verdicts(df.repartition(5)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    base = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert base == sorted(((i, *plain_base(t)) for i, t, _ in rows), key=key)
    near = lambda x: [(i is None, i or 0, -1 if a is None else round(a, 9), -1 if b is None else round(b, 9)) for i, a, b in x]
    assert sorted(near((r.doc_id, r.class_distance, r.word_distance) for r in got)) == sorted(near(plain_distances(rows)))
    for r in got:
        far = r.class_distance is not None and (
            r.class_distance > D.CLASS_LIMIT + math.sqrt(6 / (8 * math.log(2) * r.n_words))
            or r.word_distance > D.WORD_LIMIT + math.sqrt(D.COMMON / (8 * math.log(2) * r.n_words)))
        assert r.kept == (not r.base_failed and not far)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[108] and not kept[104] and sum(kept[i] for i in range(60)) > 20


def test_empty_table_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    assert D.with_verdicts(df.limit(0)).collect() == []
    plan = D.base_numbers(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
