"""Ranked lexical search against a plain count of every document for every item, and the defined cases."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexiflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, most=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, k in Counter(terms(text)).items() if t in c)
            if s:
                scores.append((-s, d is None, d or 0, d))
        for r, (s, _, _, d) in enumerate(sorted(scores)[:most], 1):
            out.append((item, r, d, -s))
    return sorted(out, key=str)


def tables():
    r = random.Random(8)
    vocab = ["".join(r.choice("abé東Z0") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["the", "THE", "a", "x1"]
    line = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "_", "\n", "-", "\x00", "\x7f"]) for _ in range(n))
    docs = [(i, line(r.randint(0, 60))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,\n"), (None, "the a x1"), (None, "the a x1"), (7, docs[9][1]), (8, docs[9][1]),
             (203, "the " * 40_000), (204, line(20_000)), (205, "abc" * 9000), (206, "THE\x85a\xa0b")]
    items = [(i, line(r.randint(1, 12))) for i in range(25)]
    items += [(50, "the the a"), (51, None), (52, ""), (53, "nowhere_to_be_found99"), (3, "another the"), (50, "the the a"), (None, "the x1"), (54, "THE\x85a\xa0b")]
    return docs, items


def test_ranks_equal_a_plain_count(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "t", "n", "score", "item_id", "rank")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = plain(docs, items)
    for parts, limit in ((1, 8 << 20), (13, 8 << 20), (5, 60)):      # the last in many slices
        got = lexical.search(d.repartition(parts), i, slice_bytes=limit)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_small_passes_and_tops(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(lexical, "PASS", 7)
    own = lexical.Slice([t for _, t in items])
    best = lexical._Best(2, 3)
    import numpy as np
    for k in range(300):
        best.add(np.array([k % 2]), np.array([k]), np.array([k % 10 + 1]))
    best.settle()
    assert best.id.tolist() == [8, 18, 28, 9, 19, 29] and best.least.tolist() == [9, 10]
    assert own.terms == sorted({t.encode() for _, x in items for t in terms(x)})


def test_empty_tables(spark):
    docs, items = tables()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert lexical.search(d.limit(0), i).collect() == []
    assert lexical.search(d, i.limit(0)).collect() == []
    assert lexical.search(d.where("doc_id in (200, 201, 202)"), i).collect() == []
    assert lexical.search(d, i.where("item_id in ('51', '52')")).collect() == []
