"""Near-dedup against brute force over all pairs of sets."""

import random
import re

import pytest

from lexiflow.llm import near_dups
from lexiflow.llm.near_dups import near_duplicates, without_near_copies

SCHEMA = "doc_id long, text string, component string"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None \
                    and 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 7))) for _ in range(500)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, "A b C d E f"),
            (5, "one two"), (6, "One  two"), (7, "one two three"), (8, "x " * 300), (9, "x " * 700)]
    i = 20
    for _ in range(25):
        base = text(r.randint(30, 150))
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                base = w                                  # chains: links through a middle document
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(r.choice([20, 40, 41]), " ".join(text(60))), (21, rows[13][1])]
    r.shuffle(rows)
    return rows


def order(x):
    return tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dups, "TILE", 3)             # many tiles
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], SCHEMA).repartition(4)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df).collect()), key=order)
    assert got == sorted(brute(rows), key=order)
    flags = near_duplicates(df).where("kept <> coalesce(doc_id = component_id, true)").count()
    assert flags == 0


def test_one_of_each_component_stays(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], SCHEMA)
    got = without_near_copies(df)
    assert got.columns == df.columns
    kept = [(x.doc_id, x.text) for x in got.collect()]
    of = {}
    for (d, n, c), (_, t) in zip(brute(rows), rows):
        of[(d, t)] = (n, c)
    linked = [of[k][1] for k in kept if k[0] is not None and of[k][0]]
    assert sorted(linked) == sorted({c for (d, _), (n, c) in of.items() if n and d is not None})
    assert sorted(k[0] for k in kept if k[0] is not None and not of[k][0]) == [0, 1, 2]
    assert sum(k[0] is None for k in kept) == 2


def test_unrelated_texts_of_one_id_both_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, c), (3, a), (4, b)]
    got = without_near_copies(spark.createDataFrame([(d, t, "c") for d, t in rows], SCHEMA))
    assert sorted((x.doc_id, x.text) for x in got.collect()) == [(1, a), (1, b), (2, c)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    assert without_near_copies(empty).collect() == []


def test_links_across_components_are_found(spark):
    """Members that are far from the least of their keys still find one another."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in r.sample(range(400), 13):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame([(d, t, "c") for d, t in rows], SCHEMA)).collect()}
    assert got == {d: c for d, _, c in brute(rows)}
