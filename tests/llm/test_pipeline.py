"""The pipeline against a brute-force version of its stages."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_counts_mix import expected_targets
from tests.llm.test_near_dups import brute as near_brute
from tests.llm.test_repeats import brute as repeat_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.fixture
def corpus():
    r = random.Random(12)
    vocab = {k: ["".join(r.choice(s) for _ in range(r.randint(2, 7))) for _ in range(400)] for k, s in (("en", "etaoinsh"), ("de", "enirsaüß"))}
    text = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n))
    items = [(i, text("en", r.randint(12, 30))) for i in range(6)]
    shared = text("en", 70)
    rows = [(0, None, None, "s1", None), (1, "", "en", "s1", 0), (2, "123 456 !!", "en", None, 10)]
    for i in range(10, 160):
        k = r.choice(["en", "en", "de"])
        t = text(k, r.randint(20, 150))
        q = r.random()
        if q < 0.15:
            t += " " + shared
        elif q < 0.25:
            t += ". " + r.choice(items)[1] + ". " + text(k, 20)
        elif q < 0.45 and i > 20:
            w = rows[r.randrange(3, len(rows))][1].split()
            w[r.randrange(len(w))] = "new"
            t = " ".join(w)
        rows.append((i, t, k, r.choice(["s1", "s1", "s2", "s3", None]), len(t)))
    return rows, items


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())


def expected(rows, items):
    docs = [x for x in rows if x[1] and re.search(r"[^\W\d_]", x[1])]
    comp = near_brute([(x[0], x[1]) for x in docs])
    docs = [x for x, (d, n, c) in zip(docs, comp) if n == 0 or d == c]
    cut = []
    for x, (_, u, gone) in zip(docs, repeat_brute([(x[0], x[1]) for x in docs], 50, lambda t: t.encode())):
        t = bytes(b for b, g in zip(u, gone) if not g).decode(errors="ignore") if any(gone) else x[1]
        if t or not any(gone):
            cut.append((x[0], t, x[2], x[3], len(t)))
    item_words = [" " + " ".join(words(t)) + " " for _, t in items]
    return [x for x in cut if not any(w in " " + " ".join(words(x[1])) + " " for w in item_words)]


def test_stages_equal_brute_force(spark, tmp_path, corpus):
    rows, items = corpus
    sf = make(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        got.write.parquet(path)
        docs = spark.read.parquet(path)
    want = expected(rows, items)
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x[:1])
    assert sorted(map(tuple, docs.collect()), key=key) == sorted(want, key=key)
    mix = corpus_pipeline.mixing(spark, docs, sf).collect()
    sizes = {}
    for x in want:
        sizes[x[3]] = sizes.get(x[3], 0) + len(x[1].split())
    target = expected_targets(sizes)
    for s, t in target.items():
        assert abs(sum(x.taken for x in mix if x.source == s) - t) <= 64
    assert all(0 < x.taken <= 3 * x.size and x.source_size == sizes[x.source] for x in mix)
    assert {x.doc_id: x.text for x in mix}.items() <= {x[0]: x[1] for x in want}.items()


def test_run_returns_the_last_stage(spark, tmp_path, corpus):
    rows, items = corpus
    sf = make(spark, tmp_path, rows, items)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "size", "source_size", "target", "taken"]
    assert {x.doc_id for x in got.collect()} <= {x[0] for x in expected(rows, items)}


def test_empty_tables(spark, tmp_path):
    sf = make(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_columns_of_the_last_stage_replace_those_of_the_same_name(spark, tmp_path, corpus):
    from pyspark.sql import functions as F
    rows, items = corpus
    sf = make(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"size": F.lit("own"), "taken": F.lit(None).cast("string"), "extra": F.lit(7)})
    got = corpus_pipeline.mixing(spark, docs, sf)
    assert got.columns == [c for c in docs.columns if c not in ("size", "taken")] + ["size", "source_size", "target", "taken"]
    assert all(x.extra == 7 and isinstance(x.size, int) for x in got.collect())
