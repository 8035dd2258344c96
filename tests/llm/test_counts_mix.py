"""Token counts, mixing, nearest neighbours: against the libraries, the rules and brute force."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest

from lexiflow.llm import ann
from lexiflow.llm.mixing import mix_sources, mixed, sainte_lague
from lexiflow.llm.token_counts import by_words, count_tokens, separable

TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a b  ", "  a b", "Hello world, the\nnew\n\n line\t tab", "▁a ▁ b▁", "éü ß 東京 🙂 x",
         "<s> </s> <unk> <0x0A>", "the " * 500, "x" * 3000, "ein  Satz   mit    Leerzeichen ", " a　b ﬁ ① Ａ", "\n", "a\n b \n", "­ ‍"]


def rows_of(texts):
    return [(i, t, "k") for i, t in enumerate(texts)] + [(None, "a b", "k"), (3, "again", "k"), (3, "again", "k")]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(spark, name, tmp_path):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer
        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    rows = rows_of(TEXTS)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    cache = str(tmp_path / "cache")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = sorted(((d, len((t or "").encode()), count(t or "")) for d, t, _ in rows), key=key)
    for _ in range(2):
        got = sorted((tuple(x) for x in count_tokens(df, path, cache).collect()), key=key)
        assert got == want
    # the second run found everything in the cache
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows})
    more = spark.createDataFrame([(1, "new text", "k"), (2, "a b", "k")], df.schema)
    assert sorted(x.n_tokens for x in count_tokens(more, path, cache).collect()) == sorted([count("new text"), count("a b")])
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in rows}) + 1
    assert count_tokens(df.limit(0), path).collect() == []


def test_words_of_a_model_are_separable():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert separable(sp)
    count, r = by_words(sp), random.Random(4)
    for _ in range(400):
        t = "".join(r.choice("ab é▁\n\tthe 0東 .") for _ in range(r.randint(0, 60)))
        assert count(t) == len(sp.encode(t)), repr(t)


def highest_quotients(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        got[i] += 1
    return got


def test_sainte_lague(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        votes = [r.choice([0, r.randint(1, 40), r.randint(1, 10_000)]) for _ in range(r.randint(1, 12))]
        seats = r.choice([0, 1, 3, r.randint(0, 500)])
        for j, n in enumerate(highest_quotients(votes, seats)):
            rows.append((g, j, votes[j], seats))
            want[g, j] = n
    df = spark.createDataFrame(rows, "g int, j int, v long, m long")
    got = {(x.g, x.j): x.s for x in sainte_lague(df, ["g"], ["j"], "v", "m", "s").collect()}
    assert got == want


def expected_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**fixed, **target}
        fixed.update({s: most * sizes[s] for s in over})


def test_mix(spark):
    r = random.Random(8)
    rows = []
    for i in range(600):
        source = r.choice(["src0"] * 8 + ["a", "b", "Z", "é", None, "tiny"] + ["src1", "src2"])
        n = 1 if source == "tiny" else r.choice([0, 1, 5, 200, 800])
        rows.append((None if i % 97 == 0 else i // 2, None if n == 0 else "w\n" * n, source, 7))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mix_sources(df, block=4, shard_words=3000).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"\S+", t or ""))
    want = expected_targets(sizes)
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        assert any(abs(x.target - want[s]) < 1e-6 and x.source_size == sizes[s] for s in sizes)
    of = dict.fromkeys(sizes, 0)
    for x in mixed(df, block=4, shard_words=3000).collect():
        of[x.source] += x["__lf_taken"]
        assert abs(x["__lf_target"] - want[x.source]) < 1e-6 and x["__lf_source_size"] == sizes[x.source]
    assert sum(of.values()) == sum(x.taken for x in got)
    for s, n in of.items():
        assert abs(n - want[s]) <= max(0.01 * want[s], 30), (s, n, want[s])
    again = mix_sources(df.repartition(7), block=4, shard_words=3000).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert mix_sources(df.limit(0)).collect() == []
    kept = mixed(df)
    assert kept.columns[:4] == df.columns and kept.count() == len(rows)


def test_mix_of_only_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((x.doc_id, x.size, x.taken, x.target) for x in mix_sources(df).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def brute_nearest(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float64))
    flat = sorted({(i, tuple(v)) for i, vs in ok.items() for v in vs})
    out = {}
    for i, q in flat:
        if i % every == 0:
            q = np.array(q)
            s = sorted((-float(q @ np.array(v)) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for j, v in flat if j != i)
            out[i] = s[:k]
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 12))
    rows = [(i, [float(x) for x in (centres[i % 10] + 0.3 * rng.standard_normal(12)).astype(np.float32)]) for i in range(900)]
    same = rows[50][1]
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2050, [0.0] * 12), (2100, [float("nan")] * 12), (2150, [1.0] * 5), (None, same), (2200, [None] + [1.0] * 11),
             (rows[1][0], rows[1][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    monkeypatch.setattr(ann, "BLOCK", 40)
    got: dict = {}
    for x in ann.nearest(df, probes=30).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute_nearest(rows, 50, 5)
    assert got.keys() == want.keys()
    found = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        found += len({m[1] for m in mine} & {j for _, j in best})
        total += 5
    assert found / total >= 0.97
    # a query within the group of equal vectors finds the smallest ids of the group
    assert [m[1] for m in sorted(got[1050])] == [50, 1000, 1001, 1002, 1003]
    assert ann.nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 2.1])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x.rank, x.vec_id) for x in ann.nearest(few).collect()] == [(0, 1, 7)]


def recall_of_default(spark, x, every=50):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got: dict = {}
    for r in ann.nearest(df, every=every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -2
        found += len(got[q] & set(np.argsort(-s)[:5].tolist()))
        total += 5
    return found / total


def test_nearest_default_keeps_its_recall(spark):
    rng = np.random.default_rng(8)
    assert recall_of_default(spark, rng.standard_normal((1_000, 64)).astype(np.float32)) >= 0.9
    assert recall_of_default(spark, rng.standard_normal((8_000, 64)).astype(np.float32)) >= 0.9


def test_every_vector_length_is_searched(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(20)] + [(50, [1.0, 0.0]), (51, [1.0, 1.0]), (100, [2.0] * 5)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    flat = lambda q: sorted((-float(np.dot(v, w)) / math.sqrt(np.dot(v, v) * np.dot(w, w)), j) for v in [dict(rows)[q]] for j, w in rows
                            if j != q and len(w) == len(v))[:5]
    for q in (0, 50, 100):
        mine = sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == q)
        assert [m[1] for m in mine] == [j for _, j in flat(q)]
        assert all(abs(m[2] + s) < 1e-12 for m, (s, _) in zip(mine, flat(q)))


def test_null_ids_of_a_source_spread_over_shards(spark):
    rows = [(None, f"w{i} " * (i % 9 + 1), "a") for i in range(3000)] + [(i, "b c", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(df, shard_words=500, block=4).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert abs(sum(x["__lf_taken"] for x in own) - own[0]["__lf_target"]) <= 120                   # a block for each shard
        assert all(x["__lf_taken"] <= 3 * x["__lf_size"] for x in own)
