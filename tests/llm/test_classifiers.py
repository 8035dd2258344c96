"""Language ID, quality, toxicity and decontamination: rules on small tables, held-out accuracy on the given ones."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import decontaminate, lang_id, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, sf, query, truth):
    got = queries.QUERIES[query](spark, sf)
    return got.join(truth, "doc_id").where("held_out").collect()


def test_language_of_held_out_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op9_language_id(spark, SF)
    assert got.count() == d.count()
    rows = got.join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def bits_by_hand(train, text, order=3):
    """Code length of method C with unpruned contexts."""
    ctx = {}
    for t in train:
        b = b"\n" * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                c = ctx.setdefault(b[i - k: i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    total, b = 0.0, b"\n" * order + text.encode()
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = ctx.get(b[i - k: i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark):
    r = random.Random(1)
    texts = {"aa": ["".join(r.choice("abc é") for _ in range(60)) for _ in range(5)], "bb": ["".join(r.choice("cdx .") for _ in range(60)) for _ in range(5)]}
    rows = [(t, k) for k, v in texts.items() for t in v] + [(None, "aa"), ("zzz", None)]
    m = lang_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert m.langs == ["aa", "bb"]
    for t in ["abc é cab", "xdx. cc", "qq", "", "a"]:
        buf = np.frombuffer(t.encode(), np.uint8)
        got = m.bits(buf, np.array([0, len(buf)]))[0]
        for i, k in enumerate(m.langs):
            assert got[i] == pytest.approx(bits_by_hand(texts[k], t), rel=1e-5), (t, k)


def test_language_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !!", "en"), (6, "é", None),
            (None, "the dog", "en"), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    m = lang_id.learn(df)
    got = lang_id.with_language(df, m).collect()
    by = {r.text: (r["__lf_lang"], r["__lf_score"]) for r in got}
    assert len(got) == len(rows) and all(r.score == "clash" for r in got)
    assert by["the cat and the dog"][0] == "en" and by["der Hund und die Katze"][0] == "de"
    assert by[None] == by[""] == by["123 !!"] == ("und", 0.0) and by["é"][0] in ("en", "de")
    assert {r["__lf_lang"] for r in lang_id.with_language(df, lang_id.learn(df.limit(0))).collect()} == {"und"}
    assert lang_id.with_language(df.limit(0), m).collect() == []


def test_a_hot_language_takes_nothing_from_a_rare_one(spark):
    r = np.random.default_rng(5)
    hot = ["".join(chr(97 + x) for x in r.integers(0, 26, 50_000)) for _ in range(40)]       # 450,000 strings, each more than once
    rare = ["ⴰⵎⴰⵣⵉⵖ qa qu", "ⴰⴷⵔⴰⵔ qi"]
    m = lang_id.learn(spark.createDataFrame([(t, "hot") for t in hot] + [(t, "rare") for t in rare], "text string, lang string").repartition(4))
    assert m.langs == ["hot", "rare"]
    for t in ["ⴰⴷⵔⴰⵔ qu", "qa qi"]:
        buf = np.frombuffer(t.encode(), np.uint8)
        assert m.bits(buf, np.array([0, len(buf)]))[0, 1] == pytest.approx(bits_by_hand(rare, t), rel=1e-5)
    got = lang_id.with_language(spark.createDataFrame([(rare[0],), (hot[0][:200],)], "text string"), m).collect()
    assert {x.text: x["__lf_lang"] for x in got} == {rare[0]: "rare", hot[0][:200]: "hot"}


@pytest.mark.parametrize("cells, grams", [(600, 10**6), (10**9, 60), (10**9, 150)])
def test_parts_give_the_result_of_one_model(spark, monkeypatch, cells, grams):
    r = random.Random(2)
    letters = {"aa": "abc é", "bb": "cdx .", "cc": "aéxz "}
    rows = [(i, "".join(r.choice(letters[k]) for _ in range(60)), k) for i, k in enumerate(sorted(letters) * 5)]
    df = spark.createDataFrame(rows + [(None, None, "aa"), (3, "12", None), (4, "dxz", None)], "doc_id long, text string, lang string")
    want = sorted((x.text or "", x["__lf_lang"], round(x["__lf_score"], 6)) for x in lang_id.with_language(df, lang_id.learn(df)).collect())
    monkeypatch.setattr(lang_id, "MAX_CELLS", cells)
    monkeypatch.setattr(lang_id, "MAX_GRAMS", grams)
    m = lang_id.learn(df)
    assert len(m.parts) > 1
    assert sorted((x.text or "", x["__lf_lang"], round(x["__lf_score"], 6)) for x in lang_id.with_language(df, m).collect()) == want


def auc(rows, label):
    s = sorted((r.score, r[label]) for r in rows)
    pos = sum(y for _, y in s)
    below = wins = 0
    for _, y in s:
        if y:
            wins += below
        else:
            below += 1
    return wins / max(1, pos * (len(s) - pos))


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = held(spark, SF, "op1_quality", labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.9


def test_quality_cases(spark):
    rows = [(i, "good words in a fair line of text number %d" % i if i % 2 else "Le " * 40) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (102, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality.learn(df, labels, "quality", F.lit(True))
    got = {r.doc_id: r["__lf_score"] for r in quality.with_quality(df, m).collect()}
    assert len(got) == 64 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(1, 60, 2)) > 0.8 and max(got[i] for i in range(0, 60, 2)) < 0.2
    assert quality.with_quality(df.limit(0), m).collect() == []
    none = quality.learn(df, labels.limit(0), "quality", F.lit(True))
    assert {r["__lf_score"] for r in quality.with_quality(df, none).collect()} == {0.5}


def test_flat_trees_equal_their_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.boost(x, y, trees=20, depth=3)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:20]:
        z = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            z += v[at - len(f)]
        assert m.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-z)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_and_trie_find_all_within_the_distance():
    r = random.Random(6)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(300):
        w = "".join(r.choice("abcd") for _ in range(r.randint(0, 7)))
        for most in (0, 1, 2):
            assert trie.within(w, most) == [i for i, t in enumerate(terms) if distance(w, t) <= most], (w, most)


def test_halves_lose_no_term():
    terms = ["worthless", "pathetic", "moron"]
    lx = toxicity.Lexicon(terms, [1.0, 2.0, 3.0], {})
    for t in terms:
        for i in range(len(t) + 1):
            for w in (t[:i] + "x" + t[i:], t[:i] + t[i + 1:], t[:i] + "x" + t[i + 1:]):
                if w != t and len(w) >= 5:
                    assert lx.judge(w)[0] == "fuzzy", w
    r = random.Random(8)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 9))) for _ in range(80)})
    lx = toxicity.Lexicon(terms, [1.0] * len(terms), {})
    for _ in range(400):
        w = "".join(r.choice("abcd") for _ in range(r.randint(5, 10)))
        assert lx.near(w) == {i for i, t in enumerate(terms) if len(t) >= 5 and distance(w, t) <= 1}, w


def test_toxicity_cases(spark):
    r = random.Random(2)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "moran", "kappa"]) for _ in range(30))
    rows, labels = [], []
    for i in range(400):
        t, bad = text(), i % 5 == 0
        if bad:
            t = t + r.choice([" you scumbag!", " what a moron", " you moron", " lowei" + r.choice(["ab", "cd", "ef", "gh"])]) + " " + text()
        elif i % 7 == 0:
            t = t + ' he said the word "moron" to report it ' + text()
        rows.append((i, t))
        labels.append((i, 1, int(bad)))
    extra = [(900, None), (901, ""), (902, "you morron " + text()), (903, text()), (904, "loweizz " + text()), (None, "x"), (905, "a" * 20_000)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("y", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.learn(df, lab, "toxic", F.lit(True))
    got = {x.doc_id: x["__lf_score"] for x in toxicity.with_toxicity(df, m).collect()}
    assert len(got) == 407 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(0, 400, 5)) >= 0.3
    assert max(got[i] for i in range(400) if i % 5 and i % 7) < 0.3
    quoted = [got[i] for i in range(400) if i % 5 and i % 7 == 0]
    assert sum(s < 0.3 for s in quoted) / len(quoted) > 0.9
    assert got[902] >= 0.3 and got[904] >= 0.3 and got[903] < 0.3 and got[900] < 0.3 and got[901] < 0.3
    assert toxicity.with_toxicity(df.limit(0), m).collect() == []


def test_misspelled_inflections_match(spark):
    forms = ["zork"] * 50 + ["zorking"] * 30 + ["zorker"] * 20
    rows = [(i, f"you {w} number{i}") for i, w in enumerate(forms)] + [(1000 + i, f"plain words number{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, toxic int")
    lx = toxicity.learn(df, lab, "toxic", F.lit(True)).lexicon
    assert {"zork", "zorking", "zorker"} <= set(lx.words) and "zork" in lx.stems
    assert lx.judge("zorked")[0] == "stem"
    for w in ["zrking", "z0rking", "zzorker", "ozrker"[1:]]:
        assert lx.judge(w)[0] == "fuzzy", w


#: more labelled rows than SF has
LARGER = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = held(spark, LARGER, "op3_toxicity", labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.95
    toxic = [r for r in rows if r.toxic == 1]
    assert sum(r.predicted == 1 for r in toxic) / len(toxic) >= 0.9


def words_of(t):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low)


def test_wand_returns_all_above_the_threshold(monkeypatch):
    import pyarrow as pa
    r = random.Random(5)
    vocab = [f"t{i}" for i in range(120)]
    items = [" ".join(r.choice(vocab[: r.choice([20, 120])]) for _ in range(r.randint(5, 30))) for _ in range(150)]
    for blocks in (64, 7):
        monkeypatch.setattr(decontaminate, "MAX_BLOCKS", blocks)
        ix = decontaminate.build(list(range(150)), items)
        queries, want = [], {}
        for k in range(200):
            q = set(r.sample(vocab, r.randint(1, 60))) | set(r.choice(items).split()[: r.randint(0, 30)])
            h, _ = decontaminate.terms(*decontaminate.K.utf8(pa.array([" ".join(q)])))
            query = np.unique(np.searchsorted(ix.vocab, h[np.isin(h, ix.vocab)]))
            queries += [(k, t) for t in query]
            score = {}
            for t in query:
                for p in range(ix.start[t], ix.start[t + 1]):
                    score[int(ix.item[p])] = score.get(int(ix.item[p]), 0) + ix.weight[p]
            want.update({(k, i): s for i, s in score.items() if s >= 0.5})
        got = {(int(q), int(i)): s for q, i, s in zip(*decontaminate.wand(ix, *np.array(queries).T, 0.5))}
        assert got == pytest.approx(want) and want


@pytest.mark.parametrize("index_bytes", [1 << 20, 400])
def test_leaks_are_found_and_clean_texts_left_alone(spark, index_bytes):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(8, 40))) for i in range(20)] + [(20, None), (None, text(20)), (21, "two words"), (22, "")]
    items.append((23, items[4][1]))
    rows, want = [], {}
    for i in range(150):
        k = r.choice([None, None, r.randrange(20)])
        t = text(r.choice([0, 3, 50, 400]))
        if k is not None:
            t = t + " " + items[k][1].upper().replace("É", "é") + ". " + text(r.choice([0, 3, 300]))
        rows.append((i, t))
        want[i] = sorted({k} | ({23} if k == 4 else set())) if k is not None else []
    half = items[0][1].split()
    rows += [(500, None), (501, ""), (502, text(200) + " " + " ".join(half[: len(half) // 3])), (None, items[1][1]), (0, rows[0][1])]
    want.update({500: [], 501: [], 502: [], None: [1]})
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench, index_bytes=index_bytes).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x["items"] for x in got} == want
    assert all(x.contaminated == bool(x["items"]) and x.n_items == len(x["items"]) for x in got)
    assert decontaminate.leaks(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.leaks(df.limit(0), bench).collect() == []


def test_items_without_blanks_and_short_items_are_found(spark):
    items = [(1, "日本の首都はどこですか。東京です。"), (2, "How many?"), (3, "世界最高峰"), (4, "。、！"), (5, "¿Dónde está «la casa» azul—verde?")]
    texts = {10: ("前の文章、" + items[0][1] + "後ろの文章", [1]), 11: ("日本の首都 は、どこですか東京です", [1]), 12: ("say HOW MANY, then", [2]),
             13: ("how very many. How. Many", [2]), 14: ("how", []), 15: ("many how", []), 16: ("彼は世界最高峰に登った", [3]), 17: ("世界の最高峰", []),
             18: ("x ¿Dónde está la casa azul verde y", [5]), 19: ("日本の首都", []), 20: ("", []), 21: ("many", [])}
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {x.doc_id: x["items"] for x in decontaminate.leaks(df, bench).collect()} == {i: w for i, (_, w) in texts.items()}
    assert {x.doc_id for x in decontaminate.leaks(df, bench.where("item_id = 2")).where("contaminated").collect()} == {12, 13}


def test_an_item_of_a_common_word_is_no_leak_and_is_reported(spark):
    items = [(1, "Paris"), (2, "in the"), (3, "Donaudampfschiff"), (4, None), (5, " .,"), (6, "What is the capital of France? Paris"), (7, "東京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, "we went to paris by train in the rain"), (2, "das donaudampfschiff kommt"),
                                (3, "x what is the capital of france paris y 東京")], "doc_id long, text string")
    assert {x.doc_id: x["items"] for x in decontaminate.leaks(df, bench).collect()} == {1: [], 2: [3], 3: [6]}
    assert {(r.item_id, r.reason) for r in decontaminate.unsearchable(bench).collect()} == {
        (1, "too short"), (2, "too short"), (4, "null"), (5, "no term"), (7, "too short")}


def test_leaks_of_the_given_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = [(b.item_id, tuple(words_of(b.text))) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for x in d:
        joined = " " + " ".join(words_of(x.text)) + " "
        want[x.doc_id] = [i for i, w in bench if f" {' '.join(w)} " in joined]
    got = {x.doc_id: x["items"] for x in queries.op8_decontamination(spark, SF).collect()}
    for i, items in want.items():
        assert set(items) <= set(got[i])
    assert sum(bool(got[i]) and not want[i] for i in want) <= 0.002 * len(want)
    assert sum(map(bool, want.values())) > 5
