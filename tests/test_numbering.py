"""Numbers within a key and free numbers: against plain Python, with keys that span partitions."""

import random
import time

from pyspark.sql import functions as F

from lexiflow.operators import names
from lexiflow.operators.names import unique_paths
from lexiflow.operators.numbering import free_numbers, with_numbers
from lexiflow.session import work_dir


def test_numbers_within_keys(spark):
    rnd = random.Random(2)
    rows = [(k, o) for k, n in ((None, 5), ("a", 3000), ("b", 1), ("c", 40)) for o in rnd.sample(range(-10**6, 10**6), n)]
    df = spark.createDataFrame(rows, "k string, o long").fillna("", ["k"])
    got = {(r.k, r.o): r.g for r in with_numbers(df.repartition(5), ["k"], ["o"], work_dir(spark), "n", "g").collect()}
    want = {}
    for key in {k or "" for k, _ in rows}:
        want |= {(key, o): i for i, o in enumerate(sorted(o for k, o in rows if (k or "") == key))}
    assert got == want


def test_free_numbers_skip_taken_ones(spark):
    rnd = random.Random(3)
    ranks, taken, want = [], [], {}
    for key, (n, t) in enumerate(((300, []), (200, range(2, 150)), (50, [1, 2, 2, 9, 10, 200]), (400, rnd.sample(range(1, 900), 300)), (3, [10**8]))):
        free = (x for x in range(2, 2000) if x not in set(t))
        ranks += [(key, m) for m in range(1, n + 1)]
        want |= {(key, m): next(free) for m in range(1, n + 1)}
        taken += [(key, x) for x in t]
    taken.append((99, 5))
    got = free_numbers(spark.createDataFrame(ranks, "key int, m long"), spark.createDataFrame(taken, "key int, n int"), ["key"], "m", "number", work_dir(spark), "f")
    assert {(r.key, r.m): r.number for r in got.collect()} == want


def plain_paths(rows):
    low = lambda r: (r[1].lower(), r[2].lower(), r[3].lower())
    own = {}
    for r in sorted(rows):
        own.setdefault(low(r), []).append(r)
    out = {}
    for (d, s, x), group in own.items():
        n = 2
        for i, (path, folder, stem, suffix) in enumerate(group):
            if i:
                while (d, f"{s}_{n}", x) in own:
                    n += 1
                stem, n = f"{stem}_{n}", n + 1
            out[path] = "/".join([folder] * bool(folder) + [stem + suffix])
    return out


def test_paths_equal_a_plain_rule_also_for_hot_names(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        stem = rnd.choice(["Note", "note", "NOTE", "x", f"note_{rnd.randint(1, 60)}", f"x_{rnd.randint(1, 9)}", "note_007", f"note_{rnd.randint(10**9, 10**10)}"])
        rows.append((f"p{i:05d}", rnd.choice(["", "A", "a/b"]), stem, rnd.choice([".txt", ".TXT", ""])))
    df = spark.createDataFrame(rows, "path string, dir_en string, stem string, suffix string")
    for hot in (10_000, 5):
        monkeypatch.setattr(names, "HOT_NAME", hot)
        got = {r.path: r.path_out for r in unique_paths(df.repartition(4)).collect()}
        assert got == plain_paths(rows)
        assert len({x.lower() for x in got.values()}) == len(rows)


def test_a_constant_stem_and_no_collision(spark):
    one = spark.range(3).select(F.col("id").cast("string").alias("path"), F.lit("d").alias("dir_en"), F.lit("same").alias("stem"), F.lit("").alias("suffix"))
    assert sorted(r.path_out for r in unique_paths(one).collect()) == ["d/same", "d/same_2", "d/same_3"]
    assert [r.path_out for r in unique_paths(one.limit(1)).collect()] == ["d/same"]
    assert unique_paths(one.limit(0)).collect() == []


def test_a_million_files_of_one_name(spark):
    """Linear: twice the files cost about twice, at most (a third of the numbers is taken)."""
    took = []
    for n in (250_000, 1_000_000):
        name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("note_"), F.col("id").cast("string"))).otherwise(F.lit("note"))
        df = spark.range(n).select(F.format_string("%09d", "id").alias("path"), F.lit("d").alias("dir_en"), name.alias("stem"), F.lit(".md").alias("suffix"))
        t = time.time()
        got = unique_paths(df).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path_out").alias("u"), F.max(F.regexp_extract("path_out", r"_(\d+)", 1).try_cast("long")).alias("top")).first()
        took.append(time.time() - t)
        assert got.n == got.u == n
        files = n - (n + 2) // 3                          # without a number of their own: they take the numbers that 3 does not divide
        assert got.top <= max(n, files * 3 // 2 + 3)
    assert took[1] < 8 * took[0] + 10


def test_paths_of_a_deep_tree_by_pointer_jumping(spark):
    from lexiflow.operators.names import folder_table, translate_dir_paths
    rnd = random.Random(9)
    deep = "/".join(f"d{i}" for i in range(300))
    dirs = {deep, "x", "", *("/".join(f"n{rnd.randint(0, 2)}" for _ in range(rnd.randint(1, 9))) for _ in range(60))}
    table = folder_table(spark.createDataFrame([(d,) for d in dirs], "rel_dir string"), "root")
    en = table.withColumn("name_en", F.when(~F.col("name").startswith("x"), F.upper("name")))     # one folder has no translation
    got = {r.rel_dir: (r.dir_en, r.folder_context) for r in translate_dir_paths(en, "root").collect()}
    every = {"/".join(d.split("/")[:i]) for d in dirs for i in range(len(d.split("/")) + 1)}
    assert set(got) == every
    for d, (path, context) in got.items():
        want = [p if p.startswith("x") else p.upper() for p in d.split("/")] if d else []
        assert path == "/".join(want) and context == (" > ".join(want) or "root")
    assert translate_dir_paths(en.limit(0), "root").collect()[0].rel_dir == ""
