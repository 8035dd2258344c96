"""S4 line source equals Python's read_text + splitlines(keepends=True) rule."""

import random

from pyspark.sql import functions as F

from lexiflow.sources.text import explode_lines

BOM = "﻿"


def _py_lines(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith(BOM):
        text = text[1:]
    out = []
    for i, line in enumerate(text.splitlines(keepends=True)):
        body = line.rstrip("\r\n")
        out.append((i, body, line[len(body):]))
    return out


def test_lines_match_splitlines(spark):
    rnd = random.Random(3)
    alphabet = ["a", "日", " ", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85",
                " ", " ", "　", "\t", BOM, "\x00"]
    texts = ["", "\n", "a", "a\n", "a\n\nb", BOM + "a\nb", "\n\n", "日　\n", "a\x00\nb", "\x00", "x\x00"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in explode_lines(df, "text", keep=["id"]).collect():
        got.setdefault(r.id, []).append((r.ord, r.text, r.ending))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == _py_lines(t), repr(t)


def test_a_flat_folder_of_200000_files_is_listed_in_batches(spark, tmp_path, monkeypatch):
    import os
    from lexiflow.sources import files
    from lexiflow.session import work_dir
    flat = tmp_path / "flat"
    (flat / "sub").mkdir(parents=True)
    where = os.open(flat, os.O_RDONLY)
    for i in range(200_000):
        os.close(os.open(f"f{i}", os.O_CREAT | os.O_WRONLY, dir_fd=where))
    os.close(where)
    (flat / "sub" / "x").write_bytes(b"123")
    os.symlink(flat / "nowhere", flat / "gone")
    os.symlink(flat / "sub", flat / "link")
    w = work_dir(spark)
    got = files.list_tree(spark, str(flat), w)
    counted = {(r.is_dir, r.is_link, r.length, r.bad): r.n for r in got.selectExpr("is_dir", "is_link", "length", "error is not null bad").groupBy(
        "is_dir", "is_link", "length", "bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counted == {(False, False, 0, False): 200_000, (False, False, 3, False): 1, (False, True, 0, True): 1, (True, False, 0, False): 1,
                       (True, True, 0, False): 1}
    assert got.filter("path = 'sub/x'").count() == 1 and got.filter("path like 'link/%'").count() == 0
