"""File sinks: the commit protocol, second names, streamed packages."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.models import MockTranslator, ModelReply, mock_translate
from lexiflow.plans.folder import translate_folder
from lexiflow.sinks.files import FileTree, files, folders, packages

S = DEFAULT.with_(throttle_waits=(0.0,))


def every_file(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def members(spark, rows):
    return files(spark.createDataFrame(rows, "path string, path_out string, data binary"))


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    dst = tmp_path / "out"
    bad = spark.range(40).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("f"), "id").alias("path_out"),
                                 F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("data"))
    with pytest.raises(Exception, match="lost"):
        with FileTree(spark, str(dst)) as tree:
            tree.write(members(spark, [("a", "a/b.txt", b"1")]))
            assert not dst.exists()
            tree.write(files(bad.repartition(8)))
    assert not dst.exists() and os.listdir(tmp_path) == []


def test_commit_puts_all_in_place_and_merges_where_asked(spark, tmp_path):
    dst = tmp_path / "out"
    with FileTree(spark, str(dst)) as tree:
        tree.write(members(spark, [("1", "a/b.txt", b"1"), ("2", "c", b""), ("3", "n", None)]))
        tree.write(folders(spark.createDataFrame([("e", "empty/deep")], "p string, t string"), "p", "t"))
        assert {(r.kind, r.path_out, r.bytes, r.written) for r in tree.results().collect()} == {
            ("file", "a/b.txt", 1, True), ("file", "c", 0, True), ("file", "n", 0, True), ("dir", "empty/deep", 0, True)}
        tree.commit()
    assert every_file(dst) == ["a/b.txt", "c", "n"] and (dst / "empty" / "deep").is_dir() and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        FileTree(spark, str(dst))
    with FileTree(spark, str(dst), "overwrite") as tree:
        tree.write(members(spark, [("1", "a/b.txt", b"22"), ("4", "z/new", b"3")]))
        assert (dst / "a" / "b.txt").read_bytes() == b"1"
        tree.commit()
    assert (dst / "a" / "b.txt").read_bytes() == b"22" and every_file(dst) == ["a/b.txt", "c", "n", "z/new"]
    assert os.listdir(tmp_path) == ["out"]


def test_a_second_attempt_of_a_task_rewrites_the_same_file(tmp_path):
    from lexiflow.sinks.files import MEMBER_SCHEMA, FilesWriter
    from pyspark.sql import Row
    for d in ("tree", "tasks", "results"):
        (tmp_path / d).mkdir()
    row = lambda data: Row(*MEMBER_SCHEMA.fieldNames())("file", "p", ["x/y"], None, data, None, None, None)
    w = FilesWriter(str(tmp_path))

    def broken():
        yield row(b"first")
        raise RuntimeError("executor lost")
    with pytest.raises(RuntimeError):
        w.write(broken())
    done = w.write(iter([row(b"second")]))
    w.commit([done, None])
    assert every_file(tmp_path / "tree") == ["x/y"] and (tmp_path / "tree" / "x" / "y").read_bytes() == b"second"
    assert len(list((tmp_path / "results").iterdir())) == 1


def test_packages_are_streamed_and_isolated(spark, tmp_path):
    rows = [(p, f"{p}.zip", i, f"m{i}" if p != "bad" or i < 2 else None, bytes([i]) * 1000, i % 2 == 0, [2001, 2, 3, 4, 5, 6], 0)
            for p in ("good", "bad", "other") for i in range(4)]
    df = spark.createDataFrame(rows, "path string, path_out string, ord int, part string, data binary, changed boolean, date_time array<int>, compress_type int")
    with FileTree(spark, str(tmp_path / "o")) as tree:
        tree.write(packages(df.repartition(3)))
        got = {r.path: (r.written, r.error) for r in tree.results().collect()}
        tree.commit()
    assert got["good"] == got["other"] == (True, None) and not got["bad"][0] and got["bad"][1]
    assert every_file(tmp_path / "o") == ["good.zip", "other.zip"]
    with zipfile.ZipFile(tmp_path / "o" / "good.zip") as z:
        assert z.namelist() == ["m0", "m1", "m2", "m3"] and z.read("m3") == b"\x03" * 1000
        assert z.getinfo("m1").date_time == (2001, 2, 3, 4, 5, 6) and z.getinfo("m1").compress_type == zipfile.ZIP_STORED


def long_names():
    class LongNames:
        """Names that no file system takes, for names with the marker; all else as the mock model."""

        def __call__(self, req):
            if req.kind == "name" and "長" in req.items[0]:
                return ModelReply("n" * 300, 1, 1)
            return MockTranslator()(req)
    return LongNames()


def test_what_cannot_be_written_goes_out_under_its_own_name(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "out"
    (src / "長い").mkdir(parents=True)
    (src / "日本").mkdir()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>報告</t></si></sst>")
    (src / "日本" / "長文.txt").write_text("日本\n", encoding="utf-8")
    (src / "日本" / "良.txt").write_text("日本\n", encoding="utf-8")
    (src / "日本" / "長表.xlsx").write_bytes(buf.getvalue())
    (src / "長い" / "中.txt").write_text("文書\n", encoding="utf-8")
    res = translate_folder(spark, str(src), str(dst), long_names(), S)
    m = mock_translate
    assert every_file(dst) == sorted([f"{m('日本')}/良.txt".replace("良", m("良")), f"{m('日本')}/長文.txt", f"{m('日本')}/長表.xlsx", "長い/中.txt"])
    assert (dst / m("日本") / "長文.txt").read_text("utf-8") == "日本\n"
    assert (dst / m("日本") / "長表.xlsx").read_bytes() == buf.getvalue()
    assert (dst / "長い" / "中.txt").read_text("utf-8") == "文書\n"
    errors = {(r.path, r.stage) for r in res.errors.collect()}
    assert errors == {("日本/長文.txt", "write"), ("日本/長表.xlsx", "write"), ("長い/中.txt", "write"), ("長い", "write")}
    assert res.written.filter("error is not null").count() == 0
    assert {r.path_out for r in res.written.collect()} >= set(every_file(dst)) | {"長い", m("日本")}
