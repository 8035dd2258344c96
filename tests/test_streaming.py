"""Incremental stream: batches share a memory; replay-safe per-batch outputs."""

import os

from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.models import MockTranslator, mock_translate
from lexiflow.operators.memory import read_memory
from lexiflow.streaming.incremental import DOC_SCHEMA, translate_stream

S = DEFAULT.with_(throttle_waits=(0.0,))


def _arrive(spark, rows, tmp_path, src, name):
    """A file lands in the watched folder: written elsewhere, then renamed in."""
    stage = str(tmp_path / ("stage_" + name))
    spark.createDataFrame(rows, DOC_SCHEMA).coalesce(1).write.parquet(stage)
    part = [f for f in os.listdir(stage) if f.endswith(".parquet")][0]
    os.makedirs(src, exist_ok=True)
    os.replace(os.path.join(stage, part), os.path.join(src, name + ".parquet"))


def test_stream_reuses_memory(spark, tmp_path):
    src = str(tmp_path / "in")
    ctx = "shared"
    _arrive(spark, [(1, "日本\n共通 行", ctx)], tmp_path, src, "a")
    out, mem, ck = str(tmp_path / "out"), str(tmp_path / "mem"), str(tmp_path / "ck")
    q = translate_stream(spark, src, MockTranslator(), out, mem, S, checkpoint=ck, glob="*.parquet")
    q.awaitTermination()
    # a second file arrives: one line is known, one is new
    _arrive(spark, [(2, "共通 行\n新しい 語", ctx)], tmp_path, src, "b")
    q = translate_stream(spark, src, MockTranslator(), out, mem, S, checkpoint=ck, glob="*.parquet")
    q.awaitTermination()
    docs = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    assert docs == {1: f"{mock_translate('日本')}\n{mock_translate('共通 行')}",
                    2: f"{mock_translate('共通 行')}\n{mock_translate('新しい 語')}"}
    learned = spark.read.parquet(mem)
    # the shared line was learned once, by the first batch only
    assert learned.filter(F.col("text") == "共通 行").count() == 1
    assert read_memory(spark, mem).count() == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from lexiflow.streaming.incremental import translate_batch
    mem, out, work = str(tmp_path / "mem"), str(tmp_path / "out"), str(tmp_path / "work")
    docs = spark.createDataFrame([(1, "日本\n語 行", "c")], DOC_SCHEMA)
    for _ in range(2):
        translate_batch(docs, 0, MockTranslator(), S, mem, out, work)
        assert read_memory(spark, mem).count() == 2
        assert [r.text for r in spark.read.parquet(out).collect()] == [f"{mock_translate('日本')}\n{mock_translate('語 行')}"]
    assert read_memory(spark, mem, except_run="b0").count() == 0


def test_translations_are_not_moved_where_no_call_failed(spark, tmp_path):
    from lexiflow.config import DEFAULT
    from lexiflow.models import MockTranslator, ScriptedFaultTranslator
    from lexiflow.operators.batch import batch_translate
    from lexiflow.operators.memory import read_memory
    from lexiflow.session import work_dir
    units = spark.createDataFrame([("a", 0, "日本 x", "c"), ("a", 1, "本失", "c"), ("b", 0, "語 y", "c"), ("b", 1, "日本 x", "c")],
                                  "scope string, ord bigint, text string, context string")
    spark.createDataFrame([("c", "日本 x", "kept", "r0"), ("c", "日本 x", "least of two", "r0")], "context string, text string, text_en string, run string") \
        .write.partitionBy("run").parquet(str(tmp_path / "memory"))
    memory = read_memory(spark, str(tmp_path / "memory"))
    good = batch_translate(units, MockTranslator(), DEFAULT, work_dir(spark), memory=memory)
    bad = batch_translate(units, ScriptedFaultTranslator(fail_marker="失", faults=False), DEFAULT, work_dir(spark), memory=memory)
    said = lambda r: sorted((x.scope, x.text, x.text_en, x.how) for x in r.translations.collect())
    assert said(good) == [("a", "日本 x", "kept", "memory"), ("a", "本失", "<en>b失", "chunk"), ("b", "日本 x", "kept", "memory"), ("b", "語 y", "<en>c y", "chunk")]
    assert said(bad) == [("b", "日本 x", "kept", "memory"), ("b", "語 y", "<en>c y", "chunk")]
    plan = lambda r: r.translations._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(good)
    assert "Join LeftAnti" in plan(bad)
