"""Public translate_documents on the sf0.001 corpus: every document, in order."""

from pyspark.sql import functions as F

from lexiflow import translate_documents
from lexiflow.config import DEFAULT
from lexiflow.models import MockTranslator, ScriptedFaultTranslator
from lexiflow.plans.fixtures import jp_documents, mock_en
from lexiflow.functions.script import is_translatable

from conftest import SF001

S = DEFAULT.with_(throttle_waits=(0.0,))


def _expected(docs):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    out = F.when(is_translatable("l"), mock_en("l")).otherwise(F.col("l"))
    return (lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", out.alias("o")))).alias("s"))
            .select("doc_id", F.array_join("s.o", "\n").alias("want")))


def test_translate_documents_whole_corpus(spark):
    docs = jp_documents(spark, SF001)
    extra = spark.createDataFrame([(10**9, "", "")], "doc_id long, text string, context string")
    res = translate_documents(docs.select("doc_id", "text", "context").unionByName(extra), MockTranslator(), S,
                              context=F.col("context"))
    got = res.documents.withColumnRenamed("scope", "doc_id")
    assert got.count() == docs.count() + 1
    assert got.filter(F.col("status") != "ok").count() == 0
    assert got.filter("doc_id = 1000000000").first().text == ""
    bad = got.join(_expected(docs), "doc_id").filter(F.col("text") != F.col("want"))
    assert bad.count() == 0


def test_failing_document_keeps_original(spark):
    rows = [(1, "日本\n普通"), (2, "失敗 行\n日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    res = translate_documents(df, ScriptedFaultTranslator(fail_marker="失敗", faults=False), S)
    got = {r.scope: (r.text, r.status) for r in res.documents.collect()}
    assert got[2] == ("失敗 行\n日本", "error")
    assert got[1][1] == "ok" and got[1][0].startswith("<en>")


def test_rewritten_parts_are_handed_on_a_few_at_a_time():
    import pyarrow as pa

    from lexiflow.plans.packages import PARTS_AT_ONCE, rewritten_batches
    n, calls = 10 * PARTS_AT_ONCE + 3, []

    def fn(xml, m):
        calls.append(xml)
        return m["t"] + xml
    b = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(n)], "part": ["p"] * n, "xml": [f"x{i}" for i in range(n)],
                                    "tmap": [[{"text": "t", "text_en": "e"}] if i % 3 else None for i in range(n)]})
    out = rewritten_batches(iter([b]), fn)
    first = next(out)
    assert first.num_rows == PARTS_AT_ONCE and len(calls) < PARTS_AT_ONCE        # before, a whole Arrow batch was held as Python objects
    got = [x for part in [first, *out] for x in part.column("xml").to_pylist()]
    assert got == [f"ex{i}" if i % 3 else f"x{i}" for i in range(n)]
