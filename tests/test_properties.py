"""Properties over the sf0.001 corpus (whole table)."""

import pytest
from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.functions.script import has_script
from lexiflow.models import IdentityTranslator, MockTranslator, ScriptedFaultTranslator
from lexiflow.operators.apply import apply_translations
from lexiflow.operators.batch import batch_translate
from lexiflow.operators.rebuild import rebuild_text
from lexiflow.plans.catalog import jp_lines
from lexiflow.plans.fixtures import jp_documents
from lexiflow.sources.text import normalize_text
from lexiflow.session import work_dir

from conftest import SF001

SMALL = DEFAULT.with_(chunk_token_budget=300, chunk_max_strings=8, throttle_waits=(0.0,))


def test_identity_rebuild_returns_input(spark):
    lines = jp_lines(spark, SF001)
    res = batch_translate(lines, IdentityTranslator(), SMALL, work_dir(spark), "prop_id")
    applied = apply_translations(lines, res.translations)
    assert applied.count() == lines.count()  # join back keeps every occurrence
    out = rebuild_text(applied, "scope", "text_out", "text")
    src = jp_documents(spark, SF001).select(F.col("doc_id").alias("scope"), normalize_text("text").alias("src"))
    assert out.join(src, "scope").filter(F.col("text") != F.col("src")).count() == 0


def test_chunks_obey_limits_and_mock_leaves_no_script(spark):
    lines = jp_lines(spark, SF001)
    res = batch_translate(lines, ScriptedFaultTranslator(), SMALL, work_dir(spark), "prop_limits")
    ch = res.chunks.select("items", F.aggregate(
        F.transform("items", lambda s: ((F.length(s) * 0.4).cast("int") + 15)), F.lit(0), lambda a, b: a + b)
        .alias("approx")).collect()
    for r in ch:
        assert len(r["items"]) <= 8
    sizes = res.unique_units.join(res.assignments, ["scope", "ord"]).groupBy("scope", "chunk_id").agg(
        F.sum("est").alias("b"), F.count(F.lit(1)).alias("n"))
    assert sizes.filter((F.col("n") > 1) & (F.col("b") > 300)).count() == 0
    assert res.translations.filter(has_script("text_en")).count() == 0
    # every unique string got exactly one translation
    assert res.translations.count() == res.unique_units.count()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_independent_of_shuffle_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        lines = jp_lines(spark, SF001)
        res = batch_translate(lines, MockTranslator(), SMALL.with_(call_partitions=parts), work_dir(spark),
                              f"prop_p{parts}")
        got = sorted((r.scope, r.text, r.text_en) for r in res.translations.collect())
        asg = sorted(tuple(r) for r in res.assignments.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    key = "prop_shuffle_ref"
    if not hasattr(spark, "_lexi_ref"):
        spark._lexi_ref = (got, asg)
    assert (got, asg) == spark._lexi_ref
