"""Scalar functions (F1 F2 C1-C14) on inline rows, values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.functions.cost import est_input_tokens, py_cost_usd
from lexiflow.functions.prompt import parse_array, prompt_body, py_prompt_body
from lexiflow.functions.script import (est_tokens, has_script, is_nonblank, py_est_tokens, py_script_chars,
                                       script_char_count)
from lexiflow.functions.text import (clean_name, color_hex, font_size_out, name_stem, name_suffix, py_clean_name,
                                     py_sanitize_tab_name, sanitize_tab_name, xml_escape, xml_unescape)


def _one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first().y


def test_worked_estimate():
    # 10 source-script + 5 other characters -> int((7.0 + 5) * 0.4) + 15 = 19
    assert py_est_tokens("日" * 10 + "abcde") == 19


def test_est_tokens_column_equals_python(spark):
    samples = ["", "a", "日本", "日本語 text 123", "　", "x" * 333 + "語" * 77]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r.e for r in df.select(est_tokens("x").alias("e")).collect()]
    assert got == [py_est_tokens(s) for s in samples]
    got = [r.c for r in df.select(script_char_count("x").alias("c")).collect()]
    assert got == [py_script_chars(s) for s in samples]


def test_cost_uses_double_arithmetic(spark):
    # int(45 * 1.4) is 62 in IEEE double, not 63
    assert _one(spark, est_input_tokens(F.col("x"), F.lit(0)), 45, "int") == 62
    assert py_cost_usd(1_000_000, 1_000_000) == 18.0


@pytest.mark.parametrize("s,script,nonblank", [
    ("abc", False, True), ("日本", True, True), ("　　", True, False), ("\x1c\x1f", False, False),
    (" \t\n", False, False), ("ｱ", False, True), ("ー", True, True), (" ", False, False)])
def test_script_and_blank(spark, s, script, nonblank):
    assert _one(spark, has_script("x"), s) is script
    assert _one(spark, is_nonblank("x"), s) is nonblank
    assert bool(s.strip()) is nonblank


def test_xml_escape_order(spark):
    assert _one(spark, xml_unescape("x"), "&amp;lt; &#39; &quot;") == "< &#39; \""
    assert _one(spark, xml_escape("x"), "a&b<c>\"") == "a&amp;b&lt;c&gt;\""


@pytest.mark.parametrize("name,stem,suffix", [
    (".gitignore", ".gitignore", ""), ("a.tar.gz", "a.tar", ".gz"), ("報告書.PDF", "報告書", ".PDF"),
    ("noext", "noext", ""), ("_x.txt", "_x", ".txt"), ("a.", "a.", "")])
def test_path_parts(spark, name, stem, suffix):
    assert _one(spark, name_stem("x"), name) == stem
    assert _one(spark, name_suffix("x"), name) == suffix


def test_names_and_tabs(spark):
    assert py_clean_name(' "Report" ') == "Report"
    assert _one(spark, clean_name("x"), " 'Report'\n") == "Report"
    raw = "Sales: Q1 [draft]/v2?*\\ and a long tail  x"
    assert py_sanitize_tab_name(raw) == "Sales- Q1 -draft--v2--- and a l"
    assert _one(spark, sanitize_tab_name("x"), raw) == py_sanitize_tab_name(raw)
    assert _one(spark, sanitize_tab_name("x"), "  name padded to be cut at a space x") == \
        py_sanitize_tab_name("  name padded to be cut at a space x")


def test_style(spark):
    assert _one(spark, color_hex("x"), 0xFF0010, "int") == "#ff0010"
    assert _one(spark, font_size_out("x"), 6.5, "double") == 6.0
    assert _one(spark, font_size_out("x"), 11.0, "double") == 10.0


def test_prompt_body(spark):
    items = ["採用資料", "報告書", "Unit Price"]
    got = spark.createDataFrame([(items,)], "x array<string>").select(prompt_body("x").alias("b")).first().b
    assert got == py_prompt_body(items) == "[1] 採用資料\n[2] 報告書\n[3] Unit Price"


@pytest.mark.parametrize("raw,expected", [
    ('["a", "b"]', ["a", "b"]),
    ('```json\n["a"]\n```', ["a"]),
    ('Here you go: ["a", "b"] hope it helps', ["a", "b"]),
    ("[]", []),
    ('[1, "a"]', None),
    ('[["a"]]', None),
    ('["a", null]', None),
    ("not json at all", None),
    ('["a", ""]', ["a", ""]),
    ('["a"] and ["b"]', None),
    ('note [1] ["a"]', None),
    (None, None),
])
def test_parse_array(raw, expected):
    assert parse_array(raw) == expected
