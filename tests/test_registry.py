"""A registered format is listed, read, translated, rebuilt and estimated like a built-in one."""

import pytest
from pyspark.sql import functions as F

from lexiflow.config import DEFAULT
from lexiflow.models import MockTranslator, mock_translate
from lexiflow.operators import routing
from lexiflow.operators.routing import TextHandler, register_handler, unregister_handler
from lexiflow.plans.folder import estimate_folder, translate_folder

S = DEFAULT.with_(throttle_waits=(0.0,))


def ini_units(files):
    """Values of ``key = value`` lines are units, other lines stay; a line of ``!`` is a parse error."""
    line = files.select("path", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    m = r"^([^=]*=\s*)(.*)$"
    return line.select("path", "ord", "line", F.regexp_extract("line", m, 1).alias("head"),
                       F.when(F.col("line").rlike(m), F.regexp_extract("line", m, 2)).alias("text"),
                       F.when(F.col("line") == "!", F.lit("bad line")).alias("error"))


def ini_rebuild(units):
    row = F.coalesce(F.concat("head", "text_out"), F.col("line"))
    return units.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


@pytest.fixture()
def ini():
    register_handler(".INI", TextHandler("ini", ini_units, ini_rebuild))
    yield
    unregister_handler(".ini")


def test_a_registered_format_comes_back_translated(spark, tmp_path, ini):
    src, dst = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "設定.ini").write_text("# 日本 comment\ntitle = 日本\nname=plain\nsame = 日本\n", encoding="utf-8")
    (src / "bad.ini").write_text("a = 語\n!\n", encoding="utf-8")
    (src / "empty.Ini").write_text("", encoding="utf-8")
    (src / "x.txt").write_text("日本\n", encoding="utf-8")
    assert estimate_folder(spark, str(src), S).totals.first().total_chars == 2 + 2 + 1 + 2
    res = translate_folder(spark, str(src), str(dst), MockTranslator(), S)
    m = mock_translate
    assert (dst / f"{m('設定')}.ini").read_text("utf-8") == f"# 日本 comment\ntitle = {m('日本')}\nname=plain\nsame = {m('日本')}\n"
    assert (dst / "bad.ini").read_text("utf-8") == "a = 語\n!\n" and (dst / "empty.Ini").read_bytes() == b""
    assert [(r.path, r.stage, r.error) for r in res.errors.collect()] == [("bad.ini", "parse", "bad line")]
    scopes = {r.scope: r.context for r in res.corpus.batch.unique_units.collect()}
    assert set(scopes) == {"設定.ini", "x.txt"} and all("folder 'src'" in c for c in scopes.values())


def test_registry_refuses_nonsense_and_forgets(spark):
    with pytest.raises(ValueError):
        register_handler(".x", "nowhere")
    with pytest.raises(ValueError):
        register_handler("x", "lines")
    with pytest.raises(ValueError):
        register_handler(".x", TextHandler("csv", ini_units, ini_rebuild))
    register_handler(".Log", "lines")
    df = spark.createDataFrame([(".LOG",), (".ini",)], "ext string")
    assert [r.handler for r in routing.route(df).collect()] == ["lines", "copy"]
    unregister_handler(".log")
    assert [r.handler for r in routing.route(df).collect()] == ["copy", "copy"]
