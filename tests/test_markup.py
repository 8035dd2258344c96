"""Markup rules: R4 string table, W4 tab names, R5 patch, S13 discovery."""

from pyspark.sql import functions as F

from lexiflow.operators.markup import free_tab_names, rewrite_string_table, sheet_ref_patch
from lexiflow.sources.markup import drawing_parts


def test_string_table_rewrite(spark):
    xml = ('<sst><si><t xml:space="preserve">日本</t><rPh><t>に</t></rPh></si>'
           '<si><r><t>資</t></r><r><t>料</t></r><rPh><t>し</t></rPh></si><si><t>same</t></si><si/><si><phoneticPr/></si></sst>')
    parts = spark.createDataFrame([(1, xml), (2, "<sst/>")], "id int, xml string")
    tr = spark.createDataFrame([("1", "日本", "Japan"), ("1", "資料し", "Docs & more $1")], "scope string, text string, text_en string")
    out = {r.id: r.xml for r in rewrite_string_table(parts, ["id"], "xml", tr, F.col("id").cast("string")).collect()}
    assert out[2] == "<sst/>"
    assert '<si><t xml:space="preserve">Japan</t></si>' in out[1]
    # rich: whole translation in the first <t>, the others emptied, ruby removed (Q2)
    assert "<si><r><t>Docs &amp; more $1</t></r><r><t></t></r></si>" in out[1]
    assert out[1].endswith("<si><t>same</t></si><si/><si><phoneticPr/></si></sst>")


def tabs_of(names, tmap):
    return dict(zip(names, free_tab_names([(n, tmap.get(n)) for n in names])))


def test_unique_tabs():
    out = tabs_of(["日本", "本", "Sheet", "語"], {"日本": "Sheet", "本": "Sheet", "語": "x" * 40})
    assert out["日本"] == "Sheet_2" and out["本"] == "Sheet_3"
    assert out["語"] == "x" * 31 and out["Sheet"] is None
    # an existing "X_2" forces "X_3"
    assert tabs_of(["日", "X_2"], {"日": "X"})["日"] == "X"
    assert tabs_of(["日", "本", "X_2"], {"日": "X", "本": "x"})["本"] == "x_3"
    assert tabs_of(["X", "日"], {"日": "x"})["日"] == "x_2"


def test_unique_tabs_property():
    import random
    rnd = random.Random(1)
    for _ in range(200):
        names = [f"日{i}" for i in range(rnd.randint(1, 12))] + ["Keep", "Keep_2"]
        out = tabs_of(names, {n: rnd.choice(["Keep", "A", "a", "B:" + "y" * 40, "  C  "]) for n in names if n.startswith("日")})
        final = [(out[n] or n).lower() for n in names]
        assert len(set(final)) == len(final)
        assert all(len(v) <= 31 and not set(v) & set("\\/?*[]:") for v in out.values() if v)


def test_nodes_cost_their_length(spark):
    """Twice the nodes take about twice the time, not four times."""
    import time
    from lexiflow.operators.markup import rewrite_nodes
    from lexiflow.sources.markup import DRAWING_NODE
    took = {}
    for n in (1_000, 20_000):
        parts = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(
            F.lit("<a:t>"), i.cast("string"), F.lit("</a:t>"))), "").alias("xml"))
        news = spark.range(n).select(F.lit(0).cast("long").alias("id0"), F.col("id").cast("int").alias("i"), F.lit("x").alias("new_raw"))
        news = news.withColumnRenamed("id0", "id")
        t0 = time.time()
        got = rewrite_nodes(parts, ["id"], "xml", DRAWING_NODE, news).first().xml
        took[n] = time.time() - t0
        assert got == "<a:t>x</a:t>" * n
    assert took[20_000] < 10 + 20 * took[1_000]


def test_sheet_ref_patch(spark):
    df = spark.createDataFrame([("採用!A1+'採用'!B2+採用表!C3",
                                 [("採用", "Hire", 0), ("採用表", "Hire table", 1)])],
                               "xml string, m array<struct<jp:string,en:string,pos:int>>")
    got = df.select(sheet_ref_patch("xml", "m").alias("x")).first().x
    assert got == "'Hire'!A1+'Hire'!B2+'Hire table'!C3"


def test_drawing_discovery(spark):
    rel = ('<Relationships><Relationship Type="http://schemas.openxmlformats.org/officeDocument/2006/'
           'relationships/drawing" Target="../a/../b/../c/../d/../e/../f/.././media//d1.xml"/></Relationships>').encode()
    rows = [("a.xlsx", "xl/worksheets/_rels/sheet1.xml.rels", rel), ("a.xlsx", "xl/media/d1.xml", b"<x/>"),
            ("a.xlsx", "xl/drawings/drawing9.xml", b"<x/>"),
            ("a.xlsx", "xl/worksheets/_rels/bad.xml.rels", b"\xff\xfe<"),
            ("b.xlsx", "xl/drawings/drawing1.xml", b"<x/>"), ("b.xlsx", "xl/drawings/_rels/x.xml.rels", b"")]
    df = spark.createDataFrame(rows, "path string, part string, data binary")
    got = sorted(tuple(r) for r in drawing_parts(df).collect())
    assert got == [("a.xlsx", "xl/media/d1.xml"), ("b.xlsx", "xl/drawings/drawing1.xml")]


def test_replacements_evaluate_the_nodes_once(spark):
    from lexiflow.operators.markup import node_replacements
    nodes = spark.range(0, 6).selectExpr("'k' || (id div 2) as k", "int(id % 2) as i", "'r' || id as raw", "'t' || id as text")
    tr = spark.createDataFrame([("k0", "t1", "a<b"), ("k2", "t4", "c"), ("k1", "t0", "other scope")], "scope string, text string, text_en string")
    got = node_replacements(nodes, ["k"], tr, nodes["k"])
    assert sorted(map(tuple, got.collect())) == [("k0", 0, "t0"), ("k0", 1, "a&lt;b"), ("k2", 0, "c"), ("k2", 1, "t5")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 1
