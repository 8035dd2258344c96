"""Packaged formats: spreadsheets (xlsx) and word documents (docx).

Parts are rows (S6).  Units from every part kind of every package go to
*one* ``batch_translate`` whose scope is the part (string table, each sheet,
each drawing, the workbook's tab list, the document body), as the original
translates part by part.  Rewrites are native where the markup allows
(R3/R4/R6 node replacement, R5/R7 folds, R8 regex rules) and per-part Python
for K4 paragraphs, bounded by one part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions.text import py_xml_escape, py_xml_unescape, xml_unescape
from ..operators.batch import BatchResult, batch_translate
from ..operators.dedup import union_units
from ..operators.markup import (drop_calc_chain_type, fonts_drawing, fonts_string_table, fonts_styles,
                                node_replacements, part_kind, patch_docprops, rename_tabs,
                                rewrite_nodes, rewrite_string_table, sheet_ref_patch, unique_tab_names)
from ..session import WorkDir, work_dir
from ..sources.markup import (CACHED_STR, DRAWING_NODE, INLINE_STR, decoded, drawing_parts, sheet_strings,
                              string_table_entries, tab_names, text_nodes)

# ---------------------------------------------------------------------------
# Fixed values (word document markup): paragraph <w:p ...>...</w:p>,
# run text <w:t ...>text</w:t>, body part word/document.xml.
# ---------------------------------------------------------------------------
DOCX_BODY = "word/document.xml"
W_PARA = r"(?s)<w:p[ >].*?</w:p>"
W_T = r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>"
W_TBL_OPEN, W_TBL_CLOSE = r"<w:tbl>", r"</w:tbl>"
# what a run's text is made of: text, tab (not a tab stop's definition, which has attributes), break
W_PIECE = W_T + r"|<w:tab/>|<w:(?:br|cr)(?:\s[^>]*)?/>"


@dataclass
class PackageResult:
    parts: DataFrame      # path, ord, part, data (rewritten; dropped members removed)
    batch: BatchResult
    errors: DataFrame     # path, stage, error


SCOPE_SEP = "\u0001"


def _scope(*cols) -> F.Column:
    return F.concat_ws(SCOPE_SEP, *cols)


def _map_per_scope(translations: DataFrame) -> DataFrame:
    """Per scope, the small map the per-part Python rewrites need."""
    return (translations.groupBy("scope")
            .agg(F.collect_list(F.struct("text", "text_en")).alias("tmap")))


#: rewritten parts that a worker holds before it hands them on
PARTS_AT_ONCE = 64


def rewritten_batches(batches, fn):
    """Batches of ``path, part, xml, tmap`` to ``path, part, xml``: a part's map becomes Python objects when its turn comes, and
    ``PARTS_AT_ONCE`` results are held at most."""
    for b in batches:
        for at in range(0, b.num_rows, PARTS_AT_ONCE):
            rows = b.slice(at, PARTS_AT_ONCE)
            new = []
            for xml, tmap in zip(rows.column("xml"), rows.column("tmap")):
                m = {r["text"]: r["text_en"] for r in tmap.as_py() or ()}
                new.append(fn(xml.as_py(), m) if m else xml.as_py())
            yield pa.RecordBatch.from_arrays([rows.column("path"), rows.column("part"), pa.array(new, pa.string())], ["path", "part", "xml"])


def _apply_python(parts: DataFrame, maps: DataFrame, fn) -> DataFrame:
    """Run ``fn(xml, dict)`` on each part row that has a map; others untouched."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.StringType()),
                           T.StructField("xml", T.StringType())])

    def run(batches):
        return rewritten_batches(batches, fn)

    j = parts.select("path", "part", "xml", _scope("path", "part").alias("scope")).join(maps, "scope", "left")
    return j.select("path", "part", "xml", "tmap").mapInArrow(run, schema)


_WP = re.compile(W_PARA)
_PIECE = re.compile(W_PIECE)


def _piece_text(m) -> str:
    if m.group(1) is not None:
        return py_xml_unescape(m.group(1))
    return "\t" if m.group(0).startswith("<w:tab") else "\n"


def rewrite_paragraph(p: str, tmap: dict[str, str]) -> str:
    """K4: the first text node of a translated paragraph takes the whole translation; the other
    texts are emptied and the tabs and breaks among them go, as the translation has its own."""
    pieces = list(_PIECE.finditer(p))
    new = tmap.get("".join(map(_piece_text, pieces)))
    texts = [m for m in pieces if m.group(1) is not None]
    if new is None or not texts:
        return p
    put = {m.start(): p[m.start():m.start(1)] + (py_xml_escape(new) if m is texts[0] else "") + "</w:t>" for m in texts}
    return _PIECE.sub(lambda m: put.get(m.start(), ""), p)


def py_rewrite_paragraphs(xml: str, tmap: dict[str, str]) -> str:
    """K4 over a body: paragraphs without a translation stay as they are."""
    return _WP.sub(lambda m: rewrite_paragraph(m.group(0), tmap), xml)


def prepare_parts(packages: DataFrame, parts: DataFrame, work: WorkDir) -> tuple[DataFrame, DataFrame]:
    """Part rows with ``kind`` (R9 + drawing discovery) and decoded ``xml``; unreadable packages apart."""
    bad = parts.filter(F.col("part").isNull()).select("path", F.lit("read").alias("stage"), "error")
    p = (parts.filter(F.col("part").isNotNull())
         .join(packages.select("path", "ext", "context"), "path")
         .withColumn("kind", part_kind("part")))
    drawings = drawing_parts(p.select("path", "part", "data")).withColumn("is_drawing", F.lit(True))
    p = (p.join(drawings, ["path", "part"], "left")
         .withColumn("kind", F.when(F.col("ext") == ".docx",
                                    F.when(F.col("part") == DOCX_BODY, "docx_body").otherwise("other"))
                     .when((F.col("kind") == "other") & F.col("is_drawing"), "drawing").otherwise(F.col("kind")))
         .drop("is_drawing"))
    xml_kinds = ["content_types", "string_table", "workbook", "styles", "sheet", "docprops", "drawing", "docx_body"]
    p = work.materialize(p.withColumn("xml", F.when(F.col("kind").isin(*xml_kinds), decoded("data"))), "packages/parts")
    # a part that is not valid UTF-8 makes its package an error, not the job
    broken = (p.filter(F.col("kind").isin(*xml_kinds) & F.col("xml").isNull() & F.col("data").isNotNull())
              .select("path", F.lit("parse").alias("stage"), F.concat(F.col("part"), F.lit(": not valid UTF-8")).alias("error")))
    ok = p.join(broken.select("path").distinct(), "path", "left_anti")
    return ok, bad.unionByName(broken)


@dataclass
class PackageUnits:
    units: DataFrame   # scope, ord, text, context
    tabs: DataFrame    # path, context, i, raw, name
    sheet: DataFrame   # sheet strings (S10)
    drawing: DataFrame # drawing nodes (S11)


def package_units(p: DataFrame, settings: Settings = DEFAULT) -> PackageUnits:
    """Units of every part kind; scope = part (or the workbook's tab list)."""
    def of(kind):
        return p.filter(F.col("kind") == kind)

    ctx = F.col("context")
    tabs = tab_names(of("workbook"), "xml", ["path", "context"])
    u_tabs = tabs.select(_scope("path", F.lit("tabs")).alias("scope"), F.col("i").cast("bigint").alias("ord"),
                         F.col("name").alias("text"), ctx)
    sst = string_table_entries(of("string_table"), "xml", ["path", "part", "context"], settings.strip_phonetic)
    u_sst = sst.select(_scope("path", "part").alias("scope"), F.col("i").cast("bigint").alias("ord"), "text", ctx)
    ss = sheet_strings(of("sheet"), "xml", ["path", "part", "context"])
    u_ss = union_units(
        ss.filter(F.col("kind") == "inline").select(_scope("path", "part").alias("scope"),
                                                    F.col("i").cast("bigint").alias("ord"), "text", ctx),
        ss.filter(F.col("kind") == "cached").select(_scope("path", "part").alias("scope"),
                                                    F.col("i").cast("bigint").alias("ord"), "text", ctx))
    dn = text_nodes(of("drawing"), "xml", DRAWING_NODE, ["path", "part", "context"])
    u_dn = dn.select(_scope("path", "part").alias("scope"), F.col("i").cast("bigint").alias("ord"), "text", ctx)
    paras = docx_paragraphs(of("docx_body"), ["path", "part", "context"])
    u_dx = paras.select(_scope("path", "part").alias("scope"), F.col("i").cast("bigint").alias("ord"), "text", ctx)
    units = u_tabs.unionByName(u_sst).unionByName(u_ss).unionByName(u_dn).unionByName(u_dx)
    return PackageUnits(units, tabs, ss, dn)


def docx_paragraphs(bodies: DataFrame, keep: list[str]) -> DataFrame:
    """Body paragraphs first, then the paragraphs inside tables, each in
    document order; ``i`` numbers them.  A paragraph's text is its run texts joined, unescaped,
    a tab element as a tab and a break as a newline."""
    xml = F.col("xml")
    paras = F.regexp_extract_all(xml, F.lit(W_PARA), 0)
    # how many tables are open where each paragraph starts: opened minus closed in the text before it, summed up
    before = F.slice(F.split(xml, W_PARA, -1), F.lit(1), F.size(paras))
    depth = F.aggregate(before, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(
        F.element_at(acc, -1) + F.size(F.regexp_extract_all(t, F.lit(W_TBL_OPEN), 0)) - F.size(F.regexp_extract_all(t, F.lit(W_TBL_CLOSE), 0)))))
    zipped = F.arrays_zip(paras.alias("p"), F.slice(depth, F.lit(2), F.size(paras)).alias("d"))
    ordered = F.concat(F.filter(zipped, lambda z: z["d"] <= 0), F.filter(zipped, lambda z: z["d"] > 0))
    ex = bodies.select(*keep, F.posexplode(ordered).alias("i", "z"))
    return ex.select(*keep, F.col("i").cast("bigint").alias("i"), paragraph_text(F.col("z.p")).alias("text"))


def paragraph_text(p) -> F.Column:
    """The run texts of a ``<w:p>``: text, tab and break elements in order."""
    return F.array_join(F.transform(F.regexp_extract_all(p, F.lit(W_PIECE), 0), lambda x: F.when(
        x.startswith("<w:t>") | x.startswith("<w:t "), xml_unescape(F.regexp_extract(x, W_T, 1))).when(
        x.startswith("<w:tab"), F.lit("\t")).otherwise(F.lit("\n"))), "")


def scope_path(scope) -> F.Column:
    """The package path of a part scope."""
    return F.split(scope, SCOPE_SEP).getItem(0)


def translate_packages(packages: DataFrame, parts: DataFrame, translator, settings: Settings = DEFAULT,
                       work: WorkDir | None = None) -> PackageResult:
    """``packages``: ``path, ext, context``; ``parts``: S6 output for those paths."""
    work = work or work_dir(parts.sparkSession)
    p, bad = prepare_parts(packages, parts, work)

    def of(kind):
        return p.filter(F.col("kind") == kind)

    pu = package_units(p, settings)
    units, tabs, ss, dn = pu.units, pu.tabs, pu.sheet, pu.drawing
    batch = batch_translate(units, translator, settings, work, "packages/content")
    tr = batch.translations

    # --- tab map per workbook (W4 then C11) ----------------------------------------
    tab_tr = (tabs.withColumn("scope", _scope("path", F.lit("tabs")))
              .join(tr.select("scope", F.col("text").alias("name"), F.col("text_en").alias("name_en")),
                    ["scope", "name"], "left").drop("scope"))
    uniq = unique_tab_names(tab_tr.select("path", F.col("i").alias("pos"), "name", "name_en"), ["path"], settings)
    tab_map = (uniq.filter(F.col("tab_en").isNotNull())
               .groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("jp"),
                                                                         F.col("tab_en").alias("en")))).alias("tab_map")))

    # --- rewrites --------------------------------------------------------------------
    key = ["path", "part"]
    scope_col = _scope("path", "part")
    sheets = of("sheet").select("path", "part", "xml")
    for pat, nodes in ((INLINE_STR, ss.filter(F.col("kind") == "inline")),
                       (CACHED_STR, ss.filter(F.col("kind") == "cached"))):
        new = node_replacements(nodes.select("path", "part", "i", "raw", "text"), key, tr, scope_col)
        sheets = rewrite_nodes(sheets, key, "xml", pat, new)
    sheets = (sheets.join(tab_map, "path", "left")
              .withColumn("xml", F.when(F.col("tab_map").isNotNull(), sheet_ref_patch("xml", "tab_map"))
                          .otherwise(F.col("xml"))).drop("tab_map"))
    dnew = node_replacements(dn.select("path", "part", "i", "raw", "text"), key, tr, scope_col)
    drawings_x = rewrite_nodes(of("drawing").select("path", "part", "xml"), key, "xml", DRAWING_NODE, dnew) \
        .withColumn("xml", fonts_drawing("xml"))
    maps = _map_per_scope(tr)
    sst_x = (rewrite_string_table(of("string_table").select("path", "part", "xml"), key, "xml", tr, scope_col)
             .withColumn("xml", fonts_string_table("xml")))
    body_x = _apply_python(of("docx_body"), maps, py_rewrite_paragraphs)
    wb_x = (of("workbook").select("path", "part", "xml").join(tab_map, "path", "left")
            .withColumn("xml", F.when(F.col("tab_map").isNotNull(), rename_tabs("xml", "tab_map"))
                        .otherwise(F.col("xml"))).drop("tab_map"))
    app_x = (of("docprops").select("path", "part", "xml").join(tab_map, "path", "left")
             .withColumn("xml", F.when(F.col("tab_map").isNotNull(), patch_docprops("xml", "tab_map"))
                         .otherwise(F.col("xml"))).drop("tab_map"))
    styles_x = of("styles").select("path", "part", fonts_styles("xml").alias("xml"))
    ct_x = of("content_types").select("path", "part", drop_calc_chain_type("xml").alias("xml"))
    rewritten = (sheets.unionByName(drawings_x).unionByName(sst_x).unionByName(body_x).unionByName(wb_x)
                 .unionByName(app_x).unionByName(styles_x).unionByName(ct_x))

    out = (p.filter(F.col("kind") != "drop").select("path", "ord", "part", "data", "xml", "date_time", "compress_type")
           .join(rewritten.select("path", "part", F.col("xml").alias("new_xml")), key, "left")
           .select("path", "ord", "part",
                   F.when(F.col("new_xml").isNotNull(), F.encode("new_xml", "UTF-8")).otherwise(F.col("data"))
                   .alias("data"),
                   (F.col("new_xml").isNotNull() & (F.col("new_xml") != F.col("xml"))).alias("changed"),
                   "date_time", "compress_type"))
    errors = bad.unionByName(batch.errors.select(scope_path("scope").alias("path"), "stage", "error"))
    return PackageResult(out, batch, errors)
