"""Markup text sources (S9-S13): XML parts as rows, text nodes exploded natively.

Every extractor is ``regexp_extract_all`` + ``posexplode`` on a part row, so
it stays in codegen and never needs a parser object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_unescape

# ---------------------------------------------------------------------------
# The markup patterns of the spreadsheet / drawing parts.
#   drawing text node:   <x:t ...>text</x:t> (any prefix)
#   string-table entry:  <si>...</si>; a rich entry has <r ...>...</r> runs
#   string text:         <t ...>text</t>
#   inline cell string:  <is><t>text</t></is>
#   cached formula text: <c ... t="str" ...>[<f ...>..</f>]<v>text</v>
#   tab name:            <sheet ... name="...">
#   drawing relation type:
#     http://schemas.openxmlformats.org/officeDocument/2006/relationships/drawing
# ---------------------------------------------------------------------------
DRAWING_NODE = r"(<\w+:t(?:\s[^>]*)?>)([^<]*)(</\w+:t>)"
PARAGRAPH_NODE = r"(<p(?:\s[^>]*)?>)([^<]*)(</p>)"
SI_ENTRY = r"(?s)<si>(.*?)</si>"
SI_NODE = r"(<si>)([\s\S]*?)(</si>)"
T_NODE = r"<t(?:\s[^>]*)?>([^<]*)</t>"
RICH_RUN = r"(?s)<r\b[^>]*>.*?</r>"
INLINE_STR = r"(?s)(<is><t>)(.*?)(</t></is>)"
# Q9: a self-closing <f .../> (shared formula) is accepted too
CACHED_STR = r'(<c [^>]*t="str"[^>]*>(?:<f[^>]*>[^<]*</f>|<f[^>]*/>)?<v>)([^<]+)(</v>)'
SHEET_NAME = r'(<sheet\b[^>]*\bname=")([^"]+)(")'
DRAWING_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/drawing"


def text_nodes(parts: DataFrame, xml_col: str, pattern: str = DRAWING_NODE, keep: list[str] | None = None,
               group: int = 2) -> DataFrame:
    """``keep..., i (0-based), raw, text`` (text = unescaped raw)."""
    keep = keep or []
    ex = parts.select(*keep, F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(pattern), group))
                      .alias("i", "raw"))
    return ex.select(*keep, "i", "raw", xml_unescape("raw").alias("text"))


def string_table_entries(parts: DataFrame, xml_col: str, keep: list[str] | None = None,
                         strip_phonetic: bool = False, keep_all: bool = False) -> DataFrame:
    """Each ``<si>``; rich = all ``<t>`` joined (ruby included, Q3), plain = first ``<t>``.

    Output ``keep..., i, is_rich, raw, text``; entries without any ``<t>`` are dropped, or kept
    with null texts (``keep_all``, which also adds ``inner``).
    """
    keep = keep or []
    ex = parts.select(*keep, F.posexplode(F.regexp_extract_all(F.col(xml_col), F.lit(SI_ENTRY), 1))
                      .alias("i", "inner"))
    inner = F.col("inner")
    if strip_phonetic:
        inner = F.regexp_replace(inner, r"(?s)<rPh\b[^>]*>.*?</rPh>", "")
    rich = F.col("inner").rlike(RICH_RUN)
    raw = F.when(rich, F.array_join(F.regexp_extract_all(inner, F.lit(T_NODE), 1), "")).otherwise(
        F.regexp_extract(inner, T_NODE, 1))
    has_t = F.col("inner").rlike(T_NODE)
    if keep_all:
        return (ex.select(*keep, "i", "inner", rich.alias("is_rich"), F.when(has_t, raw).alias("raw"))
                .withColumn("text", xml_unescape("raw")))
    return (ex.filter(has_t)
            .select(*keep, "i", rich.alias("is_rich"), raw.alias("raw"))
            .withColumn("text", xml_unescape("raw")))


def sheet_strings(parts: DataFrame, xml_col: str, keep: list[str] | None = None) -> DataFrame:
    """Inline strings first, then cached formula strings, in document order.

    Q8: the text is unescaped before it is used as a key.
    Output ``keep..., kind ('inline'|'cached'), i, raw, text``.
    """
    keep = keep or []
    a = text_nodes(parts, xml_col, INLINE_STR, keep).withColumn("kind", F.lit("inline"))
    b = text_nodes(parts, xml_col, CACHED_STR, keep).withColumn("kind", F.lit("cached"))
    return a.unionByName(b)


def tab_names(parts: DataFrame, xml_col: str, keep: list[str] | None = None) -> DataFrame:
    """``<sheet name="">`` attributes, unescaped, in order."""
    return text_nodes(parts, xml_col, SHEET_NAME, keep).withColumnRenamed("text", "name")


def resolve_path(steps) -> F.Column:
    """A path's steps without ``.``, empty steps and ``x/..`` pairs: one fold, however many there are."""
    empty = F.array().cast("array<string>")

    def go(done, step):
        return (F.when((step == "") | (step == "."), done)
                .when(step == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
                .otherwise(F.concat(done, F.array(step))))
    return F.aggregate(steps, empty, go)


def decoded(data) -> F.Column:
    """Bytes as UTF-8 text, null where they are not valid UTF-8 (``decode`` would end the job)."""
    c = F.col(data) if isinstance(data, str) else data
    return F.try_validate_utf8(c.cast("string"))


def drawing_parts(parts: DataFrame) -> DataFrame:
    """Drawing parts of each package.

    Targets of drawing relations in ``xl/worksheets/_rels/*.rels`` resolved
    against ``xl/worksheets/``; a package without any falls back to
    ``xl/drawings/*.xml``.  ``parts`` has ``path, part, data``; returns the
    ``path, part`` pairs (left-semi against existing parts, J5).
    """
    rels = parts.filter(F.col("part").startswith("xl/worksheets/_rels/") & F.col("part").endswith(".rels"))
    pat = 'Type="' + DRAWING_REL.replace(".", r"\.") + r'"[^>]*Target="([^"]+)"'
    targets = rels.select("path", F.explode(F.regexp_extract_all(decoded("data"), F.lit(pat), 1))
                          .alias("target"))
    # a target is relative to xl/worksheets/, or to the package when it starts with "/"
    steps = F.split(F.when(F.col("target").startswith("/"), F.col("target"))
                    .otherwise(F.concat(F.lit("xl/worksheets/"), F.col("target"))), "/")
    found_all = targets.select("path", F.array_join(resolve_path(steps), "/").alias("part")).distinct()
    found = found_all.join(parts.select("path", "part"), ["path", "part"], "left_semi")
    # the fallback applies only to packages whose rels name no drawing at all
    fallback = (parts.filter(F.col("part").startswith("xl/drawings/") & F.col("part").endswith(".xml"))
                .select("path", "part").join(found_all.select("path").distinct(), "path", "left_anti"))
    return found.unionByName(fallback)
