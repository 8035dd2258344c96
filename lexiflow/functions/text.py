"""String helpers as native Column expressions.

Every function takes and returns a Column so it composes with ``select`` /
``withColumn`` and stays in codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TAB_NAME_BAD_CHARS, TAB_NAME_MAX
from .script import PY_WHITESPACE_CLASS

# ---------------------------------------------------------------------------
# Fixed values (formats that must match the original output byte for byte):
#   context of a folder name:    "subfolder of <parent folder name>"
#   context of a file name:      "file in folder: <folder context>"
#   context of file content:     "Document '<file name>' in folder '<folder context>'"
#   context of one layout page:  "<file context> (page <n>)"       (n from 1)
#   folder context:              translated folder names joined by " > ",
#                                or the root folder's name at the top level
#   styled paragraph:            <p style="font-family: sans-serif; font-size: <size>pt;
#                                color: <#rrggbb>; margin: 0; padding: 0;"><text></p>
# ---------------------------------------------------------------------------
FOLDER_SEP = " > "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- C3 / C4 -------------------------------------------------------------

def xml_escape(c) -> Column:
    """``&`` then ``<`` then ``>``; quotes are left alone."""
    x = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit(">"), F.lit("&gt;"))


def xml_unescape(c) -> Column:
    """C4: ``&amp;`` first, so ``&amp;lt;`` becomes ``<``; numeric entities stay."""
    x = _col(c)
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def py_xml_escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def py_xml_unescape(s: str) -> str:
    for ent, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        s = s.replace(ent, ch)
    return s


# --- C5 path parts ---------------------------------------------------------

_SUFFIX_RE = r"^(.+)(\.[^.]+)$"


def name_stem(c) -> Column:
    """Name without its last suffix; ``.gitignore`` and ``noext`` are whole stems."""
    m = _col(c).rlike(_SUFFIX_RE)
    return F.when(m, F.regexp_extract(_col(c), _SUFFIX_RE, 1)).otherwise(_col(c))


def name_suffix(c) -> Column:
    """Last suffix with its dot and its case (``.PDF``), or ``''``."""
    return F.regexp_extract(_col(c), _SUFFIX_RE, 2)


def name_ext(c) -> Column:
    """Lower-cased suffix, the routing key."""
    return F.lower(name_suffix(c))


# --- C6 line endings ------------------------------------------------------

def line_body(c) -> Column:
    """The line without trailing CR/LF characters."""
    return F.regexp_replace(_col(c), r"[\r\n]+$", "")


def line_ending(c) -> Column:
    """The trailing CR/LF characters of the line (possibly empty)."""
    return F.regexp_extract(_col(c), r"[\r\n]*$", 0)


# --- C7 context strings -------------------------------------------------

def folder_name_context(parent_name) -> Column:
    return F.concat(F.lit("subfolder of "), _col(parent_name))


def file_name_context(folder_context) -> Column:
    return F.concat(F.lit("file in folder: "), _col(folder_context))


def document_context(file_name, folder_context) -> Column:
    return F.concat(F.lit("Document '"), _col(file_name), F.lit("' in folder '"),
                    _col(folder_context), F.lit("'"))


def page_context(context, page0) -> Column:
    """``page0`` is 0-based; the text shows it from 1."""
    return F.concat(_col(context), F.lit(" (page "), (_col(page0) + 1).cast("string"), F.lit(")"))


def folder_context(translated_parts, root_name) -> Column:
    """Translated folder names joined by `` > ``; the root's name at the top level."""
    parts = _col(translated_parts)
    return F.when(F.size(parts) > 0, F.array_join(parts, FOLDER_SEP)).otherwise(_col(root_name))


# --- C10 name clean-up ---------------------------------------------------

def clean_name(c) -> Column:
    """Trim whitespace (Python set) then outer quote characters."""
    x = F.regexp_replace(_col(c), f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")
    return F.regexp_replace(x, "^[\"']+|[\"']+$", "")


def py_clean_name(s: str) -> str:
    return s.strip().strip("\"'")


# --- C11 tab names ------------------------------------------------------

def sanitize_tab_name(c) -> Column:
    """C11: illegal characters to ``-``, strip, first 31 characters, right strip."""
    x = F.translate(_col(c), TAB_NAME_BAD_CHARS, "-" * len(TAB_NAME_BAD_CHARS))
    x = F.regexp_replace(x, f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")
    x = F.substring(x, 1, TAB_NAME_MAX)
    return F.regexp_replace(x, f"[{PY_WHITESPACE_CLASS}]+$", "")


def py_sanitize_tab_name(s: str) -> str:
    for ch in TAB_NAME_BAD_CHARS:
        s = s.replace(ch, "-")
    return s.strip()[:TAB_NAME_MAX].rstrip()


# --- C12 / C13 layout style ---------------------------------------------

def color_hex(c) -> Column:
    """24-bit colour integer to ``#rrggbb``."""
    x = _col(c).cast("int")
    return F.format_string(
        "#%02x%02x%02x",
        F.shiftright(x, 16).bitwiseAND(255),
        F.shiftright(x, 8).bitwiseAND(255),
        x.bitwiseAND(255),
    )


def font_size_out(size) -> Column:
    """One point smaller than the source, never below 6."""
    return F.greatest(_col(size) - F.lit(1.0), F.lit(6.0))


def styled_paragraph(text, size, color) -> Column:
    """The HTML paragraph that carries a translated layout line."""
    return F.format_string(
        '<p style="font-family: sans-serif; font-size: %spt; color: %s; margin: 0; padding: 0;">%s</p>',
        font_size_out(size).cast("string"), color_hex(color), _col(text),
    )
