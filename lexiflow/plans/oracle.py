"""DuckDB SQL equivalents of the registered queries (the correctness gate).

Written independently of the Spark code: the derived text, the mock model
and the fault classes are plain SQL expressions, next-fit packing is a
recursive CTE.  Casts pin the types Spark produces (INT lengths, BIGINT
counts); every double literal is written as ``::DOUBLE``.
"""

from __future__ import annotations

from ..models import FIXTURE_ACCENTS as _A, MOCK_DST as _E, MOCK_SRC as _J

JP = r"[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}]"
NOT_JP = r"[^\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}]"
NONBLANK = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def mock(x: str) -> str:
    return f"('<en>' || translate({x}, '{_J}', '{_E}'))"


def translatable(x: str) -> str:
    return f"(regexp_matches({x}, '{JP}') AND regexp_matches({x}, '{NONBLANK}'))"


def jp_chars(x: str) -> str:
    return f"CAST(length(regexp_replace({x}, '{NOT_JP}', '', 'g')) AS INTEGER)"


def est(x: str) -> str:
    jc = jp_chars(x)
    return (f"(CAST(trunc(({jc} * 0.7::DOUBLE + (length({x}) - {jc})) * 0.4::DOUBLE) AS INTEGER) + 15)")


DOC_CTES = f"""
docs AS (
  SELECT doc_id, source, lang, translate(text, '{_A}', '{_J}') AS jp FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(jp, chr(10))) AS text,
         CAST(generate_subscripts(string_split(jp, chr(10)), 1) - 1 AS BIGINT) AS ord,
         len(string_split(jp, chr(10))) AS nl
  FROM docs WHERE jp <> ''),
lines_e AS (
  SELECT doc_id, ord, text, CASE WHEN ord < nl - 1 THEN chr(10) ELSE '' END AS ending,
         {translatable('text')} AS tr
  FROM lines),
uq AS (
  SELECT doc_id, text, min(ord) AS ord, count(*) AS occurrences, {est('text')} AS est
  FROM lines_e WHERE tr GROUP BY doc_id, text)
"""


def pack_ctes(budget: int, k: int) -> str:
    """Next-fit by recursion over units numbered within each document."""
    reset = f"(p.cnt >= {k} OR p.budget + u.est > {budget})"
    return f"""
u AS (SELECT doc_id, text, ord, est, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM uq),
pk(doc_id, rn, start_rn, cnt, budget, chunk_no) AS (
  SELECT doc_id, rn, rn, 1, est, 1 FROM u WHERE rn = 1
  UNION ALL
  SELECT u.doc_id, u.rn,
         CASE WHEN {reset} THEN u.rn ELSE p.start_rn END,
         CASE WHEN {reset} THEN 1 ELSE p.cnt + 1 END,
         CASE WHEN {reset} THEN u.est ELSE p.budget + u.est END,
         CASE WHEN {reset} THEN p.chunk_no + 1 ELSE p.chunk_no END
  FROM pk p JOIN u ON u.doc_id = p.doc_id AND u.rn = p.rn + 1),
packed AS (
  SELECT u.doc_id, u.text, u.ord, s.ord AS chunk_id, CAST(pk.chunk_no AS INTEGER) AS chunk_no,
         CAST(pk.cnt AS INTEGER) AS pos
  FROM pk JOIN u ON u.doc_id = pk.doc_id AND u.rn = pk.rn
          JOIN u s ON s.doc_id = pk.doc_id AND s.rn = pk.start_rn)
"""


# Fault model outcome per chunk: class = length(first string) % 5.
FAULT_CTES = f"""
ch AS (
  SELECT doc_id, chunk_id, count(*) AS n, sum(length(text)) AS in_chars, sum(length(text) + 4) AS out_chars,
         max(CASE WHEN pos = 1 THEN length(text) END) % 5 AS fc
  FROM packed GROUP BY doc_id, chunk_id),
zipped AS (
  SELECT p.doc_id, p.chunk_id, p.pos, p.text, ch.fc, ch.n,
         CASE WHEN ch.fc IN (0, 1, 4) THEN 'chunk'
              WHEN ch.fc = 2 AND p.pos < ch.n THEN 'partial' ELSE 'single' END AS how
  FROM packed p JOIN ch USING (doc_id, chunk_id))
"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"


DOCS_SMALL = with_(DOC_CTES, pack_ctes(300, 8), FAULT_CTES)

SQL: dict[str, str] = {}

SQL["lines_explode"] = with_(DOC_CTES) + "SELECT doc_id, ord, text, ending FROM lines_e"
SQL["filter_script"] = with_(DOC_CTES) + f"SELECT doc_id, ord, text FROM lines_e WHERE regexp_matches(text, '{JP}')"
SQL["filter_nonblank"] = with_(DOC_CTES) + f"SELECT doc_id, ord, text FROM lines_e WHERE regexp_matches(text, '{NONBLANK}')"
SQL["script_char_count"] = with_(DOC_CTES) + (
    f"SELECT doc_id, {jp_chars('jp')} AS jp_chars, CAST(length(jp) AS INTEGER) AS n_chars FROM docs")
SQL["est_tokens"] = with_(DOC_CTES) + f"SELECT doc_id, ord, {jp_chars('text')} AS jp_chars, est FROM uq"
SQL["dedup_units"] = with_(DOC_CTES) + "SELECT doc_id, text, ord, occurrences FROM uq"
SQL["union_units"] = f"""
WITH cv AS (
  SELECT conv_id, turn, translate(role, '{_A}', '{_J}') AS role, translate(text, '{_A}', '{_J}') AS jp
  FROM conversations),
cl AS (
  SELECT conv_id, turn, role, unnest(string_split(jp, chr(10))) AS text,
         generate_subscripts(string_split(jp, chr(10)), 1) - 1 AS lo
  FROM cv WHERE role IN ('user', 'assistant') AND jp <> '')
SELECT conv_id, text,
       min(CAST(CAST(turn AS BIGINT) * 2147483648 + lo + CASE WHEN role = 'assistant' THEN 4611686018427387904 ELSE 0 END AS BIGINT)) AS ord
FROM cl WHERE {translatable('text')}
GROUP BY conv_id, text
"""
SQL["chunk_pack"] = with_(DOC_CTES, pack_ctes(300, 8)) + "SELECT doc_id, ord, chunk_id, chunk_no, pos FROM packed"
SQL["chunk_positions"] = with_(DOC_CTES, pack_ctes(6000, 80)) + "SELECT doc_id, ord, chunk_no, pos FROM packed"
SQL["prompt_body"] = DOCS_SMALL + """
SELECT doc_id, chunk_id, CAST(count(*) AS INTEGER) AS n_items,
       string_agg('[' || pos || '] ' || text, chr(10) ORDER BY pos) AS body
FROM packed GROUP BY doc_id, chunk_id
"""
SQL["chunk_outcomes"] = DOCS_SMALL + """
SELECT doc_id, chunk_id,
       CAST(CASE fc WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS INTEGER) AS attempts,
       CASE WHEN fc IN (0, 1, 4) THEN 'ok' WHEN fc = 2 AND n > 1 THEN 'partial' ELSE 'failed' END AS status,
       CAST(CASE WHEN fc IN (0, 1, 4) THEN n WHEN fc = 2 THEN n - 1 ELSE 0 END AS INTEGER) AS n_accepted,
       CAST(in_chars * CASE fc WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS BIGINT) AS input_tokens,
       CAST(CASE fc WHEN 2 THEN 3 * out_chars WHEN 3 THEN 0 ELSE out_chars END AS BIGINT) AS output_tokens
FROM ch
"""
SQL["positional_zip"] = DOCS_SMALL + f"""
SELECT doc_id, chunk_id, pos, text, CASE WHEN how = 'single' THEN NULL ELSE {mock('text')} END AS text_en
FROM zipped
"""
SQL["missing_units"] = DOCS_SMALL + "SELECT doc_id, text FROM zipped WHERE how = 'single'"
SQL["single_fallback"] = DOCS_SMALL + f"SELECT doc_id, text, {mock('text')} AS text_en FROM zipped WHERE how = 'single'"
SQL["batch_translate"] = DOCS_SMALL + f"SELECT doc_id, text, {mock('text')} AS text_en, how FROM zipped"
SQL["batch_stats"] = DOCS_SMALL + """
SELECT doc_id, count(*) AS unique_strings, count(DISTINCT chunk_id) AS chunks,
       count(*) FILTER (WHERE how = 'single') AS fallbacks
FROM zipped GROUP BY doc_id
"""
_LINES_OUT = f"SELECT doc_id, ord, ending, text, CASE WHEN tr THEN {mock('text')} ELSE text END AS text_out, tr FROM lines_e"
SQL["translate_lines"] = with_(DOC_CTES) + f"SELECT doc_id, ord, text_out FROM ({_LINES_OUT})"
SQL["translate_documents"] = with_(DOC_CTES) + (
    f"SELECT doc_id, string_agg(text_out || ending, '' ORDER BY ord) AS text FROM ({_LINES_OUT}) GROUP BY doc_id")
SQL["passthrough_docs"] = with_(DOC_CTES) + f"""
SELECT doc_id, count(*) FILTER (WHERE tr) AS n_translated, bool_and(text_out = text) AS unchanged
FROM ({_LINES_OUT}) GROUP BY doc_id
"""


# --- derived file tree ----------------------------------------------------------

_SUFFIX_RE = r"^(.+)(\.[^.]+)$"


def _files_cte(routed: bool) -> str:
    ext = ("list_extract(['.txt', '.md', '.csv', '.docx', '.xlsx', '.pdf', '.png', '.TXT'], "
           "CAST(doc_id % 8 + 1 AS INTEGER))") if routed else "'.txt'"
    return f"""
fw AS (
  SELECT doc_id, source, lang, text, regexp_extract(lower(text), '^[^ .,;:!?''"\\n]+', 0) AS w FROM documents),
f0 AS (
  SELECT doc_id, source, lang, source || '/' || lang || '_資料' AS rel_dir,
         translate(CASE WHEN w = '' THEN 'doc' ELSE w END, '{_A}', '{_J}') || '_' || CAST(doc_id AS VARCHAR)
           || {ext} AS name,
         translate(text, '{_A}', '{_J}') AS jp
  FROM fw),
files AS (
  SELECT doc_id, source, lang, rel_dir, name, rel_dir || '/' || name AS path,
         CASE WHEN regexp_matches(name, '{_SUFFIX_RE}') THEN regexp_extract(name, '{_SUFFIX_RE}', 1) ELSE name END AS stem,
         regexp_extract(name, '{_SUFFIX_RE}', 2) AS suffix,
         lower(regexp_extract(name, '{_SUFFIX_RE}', 2)) AS ext, jp
  FROM f0)
"""


FILES = _files_cte(False)
ROUTED = _files_cte(True)

_NAME_CALLS = f"""
nc AS (
  SELECT CAST(count(DISTINCT n) AS BIGINT) AS name_calls FROM (
    SELECT lang || '_資料' AS n FROM files UNION ALL SELECT source FROM files UNION ALL SELECT stem FROM files)
  WHERE regexp_matches(n, '{JP}'))
"""


def _estimate_select(total: str) -> str:
    return f"""
SELECT total_chars, name_calls,
       CAST(trunc(total_chars * 1.4::DOUBLE) AS BIGINT) + name_calls * 300 AS est_input_tokens,
       CAST(trunc(total_chars * 0.68::DOUBLE) AS BIGINT) + name_calls * 50 AS est_output_tokens,
       est_input_tokens / 1000000.0::DOUBLE * 3.0::DOUBLE AS est_input_cost,
       est_output_tokens / 1000000.0::DOUBLE * 15.0::DOUBLE AS est_output_cost,
       est_input_cost + est_output_cost AS est_cost,
       est_cost * 1.3::DOUBLE AS est_cost_with_overhead,
       (total_chars = 0 AND name_calls = 0) AS nothing_to_do
FROM ({total})
"""


SQL["estimate_breakdown"] = with_(FILES) + (
    f"SELECT path, name, ext, CAST({jp_chars('jp')} AS BIGINT) AS jp_chars FROM files WHERE {jp_chars('jp')} > 0")
SQL["estimate_name_calls"] = with_(FILES, _NAME_CALLS) + "SELECT name_calls FROM nc"
SQL["estimate_cost"] = with_(FILES, _NAME_CALLS) + _estimate_select(
    f"SELECT CAST(sum({jp_chars('jp')}) AS BIGINT) AS total_chars, (SELECT name_calls FROM nc) AS name_calls FROM files")
SQL["estimate_unique"] = with_(DOC_CTES) + (
    f"SELECT CAST(count(*) AS BIGINT) AS unique_strings, CAST(sum({jp_chars('text')}) AS BIGINT) AS unique_chars FROM uq")
SQL["usage_report"] = with_(DOC_CTES) + f"""
SELECT * FROM ({_estimate_select(f"SELECT CAST(sum({jp_chars('jp')}) AS BIGINT) AS total_chars, CAST(0 AS BIGINT) AS name_calls FROM docs")})
CROSS JOIN (
  SELECT input_tokens, output_tokens,
         input_tokens / 1000000.0::DOUBLE * 3.0::DOUBLE + output_tokens / 1000000.0::DOUBLE * 15.0::DOUBLE AS cost_usd
  FROM (SELECT CAST(sum(length(text)) AS BIGINT) AS input_tokens,
               CAST(sum(length(text) + 4) AS BIGINT) AS output_tokens FROM uq))
"""

_FOLDER_EN = f"({mock("lang || '_資料'")})"
_FCTX = f"(source || ' > ' || {_FOLDER_EN})"
_STEM_EN = f"(CASE WHEN regexp_matches(stem, '{JP}') THEN {mock('stem')} ELSE stem END)"

SQL["name_translate"] = with_(FILES) + f"""
SELECT DISTINCT 'folder' AS kind, lang || '_資料' AS name, 'subfolder of ' || source AS context,
       {_FOLDER_EN} AS name_en
FROM files
UNION ALL
SELECT DISTINCT 'file', stem, 'file in folder: ' || {_FCTX}, {mock('stem')}
FROM files WHERE regexp_matches(stem, '{JP}')
"""
SQL["path_translate"] = with_(FILES) + (
    f"SELECT path, source || '/' || {_FOLDER_EN} || '/' || {_STEM_EN} || suffix AS path_en FROM files")
SQL["context_strings"] = with_(FILES) + f"""
SELECT path, {_FCTX} AS folder_context, 'file in folder: ' || {_FCTX} AS name_context,
       'Document ''' || {_STEM_EN} || suffix || ''' in folder ''' || {_FCTX} || '''' AS doc_context
FROM files
"""
SQL["path_parts"] = with_(ROUTED) + "SELECT path, name, stem, suffix, ext FROM files"
SQL["route_by_ext"] = with_(ROUTED) + """
SELECT path, ext,
       CASE ext WHEN '.txt' THEN 'lines' WHEN '.md' THEN 'lines' WHEN '.csv' THEN 'csv'
                WHEN '.docx' THEN 'docx' WHEN '.xlsx' THEN 'xlsx' WHEN '.pdf' THEN 'layout' ELSE 'copy' END AS handler,
       ext IN ('.txt', '.md', '.csv', '.docx', '.xlsx', '.pdf') AS supported
FROM files
"""
SQL["translate_columns"] = f"""
WITH cv AS (
  SELECT conv_id, turn, translate(role, '{_A}', '{_J}') AS role, translate(text, '{_A}', '{_J}') AS text
  FROM conversations)
SELECT conv_id, turn,
       CASE WHEN {translatable('role')} THEN {mock('role')} ELSE role END AS role,
       CASE WHEN {translatable('text')} THEN {mock('text')} ELSE text END AS text
FROM cv
"""


# --- csv ------------------------------------------------------------------------

def _q(x: str) -> str:
    return f"""(CASE WHEN regexp_matches({x}, '[,"\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END)"""


def _tr(x: str) -> str:
    return f"(CASE WHEN {translatable(x)} THEN {mock(x)} ELSE {x} END)"


_CONV = f"""
cv AS (
  SELECT conv_id, turn, translate(role, '{_A}', '{_J}') AS role, translate(text, '{_A}', '{_J}') AS text,
         'conv/' || CAST(conv_id AS VARCHAR) || '.csv' AS path,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS BIGINT) AS row
  FROM conversations)
"""
SQL["csv_cells"] = with_(_CONV) + """
SELECT DISTINCT path, CAST(0 AS BIGINT) AS row, CAST(h.col AS INTEGER) AS col, h.text
FROM cv, (VALUES (0, '番号'), (1, '役割'), (2, '本文')) h(col, text)
UNION ALL SELECT path, row, 0, CAST(turn AS VARCHAR) FROM cv
UNION ALL SELECT path, row, 1, role FROM cv
UNION ALL SELECT path, row, 2, text FROM cv
UNION ALL SELECT path, row, 3, '済' FROM cv WHERE role = 'assistant'
"""
_HEADER_LINE = " || ',' || ".join(_q(_tr(f"'{h}'")) for h in ("番号", "役割", "本文"))
_ROW_LINE = (f"{_q(_tr('CAST(turn AS VARCHAR)'))} || ',' || {_q(_tr('role'))} || ',' || {_q(_tr('text'))}"
             f" || CASE WHEN role = 'assistant' THEN ',' || {_q(_tr(chr(39) + '済' + chr(39)))} ELSE '' END")
SQL["csv_rebuild"] = with_(_CONV) + f"""
SELECT path, {_HEADER_LINE} || chr(13) || chr(10) || chr(13) || chr(10)
             || string_agg({_ROW_LINE} || chr(13) || chr(10), '' ORDER BY turn) AS text
FROM cv GROUP BY path
"""

# --- layout ---------------------------------------------------------------------

_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_SPANS = r"""
w AS (
  SELECT doc_id, ord, unnest(regexp_extract_all(text, '\S+\s*', 0)) AS word,
         generate_subscripts(regexp_extract_all(text, '\S+\s*', 0), 1) - 1 AS span
  FROM lines_e),
sp AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, CAST(ord // 20 AS INTEGER) AS page,
         CAST((ord % 20) // 5 AS INTEGER) AS block, CAST(ord % 5 AS INTEGER) AS line, span,
         CASE WHEN (ord % 20) // 5 = 3 AND (ord // 20) % 3 = 2 THEN 1 ELSE 0 END AS block_type, word AS text,
         8.0::DOUBLE + length(word) % 4 AS size, CAST((length(word) * 4099) % 16777216 AS INTEGER) AS color,
         span * 10.0::DOUBLE AS x0, (ord % 5) * 12.0::DOUBLE AS y0,
         span * 10.0::DOUBLE + length(word) * 5.0::DOUBLE AS x1, (ord % 5) * 12.0::DOUBLE + 10.0::DOUBLE AS y1
  FROM w),
tl AS (SELECT * FROM sp WHERE block_type = 0),
sz AS (SELECT path, page, block, line, size, count(*) AS c FROM tl GROUP BY ALL),
dom AS (
  SELECT path, page, block, line, size FROM (
    SELECT *, row_number() OVER (PARTITION BY path, page, block, line ORDER BY c DESC, size ASC) AS r FROM sz)
  WHERE r = 1),
"""
_SPANS += f"""
agg AS (
  SELECT path, page, block, line, {_strip("string_agg(text, '' ORDER BY span)")} AS text,
         arg_min(color, span) AS color, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM tl GROUP BY ALL),
ll AS (
  SELECT a.path, a.page, a.block, a.line, a.text, d.size, a.color, a.x0, a.y0, a.x1, a.y1
  FROM agg a JOIN dom d USING (path, page, block, line) WHERE a.text <> '')
"""
SQL["layout_lines"] = with_(DOC_CTES, _SPANS) + "SELECT * FROM ll"
SQL["page_limit"] = with_(DOC_CTES, _SPANS) + "SELECT path, count(*) AS n_lines FROM ll WHERE page < 2 GROUP BY path"
SQL["layout_style"] = with_(DOC_CTES, _SPANS) + f"""
SELECT path, page, block, line, greatest(size - 1.0::DOUBLE, 6.0::DOUBLE) AS font_size,
       printf('#%02x%02x%02x', (color >> 16) & 255, (color >> 8) & 255, color & 255) AS color_hex,
       '<p style="font-family: sans-serif; font-size: ' || CAST(greatest(size - 1.0::DOUBLE, 6.0::DOUBLE) AS VARCHAR)
       || 'pt; color: ' || printf('#%02x%02x%02x', (color >> 16) & 255, (color >> 8) & 255, color & 255)
       || '; margin: 0; padding: 0;">' || {_tr('text')} || '</p>' AS html
FROM ll
"""

# --- markup ------------------------------------------------------------------------

_P = r"(<p(?:\s[^>]*)?>)([^<]*)(</p>)"


def _unesc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), "
            f"'&quot;', '\"'), '&apos;', '''')")


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_PAGES = f"""
pg AS (SELECT page_id, translate(html, '{_A}', '{_J}') AS h FROM pages),
nodes AS (
  SELECT page_id, unnest(regexp_extract_all(h, '{_P}', 2)) AS raw,
         CAST(generate_subscripts(regexp_extract_all(h, '{_P}', 2), 1) - 1 AS INTEGER) AS i
  FROM pg)
"""
SQL["markup_text_nodes"] = with_(_PAGES) + f"SELECT page_id, i, raw, {_unesc('raw')} AS text FROM nodes"
SQL["xml_escape_roundtrip"] = with_(_PAGES) + (
    f"SELECT page_id, i, raw, {_unesc('raw')} AS text, {_esc(_unesc('raw'))} AS reescaped FROM nodes")
SQL["markup_replace"] = with_(_PAGES) + f"""
SELECT page_id,
       CASE WHEN len(list_filter(raws, lambda r: {translatable(_unesc('r'))})) > 0
            THEN pieces[1] || array_to_string(list_transform(range(1, len(raws) + 1), lambda k:
                   opens[k] || {_esc(_tr(_unesc('raws[k]')))} || closes[k] || pieces[k + 1]), '')
            ELSE h END AS html
FROM (SELECT page_id, h, regexp_split_to_array(h, '{_P}') AS pieces,
             regexp_extract_all(h, '{_P}', 1) AS opens, regexp_extract_all(h, '{_P}', 2) AS raws,
             regexp_extract_all(h, '{_P}', 3) AS closes FROM pg)
"""
SQL["string_table_entries"] = f"""
WITH b AS (SELECT item_id, string_split(translate(text, '{_A}', '{_J}'), '. ') AS ss FROM benchmark),
e AS (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS i FROM b)
SELECT item_id, CAST(i AS INTEGER) AS i, i % 2 = 1 AS is_rich,
       CASE WHEN i % 2 = 1 THEN split_part(s, ' ', 1) || substr(s, length(split_part(s, ' ', 1)) + 2) || 'ふりがな'
            ELSE s END AS text
FROM e
"""
_TABS = """
t AS (SELECT p_partkey, p_name, p_type, p_size, p_brand,
             p_brand || '#' || CAST(p_partkey // 16 AS VARCHAR) AS wb, p_name || '表' AS jp FROM part)
"""
SQL["sheet_ref_patch"] = with_(_TABS) + f"""
, x AS (SELECT wb, '<f>' || string_agg('''' || jp || '''!A1+' || jp || '!B2', '+' ORDER BY p_partkey) || '</f>' AS xml
       FROM t GROUP BY wb),
m AS (SELECT wb, list(struct_pack(k := -length(jp), pos := pos, jp := jp, en := {mock('jp')})) AS m
      FROM (SELECT wb, jp, min(p_partkey) AS pos FROM t GROUP BY wb, jp) GROUP BY wb)
SELECT x.wb, list_reduce(list_sort(m.m), lambda acc, e:
         replace(replace(acc, '''' || e.jp || '''!', '''' || e.en || '''!'), e.jp || '!', '''' || e.en || '''!'),
         x.xml) AS xml
FROM x JOIN m USING (wb)
"""
_RAW_TAB = "upper(p_name) || ': ' || p_type || ' [' || CAST(p_size AS VARCHAR) || ']/' || p_brand"
SQL["tab_name_sanitize"] = f"""
SELECT p_partkey, {_RAW_TAB} AS raw,
       regexp_replace(substr({_strip(f"translate({_RAW_TAB}, '\\/?*[]:', '-------')")}, 1, 31), '[{_WS}]+$', '', 'g') AS tab
FROM part
"""

# --- corpus --------------------------------------------------------------------------

_FILE_LINES = f"""
fl AS (
  SELECT path, unnest(string_split(jp2, chr(10))) AS text, generate_subscripts(string_split(jp2, chr(10)), 1) AS i,
         len(string_split(jp2, chr(10))) AS nl
  FROM files2),
tx AS (
  SELECT path, string_agg({_tr('text')} || CASE WHEN i < nl THEN chr(10) ELSE '' END, '' ORDER BY i) AS text
  FROM fl GROUP BY path)
"""


def _corpus_sql(marker: bool) -> str:
    jp2 = "jp || CASE WHEN doc_id % 20 = 0 THEN chr(10) || '失敗' ELSE '' END" if marker else "jp"
    failed = "doc_id % 20 = 0" if marker else "false"
    return with_(FILES, f"files2 AS (SELECT *, {jp2} AS jp2 FROM files)", _FILE_LINES) + f"""
SELECT f.path,
       CASE WHEN {failed} THEN source || '/' || {_FOLDER_EN} || '/' || name
            ELSE source || '/' || {_FOLDER_EN} || '/' || {_STEM_EN} || suffix END AS path_out,
       CASE WHEN {failed} THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN {failed} THEN jp2 ELSE tx.text END AS text
FROM files2 f JOIN tx USING (path)
"""


SQL["translate_corpus"] = _corpus_sql(False)
SQL["quarantine_split"] = _corpus_sql(True)

SQL["memory_translate"] = with_(DOC_CTES) + f"SELECT doc_id, text, {mock('text')} AS text_en, 'memory' AS how FROM uq"
SQL["stream_translate_documents"] = SQL["translate_documents"]


# --- package parts as rows ---------------------------------------------------------

SQL["workbook_rename"] = with_(_TABS) + f"""
SELECT wb, '<workbook><sheets>' || string_agg('<sheet name="' || {mock("jp || CAST(p_partkey AS VARCHAR)")}
       || '" sheetId="' || CAST(p_partkey AS VARCHAR) || '"/>', '' ORDER BY p_partkey) || '</sheets></workbook>' AS xml
FROM t GROUP BY wb
"""

_BEFORE = "split_part(ss[k], ' ', 1)"
_AFTER = f"substr(ss[k], length({_BEFORE}) + 2)"
SQL["string_table_rewrite"] = f"""
WITH b AS (SELECT item_id, string_split(translate(text, '{_A}', '{_J}'), '. ') AS ss FROM benchmark)
SELECT item_id, '<sst>' || array_to_string(list_transform(range(1, len(ss) + 1), lambda k:
         CASE WHEN (k - 1) % 2 = 1
              THEN '<si><r><t>' || {_esc(mock(_BEFORE + " || " + _AFTER + " || 'ふりがな'"))}
                   || '</t></r><r><rPr/><t xml:space="preserve"></t></r></si>'
              WHEN {translatable('ss[k]')} THEN '<si><t>' || {_esc(mock('ss[k]'))} || '</t></si>'
              ELSE '<si><t>' || {_esc('ss[k]')} || '</t></si>' END), '') || '</sst>' AS xml
FROM b
"""
SQL["docx_paragraphs"] = with_(DOC_CTES) + "SELECT doc_id, CAST(ord AS INTEGER) AS i, text FROM lines_e"
_B = "split_part(text, ' ', 1)"
_DOCX_AFTER = _esc(f"substr(text, length({_B}) + 1)")
SQL["docx_rewrite"] = with_(DOC_CTES) + f"""
SELECT doc_id, '<w:body>' || string_agg(
         CASE WHEN text = '' THEN '<w:p><w:pPr/></w:p>'
              WHEN tr THEN '<w:p><w:r><w:t>' || {_esc(mock('text'))}
                           || '</w:t></w:r><w:r><w:t xml:space="preserve"></w:t></w:r></w:p>'
              ELSE '<w:p><w:r><w:t>' || {_esc(_B)} || '</w:t></w:r><w:r><w:t xml:space="preserve">'
                   || {_DOCX_AFTER} || '</w:t></w:r></w:p>' END,
         '' ORDER BY ord) || '</w:body>' AS xml
FROM lines_e GROUP BY doc_id
"""
SQL["drawing_discovery"] = """
WITH l AS (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS link,
         generate_subscripts(regexp_extract_all(html, 'href="/([^"]*)"', 1), 1) - 1 AS i
  FROM pages)
SELECT DISTINCT 'p' || CAST(page_id AS VARCHAR) || '.xlsx' AS path, 'xl/drawings/' || link || '.xml' AS part
FROM l WHERE i % 2 = 0
UNION ALL
SELECT 'p' || CAST(page_id AS VARCHAR) || '.xlsx', 'xl/drawings/extra#.xml' FROM pages p
WHERE page_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM l WHERE l.page_id = p.page_id)
"""
SQL["name_clean"] = f"""
SELECT item_id, raw, regexp_replace({_strip('raw')}, '^[\"'']+|[\"'']+$', '', 'g') AS name
FROM (SELECT item_id, ' "' || chr(39) || text || chr(39) || '"' || chr(10) AS raw FROM benchmark)
"""

# W4 by recursion over a workbook's tabs: the first name of the series that is not taken
SQL["tab_name_unique"] = with_(_TABS) + """
, w AS (SELECT wb, p_partkey, upper(split_part(p_name, ' ', 1)) AS word, p_partkey % 5 = 0 AS kept FROM t),
n AS (SELECT wb, p_partkey, kept, CASE WHEN p_partkey % 2 = 0 THEN word ELSE lower(word) END AS base, lower(word) || '_2' AS own,
             row_number() OVER (PARTITION BY wb ORDER BY p_partkey) AS rn FROM w),
s AS (SELECT wb, list(own) FILTER (WHERE kept) AS taken FROM n GROUP BY wb),
r(wb, rn, p_partkey, taken, tab_en) AS (
  SELECT wb, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), coalesce(taken, CAST([] AS VARCHAR[])), CAST(NULL AS VARCHAR) FROM s
  UNION ALL
  SELECT n.wb, n.rn, n.p_partkey, CASE WHEN n.kept THEN r.taken ELSE list_append(r.taken, lower(c.name)) END,
         CASE WHEN n.kept THEN NULL ELSE c.name END
  FROM r JOIN n ON n.wb = r.wb AND n.rn = r.rn + 1,
       LATERAL (SELECT list_filter(list_transform(range(1, 40), lambda k: CASE WHEN k = 1 THEN n.base ELSE n.base || '_' || CAST(k AS VARCHAR) END),
                                   lambda x: NOT list_contains(r.taken, lower(x)))[1] AS name) c)
SELECT wb, p_partkey, tab_en FROM r WHERE rn > 0
"""

# --- model replies as tables -----------------------------------------------------------
SQL["parse_responses"] = """
SELECT conv_id, turn, CAST(CASE (conv_id + turn) % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 0 END AS INTEGER) AS n_items,
       CASE WHEN (conv_id + turn) % 6 IN (0, 1) THEN text END AS first
FROM conversations
"""
SQL["best_partial"] = with_(DOC_CTES) + """
, d AS (SELECT doc_id, string_split(jp, ' ') AS w, len(string_split(jp, ' ')) AS n FROM docs),
a AS (SELECT doc_id, n, a, greatest(0, n - 2 + (doc_id * 7 + a * 5) % 4) AS l FROM d, range(1, 4) x(a)),
b AS (SELECT doc_id, coalesce(min(a) FILTER (WHERE l = n), 3) AS attempts, count(*) FILTER (WHERE l = n) > 0 AS ok,
             least(max(l), max(n)) AS l FROM a GROUP BY doc_id),
o AS (SELECT d.doc_id, b.attempts, b.ok, list_transform(range(1, n + 1), lambda i:
               CASE WHEN NOT b.ok AND i > b.l THEN '?' WHEN (i - 1 + d.doc_id) % 5 = 0 THEN CASE WHEN b.ok THEN ' ' ELSE '?' END
                    WHEN NOT b.ok AND NOT regexp_matches(w[i], 'NONBLANK') THEN '?' ELSE w[i] END) AS out
      FROM d JOIN b USING (doc_id))
SELECT doc_id, CAST(attempts AS INTEGER) AS attempts,
       CASE WHEN ok THEN 'ok' WHEN len(list_filter(out, lambda x: x <> '?')) > 0 THEN 'partial' ELSE 'failed' END AS status,
       array_to_string(out, '|') AS out
FROM o
""".replace("NONBLANK", NONBLANK)
SQL["throttled_outcomes"] = with_(DOC_CTES, pack_ctes(300, 8)) + """
, c AS (SELECT doc_id, chunk_id, sum(length(text)) AS i, sum(length(text) + 4) AS o,
               max(CASE WHEN pos = 1 THEN length(text) END) % 4 = 3 AS bad
        FROM packed GROUP BY doc_id, chunk_id)
SELECT doc_id, chunk_id, CAST(1 AS INTEGER) AS attempts, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status,
       CAST(CASE WHEN bad THEN 0 ELSE i END AS BIGINT) AS input_tokens, CAST(CASE WHEN bad THEN 0 ELSE o END AS BIGINT) AS output_tokens
FROM c
"""
SQL["error_summary"] = "SELECT 'chunk' AS stage, count(*) AS n_files FROM documents WHERE doc_id % 20 = 0 HAVING count(*) > 0"

# --- sheets, drawings, part rules ---------------------------------------------------------
SQL["sheet_strings"] = with_(_TABS) + """
SELECT wb, CASE WHEN p_partkey % 2 = 0 THEN 'inline' ELSE 'cached' END AS kind,
       CAST(row_number() OVER (PARTITION BY wb, p_partkey % 2 ORDER BY p_partkey) - 1 AS INTEGER) AS i, jp AS text
FROM t
"""
SQL["sheet_rewrite"] = with_(_TABS) + f"""
SELECT wb, '<sheetData>' || string_agg(CASE WHEN p_partkey % 2 = 0
           THEN '<c t="inlineStr"><is><t>' || {_esc(_tr('jp'))} || '</t></is></c>'
           ELSE '<c r="A1" t="str"><f>1&lt;2</f><v>' || {_esc(_tr('jp'))} || '</v></c>' END, '' ORDER BY p_partkey) || '</sheetData>' AS xml
FROM t GROUP BY wb
"""
SQL["drawing_rewrite"] = with_(_TABS) + f"""
SELECT wb, string_agg('<a:p><a:normAutofit/><a:latin typeface="Arial"/><a:t>' || {_esc(_tr('jp'))} || '</a:t></a:p>', '' ORDER BY p_partkey) AS xml
FROM t GROUP BY wb
"""
SQL["part_rules"] = with_(_TABS) + """
SELECT p_partkey,
       ['xl/calcChain.xml', '[Content_Types].xml', 'xl/sharedStrings.xml', 'xl/workbook.xml', 'xl/styles.xml', 'xl/worksheets/s.xml',
        'xl/worksheets/_rels/s.xml.rels', 'docProps/app.xml', 'xl/media/i.png'][CAST(p_partkey % 9 + 1 AS INTEGER)] AS part,
       ['drop', 'content_types', 'string_table', 'workbook', 'styles', 'sheet', 'other', 'docprops', 'other'][CAST(p_partkey % 9 + 1 AS INTEGER)] AS kind,
       CASE p_partkey % 9 WHEN 4 THEN '<font><name val="Arial"/><scheme val="none"/></font>'
                          WHEN 1 THEN '<Types><Override PartName="/x"/></Types>' END AS xml
FROM t
"""

# --- unique paths, cells, columns, csv files ------------------------------------------------
SQL["path_unique"] = r"""
WITH d AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, source AS dir,
         CASE WHEN doc_id % 3 = 0 THEN 'Name' ELSE 'name' END || CAST(doc_id % 4 AS VARCHAR)
         || CASE WHEN doc_id % 7 = 0 THEN '_' || CAST(doc_id % 5 + 2 AS VARCHAR) ELSE '' END AS stem
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(dir), lower(stem) ORDER BY path) AS k FROM d),
own AS (SELECT lower(dir) AS dir, regexp_extract(lower(stem), '^(.*)_([1-9][0-9]*)$', 1) AS stem,
               list(DISTINCT CAST(regexp_extract(lower(stem), '^(.*)_([1-9][0-9]*)$', 2) AS BIGINT)) AS taken
        FROM d WHERE regexp_matches(lower(stem), '^(.*)_([1-9][0-9]*)$') GROUP BY ALL)
SELECT k.path, k.dir || '/' || k.stem || CASE WHEN k.k = 1 THEN '' ELSE '_' || CAST(list_filter(
         range(2, k.k + 1 + coalesce(len(own.taken), 0)), lambda n: NOT list_contains(coalesce(own.taken, CAST([] AS BIGINT[])), n))[k.k - 1] AS VARCHAR) END
       || '.txt' AS path_out
FROM k LEFT JOIN own ON own.dir = lower(k.dir) AND own.stem = lower(k.stem)
"""
_CELLS = f"""
cn AS (SELECT *, 4 + coalesce(sum(CASE WHEN role = 'assistant' THEN 4 ELSE 3 END)
                               OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0 FROM cv),
cells AS (
  SELECT DISTINCT conv_id, h.n, h.text FROM cv, (VALUES (0, '番号'), (1, '役割'), (2, '本文')) h(n, text)
  UNION ALL SELECT conv_id, n0, CAST(turn AS VARCHAR) FROM cn
  UNION ALL SELECT conv_id, n0 + 1, role FROM cn
  UNION ALL SELECT conv_id, n0 + 2, text FROM cn
  UNION ALL SELECT conv_id, n0 + 3, '済' FROM cn WHERE role = 'assistant'),
uq AS (SELECT conv_id AS doc_id, text, CAST(min(n) AS BIGINT) AS ord, {est('text')} AS est FROM cells
       WHERE {translatable('text')} GROUP BY conv_id, text)
"""
SQL["csv_pack"] = with_(_CONV, _CELLS, pack_ctes(300, 8)) + (
    "SELECT 'conv/' || CAST(doc_id AS VARCHAR) || '.csv' AS path, ord, chunk_id, chunk_no, pos FROM packed")
SQL["columns_quarantine"] = with_(f"""
q AS (
  SELECT conv_id, turn, translate(role, '{_A}', '{_J}') AS role,
         translate(text, '{_A}', '{_J}') || CASE WHEN conv_id % 25 = 3 AND turn = 0 THEN '失敗' ELSE '' END AS text
  FROM conversations),
c AS (SELECT conv_id, turn, 0 AS col, role AS text FROM q UNION ALL SELECT conv_id, turn, 1, text FROM q),
f AS (SELECT text, min((conv_id, turn, col)) AS p FROM c WHERE {translatable('text')} GROUP BY text),
uq AS (SELECT 0 AS doc_id, text, row_number() OVER (ORDER BY p) AS ord, {est('text')} AS est FROM f)""", pack_ctes(300, 8)) + f"""
, bad AS (SELECT DISTINCT chunk_id FROM packed WHERE contains(text, '失敗')),
en AS (SELECT text, {mock('text')} AS en FROM packed WHERE chunk_id NOT IN (SELECT chunk_id FROM bad))
SELECT q.conv_id, q.turn, coalesce(r.en, q.role) AS role, coalesce(x.en, q.text) AS text,
       CASE WHEN NOT {translatable('q.role')} AND NOT {translatable('q.text')} THEN 'none'
            WHEN ({translatable('q.role')} AND r.en IS NULL) OR ({translatable('q.text')} AND x.en IS NULL) THEN 'kept' ELSE 'ok' END AS how
FROM q LEFT JOIN en r ON r.text = q.role LEFT JOIN en x ON x.text = q.text
"""
SQL["translate_corpus_csv"] = f"SELECT path, path AS path_out, 'ok' AS status, text FROM ({SQL['csv_rebuild']})"
SQL["translate_corpus_layout"] = f"SELECT * FROM ({SQL['layout_style']}) WHERE page < 2"
