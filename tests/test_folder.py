"""translate_folder on a real tree: names, contents, packages, copies, isolation."""

import io
import os
import zipfile

import pytest

from lexiflow.config import DEFAULT
from lexiflow.models import MockTranslator, mock_translate
from lexiflow.plans.folder import translate_folder
from lexiflow.session import work_dir

S = DEFAULT.with_(throttle_waits=(0.0,))
JP = "日本語"


def _xlsx() -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Override PartName="/xl/calcChain.xml" ContentType="x"/></Types>')
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="日本" sheetId="1"/>'
                                      '<sheet name="Summary" sheetId="2"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst><si><t>報告</t></si><si><r><t>資</t></r><r><t>料</t></r>'
                                           '<rPh><t>し</t></rPh></si><si><t>plain</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", "<sheetData><c t=\"inlineStr\"><is><t>文書</t></is></c>"
                                               "<c t=\"str\"><f>日本!A1</f><v>採用</v></c></sheetData>")
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels",
                   '<Relationships><Relationship Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                   'relationships/drawing" Target="../drawings/drawing1.xml"/></Relationships>')
        z.writestr("xl/drawings/drawing1.xml", '<a:p><a:t>表求</a:t><a:latin typeface="MS Gothic"/></a:p>')
        z.writestr("xl/calcChain.xml", "<calcChain/>")
        z.writestr("xl/styles.xml", '<fonts><font><name val="MS Gothic"/></font></fonts>')
    return buf.getvalue()


def _docx() -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<w:body><w:p><w:r><w:t>日本</w:t></w:r><w:r><w:t>語</w:t></w:r></w:p>"
                                        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>表の中</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
                                        "<w:p><w:pPr/></w:p><w:p><w:r><w:t>English</w:t></w:r></w:p></w:body>")
    return buf.getvalue()


@pytest.fixture()
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "日本" / "報告").mkdir(parents=True)
    (src / "空").mkdir()
    (src / "日本" / "報告" / "資料.txt").write_bytes("一行 日本\r\nEnglish line\r\n\r\n日本\n最後 語".encode("utf-8"))
    (src / "日本" / "文書.md").write_bytes("# 見出し 文書\nplain\n".encode("utf-8"))
    (src / "表.csv").write_bytes('番号,本文\r\n1,"日本, 語"\r\n\r\n2,"a ""q"""\r\n'.encode("utf-8"))
    (src / "a.tar.gz").write_bytes(b"\x1f\x8b binary")
    (src / ".gitignore").write_bytes(b"*.pyc\n")
    (src / "noext").write_bytes(b"")
    (src / "book.xlsx").write_bytes(_xlsx())
    (src / "doc.docx").write_bytes(_docx())
    (src / "broken.xlsx").write_bytes(_xlsx()[:40])
    return src, tmp_path / "out"


def _read(p):
    return open(p, "rb").read()


def test_translate_folder(spark, tree):
    src, dst = tree
    res = translate_folder(spark, str(src), str(dst), MockTranslator(), S, work=work_dir(spark))
    assert res.written.filter("error is not null").count() == 0
    m = mock_translate
    # folder and file names translated, extension case kept
    txt = dst / m("日本") / m("報告") / (m("資料") + ".txt")
    assert txt.exists(), sorted(os.listdir(dst))
    assert txt.read_text("utf-8") == f"{m('一行 日本')}\nEnglish line\n\n{m('日本')}\n{m('最後 語')}"
    md = dst / m("日本") / (m("文書") + ".md")
    assert md.read_text("utf-8") == f"{m('# 見出し 文書')}\nplain\n"
    csv_out = (dst / (m("表") + ".csv")).read_bytes().decode("utf-8")
    assert csv_out == f'{m("番号")},{m("本文")}\r\n1,"{m("日本, 語")}"\r\n\r\n2,"a ""q"""\r\n'
    # copies: unchanged bytes, untranslated names without source script
    assert _read(dst / "a.tar.gz") == b"\x1f\x8b binary"
    assert _read(dst / ".gitignore") == b"*.pyc\n"
    assert _read(dst / "noext") == b""
    assert (dst / m("空")).is_dir()
    # broken package: copied under its original name, reported
    assert _read(dst / "broken.xlsx") == _read(src / "broken.xlsx")
    assert res.errors.filter("path = 'broken.xlsx'").count() >= 1
    # spreadsheet package
    with zipfile.ZipFile(dst / "book.xlsx") as z:
        names = z.namelist()
        assert "xl/calcChain.xml" not in names
        assert "calcChain" not in z.read("[Content_Types].xml").decode()
        wb = z.read("xl/workbook.xml").decode()
        assert f'name="{m("日本")}"' in wb and 'name="Summary"' in wb
        sst = z.read("xl/sharedStrings.xml").decode()
        assert f"<si><t>{m('報告')}</t></si>".replace("<en>", "&lt;en&gt;") in sst
        assert "<rPh>" not in sst and "<t>plain</t>" in sst
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert m("文書").replace("<", "&lt;").replace(">", "&gt;") in sheet
        assert f"'{m('日本')}'!A1" in sheet
        drawing = z.read("xl/drawings/drawing1.xml").decode()
        assert m("表求").replace("<", "&lt;").replace(">", "&gt;") in drawing and 'typeface="Arial"' in drawing
        assert 'val="Arial"' in z.read("xl/styles.xml").decode()
        # untouched members keep their timestamp; rewritten ones are fresh
        with zipfile.ZipFile(src / "book.xlsx") as zs:
            assert z.getinfo("xl/worksheets/_rels/sheet1.xml.rels").date_time == \
                zs.getinfo("xl/worksheets/_rels/sheet1.xml.rels").date_time
        assert z.getinfo("xl/workbook.xml").compress_type == zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(dst / "doc.docx") as z:
        body = z.read("word/document.xml").decode()
        assert "<w:t>" + m("日本語").replace("<", "&lt;").replace(">", "&gt;") + "</w:t>" in body
        assert "<w:t></w:t>" in body and "<w:t>English</w:t>" in body
        assert "<w:t>" + m("表の中").replace("<", "&lt;").replace(">", "&gt;") + "</w:t>" in body


def test_overwrite_guard(spark, tree):
    src, dst = tree
    dst.mkdir()
    (dst / "x").write_text("keep")
    with pytest.raises(FileExistsError):
        translate_folder(spark, str(src), str(dst), MockTranslator(), S)


def test_estimate_folder(spark, tree):
    from lexiflow.plans.folder import estimate_folder
    src, _ = tree
    est = estimate_folder(spark, str(src), S)
    rows = {r.name: r.jp_chars for r in est.breakdown.collect()}
    # by hand: txt 一行日本 + 日本 + 最後語 = 4 + 2 + 3; md 見出し文書 = 5; csv 番号 本文 日本語 = 2+2+3
    assert rows["資料.txt"] == 9 and rows["文書.md"] == 5 and rows["表.csv"] == 7
    # xlsx: tabs are names, not content; string table 報告 + 資料し, sheet 文書 + 採用, drawing 表求
    assert rows["book.xlsx"] == 2 + 3 + 2 + 2 + 2
    assert rows["doc.docx"] == 3 + 3
    t = est.totals.first()
    # names: folders 日本 報告 空, stems 資料 文書 表 (日本 counted once), + one source-script tab
    assert t.name_calls == 6 + 1
    assert t.total_chars == 9 + 5 + 7 + 11 + 6
    assert t.est_input_tokens == int(38 * 1.4) + 7 * 300


def test_corpus_usage_counts_names_and_content(spark, tree):
    from lexiflow.plans.folder import folder_usage
    src, dst = tree
    res = translate_folder(spark, str(src), str(dst), MockTranslator(), S)
    u = folder_usage(res).first()
    # mock usage: input = characters sent, output = characters returned (+4 per answer)
    calls = res.corpus.name_calls.filter("status = 'ok'").collect()
    names_in = sum(len(r.name) for r in calls)
    content = sum(b.responses.agg({"input_tokens": "sum"}).first()[0] for b in (res.corpus.batch, res.packages.batch))
    assert res.packages.batch.responses.count() > 0
    assert u.input_tokens == names_in + content
    # every folder name is asked for once, those of empty folders in the same stage
    asked = [(r.name, r.context) for r in calls]
    assert len(asked) == len(set(asked)) and "空" in [n for n, _ in asked]
    assert u.output_tokens > u.input_tokens
    assert abs(u.cost_usd - (u.input_tokens * 3 + u.output_tokens * 15) / 1e6) < 1e-12


def test_name_collisions_get_suffixes(spark):
    """Q11: two files translating to the same path get _2, _3 (in path order)."""
    from lexiflow.operators.names import translate_dir_paths, translate_file_names, translate_folders
    from lexiflow.session import work_dir
    rows = [("日.txt", "", "日.txt", "日", ".txt"), ("日.TXT", "", "日.TXT", "日", ".TXT"),
            ("x/本.md", "x", "本.md", "本", ".md"), ("x/本.md2", "x", "本.md2", "本", ".md2")]
    files = spark.createDataFrame(rows, "path string, rel_dir string, name string, stem string, suffix string")
    w = work_dir(spark)
    folders = translate_folders(files, "root", MockTranslator(), S, w)
    named = translate_file_names(files, translate_dir_paths(folders, "root"), MockTranslator(), S, w)
    got = {r.path: r.path_en for r in named.collect()}
    m = mock_translate
    # ".txt" and ".TXT" collide case-insensitively; the later path gets _2
    assert got["日.TXT"] == m("日") + ".TXT" and got["日.txt"] == m("日") + "_2.txt"
    assert got["x/本.md"] == f"x/{m('本')}.md" and got["x/本.md2"] == f"x/{m('本')}.md2"


def test_overwrite_mode_and_empty_estimate(spark, tree, tmp_path):
    from lexiflow.plans.folder import estimate_folder
    src, dst = tree
    dst.mkdir()
    (dst / "old").write_text("x")
    res = translate_folder(spark, str(src), str(dst), MockTranslator(), S, mode="overwrite")
    assert res.written.filter("error is not null").count() == 0
    empty = tmp_path / "empty_src"
    (empty / "only_english").mkdir(parents=True)
    (empty / "only_english" / "notes.txt").write_text("plain words only\n")
    e = estimate_folder(spark, str(empty), S)
    assert tuple(e.unique.first()) == (0, 0, 0.0)
    t = e.totals.first()
    assert t.nothing_to_do and t.total_chars == 0 and t.name_calls == 0


def test_failing_file_is_isolated(spark, tmp_path):
    """A content failure affects only its file, which is copied under its
    original name into the translated folder; the others are translated."""
    from lexiflow.models import ScriptedFaultTranslator
    src = tmp_path / "src"
    (src / "日本").mkdir(parents=True)
    (src / "日本" / "報告.txt").write_text("良い 日本\n", encoding="utf-8")
    (src / "日本" / "資料.txt").write_text("失敗 する 行\n日本\n", encoding="utf-8")
    dst = tmp_path / "out"
    tr = ScriptedFaultTranslator(fail_marker="失敗", faults=False)
    res = translate_folder(spark, str(src), str(dst), tr, S)
    m = mock_translate
    assert (dst / m("日本") / (m("報告") + ".txt")).read_text("utf-8") == m("良い 日本") + "\n"
    # failed file: original bytes, original name, inside the translated folder
    assert (dst / m("日本") / "資料.txt").read_text("utf-8") == "失敗 する 行\n日本\n"
    assert not (dst / m("日本") / (m("資料") + ".txt")).exists()
    errs = res.errors.collect()
    assert [e.path for e in errs] == ["日本/資料.txt"] and "失敗" in errs[0].error


def test_final_names_are_unique_and_safe(spark):
    from lexiflow.operators.names import safe_name, unique_paths
    rows = [("1", "d", "R", ".txt"), ("2", "D", "r", ".TXT"), ("3", "d", "R_2", ".txt"), ("4", "d", "R", ".md"), ("5", "", "R", ".txt"),
            ("6", "d", "R", ".txt"), ("7", "d", "R_2", ".txt"), ("8", "d", "noext", "")]
    got = {r.path: r.path_out for r in unique_paths(spark.createDataFrame(rows, "path string, dir_en string, stem string, suffix string")).collect()}
    assert len({p.lower() for p in got.values()}) == len(rows)
    assert got == {"1": "d/R.txt", "2": "D/r_3.TXT", "3": "d/R_2.txt", "4": "d/R.md", "5": "R.txt", "6": "d/R_4.txt", "7": "d/R_2_2.txt", "8": "d/noext"}
    df = spark.createDataFrame([("../x/y",), ("..",), ("",), ("a\\b\n",), (None,), ("ok.",)], "n string")
    from pyspark.sql import functions as F
    assert [r.s for r in df.select(safe_name(F.col("n"), F.lit("O")).alias("s")).collect()] == ["..-x-y", "O", "O", "a-b-", "O", "ok."]


def test_what_cannot_be_read_or_parsed_is_an_error_row(spark, tmp_path):
    """A dangling link, a bad XML byte, a huge CSV field and deep folders beside good files."""
    src = tmp_path / "src"
    deep = src
    for i in range(60):
        deep = deep / f"d{i}"
    deep.mkdir(parents=True)
    (deep / "日.txt").write_text("日本\n", encoding="utf-8")
    os.symlink(src / "nowhere", src / "gone.txt")
    for i in range(20):
        (src / f"良{i}.txt").write_text("日本\n", encoding="utf-8")
    (src / "大.csv").write_text("日本," + "あ" * 200_000 + "\n", encoding="utf-8")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", b"<sst><si><t>\xff\xfe</t></si></sst>")
    (src / "悪.xlsx").write_bytes(buf.getvalue())
    dst = tmp_path / "out"
    res = translate_folder(spark, str(src), str(dst), MockTranslator(), S)
    m = mock_translate
    errors = {(r.path, r.stage) for r in res.errors.collect()}
    assert ("gone.txt", "list") in errors and ("gone.txt", "read") in errors and ("悪.xlsx", "parse") in errors
    assert {p for p, _ in errors} == {"gone.txt", "悪.xlsx"}
    assert not (dst / "gone.txt").exists()
    assert (dst / "悪.xlsx").read_bytes() == buf.getvalue()
    for i in range(20):
        assert (dst / f"{m(f'良{i}')}.txt").read_text("utf-8") == m("日本") + "\n"
    out = deep.relative_to(src)
    assert (dst / out / f"{m('日')}.txt").read_text("utf-8") == m("日本") + "\n"
    assert (dst / f"{m('大')}.csv").read_text("utf-8").startswith(m("日本") + "," + m("あ" * 200_000))
    with pytest.raises(FileNotFoundError):
        translate_folder(spark, str(tmp_path / "missing"), str(tmp_path / "o2"), MockTranslator(), S)


def test_word_text_with_tabs_breaks_and_nested_tables(spark):
    from lexiflow.plans.packages import docx_paragraphs, py_rewrite_paragraphs
    xml = ('<w:body><w:p><w:r><w:tabs><w:tab w:val="left"/></w:tabs><w:t>日</w:t><w:tab/><w:t>本</w:t><w:br/><w:t>語</w:t></w:r></w:p>'
           '<w:tbl><w:p><w:t>外</w:t></w:p><w:tbl><w:p><w:t>内</w:t></w:p></w:tbl><w:p><w:t>外2</w:t></w:p></w:tbl><w:p><w:t>後</w:t></w:p></w:body>')
    df = spark.createDataFrame([(1, xml)], "id int, xml string")
    got = [(r.i, r.text) for r in docx_paragraphs(df, ["id"]).orderBy("i").collect()]
    assert got == [(0, "日\t本\n語"), (1, "後"), (2, "外"), (3, "内"), (4, "外2")]
    out = py_rewrite_paragraphs(xml, {"日\t本\n語": "Japanese <x>", "後": "after"})
    assert '<w:tab w:val="left"/></w:tabs><w:t>Japanese &lt;x&gt;</w:t><w:t></w:t><w:t></w:t></w:r>' in out
    assert "<w:t>after</w:t>" in out and "<w:t>外</w:t>" in out


def test_names_are_derived_from_the_texts_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lexiflow.plans import catalog
    sf = "/root/testdata/sf0.001"
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name
    files = catalog.jp_files
    monkeypatch.setattr(catalog, "_RUNS", {})
    monkeypatch.setattr(catalog, "jp_files", lambda s, d: files(s, d).withColumn("name", F.udf(counted)("name")))
    catalog._names_run(spark, sf)
    assert seen.value == files(spark, sf).count()      # each stage derived them again
