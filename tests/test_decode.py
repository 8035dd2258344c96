"""S3: charset detection per file (best guess, utf-8 default, bad bytes replaced)."""

import pytest

from lexiflow.sources.text import decode_files

TEXT = "日本語の文書です。報告書と資料を確認してください。\n採用の情報は表にまとめました。\n" * 4


@pytest.mark.parametrize("enc", ["utf-8", "shift_jis", "euc_jp", "utf-16"])
def test_detects_encoding(spark, enc):
    df = spark.createDataFrame([("a.txt", TEXT.encode(enc))], "path string, content binary")
    r = decode_files(df).first()
    assert r.text.replace("\r\n", "\n").lstrip("﻿") == TEXT


def test_bom_empty_and_invalid(spark):
    rows = [("bom.txt", b"\xef\xbb\xbf" + "日本\n".encode()), ("empty.txt", b""),
            ("bad.txt", TEXT.encode() + b"\xff\xfe\xfa")]
    got = {r.path: (r.encoding, r.text) for r in decode_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["empty.txt"] == ("utf-8", "")
    assert got["bom.txt"][1].lstrip("﻿") == "日本\n"
    # no confident guess -> utf-8 with undecodable bytes replaced, text kept
    assert got["bad.txt"] == ("utf-8", TEXT + "\ufffd" * 3)
