import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from corpusq.functions import assets, entities, text
from corpusq.operators import lexicon


def values(spark, expression, *rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expression("x").alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    got = values(spark, text.index_tokens, "청산", "가격제한 PDF", "Schpfö A 가", None, "S_{0} x^{2}", "S<sub>-15</sub> 99<SUP>th</SUP> 주<sup>3)</sup>", "별표25")
    assert got[0] == ["청산", "청산"]
    assert got[1] == ["가격제한", "가격", "격제", "제한", "가격제", "격제한", "pdf"]
    assert got[2] == ["schpf", "a"] and got[3] == []
    assert got[4][-2:] == ["s0", "x2"] and {"s15", "99th", "주3"} <= set(got[5]) and got[6] == ["별표25"]
    assert values(spark, text.tokens, "b a b 청산") == [["b", "a", "청산"]]


def test_driver_and_column_tokens_agree(spark):
    rows = ["S_{0} 청산 가격제한", "Das ist É x", "S<sub>-15</sub> PDF", ""]
    assert values(spark, text.tokens, *rows) == [lexicon.tokenize(r) for r in rows]


def test_canonical_text_and_hash(spark):
    raw = "　é a\r\nb\rc  "
    assert values(spark, text.canonical, raw) == ["é a\nb\nc"]
    assert values(spark, text.text_hash, raw) == [hashlib.sha256("é a\nb\nc".encode()).hexdigest()]


def test_small_functions(spark):
    assert values(spark, text.slug, " A/B c_d..e:f! ", "가 나", "!!!", None) == ["a-b-c-d-e-f", "가-나", "untitled", "untitled"]
    assert values(spark, text.stored_language, "EN_us", "kor", "fr", None) == ["en", "ko", "ko", "ko"]
    assert values(spark, text.filter_language, "EN_us", "kor", "fr") == ["en", "ko", None]
    assert values(spark, text.is_iso_date, "2024-02-29", "2023-02-29", "2024-2-9", "", None) == [True, False, False, True, True]
    assert values(spark, lambda x: text.windows(x, 3), "abcdefg", "", None) == [["abc", "def", "g"], [], []]
    assert values(spark, lambda x: text.limited(x, 3), "abcd", "abc") == ["abc\n\n[truncated]", "abc"]
    page = values(spark, lambda x: text.page(x, 2, 3), "abcdefg", "ab")
    assert tuple(page[0]) == ("cde", 7, True, 5) and tuple(page[1]) == ("", 2, False, 0)
    assert values(spark, lambda x: text.snippet(x, F.array(F.lit("zz")), 10), "a " * 40 + "ZZ end") == ["... a a a a a..."[:3] + ("a " * 40 + "ZZ end")[40:50] + "..."]


def test_urls_and_file_names(spark):
    got = values(spark, lambda x: entities.safe_url(F.col(x)), " https://a.b/c ", "http://u:p@a.b/", "ftp://a.b", "https://a.b/%0a", "https:///x", "", "HTTP://a.b?q#f")
    assert got == ["https://a.b/c", None, None, None, None, None, "HTTP://a.b?q#f"]
    got = values(spark, lambda x: entities.safe_attachment_url(F.col(x)), "", "/Download.do?a=1", "/Download.do#x", "/etc/passwd", "https://a.b/")
    assert got == ["", "/Download.do?a=1", None, None, "https://a.b/"]
    got = values(spark, lambda x: entities.portable_file_name(F.col(x)), "a.hwp", "", "../a", "a/b", "..", "a\x01")
    assert got == ["a.hwp", "", None, None, None, None]


def test_image_references(spark):
    asset = {"id": "x1", "reference_path": "images/a.png", "source_anchor": "hwp:BinData/A"}
    markup = "go ![chart](./images/a.png 't') and ![](b.png) ![r](https://h/x.png)"
    assert assets.rewrite(markup, [asset], True) == "go chart hwp:BinData/A and  r"
    assert assets.rewrite(markup, [asset], False) == "go ![chart](corpus-asset:x1) and [image] ![r](https://h/x.png)"
    df = spark.createDataFrame([(markup, [("x1", "images/a.png", "hwp:BinData/A")])], "t string, a array<struct<id string, reference_path string, source_anchor string>>")
    assert df.select(assets.search_text("t", "a")).first()[0] == assets.rewrite(markup, [asset], True)


def test_image_files(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 2, 3) + b"\x08\x02"
    gif = b"GIF89a" + struct.pack("<HH", 4, 5)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 6, -7)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 8, 9)
    wide = b"GIF87a" + struct.pack("<HH", 30000, 5)
    got = [tuple(r) for r in values(spark, lambda x: assets.inspected(F.col(x)), png, gif, bmp, jpeg, wide, b"x", None, kind="binary")]
    assert got[:4] == [("image/png", 2, 3, ""), ("image/gif", 4, 5, ""), ("image/bmp", 6, 7, ""), ("image/jpeg", 9, 8, "")]
    assert got[4][3] == "invalid_dimensions" and got[5][3] == got[6][3] == "unsupported_image"


@pytest.mark.parametrize("body,declared,want", [("none", 3, None), ("```hwp-equation\n```hwp-equation", 0, (True, False, 2)), ("```math", 0, (False, True, 1)), ("```math```hwp-equation", 9, (True, True, 9))])
def test_formula_notice(spark, body, declared, want):
    n = spark.createDataFrame([(body, declared)], "t string, d long").select(entities.formula_notice(F.col("t"), F.col("d"))).first()[0]
    assert (n and (n.source_equation_available, n.generated_latex_available, n.formula_count)) == want


def test_script_aliases_of_odd_scripts_and_one_pass_for_braces(spark):
    from pyspark.sql import functions as F

    from corpusq.functions import text

    d = spark.createDataFrame([("가_{é9} x<SUP>é나-1</sup> y_{ } z ^{a b} q<sub></sub> w_{1",)], "t string")
    assert d.select(text.script_aliases("t").alias("a")).first().a == ["가9", "zab", "x나1"]
    assert str(text.script_aliases(F.col("t"))).count("_^") == 1
