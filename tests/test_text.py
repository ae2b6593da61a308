import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_headings(spark):
    texts = ["第1章 绪论", "第十二章总论", "1.2 Title", "1.2.3 Title", "1.2.3.4 T", "1.23", "1.2.3", "1.2", "no", "　１.２ Wide", None]
    assert values(spark, T.heading_level, texts) == [1, 1, 2, 3, 4, 2, 2, None, None, 2, None]
    numbers = values(spark, lambda c: T.heading_number(c, T.heading_level(c)), texts[:5])
    assert numbers == [[1], [12], [1, 2], [1, 2, 3], [1, 2, 3, 4]]


@pytest.mark.parametrize(("token", "want"), [("7", 7), ("十", 10), ("十二", 12), ("二十", 20), ("二十一", 21), ("百", None), ("一百二十", 10), ("九", 9)])
def test_numerals(spark, token, want):
    assert values(spark, T.chapter_number, [f"第{token}章 x"]) == [want]


def test_captions(spark):
    texts = ["图 4.2.1-1 1-1剖面图", "表 4.1-Synthetic title", "图 3.2-1 梁的构造", "表示一般情况", "图", "Figure 1", "图 3-2 结构平面图"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in T.caption(F.col("t")).items()]).orderBy("i").collect()]
    assert [g["label"] for g in got] == ["图", "表", "图", "表", "图", None, "图"]
    assert [g["identifier_semantics"] for g in got] == ["mixed", "publication_number", "publication_number", "unknown", "unknown", None, "drawing_mark"]
    assert (got[0]["identifier"], got[0]["identifier_start"], got[0]["identifier_stop"]) == ("4.2.1-1", 2, 9)
    assert (got[0]["hierarchy"], got[0]["sequence"], got[0]["heading_level"]) == ("4.2.1", "1", 3)
    assert got[1]["identifier"] == "4.1" and got[1]["hierarchy"] is None
    assert [g["domain_context"] for g in got[:3]] == ["architecture", "unknown", "civil_engineering"]


def test_values(spark):
    rows = [("font_name", "SimSun", "宋体", True), ("font_name", "SimHei", "宋体", False), ("font_size_pt", "12", "12.04", True), ("font_size_pt", "12", "12.2", False), ("margin_top_ratio", "0.12", "0.085", True),
            ("color_hex", "#ff0000", "FF0000", True), ("alignment", "center", "CENTER (1)", True), ("bold", "true", None, False), ("space_after_pt", None, None, True)]
    df = spark.createDataFrame(rows, "k string, e string, a string, want boolean")
    for r in df.select("*", T.same_value(F.col("k"), F.col("e"), F.col("a")).alias("got")).collect():
        assert bool(r.got) == r.want, r


def test_fields_and_markers(spark):
    assert values(spark, T.field_kind, [" REF a \\h", "toc", "123", "SEQ Figure"]) == ["REF", "TOC", "UNKNOWN", "SEQ"]
    assert values(spark, T.marker_instruction, ["[[SEQ:Figure]]", "[[REF:x]]", "[[PAGE]]", "none"]) == ["SEQ Figure \\* ARABIC \\s 1", "REF x \\h", "PAGE", None]
    assert values(spark, lambda c: T.normalised_derived(c, F.lit("Heading2")), ["1.2 [[PAGE]]Title", "Plain"]) == ["Title", "Plain"]
