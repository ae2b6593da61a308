import pytest
from pyspark.sql import functions as F

from docloom.operators import update


def test_later_rules_win_and_direct_formats_go(spark):
    old = spark.createDataFrame([(1, "Normal", "bold", "false"), (1, "Normal", "italic", "true")], "doc_id int, style string, key string, value string")
    props = spark.createDataFrame([(1, "Normal", "bold", "true", 0), (1, "Normal", "bold", "maybe", 1), (1, "Caption", "bold", "true", 2)], "doc_id int, style string, key string, value string, ord int")
    assert sorted(map(tuple, update.styles(old, props).collect())) == [(1, "Caption", "bold", "true"), (1, "Normal", "bold", "maybe"), (1, "Normal", "italic", "true")]
    direct = spark.createDataFrame([(1, 0, "bold", "x"), (1, 0, "size", "9"), (1, 1, "bold", "y")], "doc_id int, pos int, key string, value string")
    targets = spark.createDataFrame([(1, 0, "Normal")], "doc_id int, pos int, style string")
    assert sorted(map(tuple, update.direct_formats(direct, targets, props).collect())) == [(1, 0, "size", "9"), (1, 1, "bold", "y")]


def test_sections(spark):
    df = spark.createDataFrame([(1, 0, 210.0, 297.0, 20.0, 20.0, "portrait"), (2, 0, 210.0, 297.0, 20.0, 20.0, "portrait")], "doc_id int, idx int, page_width_mm double, page_height_mm double, margin_top_mm double, margin_left_mm double, orientation string")
    props = spark.createDataFrame([(1, "landscape", 0.1, None)], "doc_id int, orientation string, margin_top_ratio double, margin_left_mm double")
    got = {r.doc_id: tuple(r)[2:] for r in update.sections(df, props).collect()}
    assert got == {1: (297.0, 210.0, 21.0, 20.0, "landscape"), 2: (210.0, 297.0, 20.0, 20.0, "portrait")}
    with pytest.raises(Exception, match="below one half"):
        update.sections(df, spark.createDataFrame([(1, 0.5)], "doc_id int, margin_top_ratio double")).collect()


def test_markers_become_fields(spark):
    p = spark.createDataFrame([(1, 4, "表 1.1-[[SEQ:Table]] x"), (1, 5, "[[REF:a]] and [[SEQ:Table]]")], "doc_id int, pos int, text string")
    f = update.fields_from_markers(p, spark.createDataFrame([(1, "b")], "doc_id int, name string"))
    assert sorted((r.pos, r.nth, r.instruction, r.known) for r in f.collect()) == [(4, 0, "SEQ Table \\* ARABIC \\s 1", True), (5, 0, "REF a \\h", False), (5, 1, "SEQ Table \\* ARABIC \\s 1", True)]
    after = p.withColumn("text", F.upper("text"))
    assert update.changes(p, after, ["doc_id", "pos"], ["text"]).where("pos = 5").count() == 1


def test_tables_and_sections_that_go(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "m", "cap"), (1, 0, 0, 1, "m", "cap"), (1, 0, 1, 0, "a", "x"), (1, 0, 1, 1, "b", "y")], "doc_id int, table int, row int, cell int, cell_id string, text string")
    left, moved = update.caption_rows_moved(cells, spark.createDataFrame([(1, 0, 0)], "doc_id int, table int, caption_row int"))
    assert sorted((r.row, r.text) for r in left.collect()) == [(0, "x"), (0, "y")] and [r.text for r in moved.collect()] == ["cap"]
    rows = spark.createDataFrame([(1, 0, 0, False, False), (1, 0, 1, False, False), (1, 1, 0, True, False)], "doc_id int, table int, row int, is_header boolean, cant_split boolean")
    t = spark.createDataFrame([(1, 0, [1], 0)], "doc_id int, table int, header_rows array<int>, caption_row int")
    assert sorted(map(tuple, update.table_rows(rows, t).collect())) == [(1, 0, 0, False, False), (1, 0, 1, True, True), (1, 1, 0, True, False)]
    s = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3)], "doc_id int, idx int")
    free = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id int, idx int")
    assert [r.idx for r in update.without_trailing(s, spark.createDataFrame([(1, 3), (1, 1)], "doc_id int, idx int"), free).orderBy("idx").collect()] == [0, 1, 2]
