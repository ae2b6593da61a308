from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators import update
from docloom.plans import profile


def document(spark):
    make = spark.createDataFrame
    page = "page_width_mm double, page_height_mm double, orientation string, margin_top_mm double, margin_bottom_mm double, margin_left_mm double, margin_right_mm double, gutter_mm double"
    return {
        "of": make([(1, "p", None), (2, "p", 3), (3, "q", None)], "doc_id int, profile_id string, chapter_start int"),
        "paragraphs": make([(1, 0, "第1章 一", "Heading 1"), (1, 1, "1.2 二 [[PAGE]]", "Normal"), (2, 0, "x", "Quote"), (3, 0, "1.2 y", "Heading 2")], "doc_id int, place int, text string, style string"),
        "styles": make([(1, "Quote", "bold", "x")], "doc_id int, style string, key string, value string"), "direct": make([(1, 1, "bold", "x"), (1, 1, "size", "9")], "doc_id int, place int, key string, value string"),
        "sections": make([(i, 0, 100.0, 200.0, "portrait", 1.0, 2.0, 3.0, 4.0, 0.0) for i in (1, 2, 3)], f"doc_id int, idx int, {page}"),
        "tables": make([(1, 0, "Old", None, None, 1)], "doc_id int, table int, style string, alignment string, listed array<int>, caption_row int"),
        "rows": make([(1, 0, 0, False, True), (1, 0, 1, True, True)], "doc_id int, table int, row int, is_header boolean, cant_split boolean"),
        "counts": make([(1, 2, 5), (2, 0, 0), (3, 1, 1)], "doc_id int, fields int, equations int"), "targets": make([(1, 3, 1)], "doc_id int, ord int, place int"),
    }


RULES = "profile_id string, ord int, id string, status string, application string, selector_kind string, selector_value string, handler string, style string, by_map boolean"


def rules(spark, *given):
    rows = [(p, i, f"r{i}", status, how, "", "", handler, style, by_map) for i, (p, status, how, handler, style, by_map, _) in enumerate(given)]
    props = [(p, f"r{i}", k, v) for i, (p, *_, values) in enumerate(given) for k, v in values.items()]
    return spark.createDataFrame(rows, RULES), spark.createDataFrame(props, "profile_id string, rule_id string, key string, value string")


def test_later_rules_read_what_earlier_ones_wrote(spark):
    auto = ("approved", "automatic")
    given = rules(
        spark, ("p", *auto, "sections", None, False, {"orientation": "landscape"}), ("p", *auto, "sections", None, False, {"margin_top_ratio": "0.1", "margin_inner_ratio": "0.2"}),
        ("p", *auto, "fields", None, False, {"convert_explicit_markers": "true", "update_on_open": "true"}), ("p", *auto, "styles", "Heading 2", True, {"bold": "true"}),
        ("p", *auto, "fields", None, False, {"strip_manual_heading_prefixes": "true", "mark_fields_dirty": "true", "rebuild_heading_numbering": "true"}), ("p", *auto, "styles", "Heading 2", False, {"italic": "true"}),
        ("p", *auto, "tables", None, False, {"repeat_header_row": "true", "prevent_row_split": "false", "alignment": "center"}), ("p", "draft", "automatic", "styles", "Quote", False, {"bold": "no"}),
        ("p", "approved", "manual_review", "styles", "Quote", False, {}), ("q", *auto, "sections", None, False, {"margin_top_ratio": "0.5"}), ("q", *auto, "fields", None, False, {"strip_manual_heading_prefixes": "true"}),
        ("p", *auto, "equations", None, False, {}),
    )
    out, changes, manual, faults = profile.apply_profile(document(spark), *given)
    assert [tuple(r) for r in faults.collect()] == [(3, "margin_top_ratio")]
    assert {(r.doc_id, r.ord): r.targets for r in changes.collect()} == {
        (1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 2 + 3 + 4, (1, 5): 1, (1, 6): 1, (1, 11): 5, (2, 0): 1, (2, 1): 1, (2, 2): 1, (2, 3): 0, (2, 4): 4, (2, 5): 0, (2, 6): 0, (2, 11): 0,
    }
    assert sorted(tuple(r) for r in manual.collect()) == [(1, 8, "r8"), (2, 8, "r8")]
    pages = {r.doc_id: (r.page_width_mm, r.page_height_mm, r.orientation, round(r.margin_top_mm, 6), round(r.margin_left_mm, 6)) for r in out["sections"].collect()}
    assert pages == {1: (200.0, 100.0, "landscape", 10.0, 40.0), 2: (200.0, 100.0, "landscape", 10.0, 40.0), 3: (100.0, 200.0, "portrait", 1.0, 3.0)}
    assert sorted((r.doc_id, r.place, r.text, r.style) for r in out["paragraphs"].collect()) == [(1, 0, "一", "Heading 1"), (1, 1, "二 ", "Heading 2"), (2, 0, "x", "Quote"), (3, 0, "1.2 y", "Heading 2")]
    assert sorted((r.row, r.is_header, r.cant_split) for r in out["rows"].collect()) == [(0, True, False), (1, True, True)]
    assert [(r.style, r.alignment, r.centred) for r in out["tables"].collect()] == [("Old", "center", True)]
    flags = {r.doc_id: (r.update_on_open, r.dirty, r.fields, r.levels, r.start) for r in out["flags"].collect()}
    assert flags == {1: (True, 3, 3, 4, 1), 2: (True, 0, 0, 4, 3)}
    assert sorted((r.doc_id, r.style) for r in out["made"].collect()) == [(1, "Heading 2"), (2, "Heading 2")]
    assert sorted((r.doc_id, r.place, r.key) for r in out["direct"].collect()) == [(1, 1, "size")]


def test_spans_of_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, "图 1", True, "a"), (1, 0, 1, ".2-", True, "b"), (1, 0, 2, "3 梁", True, "c"), (2, 0, 0, "ab", True, "d"), (2, 0, 1, "cd", False, "e"), (3, 0, 0, "", True, "f")], "doc_id int, place int, run int, text string, plain boolean, bold string")
    edits = spark.createDataFrame([(1, 0, 2, 7, "9.9"), (2, 0, 1, 3, "x"), (3, 0, 0, 1, "y"), (4, 0, 0, 1, "z")], "doc_id int, place int, start int, stop int, replacement string")
    after, faults = update.spliced(runs, edits)
    assert [(r.text, r.bold) for r in after.where("doc_id = 1").orderBy("run").collect()] == [("图 9.9", "a"), ("", "b"), (" 梁", "c")]
    assert sorted((r.doc_id, r.fault) for r in faults.collect()) == [(2, "unsupported_object"), (3, "span"), (4, "span")]
    assert [r.text for r in after.where("doc_id = 2").orderBy("run").collect()] == ["ab", "cd"]
    prefix, _ = update.spliced(runs, spark.createDataFrame([(1, 0, 0, 4, None), (2, 0, 0, 1, ""), (2, 0, 0, 2, "")], "doc_id int, place int, start int, stop int, replacement string"))
    assert [r.text for r in prefix.orderBy("doc_id", "run").collect()] == ["", "2-", "3 梁", "ab", "cd", ""]


def test_a_rule_works_out_each_pattern_once_a_use(spark):
    """What stands twice in a fold is worked out twice, and so is all that it holds: 14 patterns, not a product of uses."""
    step = profile.paragraph_step(F.col("s"), F.col("r"))
    step = step if isinstance(step, Column) else F.struct(*step.values())
    assert str(step).lower().count("regexp") <= 14


def test_odd_paragraphs_of_a_profile(spark):
    """A null text, a null style, markers that are there once others are gone, and a rule for too few levels."""
    auto = ("approved", "automatic", "fields", None, False)
    doc = document(spark)
    doc["paragraphs"] = spark.createDataFrame([(1, 0, None, "Heading 1"), (1, 1, "1.2 [[PA[[PAGE]]GE]]x", None), (1, 2, "[[PAGE]]1.2[[PAGE]] y", "Heading 2"), (1, 3, "1.2.3 z", "Heading 3"), (1, 4, "[[page", "Heading 1")], "doc_id int, place int, text string, style string")
    given = rules(spark, ("p", *auto, {"convert_explicit_markers": "true", "strip_manual_heading_prefixes": "true", "heading_levels": "2"}), ("p", *auto, {"convert_explicit_markers": "true"}), ("p", *auto, {"strip_manual_heading_prefixes": "true", "heading_levels": "2"}))
    out, changes, _, _ = profile.apply_profile(doc, *given)
    assert sorted((r.place, r.text, r.style) for r in out["paragraphs"].where("doc_id = 1").collect()) == [(0, None, "Heading 1"), (1, "1.2 x", None), (2, "y", "Heading 2"), (3, "1.2.3 z", "Heading 3"), (4, "[[page", "Heading 1")]
    assert {r.ord: r.targets for r in changes.where("doc_id = 1").collect()} == {0: 3, 1: 1, 2: 1}
