import hashlib

from docloom.operators import structure


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


PARAGRAPHS = "doc_id int, part string, pos int, body_index int, text string, style string"


def test_normalised_texts(spark):
    texts = [("toc a", None), ("1.2 Title [[PAGE]]", "Heading 2"), ("图 3.2-1 梁", None), ("表 1.1-2 moved", None), ("表 - generated", "Caption"), ("图 4.1-3 captioned", None), ("表 2.2-2 manual", None), ("tail", None)]
    p = spark.createDataFrame([(1, "d", i, i, t, s) for i, (t, s) in enumerate(texts)] + [(1, "h", 0, None, "header", None), (2, "d", 0, 0, "other", None)], PARAGRAPHS)
    entry = (1, 2, 7, sha("图 3.2-1 梁"), sha("图 "), sha("3.2-1"), sha(" 梁"), "9.9-9")
    r = spark.createDataFrame([(1, 0, 2, 7, *entry[3:])], "doc_id int, ord int, start int, stop int, text_sha256 string, prefix_sha256 string, identifier_sha256 string, suffix_sha256 string, replacement string")
    args = [
        spark.createDataFrame([(1, 7)], "doc_id int, cutoff int"), r,
        spark.createDataFrame([(1, sha("表 1.1-2 moved"), False), (1, sha("表 2.2-2 manual"), True)], "doc_id int, text_sha256 string, manual boolean"),
        spark.createDataFrame([(1, 0)], "doc_id int, body_index int"), spark.createDataFrame([(1, 1, 2)], "doc_id int, body_index int, level int"), spark.createDataFrame([(1, 5)], "doc_id int, body_index int"),
    ]
    got = [(x.doc_id, x.part, x.pos, x.text) for x in structure.normalised(p, *args).collect()]
    want = ["", "Title ", "图 [[CAPTION_IDENTIFIER]] 梁", "表 moved", "表 generated", "图 captioned", "[[MOVED_MANUAL_CAPTION]]"]
    assert sorted(got) == sorted([(1, "d", i, t) for i, t in enumerate(want)] + [(1, "h", 0, "header"), (2, "d", 0, "other")])
    new = [(t if i != 2 else "图 9.9-9 梁", s) for i, (t, s) in enumerate(texts)]
    q = spark.createDataFrame([(1, "d", i, i, t, s) for i, (t, s) in enumerate(new)] + [(1, "h", 0, None, "header", None), (2, "d", 0, 0, "other", None)], PARAGRAPHS)
    prints = [sorted(map(tuple, structure.structure_fingerprint(structure.normalised(x, *args)).collect())) for x in (p, q)]
    assert prints[0] == prints[1]


def test_replacements_are_audited(spark):
    old = spark.createDataFrame([(1, 0, "图 3.2-1 梁"), (1, 1, "图 3.2-2 柱")], "doc_id int, pos int, text string")
    new = spark.createDataFrame([(1, 0, "图 14.2-1 梁"), (1, 1, "图 4.2-2 chg")], "doc_id int, pos int, text string")
    rows = [(1, 0, 2, 7, 8, sha("图 3.2-1 梁"), sha("3.2-1"), sha("梁"), "14.2-1"), (1, 1, 2, 7, 8, sha("图 3.2-2 柱"), sha("3.2-2"), sha("柱"), "4.2-2")]
    e = spark.createDataFrame(rows, "doc_id int, pos int, start int, stop int, title_start int, text_sha256 string, identifier_sha256 string, title_text_sha256 string, replacement string")
    assert sorted(map(tuple, structure.replacement_audit(old, new, e, ["doc_id", "pos"]).collect())) == [(1, 0, True, True, True), (1, 1, False, False, False)]


def test_role_targets(spark):
    p = spark.createDataFrame([(1, 0, "A", "Heading 1"), (1, 1, "B2", "Heading 2"), (1, 2, "C", "x"), (1, 3, "D2", "Caption"), (1, 4, "E2", "Caption")], "doc_id int, pos int, text string, style string")
    roles = spark.createDataFrame([(1, 0, "heading1", sha("A"), True), (1, 1, "heading_2", sha("B"), True), (1, 3, "figure_caption", sha("D"), True), (1, 4, "table_caption", sha("E"), True), (1, 9, "table_caption", sha("E"), True), (1, 2, "body", sha("C"), False)], "doc_id int, pos int, role string, text_sha256 string, approved boolean")
    c = spark.createDataFrame([(1, 3, "replace_identifier", True), (1, 4, "preserve", True)], "doc_id int, pos int, action string, approved boolean")
    status = lambda want: sorted((r.pos, r.status) for r in structure.role_targets(roles, p, c, want).collect())
    assert status("heading_1") == [(0, "ok")] and status("level_2_section") == [(1, "accepted")] and status("body") == []
    assert status("all_captions") == [(3, "accepted"), (4, "mismatch"), (9, "missing")]


def test_audits(spark):
    s = spark.createDataFrame([(1, 0, 210.0, 297.0, 25.2, 20.0, True), (1, 1, 297.0, 210.0, 60.0, 20.0, False)], "doc_id int, idx int, page_width_mm double, page_height_mm double, margin_left_mm double, margin_top_mm double, mirror_margins boolean")
    rules = spark.createDataFrame([("r", "section", "orientation", "portrait"), ("r", "section", "margin_inner_ratio", "0.12"), ("r", "section", "mirror_margins", "true"), ("r", "section", "page_size_policy", "preserve")], "rule_id string, target string, prop string, expected string")
    assert sorted((x.idx, x.prop) for x in structure.section_failures(s, rules).collect()) == [(1, "margin_inner_ratio"), (1, "mirror_margins"), (1, "orientation")]
    p = spark.createDataFrame([(1, 0, " [[PAGE]] ", "Normal"), (1, 1, "1.2 T", "Heading 2"), (1, 2, "T", "Heading 1")], "doc_id int, pos int, text string, style string")
    styles = spark.createDataFrame([(1, "Heading 1", True), (1, "Normal", True)], "doc_id int, style string, numbered boolean")
    found = structure.field_failures(p, styles, spark.createDataFrame([(1, False, 3)], "doc_id int, update_fields boolean, start int"), levels=2, chapter_start=4)
    assert sorted((x.prop, x.actual) for x in found.collect()) == [("chapter_start", "3"), ("convert_explicit_markers", " [[PAGE]] "), ("rebuild_heading_numbering", "Heading 2"), ("strip_manual_heading_prefixes", "1.2 T"), ("update_on_open", "false")]
    o = spark.createDataFrame([(1, "omml", None, None), (1, "ole", "Equation.DSMT4", None), (1, "ole", "Excel", None), (1, "image", None, "My Formula 1"), (1, "image", None, "photo")], "doc_id int, kind string, prog_id string, hint string")
    assert tuple(structure.equations(o).first()) == (1, 1, 1, 0, 1, 1, 2)
    r = spark.createDataFrame([(1, "a", "Heading 2", "s1"), (1, "b", "None", "s2")], "doc_id int, rule_id string, style string, summary string")
    assert sorted(map(tuple, structure.comments(r, p).collect())) == [(1, "a", 1, "s1"), (1, "b", 0, "s2")]
