import io
import zipfile

from docloom.functions import text as T
from docloom.operators import binding, inventory
from docloom.sources import docx, word
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def package(body, **extra):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, data in extra.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


FIELD = (
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:bookmarkStart w:name="here"/><w:r><w:t>See </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r>'
    '<w:r><w:instrText> RE</w:instrText></w:r><w:r><w:instrText>F there \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>'
    '<w:r><w:t>result</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:tab/><w:t>end</w:t></w:r></w:p>'
    '<w:p><w:fldSimple w:instr=" REF here "><w:r><w:t>shown</w:t></w:r></w:fldSimple><m:oMath><m:r/></m:oMath></w:p>'
)


def files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(FIELD, word__media__x_dot_png=b"\x01", word__footnotes_dot_xml=f"<w:footnotes {W}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>"))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"other")
    return docx.packages(spark, str(tmp_path)).withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1))


def test_relations_of_a_package(spark, tmp_path):
    f = files(spark, tmp_path)
    assert sorted(map(tuple, docx.faults(f).collect())) == [("b.docx", "not_a_zip")] and docx.fault_of(b"") == "empty"
    got = sorted((r.part, r.pos, r.style, r.text) for r in docx.paragraphs(f).collect())
    assert got == [("word/document.xml", 0, "Heading1", "See \tend"), ("word/document.xml", 1, None, ""), ("word/footnotes.xml", 0, None, "note")]
    assert docx.objects(f).collect()[0]["name"] == "word/media/x.png"
    c = docx.counts(f).collect()[0]
    assert (c.fields, c.equations, c.drawings, c.footnotes, c.comments) == (4, 1, 0, 1, 0)
    assert docx.formulas(f).count() == 1


def test_fields_and_references(spark, tmp_path):
    f = files(spark, tmp_path)
    found = docx.fields(f)
    assert sorted(r.instruction for r in found.collect()) == ["REF here", "REF there \\h"]
    refs = found.where(T.field_kind(F.col("instruction")).isin("REF", "PAGEREF")).select(T.field_argument(F.col("instruction")).alias("name"))
    assert [r.name for r in binding.unresolved(refs, docx.bookmarks(f), "name").collect()] == ["there"]
    assert {r.kind: r.n for r in inventory.kind_counts(found, "instruction").collect()} == {"REF": 2}


STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="Heading 1"/><w:basedOn w:val="N"/><w:pPr><w:keepNext/><w:jc w:val="both"/>
<w:spacing w:before="240" w:after="60" w:line="360" w:lineRule="auto"/><w:ind w:left="420" w:hanging="210" w:firstLineChars="200"/></w:pPr>
<w:rPr><w:rFonts w:ascii="Arial" w:eastAsia="SimHei"/><w:b w:val="0"/><w:i/><w:color w:val="auto"/><w:sz w:val="29"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="N"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="300" w:lineRule="exact"/></w:pPr></w:style></w:styles>"""
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="H1"/><w:rPr><w:b/></w:rPr></w:pPr><w:r><w:t>One</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t> two</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:trPr><w:tblHeader/><w:cantSplit w:val="0"/></w:trPr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
    '<w:tr><w:trPr><w:cantSplit/></w:trPr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:bookmarkStart w:name="x"/></w:p>'
    '<w:sectPr><w:headerReference/><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:left="720" w:gutter="0" w:header="720"/><w:titlePg/><w:pgNumType w:start="3"/></w:sectPr>'
)


def parsed(spark, **extra):
    content = package(BODY, word__styles_dot_xml=STYLES, word__settings_dot_xml=f"<w:settings {W}><w:mirrorMargins/></w:settings>", **extra)
    return docx.nodes(spark.createDataFrame([("a", bytearray(content))], "doc_id string, content binary")).cache()


def test_places_rows_and_runs(spark):
    n = parsed(spark)
    got = [tuple(r)[:] for r in word.paragraphs(n).orderBy("seq").select("kind", "table", "row", "cell", "paragraph", "style_id", "text").collect()]
    body, cell = "body_paragraph", "table_cell_paragraph"
    assert got == [
        (body, None, None, None, 0, "H1", "One two"), (body, None, None, None, 1, None, " "), (body, None, None, None, 2, None, ""),
        (cell, 0, 0, 0, 0, None, "a"), (cell, 0, 0, 0, 1, None, ""), (cell, 0, 0, 1, 0, None, "b"), (cell, 0, 1, 0, 0, None, "c"),
    ]
    assert sorted(tuple(r) for r in word.rows(n).select("table", "row", "is_header", "cant_split", "cells").collect()) == [(0, 0, True, False, 2), (0, 1, False, True, 1)]
    first = word.runs(n).where("text in ('One', ' two')").orderBy("run").select("run", "start", "stop", "text", "bold").collect()
    assert [tuple(r) for r in first] == [(0, 0, 3, "One", None), (1, 3, 7, " two", True)]
    held = {r.p: r.payload for r in word.payloads(n).collect()}
    assert [held[p] for p in sorted(held)] == [True, True, False, True, True, False, True]
    assert len({r.signature for r in word.signatures(n).collect()}) == 2


def test_styles_sections_and_settings(spark):
    n = parsed(spark)
    s = {r.style: r for r in word.styles(n).collect()}
    h = s["Heading 1"]
    assert (h.font_name, h.font_name_east_asia, h.font_name_complex_script, h.font_size_pt, h.bold, h.italic, h.color_hex) == ("Arial", "SimHei", None, 14.5, False, True, None)
    assert (h.alignment, h.space_before_pt, h.space_after_pt, h.line_spacing, h.line_spacing_rule, h.line_spacing_pt) == ("justify", 12.0, 3.0, 1.5, "one_point_five", None)
    assert (h.first_line_indent_pt, h.first_line_indent_chars, h.left_indent_pt, h.keep_with_next, h.widow_control, h.based_on) == (-10.5, 2.0, 21.0, True, None, "N")
    assert (s["Normal"].line_spacing, s["Normal"].line_spacing_rule, s["Normal"].line_spacing_pt) == (None, "exact", 15.0)
    (x,) = word.with_toggles(word.sections(n), word.settings(n)).collect()
    assert (round(x.page_width_mm), round(x.page_height_mm), x.margin_top_mm, x.margin_left_mm, x.margin_right_mm, x.starts_at, x.headers, x.footers) == (210, 297, 25.4, 12.7, None, 3, 1, 0)
    assert x.different_first_page_header_footer and x.mirror_margins and not x.odd_and_even_pages_header_footer


def test_damaged_parts_are_faults_not_failures(spark):
    content = bytearray(package(BODY, word__styles_dot_xml="<w:styles", word__media__x_dot_png=b"1"))
    f = spark.createDataFrame([("a", content), ("b", bytearray(b"x"))], "doc_id string, content binary")
    assert sorted(map(tuple, docx.faults(f).collect())) == [("a", "bad_part:word/styles.xml"), ("b", "not_a_zip")]
    assert {r.part for r in docx.nodes(f).collect()} == {"word/document.xml"}


def test_written_packages_read_back(spark):
    rows = [("a", 0, "x < y & \x07 \"q\"\r", "Title"), ("a", 1, "", None), ("a", 2, "  two  ", None), ("b", 0, "\t日本😀", None)]
    p = spark.createDataFrame(rows, "doc_id string, seq int, text string, style string")
    packages = word.packed(p.select("doc_id", "seq", word.paragraph_xml(F.col("text"), F.col("style")).alias("xml")))
    back = sorted((r.doc_id, r.seq, r.text, r.style_id) for r in word.paragraphs(docx.nodes(packages)).collect())
    assert back == [(d, s, t.replace("\x07", "\ufffd"), style) for d, s, t, style in rows]
