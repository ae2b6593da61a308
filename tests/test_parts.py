import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from docloom.operators import breaks, numbering
from docloom.plans import apply
from docloom.sources import docx, parts, rules, word
from docloom.sources.stored import stored

W = parts.SPACES
RELS = f'<Relationships xmlns="{parts.RELATIONSHIPS}">%s</Relationships>'


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def package(body, **named):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, data in named.items():
            z.writestr({"rels": "word/_rels/document.xml.rels", "numbering": "word/numbering.xml", "styles": "word/styles.xml"}.get(name, f"word/{name}.xml"), data)
    return bytearray(out.getvalue())


def nodes(spark, **packages):
    return stored(docx.nodes(spark.createDataFrame(list(packages.items()), "doc_id string, content binary"), parts.PARTS))


def p(text, inner=""):
    return f"<w:p>{inner and f'<w:pPr>{inner}</w:pPr>'}<w:r><w:t>{text}</w:t></w:r></w:p>"


def edge(i, target, mode=""):
    return f'<Relationship Id="{i}" Type="{parts.KINDS}/header" Target="{target}"{mode}/>'


def test_headers_are_found_by_their_relationships(spark):
    refs = lambda *ids: "".join(f'<w:headerReference r:id="{i}"/>' for i in ids)
    sect = lambda inner: f"<w:p><w:pPr><w:sectPr>{inner}</w:sectPr></w:pPr></w:p>"
    body = sect(refs("a")) + sect(refs("b", "c")) + sect(refs("gone")) + sect(refs("out")) + sect(refs("bad")) + sect("<w:footerReference/><w:titlePg/>") + '<w:sectPr><w:pgNumType w:start="0"/><w:type w:val="nextPage"/><w:pgMar/></w:sectPr>'
    rels = RELS % (edge("a", "header1.xml") + edge("b", "./header2.xml") + edge("c", "/word/header3.xml") + edge("out", "http://x", ' TargetMode="External"') + edge("bad", "header4.xml") + edge("up", "../other.xml"))
    head = lambda inner: f"<w:hdr {W}>{inner}</w:hdr>"
    n = nodes(spark, x=package(body, rels=rels, header1=head(p(" ")), header2=head("<w:p/>"), header3=head("<w:p><w:r><w:drawing/></w:r></w:p>"), header4="<no"))
    assert {r.id: r.target for r in parts.relationships(n).collect()} == {"a": "word/header1.xml", "b": "word/header2.xml", "c": "word/header3.xml", "out": None, "bad": "word/header4.xml", "up": "other.xml"}
    got = {r.idx: r for r in parts.section_evidence(n).collect()}
    assert [got[i].header_footer_has_payload for i in range(7)] == [False, True, True, True, True, False, False]
    assert [got[i].header_reference_count for i in range(7)] == [1, 2, 1, 1, 1, 0, 0] and got[5].footer_reference_count == 0
    assert got[0].empty_header_footer_references and got[0].safe_to_delete and not got[5].safe_to_delete
    assert (got[6].page_number_start, got[6].section_type, got[6].has_page_geometry, got[6].safe_to_delete) == ("0", "nextPage", True, False)


def test_sections_that_hold_nothing_go_from_the_end(spark):
    sect = "<w:sectPr/>"
    table = "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    body = p("one", sect) + "<w:p/>" + table + f"<w:p><w:pPr>{sect}</w:pPr></w:p>" + f'<w:p><w:pPr><w:keepNext/>{sect}</w:pPr></w:p>' + "<w:p/>" + '<w:sectPr><w:pgSz w:w="1"/></w:sectPr>'
    n = nodes(spark, a=package(body), b=package(p("x") + sect), c=package(p("x", sect) + p("y") + sect))
    found = breaks.trailing_empty(n)
    got = sorted((r.doc_id, r.section, r.previous_boundary_paragraph, r.previous_boundary_sha256, r.confidence, r.approved_delete) for r in found.collect())
    assert got == [("a", 1, 0, sha("one"), "high", False), ("a", 2, 2, sha(""), "high", False), ("a", 3, 3, sha(""), "high", False)]
    yes = found.withColumn("approved_delete", F.lit(True))
    left, faults = breaks.without_trailing(n, yes)
    assert faults.count() == 0
    assert [(r.tag, r.section) for r in left.where("doc_id = 'a'").orderBy("child").collect()] == [("w:p", 0), ("w:sectPr", 0)]
    left, faults = breaks.without_trailing(n, yes.where("section > 1"))
    kept = left.where("doc_id = 'a'").orderBy("child").collect()  # the empty boundary goes with what follows
    assert [r.tag for r in kept] == ["w:p", "w:p", "w:tbl", "w:sectPr"] and kept[-1].section == 1
    left, faults = breaks.without_trailing(n, yes.where("section > 2"))
    assert [r.tag for r in left.where("doc_id = 'a'").orderBy("child").collect()] == ["w:p", "w:p", "w:tbl", "w:p", "w:p", "w:sectPr"] or faults.count() == 0
    for wrong, fault in ((yes.where("section = 1"), "not_from_the_end"), (yes.withColumn("previous_boundary_sha256", F.lit("x")), "boundary_changed"), (yes.withColumn("previous_boundary_paragraph", F.lit(99)), "boundary_missing")):
        left, faults = breaks.without_trailing(n, wrong)
        assert [(r.doc_id, r.fault) for r in faults.collect()] == [("a", fault)] and left.where("doc_id = 'a'").count() == 7


def test_sections_are_told_by_nodes_without_their_text(spark):
    """Hashes and whether a text is blank stand for the text: the same sections, boundaries and faults."""
    sect = "<w:pPr><w:sectPr><w:headerReference r:id=\"h\"/></w:sectPr></w:pPr>"
    more = f'<w:p>{sect}<w:r><w:tab/><w:t>a</w:t><w:br/><w:t>é</w:t><w:cr/></w:r><w:r><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r><w:r><w:t> b</w:t></w:r></w:p>'
    bodies = {"a": p("x") + more + f"<w:p>{sect}</w:p><w:p/><w:sectPr/>", "b": f"<w:p>{sect}<w:r><w:t> \t</w:t></w:r></w:p><w:sectPr/>", "c": more + "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:sectPr/>"}
    files = spark.createDataFrame([(k, package(b, rels=RELS % edge("h", "header1.xml"), header1=f"<w:hdr {W}><w:p/></w:hdr>")) for k, b in bodies.items()], "doc_id string, content binary")
    plain, hashed = stored(docx.nodes(files, parts.PARTS)), stored(parts.without_text(docx.nodes(files, parts.PARTS, hashed=True)))
    assert "text" not in hashed.columns and hashed.count() == plain.count()
    of = lambda n: sorted((r.doc_id, r.node, bytes(r.text_sha256).hex()) for r in parts.paragraph_hashes(n).collect())
    assert of(hashed) == of(plain)
    assert {h for _, _, h in of(hashed)} == {sha("x"), sha("\ta\né\n b"), sha(""), sha(" \t")}
    found = breaks.trailing_empty(plain)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(breaks.trailing_empty(hashed)) == rows(found) and found.count() == 4
    yes = found.withColumn("approved_delete", F.lit(True))
    for approved in (yes, yes.where("section = 1"), yes.withColumn("previous_boundary_sha256", F.lit("x")), yes.withColumn("previous_boundary_paragraph", F.lit(0)), yes.withColumn("previous_boundary_paragraph", F.lit(9))):
        for one, other in zip(breaks.without_trailing(plain, approved), breaks.without_trailing(hashed, approved), strict=True):
            assert rows(one) == rows(other)


NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="0"><w:start w:val="4"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="9"/></w:lvl></w:abstractNum>
<w:num w:numId="5"><w:abstractNumId w:val="3"/>%s</w:num></w:numbering>"""
OVER = '<w:lvlOverride w:ilvl="1"><w:startOverride w:val="8"/></w:lvlOverride><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride>'


def styles(num):
    link = num and f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{num}"/></w:numPr>'
    return f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/><w:pPr>{link}</w:pPr></w:style></w:styles>'


def test_where_a_numbering_starts_and_a_new_one(spark):
    made = {x: package("", numbering=NUMBERING % o, styles=styles(s)) for x, o, s in (("own", "", "5"), ("over", OVER, "5"), ("other", OVER, "6"), ("none", "", ""))}
    found = parts.numberings(nodes(spark, **made))
    assert dict(map(tuple, numbering.heading_starts(found).collect())) == {"own": 4, "over": 7, "other": None}
    wanted = spark.createDataFrame([("own", 2, 6), ("over", 4, 1), ("other", 5, 1), ("none", 1, 0)], "doc_id string, levels int, chapter_start int")
    new, faults = numbering.rebuilt(found, wanted)
    assert dict(map(tuple, faults.collect())) == {"other": "heading_levels", "none": "chapter_start"}
    written = numbering.numbering_xml(new).unionByName(spark.createDataFrame([(x, word.MAIN, f"<w:document {W}/>") for x in made], "doc_id string, name string, content string"))
    again = parts.numberings(docx.nodes(parts.packed(written), parts.PARTS))
    again["links"] = new["links"]
    assert dict(map(tuple, numbering.heading_starts(again).collect())) == {"own": 6, "over": 1, "other": None}
    assert {(r.num, r.abstract) for r in again["nums"].where("doc_id = 'own'").collect()} == {("5", "3"), ("6", "4")}
    assert [r.text for r in again["levels"].where("doc_id = 'over' and text is not null").orderBy("level").collect()] == ["第%1章", "%1.%2", "%1.%2.%3", "%1.%2.%3.%4"]
    assert {(r.style_id, r.num, r.level) for r in new["links"].where("doc_id = 'own'").collect()} == {("H1", "6", "0"), ("Heading2", "6", "1")}


def test_a_map_in_its_own_words_is_applied_to_a_package(spark, tmp_path):
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(text)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("表 1.1-2 梁", "<w:gridSpan w:val=&quot;2&quot;/>".replace("&quot;", chr(34)))}</w:tr><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("c")}{cell("d")}</w:tr></w:tbl>'
    body = p("目录") + p("1 old") + p("第1章 总则") + table + p("图 1.1-1 柱") + p("end", "<w:sectPr/>") + "<w:p/><w:sectPr/>"
    n = nodes(spark, a=package(body), b=package(body))
    first = "表 1.1-2 梁␟表 1.1-2 梁"
    whole = f"{first}␞a␟b␞c␟d"
    locator = {"kind": "table_cell_paragraph", "table": 0, "row": 0, "cell": 0, "paragraph": 0}
    caption = "图 1.1-1 柱"
    value = {
        "schema_version": "1.2", "status": "approved", "source_content_fingerprint_sha256": "f", "conflicts": [], "paragraph_roles": [],
        "toc_ranges": [{"start_paragraph": 0, "end_paragraph": 1, "paragraph_sha256": [sha("目录"), sha("1 old")], "levels": 2, "approved": True}],
        "headings": [{"paragraph": 2, "level": 1, "cached_number": [1], "text_sha256": sha("第1章 总则"), "approved": True}, {"paragraph": 3, "level": 1, "text_sha256": "x", "approved": False}],
        "captions": [
            {"locator": locator, "text_sha256": sha("表 1.1-2 梁"), "label": "表", "action": "move_caption", "migrate_outside_table": True, "approved": True},
            {"locator": {"kind": "body_paragraph", "paragraph": 3}, "text_sha256": sha(caption), "label": "图", "sequence_name": "Figure", "action": "convert_to_seq", "heading_level": 2, "cached_hierarchy": "1.1", "cached_sequence": "1", "approved": True},
        ],
        "tables": [{"table": 0, "kind": "data", "table_text_sha256": sha(whole), "first_row_sha256": sha(first), "caption_row": 0, "header_rows": [1], "repeat_header_rows": [1], "prevent_normal_row_split": True, "approved": True}],
        "trailing_empty_sections": [{"section": 1, "previous_boundary_paragraph": 4, "previous_boundary_sha256": sha("end"), "approved_delete": True, "confidence": "high", "evidence": {"header_footer_has_payload": False, "safe_to_delete": True}}],
        "numbering": {"mode": "single_chapter", "chapter_start": 1, "heading_levels": 4, "expected_progression": "strict", "approved": False, "anomalies": []},
    }
    bad = value | {"headings": [value["headings"][0] | {"text_sha256": "old"}]}
    for name, x in (("a", value), ("b", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x, ensure_ascii=False))
    maps = rules.maps(spark, str(tmp_path)).withColumn("doc_id", F.regexp_extract("map_id", r"(\w)\.json$", 1))
    assert maps.where("trailing_empty_sections[0].evidence.safe_to_delete and tables[0].table_text_sha256 is not null and source_content_fingerprint_sha256 = 'f'").count() == 2
    result, changes, faults = apply.apply_map(apply.document_of(n), apply.entries(maps))
    assert [tuple(r) for r in faults.collect()] == [("b", 1, "heading_changed")]
    assert [(r.doc_id, r.kind, r.targets) for r in changes.orderBy("step").collect()] == [("a", k, c) for k, c in (("toc", 2), ("headings", 1), ("tables", 1), ("captions", 2), ("trailing_sections", 1))]
    shown = lambda doc: [(r.text, r.style) for r in result["paragraphs"].where(F.col("doc_id") == doc).orderBy("place").collect()]
    normal = [(x, "Normal") for x in ("a", "b", "c", "d")]
    assert shown("a") == [("", "Normal"), ("", "Normal"), ("第1章 总则", "Heading 1"), ("表 1.1-2 梁", "Caption"), *normal, ("图 - 柱", "Caption"), ("end", "Normal"), ("", "Normal")]
    assert shown("b")[:4] == [("目录", "Normal"), ("1 old", "Normal"), ("第1章 总则", "Normal"), ("表 1.1-2 梁", "Normal")]
    assert [(r.at, r.instruction, r.shown) for r in result["fields"].orderBy("place", "nth").collect()][1:] == [(2, "STYLEREF 2 \\s", "1.1"), (3, "SEQ Figure \\* ARABIC \\s 2", "1")]
    assert [(r.row, r.is_header, r.cant_split) for r in result["rows"].where("doc_id = 'a'").orderBy("row").collect()] == [(0, True, True), (1, False, True)]
    assert result["rows"].where("doc_id = 'b'").count() == 3 and {(r.action, r.n) for r in result["actions"].collect()} == {("move_caption", 1), ("convert_to_seq", 1)}


def test_hashes_of_tables_with_merged_cells(spark):
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(text)}</w:tc>"
    down, wide = '<w:vMerge w:val="restart"/>', '<w:gridSpan w:val="2"/>'
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{cell('u', down)}{cell('v', wide)}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('x')}<w:tc>{p('y')}{inner}{p('z')}</w:tc></w:tr></w:tbl>"
    n = nodes(spark, a=package(table + table))
    (one, two) = word.table_hashes(n).orderBy("table").collect()
    assert one.first_row_sha256 == sha("u␟v␟v") and one.table_text_sha256 == two.table_text_sha256 == sha("u␟v␟v␞u␟x␟y\nz") and one.rows == 2
    assert word.rows(n).select("table").distinct().count() == 2  # tables in cells have no number


def test_paragraphs_at_any_depth(spark):
    cell = lambda *inner: f"<w:tc>{''.join(inner)}</w:tc>"
    table = lambda *rows: "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"
    deep = table([cell(table([cell(p("e"))]), p("d"))])
    body = table([cell(p("b"), deep, p("c")), cell(p("f"))], [cell(p("g"))]) + p("a") + table([cell(p("h"))]) + "<w:sectPr/>"
    got = word.all_paragraphs(nodes(spark, x=package(body), y=package(p("only")))).orderBy("doc_id", "seq").collect()
    assert [(r.text, r.depth) for r in got if r.doc_id == "x"] == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 1), ("g", 1), ("h", 1)]
    assert [(r.text, r.place) for r in got if r.doc_id == "y"] == [("only", [0, 0])]
