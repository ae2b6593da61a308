"""Packages are parsed and put together piece by piece: the same nodes as from the whole tree, and few of them held at once."""

import hashlib
import io
import zipfile
from xml.etree import ElementTree

import pytest

from docloom.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
PARAGRAPH = '<w:p w:id="{}"><w:pPr><w:jc w:val="x"/></w:pPr> a<!-- c -->b <m:oMath><m:r><m:t>1</m:t></m:r></m:oMath> tail<w:r><w:t>é &amp; {}</w:t></w:r></w:p>'


def package(body, name="word/document.xml"):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return zipfile.ZipFile(raw)


def from_tree(whole, name="word/document.xml"):
    for n, parent, depth, e, around in docx.walk_around(docx.part_of(whole, name)):
        tag, sha = docx.short_name(e.tag), None
        if tag == "m:oMath":
            e.tail = None
            sha = hashlib.sha256(ElementTree.canonicalize(ElementTree.tostring(e, encoding="unicode")).encode()).hexdigest()
        yield ["d", name, n, parent, depth, tag, [(docx.short_name(k), v) for k, v in e.attrib.items()], e.text, sha, *around]


@pytest.mark.parametrize("n", [0, 3, 9000])
def test_nodes_are_those_of_the_tree(n):
    whole = package("".join(PARAGRAPH.format(i, i) for i in range(n)) + "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>")
    pieces = list(docx._part_rows(whole, "d", "word/document.xml"))
    assert [r for rows, _ in pieces for r in rows] == list(from_tree(whole))
    if n == 9000:  # larger than SMALL_PART: no piece is the whole part
        assert whole.getinfo("word/document.xml").file_size > docx.SMALL_PART
        assert max(len(rows) for rows, _ in pieces) < n


@pytest.mark.parametrize("n", [3, 9000])
def test_a_part_that_is_damaged_at_its_end_gives_nothing(n):
    whole = package("".join(PARAGRAPH.format(i, i) for i in range(n)) + "<w:p>&unknown;</w:p>")
    assert docx.part_of(whole, "word/document.xml") is None
    assert not docx.is_sound(whole, "word/document.xml")
    assert [r for rows, _ in docx._part_rows(whole, "d", "word/document.xml") for r in rows] == []


def test_batches_are_bounded_and_packages_share_them(spark):
    """One package of many nodes comes in several batches; many small ones do not come in one each."""
    large = package("".join(PARAGRAPH.format(i, i) for i in range(9000))).fp.getvalue()
    small = package(PARAGRAPH.format(0, 0)).fp.getvalue()
    sizes = []

    class Files:
        sparkSession = spark

        def mapInArrow(self, run, schema):  # noqa: N802
            import pyarrow as pa

            for contents in ([large], [small] * 300):
                batch = pa.RecordBatch.from_arrays([pa.array(["d"] * len(contents)), pa.array(contents, pa.binary())], names=["doc_id", "content"])
                sizes.append([b.num_rows for b in run([batch])])

    docx.nodes(Files())
    assert max(sizes[0]) <= docx.NODE_ROWS and sum(sizes[0]) > 10 * docx.NODE_ROWS
    assert len(sizes[1]) < 3
