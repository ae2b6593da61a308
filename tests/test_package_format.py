import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import comments
from docloom.sources import docx, parts, word
from docloom.sources.package_format import PackageParts, packages_to_write


def package(**named):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in named.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(PackageParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.docx").write_bytes(package(word__document_dot_xml="<a/>", word__media__x_dot_png=b"\x00\xff", word__styles_dot_xml="<s/>"))
    (folder / "sub" / "b.docx").write_bytes(package(word__document_dot_xml="<b/>", _Content="x"))
    (folder / "c.docx").write_bytes(b"no zip")
    (folder / "d.txt").write_bytes(b"")
    yield spark.read.format("docx_parts").option("path", str(folder)).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_on_parts_are_in_the_scan(source):
    assert sorted((r.doc_id, r.part) for r in source.collect()) == [("a.docx", "word/document.xml"), ("a.docx", "word/media/x.png"), ("a.docx", "word/styles.xml"), ("sub/b.docx", "_Content"), ("sub/b.docx", "word/document.xml")]
    plans = []
    for filtered, want in ((source.where("part = 'word/document.xml'"), 2), (source.where("part in ('word/styles.xml', 'no')"), 1), (source.where(F.col("part").startswith("word/") & F.col("part").endswith(".xml")), 3)):
        assert filtered.count() == want
        plans.append(filtered._jdf.queryExecution().executedPlan().toString())
    assert not any("Filter " in x for x in plans)  # the scan has taken them
    kept = source.where("length(content) > 99")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " in kept
    assert source.where("part = 'word/document.xml' and length(content) > 99").count() == 0


def test_packages_are_written_whole_or_not_at_all(spark, source, tmp_path):
    out = tmp_path / "out"
    changed = spark.createDataFrame([("a.docx", "word/styles.xml", bytearray(b"<new/>")), ("a.docx", "word/comments.xml", bytearray(b"<c/>")), ("sub/b.docx", "_Content", None)], "doc_id string, part string, content binary")
    rows = packages_to_write(source, changed)
    rows.write.format("docx_parts").option("path", str(out)).mode("append").save()
    with zipfile.ZipFile(out / "a.docx") as z:
        assert {n: z.read(n) for n in z.namelist()} == {"word/comments.xml": b"<c/>", "word/document.xml": b"<a/>", "word/media/x.png": b"\x00\xff", "word/styles.xml": b"<new/>"}
    back = spark.read.format("docx_parts").option("path", str(out)).load()
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    with pytest.raises(Exception, match="(?i)exists|a.docx"):
        rows.write.format("docx_parts").option("path", str(out)).mode("append").save()
    broken = rows.withColumn("part", F.when(F.col("doc_id") == "sub/b.docx", F.raise_error(F.lit("stop"))).otherwise(F.col("part")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("docx_parts").option("path", str(tmp_path / "other")).mode("append").save()
    assert not [f for _, _, files in os.walk(tmp_path / "other") for f in files]
    assert sorted(os.listdir(out)) == ["a.docx", "sub"]
    with pytest.raises(Exception, match="not a name"):
        rows.withColumn("doc_id", F.lit("../x.docx")).write.format("docx_parts").option("path", str(out)).mode("append").save()


def test_comments_with_anchors(spark, tmp_path):
    spark.dataSource.register(PackageParts)
    found = comments.numbered(spark.createDataFrame([("a.docx", 1, "r2", "second & last"), ("a.docx", 0, "r1", "first"), ("a.docx", 1, "r1", "one")], "doc_id string, pos int, rule_id string, comment string"))
    ids = found.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    p = spark.createDataFrame([("a.docx", 0, "x", "H"), ("a.docx", 1, "y", None), ("a.docx", 2, "z", None)], "doc_id string, pos int, text string, style string")
    blocks = p.join(ids, ["doc_id", "pos"], "left").select("doc_id", F.col("pos").alias("seq"), comments.anchored(word.paragraph_xml(F.col("text"), F.col("style")), F.col("ids")).alias("xml"))
    main = parts.body_xml(blocks).select("doc_id", F.col("name").alias("part"), F.encode("content", "UTF-8").alias("content"))
    packages_to_write(main, comments.comments_part(found, "Review")).write.format("docx_parts").option("path", str(tmp_path / "o")).mode("append").save()
    files = docx.packages(spark, str(tmp_path / "o")).withColumn("doc_id", F.lit("a"))
    n = docx.nodes(files)
    assert [(r.paragraph, r.style_id, r.text) for r in word.paragraphs(n).orderBy("paragraph").collect()] == [(0, "H", "x"), (1, None, "y"), (2, None, "z")]
    starts = n.where("tag = 'w:commentRangeStart'").select("p", F.col("attrs")["w:id"].alias("id")).orderBy("p", "id").collect()
    assert [r.id for r in starts] == ["0", "1", "2"] and starts[1].p == starts[2].p != starts[0].p
    texts = n.where("part = 'word/comments.xml' and tag = 'w:t'").orderBy("node").collect()
    assert [r.text for r in texts] == ["first", "one", "second & last"]
    assert docx.counts(n).first().comments == 1


def test_parts_that_name_the_comments(spark):
    kinds, rels = '<Types><Default/></Types>', '<Relationships><Relationship Id="a"/></Relationships>'
    found = spark.createDataFrame([("a", "[Content_Types].xml", bytearray(kinds.encode())), ("a", "word/_rels/document.xml.rels", bytearray(rels.encode())), ("a", "word/document.xml", bytearray(b"</Types>")), ("b", "[Content_Types].xml", bytearray(kinds.encode()))], "doc_id string, part string, content binary")
    of = spark.createDataFrame([("a",), ("a",)], "doc_id string")
    got = {r.part: bytes(r.content).decode() for r in comments.made_known(found, of).collect()}
    assert set(got) == {"[Content_Types].xml", "word/_rels/document.xml.rels"}
    assert got["[Content_Types].xml"].startswith("<Types><Default/><Override PartName=\"/word/comments.xml\"") and got["word/_rels/document.xml.rels"].count("<Relationship ") == 2
    again = spark.createDataFrame([("a", k, bytearray(v.encode())) for k, v in got.items()], "doc_id string, part string, content binary")
    assert comments.made_known(again, of).count() == 0
