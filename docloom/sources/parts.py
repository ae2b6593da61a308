"""Parts of a package and how they refer to each other: relationships as an edge table, sections with the evidence of the parts that they
name, the spans of sections, numberings with their overrides, and packages written from all their parts.

Everything but the writer is relational work on docx.nodes(files, PARTS), which parses each package once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import word

#: Parts of words, and the relationships of each.
PARTS = r"^word/(_rels/[^/]+\.rels|.*\.xml)$"
#: What a header or footer may hold besides text.
PICTURES = ["w:drawing", "w:object", "w:pict"]
#: How a section names its headers and its footers.
REFERENCES = ("w:headerReference", "w:footerReference")


def _filled(nodes: DataFrame) -> Column:
    """Whether a node is a text that is not blank."""
    if "filled" in nodes.columns:
        return F.col("filled")
    return (F.col("tag") == "w:t") & F.coalesce(F.rlike("text", F.lit(r"(?U)\S")), F.lit(False))


def without_text(nodes: DataFrame) -> DataFrame:
    """Of nodes with hashes all that sections, their evidence and the children of the body are told by: filled and the hashes stand for the text,
    which is then neither kept nor moved."""
    return nodes.select("doc_id", "part", "node", "parent", "tag", "attrs", "p", "ppr", "sect", "top", _filled(nodes).alias("filled"), "text_sha256")


def relationships(nodes: DataFrame) -> DataFrame:
    """doc_id, source (a part), id, kind, target: the part that it names, null for an external one."""
    found = nodes.where(F.rlike("part", F.lit(r"^word/_rels/[^/]+\.rels$")) & (F.col("tag") == "Relationship"))
    target = F.col("attrs")["Target"]
    # targets are relative to the folder of their source, which is word/
    path = F.when(target.startswith("/"), F.substring(target, F.lit(2), F.length(target))).when(target.startswith("../"), F.substring(target, F.lit(4), F.length(target)))
    path = F.coalesce(path, F.concat(F.lit("word/"), F.regexp_replace(target, r"^\./", "")))
    return found.select(
        "doc_id", F.concat(F.lit("word/"), F.regexp_extract("part", r"_rels/(.*)\.rels$", 1)).alias("source"), F.col("attrs")["Id"].alias("id"),
        F.regexp_extract(F.col("attrs")["Type"], "([^/]*)$", 1).alias("kind"), F.when(F.coalesce(F.col("attrs")["TargetMode"], F.lit("")) != "External", path).alias("target"),
    )


def part_payloads(nodes: DataFrame) -> DataFrame:
    """doc_id, part, payload: whether a part that can be read has text that is not blank, or a picture."""
    return nodes.groupBy("doc_id", "part").agg(F.bool_or(_filled(nodes) | F.col("tag").isin(PICTURES)).alias("payload"))


def section_settings(nodes: DataFrame) -> DataFrame:
    """doc_id, sect, p, idx and what they say themselves, of the section properties of the body itself and of its paragraphs, in order; p is null for
    the body's. Only they and their children move."""
    own = (F.col("tag") == "w:sectPr") & ((F.col("node") == F.col("top")) | ((F.col("parent") == F.col("ppr")) & (F.col("p") == F.col("top"))))
    has = lambda *tags: F.bool_or(F.col("tag").isin(*tags))
    refers = lambda tag: F.count_if((F.col("tag") == tag) & F.col("attrs")["r:id"].isNotNull()).cast("int")
    found = nodes.where((F.col("part") == word.MAIN) & ((F.col("node") == F.col("sect")) | (F.col("parent") == F.col("sect")))).groupBy("doc_id", "sect").agg(
        F.bool_or(F.coalesce(own, F.lit(False))).alias("own"), F.max(F.when(F.col("node") == F.col("sect"), F.col("p"))).alias("p"), refers(REFERENCES[0]).alias("headers"), refers(REFERENCES[1]).alias("footers"),
        F.nullif(word.value("w:pgNumType", "w:start"), F.lit("")).alias("page_number_start"), has("w:titlePg").alias("different_first_page"),
        F.nullif(word.value("w:type"), F.lit("")).alias("section_type"), has("w:pgSz", "w:pgMar").alias("has_page_geometry"), has("w:pgNumType").alias("numbers_pages"),
    )
    return found.where("own").drop("own").withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("sect")) - 1)


def section_evidence(nodes: DataFrame) -> DataFrame:
    """doc_id, idx, what makes a section more than a break, and whether it may go.

    Headers and footers are found by their ids: a reference is an edge to a relationship of the main part, that one to a part, and
    the part has a payload or not. What is missing, external or cannot be read counts as a payload.
    """
    edges = nodes.where((F.col("part") == word.MAIN) & (F.col("parent") == F.col("sect")) & F.col("tag").isin(*REFERENCES)).select("doc_id", "sect", F.col("attrs")["r:id"].alias("id")).where("id is not null")
    related = relationships(nodes).where(F.col("source") == word.MAIN).groupBy("doc_id", "id").agg(F.min("target").alias("part"))
    payload = F.bool_or(F.coalesce("payload", F.lit(True)))
    of_refs = edges.join(related, ["doc_id", "id"], "left").join(part_payloads(nodes), ["doc_id", "part"], "left").groupBy("doc_id", "sect").agg(payload.alias("payload"))
    joined = section_settings(nodes).join(of_refs, ["doc_id", "sect"], "left").fillna(False, ["payload"])
    empty = (F.col("headers") + F.col("footers") > 0) & ~F.col("payload")
    safe = ~(F.col("payload") | F.col("page_number_start").isNotNull() | F.col("different_first_page"))
    return joined.select(
        "doc_id", "idx", F.col("headers").alias("header_reference_count"), F.col("footers").alias("footer_reference_count"), F.col("payload").alias("header_footer_has_payload"), "page_number_start",
        "different_first_page", "section_type", "has_page_geometry", empty.alias("empty_header_footer_references"), safe.alias("safe_to_delete"), "numbers_pages",
    )


def body_children(nodes: DataFrame) -> DataFrame:
    """doc_id, child, node, tag, section, paragraph, payload, sect, only_sect: the children of the body in order.

    A child's section is the number of breaks before it, so a paragraph that carries a break ends its section; paragraph is its
    number among the body's; payload tells whether it has text or an element within that may not be lost; sect is the break that it
    carries; only_sect tells that its properties hold nothing else.
    """
    at, own = F.col("node") == F.col("top"), F.coalesce((F.col("parent") == F.col("ppr")) & (F.col("p") == F.col("top")), F.lit(False))
    breaks = own & (F.col("tag") == "w:sectPr")
    held = (F.col("node") > F.col("top")) & (_filled(nodes) | F.col("tag").isin(word.PAYLOAD))
    # what tells nothing of its child is left where it is, and so is all text
    of_child = nodes.where((F.col("part") == word.MAIN) & (at | own | held)).groupBy("doc_id", "top").agg(
        F.max(F.when(at, F.col("tag"))).alias("tag"), F.bool_or(held).alias("payload"), F.count_if(own).alias("settings"), F.count_if(breaks).alias("breaks"), F.min(F.when(breaks, F.col("node"))).alias("sect"),
    )
    upto = Window.partitionBy("doc_id").orderBy("top")
    return of_child.select(
        "doc_id", (F.row_number().over(upto) - 1).alias("child"), F.col("top").alias("node"), "tag", (F.sum("breaks").over(upto) - F.col("breaks")).cast("int").alias("section"),
        F.when(F.col("tag") == "w:p", F.count_if(F.col("tag") == "w:p").over(upto) - 1).cast("int").alias("paragraph"), "payload", "sect", (F.col("settings") == 1).alias("only_sect"),
    )


def paragraph_hashes(nodes: DataFrame) -> DataFrame:
    """doc_id, node, text_sha256 (bytes) of the paragraphs that are children of the body: what nodes() told, or else of their text, which then moves."""
    main = nodes.where((F.col("part") == word.MAIN) & (F.col("p") == F.col("top")))
    if "text_sha256" in nodes.columns:
        return main.where("tag = 'w:p'").select("doc_id", "node", "text_sha256")
    return main.groupBy("doc_id", F.col("p").alias("node")).agg(F.unhex(F.sha2(word.text_within(), 256)).alias("text_sha256"))


# -- numberings


def _under(above: DataFrame, nodes: DataFrame, tag: str, **columns) -> DataFrame:
    """above(doc_id, node, ...) with the children ``tag`` of its nodes: their number as child, and ``columns`` of them."""
    below = nodes.where(F.col("tag") == tag).select(F.col("doc_id").alias("of"), F.col("parent").alias("up"), F.col("node").alias("child"), *[c.alias(n) for n, c in columns.items()])
    return above.join(below, (above.doc_id == F.col("of")) & (above.node == F.col("up"))).drop("of", "up")


def numberings(nodes: DataFrame) -> dict[str, DataFrame]:
    """nums(doc_id, num, ord, abstract), overrides(doc_id, ord, level, start), abstracts(doc_id, abstract, ord), levels(doc_id, ord, level, start, format,
    text, style) and links(doc_id, style_id, style, num, level): a num names an abstract numbering and may override its starts; a style names a num.
    ord tells apart, and orders, numberings of the same id."""
    attr = lambda name: F.col("attrs")[name]
    part = nodes.where("part = 'word/numbering.xml'")
    whole = part.where("tag = 'w:num'").select("doc_id", "node", attr("w:numId").alias("num"))
    named = _under(whole, part, "w:abstractNumId", abstract=attr("w:val")).groupBy("doc_id", F.col("node").alias("ord")).agg(F.min_by("abstract", "child").alias("abstract"))
    nums = whole.select("doc_id", "num", F.col("node").alias("ord")).join(named, ["doc_id", "ord"], "left")
    over = _under(whole, part, "w:lvlOverride", level=attr("w:ilvl")).select("doc_id", F.col("node").alias("ord"), F.col("child").alias("node"), "level")
    starts = _under(over, part, "w:startOverride", start=attr("w:val"))
    first = starts.groupBy("doc_id", "ord", "level").agg(F.min_by("start", "child").try_cast("int").alias("start"))
    abstracts = part.where("tag = 'w:abstractNum'").select("doc_id", attr("w:abstractNumId").alias("abstract"), F.col("node").alias("ord"))
    levels = part.where("lvl is not null and abstract is not null").groupBy("doc_id", F.col("abstract").alias("ord"), "lvl").agg(
        word.value("w:lvl", "w:ilvl").alias("level"), word.value("w:start").try_cast("int").alias("start"), word.value("w:numFmt").alias("format"), word.value("w:lvlText").alias("text"), word.value("w:pStyle").alias("style")
    )
    links = nodes.where("part = 'word/styles.xml' and style is not null").groupBy("doc_id", F.col("style").alias("node")).agg(
        word.value("w:style", "w:styleId").alias("style_id"), word.value("w:name").alias("style"), word.value("w:numId").alias("num"), word.value("w:ilvl").alias("level")
    )
    return {"nums": nums, "overrides": first, "abstracts": abstracts, "levels": levels.drop("lvl"), "links": links.drop("node")}


# -- writing

SPACES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def document_xml(*inner: Column) -> Column:
    """The main part of the XML of the children of its body."""
    return F.concat(F.lit(f"<w:document {SPACES}><w:body>"), *inner, F.lit("</w:body></w:document>"))


def body_xml(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, seq, xml), the children of a body -> doc_id, name, content: the main part of each document."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "xml"))), lambda x: x["xml"]), "")
    whole = document_xml(inner)
    return blocks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.lit(word.MAIN).alias("name"), whole.alias("content"))


def relationship_xml(id_: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit('<Relationship Id="'), word.escaped(id_), F.lit(f'" Type="{KINDS}/'), word.escaped(kind), F.lit('" Target="'), word.escaped(target), F.lit('"/>'))


def relationships_part(*inner: Column) -> Column:
    return F.concat(F.lit(f'<Relationships xmlns="{RELATIONSHIPS}">'), *inner, F.lit("</Relationships>"))


def relationships_xml(edges: DataFrame) -> DataFrame:
    """edges(doc_id, id, kind, target) of the main part -> doc_id, name, content."""
    xml = relationship_xml(F.col("id"), F.col("kind"), F.col("target"))
    whole = relationships_part(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", xml.alias("xml")))), lambda x: x["xml"]), ""))
    return edges.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.lit("word/_rels/document.xml.rels").alias("name"), whole.alias("content"))


def packed(parts: DataFrame) -> DataFrame:
    """parts(doc_id, name, content as text or bytes) -> doc_id, content: packages with all these parts, in the order of their names, the same
    bytes for the same parts. One document is put together in one task."""
    each = F.collect_list(F.struct("name", F.col("content").cast("binary").alias("content")))
    return packed_rows(parts.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(each.alias("parts")))


def packed_rows(docs: DataFrame) -> DataFrame:
    """docs(doc_id, parts: an array of name, content as bytes) -> doc_id, content: a package of each row, as packed() does; no row moves."""
    entries = lambda parts: [(x["name"].as_py(), (x["content"].as_buffer(),)) for x in parts]
    return word.zipped(docs.select("doc_id", F.array_sort("parts").alias("parts")), "parts", entries)
