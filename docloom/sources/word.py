"""What a word-processing package says, as queries over its nodes: parse once with docx.nodes(), write, and derive all of these.

Nodes know the paragraph, run, table, row, cell, style and section that they stand in, so that each relation is one grouping by
(doc_id, node): no walk through parents, no second parse. Order comes from node numbers, which follow the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.sources.stored import BATCH_BYTES, bound_batches

MAIN = "word/document.xml"
#: Elements that a paragraph may not lose.
PAYLOAD = ["w:tbl", "w:drawing", "w:object", "w:pict", "w:bookmarkStart", "w:commentRangeStart", "w:footnoteReference", "w:endnoteReference", "w:fldChar"]
#: Units: twentieths of a point in a point, half points in a point, and millimetres of a twentieth of a point.
TWENTIETHS, HALVES, MM = 20.0, 2.0, 25.4 / 1440.0


def value(tag: str, name: str = "w:val") -> Column:
    """Of a group of nodes: the attribute ``name`` of its first element ``tag``, null where there is none."""
    return F.min_by(F.when(F.col("tag") == tag, F.col("attrs")[name]), F.when(F.col("tag") == tag, F.col("node")))


def toggle(tag: str) -> Column:
    """Of a group of nodes: true or false as the element ``tag`` says, null where it stands not."""
    on = ~F.coalesce(F.lower(F.col("attrs")["w:val"]), F.lit("true")).isin("0", "false", "off")
    return F.min_by(F.when(F.col("tag") == tag, on), F.when(F.col("tag") == tag, F.col("node")))


def _number(c: Column, unit: float) -> Column:
    return c.try_cast("double") / unit


def text_within() -> Column:
    """Of a group of nodes: their text in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isin("w:t", "w:tab", "w:br", "w:cr"), F.struct("node", F.when(F.col("tag") == "w:t", F.coalesce("text", F.lit(""))).when(F.col("tag") == "w:tab", "\t").otherwise("\n").alias("text"))))), lambda x: x["text"]), "")


def getters() -> dict[str, Column]:
    """The properties of a style, or of what a paragraph sets itself, as aggregates over its nodes."""
    rule = F.coalesce(value("w:spacing", "w:lineRule"), F.lit("auto"))
    line = value("w:spacing", "w:line").try_cast("double")
    colour = value("w:color")
    multiple = (
        F.when(line.isNull(), F.lit(None)).when(rule == "exact", "exact").when(rule == "atLeast", "at_least")
        .when(line == 240, "single").when(line == 360, "one_point_five").when(line == 480, "double").otherwise("multiple")
    )
    hanging = -_number(value("w:ind", "w:hanging"), TWENTIETHS)
    return {
        "font_name": value("w:rFonts", "w:ascii"),
        "font_name_ascii": F.coalesce(value("w:rFonts", "w:ascii"), value("w:rFonts", "w:hAnsi")),
        "font_name_east_asia": value("w:rFonts", "w:eastAsia"),
        "font_name_complex_script": value("w:rFonts", "w:cs"),
        "font_size_pt": _number(value("w:sz"), HALVES),
        "bold": toggle("w:b"),
        "italic": toggle("w:i"),
        "color_hex": F.when(colour != "auto", colour),
        "alignment": F.when(value("w:jc") == "both", "justify").otherwise(F.lower(value("w:jc"))),
        "space_before_pt": _number(value("w:spacing", "w:before"), TWENTIETHS),
        "space_after_pt": _number(value("w:spacing", "w:after"), TWENTIETHS),
        "line_spacing": F.when(rule == "auto", line / 240.0),
        "line_spacing_rule": multiple,
        "line_spacing_pt": F.when(rule != "auto", line / TWENTIETHS),
        "first_line_indent_pt": F.coalesce(hanging, _number(value("w:ind", "w:firstLine"), TWENTIETHS)),
        "first_line_indent_chars": _number(value("w:ind", "w:firstLineChars"), 100.0),
        "left_indent_pt": _number(F.coalesce(value("w:ind", "w:left"), value("w:ind", "w:start")), TWENTIETHS),
        "right_indent_pt": _number(F.coalesce(value("w:ind", "w:right"), value("w:ind", "w:end")), TWENTIETHS),
        "keep_with_next": toggle("w:keepNext"),
        "keep_together": toggle("w:keepLines"),
        "page_break_before": toggle("w:pageBreakBefore"),
        "widow_control": toggle("w:widowControl"),
    }


def styles(nodes: DataFrame) -> DataFrame:
    """doc_id, style_id, style (its name), kind, based_on, and the 22 properties of getters()."""
    own = nodes.where("part = 'word/styles.xml' and style is not null")
    head = {"style_id": value("w:style", "w:styleId"), "style": F.coalesce(value("w:name"), value("w:style", "w:styleId")), "kind": value("w:style", "w:type"), "based_on": value("w:basedOn")}
    found = own.groupBy("doc_id", F.col("style").alias("style_node")).agg(*[c.alias(n) for n, c in (head | getters()).items()])
    return found.drop("style_node")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, kind, table, row, cell, paragraph, style_id, text of the main part: paragraphs of the body, then those of the cells of
    its tables, by table, row and cell; each with the locator that names it. Text is that of its runs; those in text boxes, and
    tables within cells, have no locator and are left out.
    """
    main = nodes.where(F.col("part") == MAIN)
    body = main.where("tag = 'w:body'").select("doc_id", F.col("node").alias("body"))
    # of the main part's tables those that stand in the body itself
    tables = main.where("tag = 'w:tbl'").join(body, "doc_id").where("parent = body").select("doc_id", F.col("node").alias("tbl"))
    tables = tables.withColumn("table", F.row_number().over(Window.partitionBy("doc_id").orderBy("tbl")) - 1)
    rows = main.where("tag = 'w:tr'").select("doc_id", "tbl", "tr").withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("tr")) - 1)
    cells = main.where("tag = 'w:tc'").select("doc_id", "tbl", "tr", "tc").withColumn("cell", F.row_number().over(Window.partitionBy("doc_id", "tr").orderBy("tc")) - 1)
    text = text_within()
    of = main.where("p is not null").groupBy("doc_id", "p").agg(
        F.max(F.when(F.col("node") == F.col("p"), F.col("parent"))).alias("parent"), F.min("tbl").alias("tbl"), F.min("tr").alias("tr"), F.min("tc").alias("tc"),
        value("w:pStyle").alias("style_id"), text.alias("text"),
    )
    in_body = of.join(body, (of.doc_id == body.doc_id) & (of.parent == body.body), "left_semi").where("tbl is null")
    in_body = in_body.select(
        "doc_id", "p", F.lit("body_paragraph").alias("kind"), *[F.lit(None).cast("int").alias(c) for c in ("table", "row", "cell")],
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("p")) - 1).alias("paragraph"), "style_id", "text",
    )
    in_cell = of.where("parent = tc").join(tables, ["doc_id", "tbl"]).join(rows, ["doc_id", "tbl", "tr"]).join(cells, ["doc_id", "tbl", "tr", "tc"])
    in_cell = in_cell.select(
        "doc_id", "p", F.lit("table_cell_paragraph").alias("kind"), "table", "row", "cell",
        (F.row_number().over(Window.partitionBy("doc_id", "tc").orderBy("p")) - 1).alias("paragraph"), "style_id", "text",
    )
    order = Window.partitionBy("doc_id").orderBy("kind", "table", "row", "cell", "paragraph")
    return in_body.unionByName(in_cell).withColumn("seq", F.row_number().over(order) - 1)


def all_paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, p, place, depth, style_id, text of the paragraphs of the main part at any depth, those of tables within cells too.

    A container, the body or a cell, gives its own paragraphs first, then those of its tables by table, row and cell, and so on within each cell.
    place is that path: 0 and the paragraph's number, or 1 and the numbers of table, row and cell before what is in the cell. Paths grow by a
    join for each level of tables within tables.
    """
    main = nodes.where(F.col("part") == MAIN)
    nth = lambda *by: F.row_number().over(Window.partitionBy("doc_id", *by).orderBy("node")) - 1
    tables = main.where("tag = 'w:tbl'").select("doc_id", "node", F.col("parent").alias("outer")).withColumn("table", nth("outer")).withColumnRenamed("node", "tbl")
    rows_ = main.where("tag = 'w:tr' and parent = tbl").select("doc_id", "tbl", "node").withColumn("row", nth("tbl")).withColumnRenamed("node", "tr")
    cells = main.where("tag = 'w:tc' and parent = tr").select("doc_id", "tr", "node").withColumn("cell", nth("tr")).withColumnRenamed("node", "tc")
    inner = cells.join(rows_, ["doc_id", "tr"]).join(tables, ["doc_id", "tbl"]).select("doc_id", F.col("tc").alias("container"), "outer", F.array(F.lit(1), "table", "row", "cell").alias("step"))
    level = main.where("tag = 'w:body'").select("doc_id", F.col("node").alias("container"), F.array().cast("array<int>").alias("place"))
    deepest = main.where("tag = 'w:tbl'").agg(F.max("depth")).first()[0]
    found, depth = level.withColumn("depth", F.lit(0)), 0
    # a table within a table stands at least three nodes deeper, and the first two below the root
    while deepest is not None and 3 * depth + 2 <= deepest:
        depth += 1
        level = inner.join(level.select("doc_id", F.col("container").alias("outer"), F.col("place").alias("above")), ["doc_id", "outer"]).select("doc_id", "container", F.concat("above", "step").alias("place"))
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    text = text_within()
    own = main.where("p is not null").groupBy("doc_id", "p").agg(F.max(F.when(F.col("node") == F.col("p"), F.col("parent"))).alias("container"), value("w:pStyle").alias("style_id"), text.alias("text"))
    placed = own.join(found, ["doc_id", "container"])
    number = F.row_number().over(Window.partitionBy("doc_id", "container").orderBy("p")) - 1
    placed = placed.withColumn("place", F.concat("place", F.array(F.lit(0), number)))
    return placed.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).alias("seq"), "p", "place", "depth", "style_id", "text")


def runs(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, run, start, stop, text and what the run sets itself; start and stop count characters of the paragraph's runs."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == "w:t", F.struct("node", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]), "")
    own = nodes.where("r is not null and p is not null").groupBy("doc_id", "part", "p", "r").agg(text.alias("text"), *[c.alias(n) for n, c in getters().items() if n.startswith("font") or n in ("bold", "italic", "color_hex")])
    order = Window.partitionBy("doc_id", "part", "p").orderBy("r")
    stop = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return own.withColumn("run", F.row_number().over(order) - 1).withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("text")).drop("r")


def rows(nodes: DataFrame) -> DataFrame:
    """doc_id, table, row, is_header, cant_split, cells of the tables that stand in the body itself, in document order, as paragraphs() numbers them."""
    whole = nodes.where(F.col("part") == MAIN)
    main = whole.where("tbl is not null")
    body = whole.where("tag = 'w:body'").select("doc_id", F.col("node").alias("body"))
    tables = main.where("tag = 'w:tbl'").join(body, "doc_id").where("parent = body").select("doc_id", "tbl").withColumn("table", F.row_number().over(Window.partitionBy("doc_id").orderBy("tbl")) - 1)
    found = main.where("tr is not null").groupBy("doc_id", "tbl", "tr").agg(
        F.coalesce(toggle("w:tblHeader"), F.lit(False)).alias("is_header"), F.coalesce(toggle("w:cantSplit"), F.lit(False)).alias("cant_split"), F.count_if(F.col("tag") == "w:tc").cast("int").alias("cells")
    )
    found = found.withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "tbl").orderBy("tr")) - 1)
    return found.join(tables, ["doc_id", "tbl"]).select("doc_id", "table", "row", "is_header", "cant_split", "cells")


def table_hashes(nodes: DataFrame) -> DataFrame:
    """doc_id, table, place (its node), rows, table_text_sha256, first_row_sha256 of the tables that stand in the body itself.

    The text of a cell is that of its own paragraphs, a line each; a cell that spans columns counts in each, and one that goes on from
    the row above has its text. Cells of a row are joined by CELL_END, rows by ROW_END.
    """
    main = nodes.where(F.col("part") == MAIN)
    body = main.where("tag = 'w:body'").select("doc_id", F.col("node").alias("body"))
    tables = main.where("tag = 'w:tbl'").join(body, "doc_id").where("parent = body").select("doc_id", "tbl")
    tables = tables.withColumn("table", F.row_number().over(Window.partitionBy("doc_id").orderBy("tbl")) - 1)
    texts = paragraphs(nodes).where("kind = 'table_cell_paragraph'").groupBy("doc_id", "table", "row", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n").alias("text"))
    merged = F.bool_or((F.col("tag") == "w:vMerge") & (F.coalesce(F.col("attrs")["w:val"], F.lit("continue")) == "continue"))
    cells = main.where("tc is not null").join(tables, ["doc_id", "tbl"]).groupBy("doc_id", "table", "tbl", "tr", "tc").agg(F.greatest(F.coalesce(value("w:gridSpan").try_cast("int"), F.lit(1)), F.lit(1)).alias("span"), merged.alias("goes_on"))
    cells = cells.withColumn("row", F.dense_rank().over(Window.partitionBy("doc_id", "tbl").orderBy("tr")) - 1)
    in_row = Window.partitionBy("doc_id", "tr").orderBy("tc")
    cells = cells.withColumn("cell", F.row_number().over(in_row) - 1).withColumn("column", F.sum("span").over(in_row) - F.col("span"))
    cells = cells.join(texts, ["doc_id", "table", "row", "cell"], "left")
    above = F.last(F.when(~F.col("goes_on"), F.coalesce("text", F.lit(""))), True).over(Window.partitionBy("doc_id", "tbl", "column").orderBy("row"))
    of_row = cells.withColumn("shown", F.coalesce(above, F.lit(""))).groupBy("doc_id", "table", "tbl", "row").agg(
        F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "shown", "span"))), lambda x: F.array_repeat(x["shown"], x["span"]))), K.CELL_END).alias("line")
    )
    whole = of_row.groupBy("doc_id", "table", "tbl").agg(F.count(F.lit(1)).cast("int").alias("rows"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    return whole.select(
        "doc_id", "table", F.col("tbl").alias("place"), "rows", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), K.ROW_END), 256).alias("table_text_sha256"), F.sha2(F.col("lines")[0]["line"], 256).alias("first_row_sha256")
    )


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, idx, sizes and margins in mm, title_page, starts_at, headers and footers of each section of the main part, in order."""
    mm = lambda tag, name: (value(tag, name).try_cast("double") * MM)
    found = nodes.where((F.col("part") == MAIN) & F.col("sect").isNotNull()).groupBy("doc_id", "sect").agg(
        mm("w:pgSz", "w:w").alias("page_width_mm"), mm("w:pgSz", "w:h").alias("page_height_mm"),
        *[mm("w:pgMar", f"w:{side}").alias(f"margin_{side}_mm") for side in ("top", "bottom", "left", "right")],
        mm("w:pgMar", "w:gutter").alias("gutter_mm"), mm("w:pgMar", "w:header").alias("header_distance_mm"), mm("w:pgMar", "w:footer").alias("footer_distance_mm"),
        F.coalesce(toggle("w:titlePg"), F.lit(False)).alias("different_first_page_header_footer"), value("w:pgNumType", "w:start").try_cast("int").alias("starts_at"),
        F.count_if(F.col("tag") == "w:headerReference").cast("int").alias("headers"), F.count_if(F.col("tag") == "w:footerReference").cast("int").alias("footers"),
    )
    return found.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("sect")) - 1).drop("sect")


def settings(nodes: DataFrame) -> DataFrame:
    """doc_id, name of each child of the settings, for document toggles: it stands there or not."""
    return nodes.where("part = 'word/settings.xml' and depth = 1").select("doc_id", F.regexp_replace("tag", "^w:", "").alias("name")).distinct()


def with_toggles(sections_: DataFrame, settings_: DataFrame) -> DataFrame:
    """Sections with the toggles that hold for the whole document."""
    of = settings_.groupBy("doc_id").agg(F.bool_or(F.col("name") == "mirrorMargins").alias("mirror_margins"), F.bool_or(F.col("name") == "evenAndOddHeaders").alias("odd_and_even_pages_header_footer"))
    return sections_.join(of, "doc_id", "left").fillna(False, ["mirror_margins", "odd_and_even_pages_header_footer"])


def numbering(nodes: DataFrame) -> DataFrame:
    """doc_id, abstract, level, start, format, text, style of the levels that numberings define."""
    found = nodes.where("part = 'word/numbering.xml' and lvl is not null").groupBy("doc_id", "abstract", "lvl").agg(
        value("w:lvl", "w:ilvl").cast("int").alias("level"), value("w:start").try_cast("int").alias("start"), value("w:numFmt").alias("format"), value("w:lvlText").alias("text"), value("w:pStyle").alias("style")
    )
    return found.drop("lvl")


def payloads(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, payload: whether a paragraph has text that is not blank, or an element that it may not lose."""
    text = (F.col("tag") == "w:t") & F.coalesce(F.rlike("text", F.lit(r"(?U)\S")), F.lit(False))
    held = F.col("tag").isin(PAYLOAD) & ((F.col("tag") != "w:tbl") | (F.col("node") > F.col("p")))
    return nodes.where("p is not null").groupBy("doc_id", "part", "p").agg(F.bool_or(text | held).alias("payload"))


def signatures(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, signature: a hash of how a paragraph's mark is set, else of its paragraph properties, else of nothing.

    Equal where the same elements with the same attributes stand in the same order, whatever their prefixes; not the digest of other tools.
    """
    element = F.concat_ws(" ", F.col("tag"), F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " "))
    mark = F.col("ppr").isNotNull() & F.col("rpr").isNotNull() & (F.col("rpr") > F.col("ppr")) & F.col("r").isNull()
    listed = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("node", element.alias("e"))))), lambda x: x["e"]), "\n")
    both = nodes.where("p is not null").groupBy("doc_id", "part", "p").agg(listed(mark).alias("mark"), listed(F.col("ppr").isNotNull()).alias("whole"))
    return both.select("doc_id", "part", "p", F.sha2(F.when(F.col("mark") != "", F.col("mark")).otherwise(F.col("whole")), 256).alias("signature"))


# -- writing

HEAD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
TAIL = "</w:body></w:document>"


def escaped(c: Column) -> Column:
    """Text for XML; characters that XML has no place for become U+FFFD."""
    clean = F.regexp_replace(c, "[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "�")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    return clean


def paragraph_xml(text: Column, style: Column | None = None) -> Column:
    mark = F.lit("") if style is None else F.coalesce(F.concat(F.lit('<w:pPr><w:pStyle w:val="'), escaped(style), F.lit('"/></w:pPr>')), F.lit(""))
    return F.concat(F.lit("<w:p>"), mark, F.lit('<w:r><w:t xml:space="preserve">'), escaped(text), F.lit("</w:t></w:r></w:p>"))


def row_xml(cells: Column, is_header: Column) -> Column:
    """cells: an array of texts."""
    each = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<w:tc>"), paragraph_xml(c), F.lit("</w:tc>"))), "")
    return F.concat(F.lit("<w:tr><w:trPr>"), F.when(is_header, "<w:tblHeader/>").otherwise(""), F.lit("</w:trPr>"), each, F.lit("</w:tr>"))


def packed(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, seq, xml), the children of a body -> doc_id, content: packages with a main part. One document is put together in one task."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "xml"))), lambda x: x["xml"]), "")
    bodies = blocks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(ordered.alias("body"))
    return zipped(bodies, "body", lambda body: [(MAIN, (HEAD.encode(), body.as_buffer(), TAIL.encode()))])


def zipped(df: DataFrame, column: str, entries: Callable) -> DataFrame:
    """df(doc_id, column) -> doc_id, content. ``entries`` gives of a value of the column, an Arrow scalar, the parts (name, pieces of bytes). Packages are
    put together one at a time, and go back to Spark before they are many bytes."""
    import io
    import zipfile

    import pyarrow as pa

    def one(value) -> bytes:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for name, pieces in entries(value):
                info = zipfile.ZipInfo(name)
                info.file_size = sum(map(len, pieces))
                with z.open(info, "w") as part:
                    for piece in pieces:
                        part.write(piece)
        return raw.getvalue()

    def run(batches):
        for batch in batches:
            docs, values, first, out, size = batch.column("doc_id"), batch.column(column), 0, [], 0
            for i in range(batch.num_rows):
                out.append(one(values[i]))
                size += len(out[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([docs.slice(first, len(out)), pa.array(out, pa.binary())], names=["doc_id", "content"])
                    first, out, size = i + 1, [], 0

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, "doc_id string, content binary")
