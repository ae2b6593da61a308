"""Approved rules applied as row updates: every operator gives the new rows, and changes() what has changed.

Rules act in the order of their profile, the later one wins; a map acts before them in the order table of
contents, headings, tables, captions, trailing sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T

MAP_ORDER = ["toc", "headings", "tables", "captions", "trailing_sections"]


def winning(props: DataFrame, keys: list[str]) -> DataFrame:
    """props(..., key, value, ord): of rules that set the same property of the same target, the last."""
    w = Window.partitionBy(*keys, "key").orderBy(F.col("ord").desc())
    return props.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "ord")


def styles(existing: DataFrame, props: DataFrame) -> DataFrame:
    """existing(doc_id, style, key, value), props(doc_id, style, key, value, ord) -> the styles after the rules; missing ones are made."""
    new = winning(props, ["doc_id", "style"]).withColumnRenamed("value", "new")
    return existing.join(new, ["doc_id", "style", "key"], "full_outer").select("doc_id", "style", "key", F.coalesce("new", "value").alias("value"))


def direct_formats(direct: DataFrame, targets: DataFrame, props: DataFrame) -> DataFrame:
    """direct(doc_id, pos, key, value): what rules control goes from their targets(doc_id, pos, style), so that the style shows."""
    controlled = targets.join(props.select("doc_id", "style", "key").distinct(), ["doc_id", "style"]).select("doc_id", "pos", "key")
    return direct.join(controlled, ["doc_id", "pos", "key"], "left_anti")


def sections(df: DataFrame, props: DataFrame) -> DataFrame:
    """df(doc_id, idx, page sizes and margins in mm, orientation), props(doc_id, prop columns or null) -> the sections after the rule.

    Sizes that are given win; an orientation alone swaps the sides where it changes; ratios are of the
    page's sides after that and must be below one half, or their rows fail.
    """
    p = props.select("doc_id", *[F.col(c).alias(f"to_{c}") for c in props.columns if c != "doc_id"])
    has = lambda c: F.col(f"to_{c}") if f"to_{c}" in p.columns else F.lit(None)
    joined = df.join(p, "doc_id", "left")
    turned = has("orientation").isNotNull() & (has("orientation") != F.col("orientation")) & has("page_width_mm").isNull() & has("page_height_mm").isNull()
    width = F.coalesce(has("page_width_mm"), F.when(turned, F.col("page_height_mm")).otherwise(F.col("page_width_mm"))).cast("double")
    height = F.coalesce(has("page_height_mm"), F.when(turned, F.col("page_width_mm")).otherwise(F.col("page_height_mm"))).cast("double")

    def share(name: str, side: Column) -> Column:
        r = has(name).cast("double")
        return F.when(r.isNull(), F.lit(None).cast("double")).when((r >= 0) & (r < 0.5), r * side).otherwise(F.raise_error(F.lit(f"{name} is not a ratio below one half")).cast("double"))

    out = joined.withColumn("new_width", width).withColumn("new_height", height)
    ratios = {"margin_top_mm": ("margin_top_ratio", "new_height"), "margin_bottom_mm": ("margin_bottom_ratio", "new_height"), "margin_left_mm": ("margin_inner_ratio", "new_width"), "margin_right_mm": ("margin_outer_ratio", "new_width")}
    margins = {m: F.coalesce(share(r, F.col(side)), has(m).cast("double"), F.col(m)) for m, (r, side) in ratios.items() if m in df.columns}
    new = {"page_width_mm": F.col("new_width"), "page_height_mm": F.col("new_height"), "orientation": F.coalesce(has("orientation"), F.col("orientation"))} | margins
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def table_rows(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows(doc_id, table, row, is_header, cant_split), tables(doc_id, table, header_rows or null, caption_row or null): listed rows repeat, by
    default the first; no row but that of the caption splits."""
    joined = rows.join(tables, ["doc_id", "table"], "left")
    target = F.col("target")
    joined = joined.join(tables.select("doc_id", "table", F.lit(True).alias("target")), ["doc_id", "table"], "left")
    header = F.array_contains(F.coalesce("header_rows", F.array(F.lit(0))), F.col("row"))
    return joined.select(
        "doc_id", "table", "row", F.when(target, header).otherwise(F.col("is_header")).alias("is_header"),
        F.when(target, ~F.col("row").eqNullSafe(F.col("caption_row"))).otherwise(F.col("cant_split")).alias("cant_split"),
    )


def fields_from_markers(paragraphs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, text) -> doc_id, pos, nth, marker, instruction, known: whether a reference's bookmark exists."""
    each = paragraphs.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(K.FIELD_MARKER), F.lit(0))).alias("nth", "marker"))
    named = each.withColumn("instruction", T.marker_instruction(F.col("marker"))).withColumn("name", F.regexp_extract("marker", r"^\[\[(?:REF|PAGEREF):([A-Za-z0-9_.-]+)\]\]$", 1))
    there = bookmarks.select("doc_id", "name", F.lit(True).alias("there")).distinct()
    known = F.coalesce(F.col("there"), F.col("name") == "")
    return named.join(there, ["doc_id", "name"], "left").select("doc_id", "pos", "nth", "marker", "instruction", F.coalesce(known, F.lit(False)).alias("known"))


def caption_rows_moved(cells: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells(doc_id, table, row, cell, cell_id, text), approved(doc_id, table, caption_row) -> cells without the rows, and the paragraphs (doc_id, table, text)
    that stand before their tables instead. Only a row of one merged cell moves."""
    rows = cells.groupBy("doc_id", "table", "row").agg(F.count_distinct("cell_id").alias("n"), F.min_by("text", "cell").alias("text"))
    moved = rows.where("n = 1").join(approved.withColumnRenamed("caption_row", "row"), ["doc_id", "table", "row"], "left_semi")
    left = cells.join(moved.select("doc_id", "table", "row"), ["doc_id", "table", "row"], "left_anti")
    gone = moved.select("doc_id", "table", F.col("row").alias("gone"))
    left = left.join(gone, ["doc_id", "table"], "left").withColumn("row", F.when(F.col("row") > F.col("gone"), F.col("row") - 1).otherwise(F.col("row"))).drop("gone")
    return left.select(*cells.columns), moved.select("doc_id", "table", "text")


def without_trailing(df: DataFrame, approved: DataFrame, last_empty: DataFrame) -> DataFrame:
    """Sections df(doc_id, idx) without those that are approved and in the unbroken row of empty ones at the end."""
    w = Window.partitionBy("doc_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.join(approved.withColumn("yes", F.lit(True)), ["doc_id", "idx"], "left").join(last_empty.withColumn("free", F.lit(True)), ["doc_id", "idx"], "left")
    goes = F.bool_and(F.coalesce("yes", F.lit(False)) & F.coalesce("free", F.lit(False))).over(w)
    return marked.withColumn("goes", goes).where("not goes").select(*df.columns)


def changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, old, new of every value that differs, rows that have come or gone too."""
    a = before.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    b = after.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("b"))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("old"), F.col(f"b.{c}").alias("new")) for c in columns])
    return a.join(b, keys, "full_outer").select(*keys, F.explode(each).alias("x")).where(~F.col("x.old").eqNullSafe(F.col("x.new"))).select(*keys, "x.*")


def spliced(runs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs(doc_id, place, run, text, plain, ...), edits(doc_id, place, start, stop, replacement) of characters of the runs' joined text -> the runs after
    the edits, and faults(doc_id, place, fault).

    Of the runs that the span meets the first gets the replacement where its own part of the span was, and all lose their parts, so
    what stands around, and how each run is set, stays. A prefix goes by an edit from 0 without a replacement. A fault, which changes
    nothing in its paragraph: a span that is empty or not in the text, a run within it that is not plain, or two edits of a paragraph.
    """
    spans = edits.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("edits"), F.min("start").alias("from"), F.min("stop").alias("to"), F.min("replacement").alias("new"))
    order = Window.partitionBy("doc_id", "place").orderBy("run")
    whole = Window.partitionBy("doc_id", "place")
    end = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = runs.join(spans, ["doc_id", "place"], "left").withColumn("end_", end).withColumn("begin_", F.col("end_") - F.length("text"))
    low, high = F.greatest("from", "begin_"), F.least("to", "end_")
    at = at.withColumn("meets", F.coalesce(low < high, F.lit(False)))
    first = F.min(F.when(F.col("meets"), F.col("run"))).over(whole)
    outside = (F.col("from") < 0) | (F.col("from") >= F.col("to")) | (F.col("to") > F.max("end_").over(whole))
    mixed = F.bool_or(F.col("meets") & ~F.coalesce("plain", F.lit(True))).over(whole)
    fault = F.when(F.col("edits") > 1, "several_edits").when(outside, "span").when(mixed, "unsupported_object")
    at = at.withColumn("first_", first).withColumn("fault", fault)
    head = F.substring(F.col("text"), F.lit(1), (low - F.col("begin_")).cast("int"))
    tail = F.substring(F.col("text"), (high - F.col("begin_") + 1).cast("int"), F.length("text"))
    new = F.concat(head, F.when(F.col("run") == F.col("first_"), F.coalesce("new", F.lit(""))).otherwise(F.lit("")), tail)
    after = at.withColumn("text", F.when(F.col("meets") & F.col("fault").isNull(), new).otherwise(F.col("text")))
    missing = spans.join(runs.select("doc_id", "place").distinct(), ["doc_id", "place"], "left_anti").select("doc_id", "place", F.lit("span").alias("fault"))
    return after.select(*runs.columns), at.where("fault is not null").select("doc_id", "place", "fault").distinct().unionByName(missing)
