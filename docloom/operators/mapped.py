"""The steps of an approved structure map, each on the relations that the step before has left.

Paragraphs have a place, a number or array that orders them and is never given anew, and a spot, which names them from outside (``b/3``, the
fourth paragraph of the body; ``c/0/1/2/0``, a paragraph of a cell). A paragraph that moves gets a place between others and nothing else
is renumbered; spots are those of the document as the map saw it. Every entry must find its paragraph, or its table, with the text that
it was approved for. An entry that doesn't is a fault of its document.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T

#: Writes a table that several relations come from and reads it back; the steps follow one another, so without it a plan holds all before it many times.
Keep = Callable[[DataFrame], DataFrame]


def as_it_is(df: DataFrame) -> DataFrame:
    return df


class Step(NamedTuple):
    """after: the changed relation; targets(doc_id, n); faults(doc_id, fault); fields(doc_id, place, at, nth, instruction, shown): what
    stands in a paragraph besides its text, at characters of it."""

    after: DataFrame
    targets: DataFrame
    faults: DataFrame
    fields: DataFrame | None = None


def spot(locator: Column) -> Column:
    """Of a locator struct(kind, table, row, cell, paragraph): ``b/paragraph`` or ``c/table/row/cell/paragraph``."""
    cell = F.concat_ws("/", F.lit("c"), *[locator[c].cast("string") for c in ("table", "row", "cell", "paragraph")])
    return F.when(locator["kind"] == "table_cell_paragraph", cell).otherwise(F.concat(F.lit("b/"), locator["paragraph"].cast("string")))


def body_spot(paragraph: Column) -> Column:
    return F.concat(F.lit("b/"), paragraph.cast("string"))


def _counted(targets: DataFrame, n: Column | None = None) -> DataFrame:
    return targets.groupBy("doc_id").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))


def toc(paragraphs: DataFrame, ranges: DataFrame, keep: Keep = as_it_is) -> Step:
    """ranges(doc_id, ord, first, last, hashes, levels), in paragraphs of the body: all of a range lose their text, and the first gets a field that
    gathers headings. There must be a hash for each paragraph, and each must hold; of ranges that overlap the later one finds no text."""
    r = ranges.withColumn("levels", F.coalesce("levels", F.lit(4)))
    size = F.size("hashes")
    sizes = paragraphs.where(F.startswith("spot", F.lit("b/"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    shaped = r.join(sizes, "doc_id", "left").withColumn("fault", F.when((F.col("first") < 0) | (F.col("last") < F.col("first")) | (F.col("last") >= F.coalesce("paragraphs", F.lit(0))), "toc_out_of_bounds").when(size != F.col("last") - F.col("first") + 1, "toc_hash_count"))
    good = shaped.where("fault is null")
    each = good.select("doc_id", "ord", "first", "levels", F.posexplode("hashes").alias("nth", "hash")).withColumn("spot", body_spot(F.col("first") + F.col("nth")))
    again = F.row_number().over(Window.partitionBy("doc_id", "spot").orderBy("ord")) > 1
    met = keep(each.withColumn("again", again).join(paragraphs.select("doc_id", "spot", "place", "text"), ["doc_id", "spot"]))
    wrong = met.where(F.sha2(F.when(F.col("again"), "").otherwise(F.col("text")), 256) != F.col("hash"))
    faults = shaped.where("fault is not null").select("doc_id", "fault").unionByName(wrong.select("doc_id", F.lit("toc_changed").alias("fault")))
    cleared = met.select("doc_id", "spot").distinct().withColumn("clears", F.lit(True))
    after = paragraphs.join(cleared, ["doc_id", "spot"], "left").withColumn("text", F.when(F.col("clears"), "").otherwise(F.col("text"))).select(*paragraphs.columns)
    instruction = F.concat(F.lit('TOC \\o "1-'), F.col("levels").cast("string"), F.lit('" \\h \\z \\u'))
    fields = met.where("nth = 0").select("doc_id", "place", F.lit(0).alias("at"), F.col("ord").cast("int").alias("nth"), instruction.alias("instruction"), F.lit("Update table of contents").alias("shown"))
    return Step(after, _counted(good, F.col("last") - F.col("first") + 1), faults, fields)


def _met(entries: DataFrame, paragraphs: DataFrame, kind: str) -> DataFrame:
    """Entries with what their spot has, and the fault of those whose text is another."""
    there = paragraphs.select("doc_id", "spot", "place", "text", F.lit(True).alias("there"))
    fault = F.when(F.col("there").isNull(), f"{kind}_missing").when(F.sha2("text", 256) != F.col("text_sha256"), f"{kind}_changed")
    return entries.join(there, ["doc_id", "spot"], "left").withColumn("fault", fault)


def headings(paragraphs: DataFrame, approved: DataFrame, keep: Keep = as_it_is) -> Step:
    """approved(doc_id, spot, level, text_sha256): the paragraph gets the style of its level; its text stays, number and all."""
    met = keep(_met(approved, paragraphs, "heading").withColumn("fault", F.when(~F.coalesce(F.col("level").between(1, 4), F.lit(False)), "heading_level").otherwise(F.col("fault"))))
    good = met.where("fault is null")
    styled = good.groupBy("doc_id", "spot").agg(F.concat(F.lit("Heading "), F.max("level").cast("string")).alias("to"))
    after = paragraphs.join(styled, ["doc_id", "spot"], "left").withColumn("style", F.coalesce("to", "style")).select(*paragraphs.columns)
    return Step(after, _counted(good), met.where("fault is not null").select("doc_id", "fault"))


def tables(rows: DataFrame, hashes: DataFrame, approved: DataFrame, keep: Keep = as_it_is) -> Step:
    """rows(doc_id, table, row, is_header, cant_split), hashes(doc_id, table, rows, table_text_sha256, first_row_sha256), approved(doc_id, table, semantic,
    kind, table_text_sha256 or null, first_row_sha256, repeat_header_rows, repeat_header, prevent_normal_row_split, caption_row).

    Listed rows repeat as headers, or the first if none is listed and repeat_header says so; where rows are not to be split, all but the
    caption's are kept whole. Nothing is set back. Semantic maps may only name data tables.
    """
    a = approved.select("doc_id", "table", "semantic", "kind", F.col("table_text_sha256").alias("asked"), F.col("first_row_sha256").alias("asked_first"), "repeat_header_rows", "repeat_header", "prevent_normal_row_split", "caption_row")
    met = a.join(hashes, ["doc_id", "table"], "left")
    listed = F.coalesce("repeat_header_rows", F.array().cast("array<int>"))
    repeats = F.when((F.size(listed) == 0) & F.coalesce("repeat_header", F.lit(False)), F.array(F.lit(0))).otherwise(listed)
    fault = (
        F.when(F.col("semantic") & ~F.col("kind").eqNullSafe("data"), "table_kind").when(F.col("rows").isNull(), "table_missing")
        .when((F.coalesce("asked", F.lit("")) != "") & (F.col("asked") != F.col("table_text_sha256")), "table_changed").when(~F.col("asked_first").eqNullSafe(F.col("first_row_sha256")), "table_changed")
        .when(F.exists(repeats, lambda r: (r < 0) | (r >= F.col("rows"))), "table_header_row")
    )
    judged = keep(met.withColumn("repeats", repeats).withColumn("fault", fault))
    good = judged.where("fault is null")
    one = good.groupBy("doc_id", "table").agg(
        F.flatten(F.collect_list("repeats")).alias("repeats"), F.collect_list(F.when(F.coalesce("prevent_normal_row_split", F.lit(False)), F.coalesce("caption_row", F.lit(-1)))).alias("kept")
    )
    joined = rows.join(one, ["doc_id", "table"], "left")
    header = F.col("is_header") | F.coalesce(F.array_contains("repeats", F.col("row")), F.lit(False))
    whole = F.col("cant_split") | F.coalesce(F.exists("kept", lambda c: c != F.col("row")), F.lit(False))
    after = joined.withColumn("is_header", header).withColumn("cant_split", whole).select(*rows.columns)
    return Step(after, _counted(good), judged.where("fault is not null").select("doc_id", "fault"))


def captions(paragraphs: DataFrame, rows: DataFrame, places: DataFrame, approved: DataFrame, keep: Keep = as_it_is) -> tuple[Step, DataFrame, DataFrame]:
    """rows(doc_id, table, row, cells), places(doc_id, table, place), approved(doc_id, spot, ord, version, action, text_sha256, migrate_outside_table, start, stop,
    identifier_sha256, identifier_prefix_sha256, identifier_suffix_sha256, replacement_identifier, label, sequence_name, heading_level, cached_hierarchy,
    cached_sequence) -> the step, the rows that stay, numbered anew, and actions(doc_id, action, n).

    ``preserve`` and ``style_only`` change nothing and are no targets. ``replace_identifier`` puts another identifier in the place of the approved span, if that,
    what is before and what is after it are as approved; the style stays. ``move_caption`` takes the paragraph out of a row that has one cell
    and no other text, to the place just before its table, and the row goes. ``convert_to_seq`` leaves label, fields and title: the chapter
    by the style of its heading, and a sequence. Maps before 1.2 have no actions: their captions are converted, and moved before if they say so.
    """
    second = F.col("version") == "1.2"
    acts = F.when(second, F.col("action")).otherwise("convert_to_seq")
    cell = F.startswith("spot", F.lit("c/"))
    entries = approved.withColumn("does", acts).withColumn("moves", cell & F.when(second, F.col("action") == "move_caption").otherwise(F.coalesce("migrate_outside_table", F.lit(False))))
    met = _met(entries, paragraphs, "caption")
    met = met.withColumn("table", F.when(cell, F.split("spot", "/")[1].cast("int"))).withColumn("row", F.when(cell, F.split("spot", "/")[2].cast("int")))
    of_row = paragraphs.where(cell & (F.trim("text") != "")).select(F.col("doc_id"), F.split("spot", "/")[1].cast("int").alias("table"), F.split("spot", "/")[2].cast("int").alias("row")).groupBy("doc_id", "table", "row").agg(F.count(F.lit(1)).alias("filled"))
    met = met.join(rows.select("doc_id", "table", "row", "cells"), ["doc_id", "table", "row"], "left").join(of_row, ["doc_id", "table", "row"], "left").join(places.withColumnRenamed("place", "table_place"), ["doc_id", "table"], "left")
    t, start, stop = F.col("text"), F.col("start"), F.col("stop")
    cut = lambda a, b: F.substring(t, a + 1, b - a)
    differs = lambda c, h: ~F.sha2(c, 256).eqNullSafe(F.col(h))
    found = {x: T.extract(t, K.CAPTION, i) for x, i in (("label", 1), ("hierarchy", 2), ("sequence", 3), ("title", 4))}
    replaces, converts = F.col("does") == "replace_identifier", F.col("does") == "convert_to_seq"
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(~F.coalesce(F.col("does").isin(K.CAPTION_ACTIONS), F.lit(False)), "caption_action")
        .when(replaces & ~F.coalesce((start >= 0) & (start < stop) & (stop <= F.length(t)), F.lit(False)), "caption_span").when(replaces & differs(cut(start, stop), "identifier_sha256"), "caption_identifier")
        .when(replaces & differs(cut(F.lit(0), start), "identifier_prefix_sha256"), "caption_prefix").when(replaces & differs(cut(stop, F.length(t)), "identifier_suffix_sha256"), "caption_suffix")
        .when(F.col("moves") & (F.coalesce("cells", F.lit(0)) != 1), "caption_row_cells").when(F.col("moves") & (F.coalesce("filled", F.lit(0)) > 1), "caption_row_text")
        .when(converts & found["title"].isNull(), "caption_pattern").when(converts & ~found["label"].eqNullSafe(F.col("label")), "caption_label")
    )
    judged = keep(met.withColumn("fault", fault))
    good = judged.where("fault is null and does not in ('preserve', 'style_only')")
    label = found["label"]
    new = F.when(replaces, F.concat(cut(F.lit(0), start), F.col("replacement_identifier"), cut(stop, F.length(t)))).when(converts, F.concat(label, F.lit(" - "), found["title"])).otherwise(t)
    done = good.select("doc_id", "spot", new.alias("to_text"), F.when(~replaces, "Caption").alias("to_style"), F.when(F.col("moves"), F.col("table_place")).alias("to_place"), "table", "row", F.col("moves").alias("moved"))
    done = done.groupBy("doc_id", "spot").agg(*[F.max(c).alias(c) for c in ("to_text", "to_style", "to_place", "table", "row", "moved")])
    gone = done.where("moved").select("doc_id", "table", "row").distinct()
    blank = F.split("spot", "/")
    changed = paragraphs.join(done.drop("table", "row"), ["doc_id", "spot"], "left")
    changed = changed.withColumn("in_table", F.when(cell, blank[1].cast("int"))).withColumn("in_row", F.when(cell, blank[2].cast("int")))
    # what else stood in a row that goes is blank, and goes too
    left = changed.join(gone.select("doc_id", F.col("table").alias("in_table"), F.col("row").alias("in_row"), F.lit(True).alias("goes")), ["doc_id", "in_table", "in_row"], "left").where("moved or goes is null")
    after = left.withColumns({"text": F.coalesce("to_text", "text"), "style": F.coalesce("to_style", "style"), "place": F.coalesce("to_place", "place")}).select(*paragraphs.columns)
    at = F.length(label)
    each = F.explode(F.array(
        F.struct((at + 1).alias("at"), F.lit(0).alias("nth"), F.concat(F.lit("STYLEREF "), F.col("heading_level").cast("string"), F.lit(" \\s")).alias("instruction"), F.coalesce("cached_hierarchy", found["hierarchy"]).alias("shown")),
        F.struct((at + 2).alias("at"), F.lit(1).alias("nth"), F.concat(F.lit("SEQ "), F.col("sequence_name"), F.lit(" \\* ARABIC \\s "), F.col("heading_level").cast("string")).alias("instruction"), F.coalesce("cached_sequence", found["sequence"]).alias("shown")),
    ))
    fields = good.where(converts).select("doc_id", F.when(F.col("moves"), F.col("table_place")).otherwise(F.col("place")).alias("place"), each.alias("x")).select("doc_id", "place", "x.*")
    later = gone.select("doc_id", "table", F.col("row").alias("gone")).groupBy("doc_id", "table").agg(F.array_sort(F.collect_list("gone")).alias("gone"))
    kept_rows = rows.join(later, ["doc_id", "table"], "left").where("gone is null or not array_contains(gone, row)")
    kept_rows = kept_rows.withColumn("row", (F.col("row") - F.coalesce(F.size(F.filter("gone", lambda g: g < F.col("row"))), F.lit(0))).cast("int")).select(*rows.columns)
    step = Step(after, _counted(good), judged.where("fault is not null").select("doc_id", "fault"), fields)
    return step, kept_rows, good.where(second).groupBy("doc_id", F.col("does").alias("action")).agg(F.count(F.lit(1)).alias("n"))
