"""Sections at the end of documents that hold nothing: which may go, and the documents without them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import parts


def _hex(hash_: str) -> Column:
    return F.lower(F.hex(hash_))


def _without_last(children: DataFrame) -> DataFrame:
    """The children without the last one, where that is the properties of the last section."""
    last = F.max("child").over(Window.partitionBy("doc_id"))
    return children.withColumn("last", last).where((F.col("child") < F.col("last")) | (F.col("tag") != "w:sectPr")).drop("last")


def trailing_empty(nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """doc_id, section, previous_boundary_paragraph, previous_boundary_sha256, approved_delete, confidence, evidence.

    The sections in an unbroken row at a document's end whose children have no payload; the first section never is one. The evidence
    is that of the document's last section, and gives a high confidence if that may go. Nothing is approved here. ``children``: the body's children, if they are at hand.
    """
    every = Window.partitionBy("doc_id")
    children = (parts.body_children(nodes) if children is None else children).withColumn("end", F.max("child").over(every))
    last = (F.col("child") == F.col("end")) & (F.col("tag") == "w:sectPr")
    filled = F.coalesce(F.max(F.when(F.col("payload") & ~last, F.col("section"))).over(every), F.lit(0))
    # a section without a child is empty too, so sections are told by the paragraphs that they begin after
    bounds = children.withColumn("filled", filled).where("sect is not null and section >= filled").select("doc_id", "node", (F.col("section") + 1).alias("section"), "paragraph")
    empty = bounds.join(parts.paragraph_hashes(nodes), ["doc_id", "node"])
    evidence = parts.section_evidence(nodes).drop("numbers_pages")
    last = evidence.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("idx").desc()))).where("nth = 1")
    last = last.select("doc_id", F.struct(*[c for c in evidence.columns if c not in ("doc_id", "idx")]).alias("evidence"))
    return empty.join(last, "doc_id").select(
        "doc_id", "section", F.col("paragraph").alias("previous_boundary_paragraph"), _hex("text_sha256").alias("previous_boundary_sha256"), F.lit(False).alias("approved_delete"),
        F.when(F.col("evidence.safe_to_delete"), "high").otherwise("low").alias("confidence"), "evidence",
    )


def without_trailing(nodes: DataFrame, approved: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, children: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """approved: rows of trailing_empty() with approved_delete -> the body's children that stay (doc_id, child, node, tag, section, sect), and
    faults(doc_id, section, fault).

    Sections go from the end inward: of the approved ones the last must be the document's last, the next the one before it, and so on.
    Each must name its boundary by place and hash, still be empty, be safe by its evidence, and have no page numbers, first page or
    headers of its own. A document with a fault keeps all its children, and its first fault is told. Otherwise what follows the last
    boundary that stays goes; the boundary gives its break to the body, and goes too if it then holds nothing. ``keep`` writes what is used again,
    ``children`` are the body's children, if they are at hand.
    """
    children = keep(parts.body_children(nodes)) if children is None else children
    wanted = approved.where("approved_delete").select(
        "doc_id", "section", F.col("previous_boundary_paragraph").alias("paragraph"), F.col("previous_boundary_sha256").alias("sha256"), F.col("evidence.safe_to_delete").alias("safe"),
        F.coalesce("evidence.header_footer_has_payload", F.lit(True)).alias("told_payload"),
    )
    counted = children.groupBy("doc_id").agg((F.max("section") + 1).alias("sections"))
    filled = _without_last(children).groupBy("doc_id", "section").agg(F.bool_or("payload").alias("filled"))
    bounds = children.where("paragraph is not null").select("doc_id", "paragraph", "node", F.col("sect").isNotNull().alias("breaks"))
    own = parts.section_settings(nodes).select("doc_id", F.col("idx").alias("section"), (F.col("headers") + F.col("footers") > 0).alias("refers"), (F.col("numbers_pages") | F.col("different_first_page")).alias("own_pages"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("section").desc()))
    tried = wanted.withColumn("nth", nth).join(counted, "doc_id").join(filled, ["doc_id", "section"], "left").join(bounds, ["doc_id", "paragraph"], "left")
    tried = tried.join(parts.paragraph_hashes(nodes), ["doc_id", "node"], "left").withColumn("found", _hex("text_sha256")).join(own, ["doc_id", "section"], "left")
    fault = (
        F.when(~F.coalesce("safe", F.lit(False)), "unsafe_evidence").when(F.col("section") != F.col("sections") - F.col("nth"), "not_from_the_end").when(F.col("found").isNull(), "boundary_missing")
        .when(F.col("found") != F.col("sha256"), "boundary_changed").when(F.coalesce("filled", F.lit(False)), "no_longer_empty").when(~F.col("breaks"), "boundary_without_break")
        .when(F.coalesce("own_pages", F.lit(False)) | (F.coalesce("refers", F.lit(False)) & F.col("told_payload")), "own_settings")
    )
    judged = keep(tried.withColumn("fault", fault))
    faults = judged.where("fault is not null").groupBy("doc_id").agg(F.max_by("fault", "section").alias("fault"), F.max("section").alias("section"))
    going = judged.join(faults.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("section").alias("from"))
    every = Window.partitionBy("doc_id")
    marked = children.join(going, "doc_id", "left").withColumn("end", F.max("child").over(every))
    body = (F.col("child") == F.col("end")) & (F.col("tag") == "w:sectPr")
    bound = (F.col("section") == F.col("from") - 1) & F.col("sect").isNotNull()
    gives = F.max(F.when(bound, F.col("sect"))).over(every)
    goes = ((F.col("section") >= F.col("from")) & ~body) | (bound & ~F.col("payload") & F.col("only_sect"))
    left = marked.withColumn("gives", gives).where(F.col("from").isNull() | ~goes).select(
        "doc_id", "child", "node", "tag", F.when(body & F.col("from").isNotNull(), F.col("from") - 1).otherwise(F.col("section")).alias("section"),
        F.when(body & F.col("from").isNotNull(), F.col("gives")).when(body, F.col("node")).when(~F.coalesce(bound, F.lit(False)), F.col("sect")).alias("sect"),
    )
    return left, faults.select("doc_id", "section", "fault")
