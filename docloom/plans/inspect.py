"""Inspection: what a collection of packages holds, and candidate structure maps. Nothing is approved here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import authority, inventory, ordered
from docloom.sources import docx, word


def inventory_of(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """files(doc_id, content) -> the relations of an inventory.

    ``keep`` writes a table and reads it back, so that packages are parsed once for their nodes and once for their
    paragraphs, whatever the number of relations that are used; without it each relation parses them anew.
    """
    nodes, paragraphs = keep(docx.nodes(files)), keep(docx.paragraphs(files))
    fields = keep(docx.fields(files, nodes))
    places = word.paragraphs(nodes)
    level = T.heading_level(F.col("text"))
    kinds = fields.groupBy("doc_id", T.field_kind(F.col("instruction")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    references = fields.where(T.field_kind(F.col("instruction")).isin("REF", "PAGEREF")).select("doc_id", T.field_argument(F.col("instruction")).alias("name")).where("name is not null")
    return {
        "faults": docx.faults(files),
        "counts": docx.counts(nodes),
        "headings": places.where(level.isNotNull()).select("doc_id", "seq", level.alias("level"), F.substring("text", 1, 160).alias("text")),
        "sections": word.with_toggles(word.sections(nodes), word.settings(nodes)),
        "tables": word.rows(nodes).groupBy("doc_id", "table").agg(F.count(F.lit(1)).alias("rows"), F.max("cells").alias("columns"), F.count_if("is_header").alias("header_rows")),
        "style_definitions": word.styles(nodes),
        "numbering": word.numbering(nodes),
        "sequences": authority.sequences(fields),
        "styles": paragraphs.groupBy("doc_id", F.coalesce("style", F.lit("<none>")).alias("style")).agg(F.count(F.lit(1)).alias("n")),
        "paragraph_counts": inventory.paragraph_counts(paragraphs.where("part = 'word/document.xml'")),
        "fingerprints": inventory.ordered_hash(paragraphs, ["doc_id"], ["part", "pos"], F.col("text"), "fingerprint"),
        "fields": kinds,
        "unresolved": references.join(docx.bookmarks(nodes), ["doc_id", "name"], "left_anti").distinct(),
        "objects": docx.objects(files).unionByName(docx.formulas(nodes).select("doc_id", "kind", F.col("part").alias("name"), "sha256")),
    }


def candidates(paragraphs: DataFrame) -> dict[str, DataFrame]:
    """paragraphs(doc_id, pos, text, style) -> roles, headings, captions and anomalies. They hold hashes and places, no text."""
    near = ordered.nearby(paragraphs)
    caption = T.caption(F.col("text"), F.col("context"))
    found = near.select("*", *[c.alias(n) for n, c in caption.items()], T.heading_level(F.col("text")).alias("level"), T.role(F.col("text"), F.col("style")).alias("role_"), F.sha2("text", 256).alias("text_sha256"))
    found = found.where(T.not_blank(F.col("text"))).withColumn("number", T.heading_number(F.col("text"), F.col("level")))
    role = F.when(F.col("label") == "图", "figure_caption").when(F.col("label") == "表", "table_caption").otherwise(F.col("role_"))
    open_ = F.lit(False).alias("approved")
    headings = found.where("level is not null").select("doc_id", "pos", "level", F.coalesce("number", F.array().cast("array<int>")).alias("number"), "text_sha256", open_)
    return {
        "roles": found.select("doc_id", "pos", role.alias("role"), "text_sha256", open_),
        "headings": headings,
        "captions": found.where("label is not null").select(
            "doc_id", "pos", "label", "sequence_name", "identifier_start", "identifier_stop", F.sha2("identifier", 256).alias("identifier_sha256"), F.sha2("title", 256).alias("title_text_sha256"),
            F.sha2(F.substring(F.col("text"), F.lit(1), F.col("identifier_start")), 256).alias("identifier_prefix_sha256"), F.sha2(F.substring(F.col("text"), F.col("identifier_stop") + 1, F.length("text")), 256).alias("identifier_suffix_sha256"),
            (F.length("text") - F.length("title")).alias("title_span_start"),
            "identifier_semantics", "domain_context", "hierarchy", "sequence", "heading_level", F.lit("preserve").alias("action"), "text_sha256", open_,
        ),
        "anomalies": ordered.numbering_anomalies(headings),
        "modes": inventory.chapter_mode(headings.where("level = 1").select("doc_id", "pos", F.element_at("number", 1).alias("chapter"))),
    }


def bound(entries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """entries(doc_id, pos, text_sha256, ...) -> with status ok, mismatch or missing."""
    there = paragraphs.select("doc_id", "pos", F.sha2("text", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("text_sha256"), "ok").otherwise("mismatch")
    return entries.join(there, ["doc_id", "pos"], "left").withColumn("status", status).drop("found")


