"""An approved structure map applied to documents, in its fixed order: table of contents, headings, tables, captions, trailing sections.

A document is changed as a whole or not at all: the first fault of any of its entries leaves all its relations as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.operators import authority, breaks, mapped, update
from docloom.sources import word
from docloom.sources.stored import stored


def entries(maps: DataFrame) -> dict[str, DataFrame]:
    """maps as sources.rules.maps() reads them, with the doc_id that each is for -> the approved entries of each kind."""
    semantic = F.col("schema_version").isin(K.SEMANTIC_MAP_VERSIONS)

    def each(column: str, flag: str = "approved") -> DataFrame:
        whole = maps.select("doc_id", F.col("schema_version").alias("version"), semantic.alias("semantic"), F.posexplode(column).alias("ord", "x"))
        return whole.where(f"x.{flag}")

    x = F.col("x")
    at = F.when(x["locator"].isNotNull(), mapped.spot(x["locator"])).otherwise(mapped.body_spot(x["paragraph"]))
    return {
        "toc": each("toc_ranges").select("doc_id", "ord", x["start_paragraph"].alias("first"), x["end_paragraph"].alias("last"), x["paragraph_sha256"].alias("hashes"), x["levels"].alias("levels")),
        "headings": each("headings").select("doc_id", at.alias("spot"), x["level"].alias("level"), x["text_sha256"].alias("text_sha256")),
        "tables": each("tables").select("doc_id", "semantic", *[x[c].alias(c) for c in ("table", "kind", "table_text_sha256", "first_row_sha256", "repeat_header_rows", "repeat_header", "prevent_normal_row_split", "caption_row")]),
        "captions": each("captions").select(
            "doc_id", at.alias("spot"), "ord", "version", x["identifier_span"]["start"].alias("start"), x["identifier_span"]["end"].alias("stop"),
            *[x[c].alias(c) for c in ("action", "text_sha256", "migrate_outside_table", "identifier_sha256", "identifier_prefix_sha256", "identifier_suffix_sha256", "replacement_identifier", "label", "sequence_name", "heading_level", "cached_hierarchy", "cached_sequence")],
        ),
        "trailing_sections": each("trailing_empty_sections", "approved_delete").select("doc_id", "x.*"),
    }


def document_of(nodes: DataFrame) -> dict[str, DataFrame]:
    """The relations of packages that a map acts on. Places are numbers of nodes."""
    styles = word.styles(nodes).select("doc_id", "style_id", F.col("style").alias("named"))
    found = word.paragraphs(nodes).join(styles, ["doc_id", "style_id"], "left")
    here: Column = F.struct("kind", "table", "row", "cell", "paragraph")
    paragraphs = found.select("doc_id", F.col("p").alias("place"), mapped.spot(here).alias("spot"), "text", F.coalesce("named", "style_id", F.lit("Normal")).alias("style"))
    return {"paragraphs": paragraphs, "rows": word.rows(nodes), "tables": word.table_hashes(nodes), "nodes": nodes}


def apply_map(document: dict[str, DataFrame], approved: dict[str, DataFrame], keep: mapped.Keep = stored) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """document: paragraphs(doc_id, place, spot, text, style), rows(doc_id, table, row, is_header, cant_split, cells), tables(doc_id, table, place, rows,
    table_text_sha256, first_row_sha256) and, for trailing sections, nodes; approved: as of entries() -> the new relations (with fields, and the
    body's children where nodes are given), changes(doc_id, step, kind, targets), and faults(doc_id, step, fault).

    A document's first fault, by step and then by name, is told; steps without a target are left out of the changes. ``keep`` writes what
    the next step starts from.
    """
    old, old_rows, of_tables = keep(document["paragraphs"]), keep(document["rows"]), keep(document["tables"])
    places, hashes = of_tables.select("doc_id", "table", "place"), of_tables.drop("place")
    steps = {"toc": mapped.toc(old, approved["toc"], keep)}
    steps["headings"] = mapped.headings(steps["toc"].after, approved["headings"], keep)
    steps["tables"] = mapped.tables(old_rows, hashes, approved["tables"], keep)
    steps["captions"], rows, actions = mapped.captions(keep(steps["headings"].after), keep(steps["tables"].after), places, approved["captions"], keep)
    out = {"paragraphs": steps["captions"].after, "rows": rows, "fields": steps["toc"].fields.unionByName(steps["captions"].fields), "actions": actions}
    faults = [s.faults.withColumn("kind", F.lit(kind)) for kind, s in steps.items()]
    targets = [s.targets.withColumn("kind", F.lit(kind)) for kind, s in steps.items()]
    if "nodes" in document:
        children, bad = breaks.without_trailing(document["nodes"], approved["trailing_sections"], keep)
        out["children"] = children
        faults.append(bad.select("doc_id", "fault", F.lit("trailing_sections").alias("kind")))
        good = approved["trailing_sections"].where("approved_delete").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        targets.append(good.select("doc_id", "n", F.lit("trailing_sections").alias("kind")))
    order = F.array_position(F.array(*map(F.lit, update.MAP_ORDER)), F.col("kind")).cast("int") - 1
    every = reduce(DataFrame.unionByName, faults).withColumn("step", order)
    first = keep(every.groupBy("doc_id").agg(F.min(F.struct("step", "fault")).alias("x")).select("doc_id", "x.step", "x.fault"))
    failed = first.select("doc_id")
    changes = authority.map_changes(reduce(DataFrame.unionByName, targets).withColumnRenamed("doc_id", "map_id"), update.MAP_ORDER).withColumnRenamed("map_id", "doc_id")
    kept = {"paragraphs": old, "rows": old_rows}
    result = {name: df.join(failed, "doc_id", "left_anti") for name, df in out.items()}
    for name, df in kept.items():
        result[name] = result[name].unionByName(df.join(failed, "doc_id", "left_semi").select(*result[name].columns))
    return result, changes.join(failed, "doc_id", "left_anti"), first
