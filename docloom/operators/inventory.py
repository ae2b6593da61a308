"""Counts, fingerprints and manifests of documents. Keys hash or count map-side before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T


def paragraphs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, pos, text: a row for each line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def style_counts(df: DataFrame, style: str) -> DataFrame:
    return df.groupBy(F.coalesce(style, F.lit("<none>")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


def paragraph_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if(T.not_blank(F.col("text"))).alias("non_empty"))


def ordered_hash(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "sha256") -> DataFrame:
    """A hash of the hashes of a key's values in order: equal if and only if the same values stand in the same order.

    Only 64 characters a value are gathered, however long the values are.
    """
    each = df.select(*keys, F.struct(*order, F.sha2(value, 256).alias("h")).alias("x"))
    gathered = F.array_sort(F.collect_list("x"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(gathered, lambda x: x["h"]), ","), 256).alias(name))


def content_fingerprint(lines: DataFrame) -> DataFrame:
    return ordered_hash(lines, ["doc_id"], ["pos"], F.col("text"), "fingerprint")


def table_text_hash(cells: DataFrame, table: str) -> DataFrame:
    """cells(table, row, cell, text): cells joined by U+241F, rows by U+241E, hashed."""
    rows = cells.groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]), K.CELL_END).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), K.ROW_END)
    return rows.groupBy(table).agg(F.sha2(whole, 256).alias("text_sha256"))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, status of each object: same, changed, removed or added."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def element_counts(df: DataFrame, key: str, xml: str, names: list[str]) -> DataFrame:
    """How many elements of each name open in the markup of a row."""
    return df.select(key, *[F.regexp_count(xml, F.lit(rf"<{n}[\s>/]")).cast("long").alias(f"n_{n}") for n in names])


def kind_counts(fields: DataFrame, instruction: str) -> DataFrame:
    return fields.groupBy(T.field_kind(F.col(instruction)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def fonts_of(props: DataFrame) -> DataFrame:
    """props(key, value): the distinct fonts that rules name, by their groups."""
    used = props.where(F.col("key").isin("font_name", "font_name_ascii", "font_name_east_asia", "font_name_complex_script") & T.not_blank(F.col("value")))
    return used.select(F.trim("value").alias("font")).distinct()


def resolved_fonts(required: DataFrame, available: DataFrame) -> DataFrame:
    """required(font), available(font) -> font, match: exact, verified_alias or missing."""
    key = lambda df, name: df.select(F.col("font").alias(name), T.font_key(F.col("font")).alias(f"{name}_key"), T.font_group(F.col("font")).alias("font_group")).distinct()
    a, b = key(required, "wanted"), key(available, "there")
    best = a.join(b, "font_group", "left").groupBy("wanted").agg(
        F.max(F.when(F.col("there_key") == F.col("wanted_key"), 2).when(F.col("there_key").isNotNull(), 1).otherwise(0)).alias("best")
    )
    return best.select(F.col("wanted").alias("font"), F.when(F.col("best") == 2, "exact").when(F.col("best") == 1, "verified_alias").otherwise("missing").alias("match"))


def chapter_mode(headings: DataFrame) -> DataFrame:
    """headings(doc_id, pos, chapter): one distinct chapter makes a document a single chapter; chapter_start is the first."""
    out = headings.groupBy("doc_id").agg(F.count_distinct("chapter").alias("n"), F.min_by("chapter", "pos").alias("chapter_start"))
    return out.select("doc_id", F.when(F.col("n") == 1, "single_chapter").otherwise("whole_book").alias("mode"), "chapter_start")


def ole_kind(prog_id: Column) -> Column:
    low = F.lower(F.coalesce(prog_id, F.lit("")))
    return F.when(F.contains(low, F.lit("dsmt")) | F.contains(low, F.lit("mathtype")), "mathtype_ole").when(low.isin("equation.3", "equation.2", "equation"), "legacy_equation_ole").otherwise("other_ole")
