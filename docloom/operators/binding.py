"""Joins that bind rules, maps and references to the documents they speak of.

Maps are small beside the documents, so Spark broadcasts them where their size allows; nothing is forced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATOR = ["kind", "table", "row", "cell", "paragraph"]


def unresolved(references: DataFrame, bookmarks: DataFrame, key: str) -> DataFrame:
    return references.select(key).where(F.col(key).isNotNull()).join(bookmarks.select(key), key, "left_anti").distinct()


def unknown_ids(df: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, id) for each id of an array column that is not known."""
    each = df.select(key, F.explode(F.array_distinct(ids)).alias("id"))
    return each.join(known.select(F.col(known_id).alias("id")).distinct(), "id", "left_anti").select(key, "id")


def unsupported(props: DataFrame, allowed: DataFrame) -> DataFrame:
    """props(rule_id, kind, key), allowed(kind, key) -> rule_id, key of what a rule of that kind may not set."""
    return props.join(allowed, ["kind", "key"], "left_anti").select("rule_id", "key")


def _same_place(a: DataFrame, b: DataFrame) -> Column:
    on = a["doc_id"] == b["doc_id"]
    for c in LOCATOR:
        on = on & a[c].eqNullSafe(b[c])
    return on


def bound(entries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """entries(doc_id, locator columns, text_sha256) -> with status: ok, mismatch or missing."""
    there = paragraphs.select("doc_id", *LOCATOR, F.sha2("text", 256).alias("found_sha256"))
    joined = entries.join(there, _same_place(entries, there), "left")
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("found_sha256") == F.col("text_sha256"), "ok").otherwise("mismatch")
    return joined.select(*[entries[c] for c in entries.columns], status.alias("status"))


def hash_bound(entries: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """entries(key, text_sha256), texts(key, text) -> key, status."""
    there = texts.select(key, F.sha2("text", 256).alias("found_sha256"))
    status = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("found_sha256") == F.col("text_sha256"), "ok").otherwise("mismatch")
    return entries.join(there, key, "left").select(key, status.alias("status"))


def approved(df: DataFrame, entries: DataFrame, key: str, condition: Column) -> DataFrame:
    return df.join(entries.where(condition).select(key), key, "left_semi")


def in_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines(doc_id, pos, ...) that stand in a range (doc_id, first, last) of their document, each once."""
    return lines.join(ranges, "doc_id").where(F.col("pos").between(F.col("first"), F.col("last"))).select(*lines.columns).distinct()


def contained(spans: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """spans(keys, s, e) in runs(keys, start, stop): the number of runs that hold the span whole, and that overlap it."""
    r = runs.select(*keys, "start", "stop")
    holds = (F.col("start") <= F.col("s")) & (F.col("e") <= F.col("stop"))
    meets = F.least("stop", "e") > F.greatest("start", "s")
    return spans.join(r, keys, "left").groupBy(*keys, "s", "e").agg(F.count_if(holds).alias("holding"), F.count_if(meets).alias("overlapping"))


def effective(direct: DataFrame, styles: DataFrame, key: str, style: str, value: str) -> DataFrame:
    """The value set on a paragraph itself, else its own style's; no further inheritance."""
    s = styles.select(style, F.col(value).alias("style_value"))
    return direct.join(s, style, "left").select(key, F.coalesce(value, "style_value").alias(value))


def looked_up(df: DataFrame, hops: list[tuple[DataFrame, str, str]], default: Column, name: str) -> DataFrame:
    """Follows (table, key, value) one after the other from the column ``name``; ``default`` where a hop is missing."""
    for table, key, value in hops:
        table = table.select(F.col(key).alias(name), F.col(value).alias("next_"))
        df = df.join(table, name, "left").drop(name).withColumnRenamed("next_", name)
    return df.withColumn(name, F.coalesce(name, default))


def shifted_rows(rows: Column, deleted: Column) -> Column:
    """An array of row indices after the row ``deleted`` has gone: it is left out and later ones move up by one."""
    kept = F.filter(rows, lambda r: r != deleted)
    moved = F.transform(kept, lambda r: F.when(r > deleted, r - 1).otherwise(r))
    return F.when(deleted.isNull(), rows).otherwise(moved)
