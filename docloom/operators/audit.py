"""Rules against values: failures, and the verdict over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def failures(rules: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rules(rule_id, target, prop, expected), values(key, target, prop, actual) -> a row for each value that is not as expected.

    Rules meet values by target and property, an equi-join; a rule for all has a row for each target.
    """
    joined = values.join(rules, ["target", "prop"])
    return joined.where(~F.coalesce(T.same_value(F.col("prop"), F.col("expected"), F.col("actual")), F.lit(False))).select(key, "rule_id", "prop", "expected", "actual")


def long_values(df: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """A row for each property column, its value as a string."""
    pairs = F.array(*[F.struct(F.lit(p).alias("prop"), F.col(p).cast("string").alias("actual")) for p in props])
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.prop", "x.actual")


def verdict(checks: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and(passed).alias("passed"), F.count_if(~passed).alias("failed"))


def overall(checks: DataFrame, passed: Column) -> DataFrame:
    """One row; without any check all have passed."""
    return checks.agg(F.coalesce(F.bool_and(passed), F.lit(True)).alias("passed"))


def first_failures(found: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` of each key, in order: the rest of a report is left out on purpose."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def header_repeats(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows(doc_id, table, row, is_header), tables(doc_id, table, header_rows): whether all rows listed repeat; an empty list does not."""
    listed = tables.select("doc_id", "table", F.explode_outer("header_rows").alias("row"))
    found = listed.join(rows, ["doc_id", "table", "row"], "left")
    return found.groupBy("doc_id", "table").agg(F.bool_and(F.coalesce("is_header", F.lit(False))).alias("repeats"))


def section_evidence(sections: DataFrame, keys: list[str]) -> DataFrame:
    """sections(..., kind header or footer, payload, page_start, title_page) -> counts and whether the section may go."""
    out = sections.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "header").alias("headers"), F.count_if(F.col("kind") == "footer").alias("footers"),
        F.bool_or("payload").alias("payload"), F.bool_or("page_start").alias("page_start"), F.bool_or("title_page").alias("title_page"),
    )
    return out.withColumn("safe", ~(F.col("payload") | F.col("page_start") | F.col("title_page")))
