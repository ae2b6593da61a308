"""Operators that depend on the order within a document. Each partitions by document, so one shuffle serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

BEFORE = (Window.unboundedPreceding, -1)


def numbering_anomalies(headings: DataFrame) -> DataFrame:
    """headings(doc_id, pos, number array<int>) -> doc_id, pos, kind, number, expected_last.

    Of a number seen before: duplicate_number; whose parent was not seen before: missing_parent; that does
    not follow its sibling before it: sequence_gap. The sibling is the one observed, right or wrong.
    """
    # A heading stands twice: under its own number, and under its parent's as a child. Rows under one number,
    # in order, then show all three faults at once: one scan, one shuffle, one window order.
    h = headings.where(F.size("number") > 0)
    parent = F.slice("number", 1, F.size("number") - 1)
    roles = F.array(F.struct(F.col("number").alias("under"), F.lit(False).alias("child")), F.struct(parent.alias("under"), F.lit(True).alias("child")))
    rows = h.select("doc_id", "pos", "number", F.explode(roles).alias("x")).select("doc_id", "pos", "number", "x.under", "x.child")
    before = Window.partitionBy("doc_id", "under").orderBy("pos").rowsBetween(*BEFORE)
    rows = rows.withColumn("seen", F.coalesce(F.count_if(~F.col("child")).over(before), F.lit(0)))
    rows = rows.withColumn("sibling", F.last(F.when(F.col("child"), F.element_at("number", -1)), ignorenulls=True).over(before))
    deep, expected = F.col("child") & (F.size("number") > 1), F.coalesce(F.col("sibling") + 1, F.lit(1))
    nothing = F.lit(None).cast("int").alias("expected_last")
    found = F.array(
        F.when(~F.col("child") & (F.col("seen") > 0), F.struct(F.lit("duplicate_number").alias("kind"), nothing)),
        F.when(deep & (F.col("seen") == 0), F.struct(F.lit("missing_parent").alias("kind"), nothing)),
        F.when(deep & (F.element_at("number", -1) != expected), F.struct(F.lit("sequence_gap").alias("kind"), expected.alias("expected_last"))),
    )
    return rows.select("doc_id", "pos", "number", F.explode(F.array_compact(found)).alias("x")).select("doc_id", "pos", "number", "x.kind", "x.expected_last")


def nearby(lines: DataFrame, reach: int = 2) -> DataFrame:
    """The texts from ``reach`` before to ``reach`` after, joined by newlines."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-reach, reach)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def run_offsets(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """runs(..., text) -> with start and stop of each run in its paragraph."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.length("text")).over(w)
    return runs.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("text"))


def without_prefix(runs: DataFrame, n: Column) -> DataFrame:
    """runs with start: the first ``n`` characters of the paragraph removed from left to right."""
    return runs.withColumn("text", F.substring("text", F.greatest(F.lit(1), n - F.col("start") + 1).cast("int"), F.length("text")))


def first_anchor(lines: DataFrame, style: str | None = None) -> DataFrame:
    """The first paragraph of the style that is not blank, else the first that is not blank."""
    match = F.coalesce(F.col("style") == style, F.lit(False)).cast("int") if style is not None else F.lit(0)
    w = Window.partitionBy("doc_id").orderBy(match.desc(), "pos")
    return lines.where(T.not_blank(F.col("text"))).withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def trailing_empty(sections: DataFrame) -> DataFrame:
    """sections(doc_id, idx, payload): those from the end back to the first with payload, never the first section."""
    w = Window.partitionBy("doc_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sections.withColumn("used", F.bool_or("payload").over(w)).where("not used and idx > 0").drop("used")


def body_index(lines: DataFrame, direct: Column) -> DataFrame:
    """Numbers the paragraphs that stand in the body itself; others have the number of the one before."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("body_index", F.sum(direct.cast("int")).over(w) - 1)


def text_outside_results(tokens: Column) -> Column:
    """tokens array<struct<kind, text>> of a paragraph -> its text without the results of fields.

    kind: begin, separate, end, text, tab or break. A stack holds for each open field whether its result has begun.
    """
    seed = F.struct(F.array().cast("array<boolean>").alias("stack"), F.lit("").alias("text"))

    def step(s: Column, t: Column) -> Column:
        stack, kind = s["stack"], t["kind"]
        inside = F.exists(stack, lambda x: x)
        new = (
            F.when(kind == "begin", F.concat(stack, F.array(F.lit(False))))
            .when((kind == "separate") & (F.size(stack) > 0), F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(F.lit(True))))
            .when((kind == "end") & (F.size(stack) > 0), F.slice(stack, 1, F.size(stack) - 1))
            .otherwise(stack)
        )
        more = F.when((kind == "text") & ~inside, F.coalesce(t["text"], F.lit(""))).when(kind == "tab", "\t").when(kind == "break", "\n").otherwise("")
        return F.struct(new.alias("stack"), F.concat(s["text"], more).alias("text"))

    return F.aggregate(tokens, seed, step, lambda s: s["text"])


def field_instructions(tokens: Column) -> Column:
    """tokens array<struct<kind, text>> of a paragraph -> the instructions of its fields, each when it is complete."""
    field = "struct<parts:string,captured:boolean>"
    seed = F.struct(F.array().cast(f"array<{field}>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        stack, kind, out = s["stack"], t["kind"], s["out"]
        depth = F.size(stack)
        top, rest = F.try_element_at(stack, F.lit(-1)), F.slice(stack, 1, F.greatest(depth - 1, F.lit(0)))
        open_ = (depth > 0) & ~F.coalesce(top["captured"], F.lit(True))
        put = lambda parts, done: F.concat(rest, F.array(F.struct(parts.alias("parts"), done.alias("captured"))))
        stacked = (
            F.when(kind == "begin", F.concat(stack, F.array(F.struct(F.lit("").alias("parts"), F.lit(False).alias("captured")))))
            .when((kind == "separate") & open_, put(top["parts"], F.lit(True)))
            .when((kind == "end") & (depth > 0), rest)
            .when((kind == "instr") & open_, put(F.concat(top["parts"], F.coalesce(t["text"], F.lit(""))), F.lit(False)))
            .otherwise(stack)
        )
        value = F.regexp_replace(F.coalesce(top["parts"], F.lit("")), r"(?U)^\s+|\s+$", "")
        ready = kind.isin("separate", "end") & open_ & (value != "")
        return F.struct(stacked.alias("stack"), F.when(ready, F.concat(out, F.array(value))).otherwise(out).alias("out"))

    return F.aggregate(tokens, seed, step, lambda s: s["out"])


#: Tokens of a chunk: what a chunk of brackets comes to is two numbers, which are summed up over the chunks before.
CHUNK = 4096


def open_fields(tokens: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """tokens(keys, at, kind, text) as rows -> with depth, the open fields after each, level, that of the field it acts on, field, where that
    began, and inside: whether a result of any open field has begun.

    An end without an open field does nothing, so the depth is the running sum of begins and ends less the least that it has been below 0.
    Sum and least of a sequence follow from those of its parts: they are found for chunks, carried over the chunks of a key, and then
    within each chunk. No key is gathered: all else are windows, by key and level. A result lasts from its separator to the next end that
    goes below its level, and what is open is a running sum again.
    """
    by = lambda *more: Window.partitionBy(*keys, *more).orderBy("at")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    t = tokens.withColumn("chunk_", F.expr(f"at div {chunk}")).withColumn("step_", step)
    here = upto(by("chunk_"))
    t = t.withColumn("sum_", F.sum("step_").over(here))
    t = t.withColumn("least_", F.min("sum_").over(here))
    chunks = t.groupBy(*keys, "chunk_").agg(F.sum("step_").alias("total"), F.min("least_").alias("low"))
    before = Window.partitionBy(*keys).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    chunks = chunks.withColumn("floor", F.coalesce(F.min(F.col("base") + F.col("low")).over(before), F.lit(0))).select(*keys, "chunk_", "base", "floor")
    t = t.join(chunks, [*keys, "chunk_"])
    depth = F.col("base") + F.col("sum_") - F.least(F.lit(0), F.col("floor"), F.col("base") + F.col("least_"))
    t = t.withColumn("depth", depth.cast("int")).withColumn("was_", F.coalesce(F.lag("depth").over(by()), F.lit(0)))
    # an end acts on the field that it closes, all others on the top
    t = t.withColumn("level", F.when(F.col("kind") == "end", F.col("was_")).otherwise(F.col("depth")))
    t = t.withColumn("field", F.when(F.col("level") > 0, F.last(F.when(F.col("kind") == "begin", F.col("at")), True).over(upto(by("level")))))
    opens = (F.col("kind") == "separate") & (F.col("level") > 0)
    nth = F.sum(F.when(opens, 1).otherwise(0)).over(upto(by("level", "field")))
    t = t.withColumn("starts_", (opens & (nth == 1)).cast("int")).withColumn("stops_", ((F.col("kind") == "end") & (F.col("level") > 0) & (nth > 0)).cast("int"))
    return t.withColumn("inside", F.sum(F.col("starts_") - F.col("stops_")).over(upto(by())) > 0).select(*tokens.columns, "depth", "level", "field", "inside")


def shown(tokens: DataFrame) -> Column:
    """Of open_fields(): the text that a token shows, null for none."""
    kind = F.col("kind")
    return F.when((kind == "text") & ~F.col("inside"), F.coalesce("text", F.lit(""))).when(kind == "tab", "\t").when(kind == "break", "\n")


def completed_fields(opened: DataFrame, keys: list[str]) -> DataFrame:
    """open_fields() -> keys, at, instruction: each field's instruction, where it is complete: at its first separator, else at its end. Only the
    parts of one field meet."""
    kind, acts = F.col("kind"), F.col("level") > 0
    done = F.min(F.when(kind.isin("separate", "end"), F.col("at"))).over(Window.partitionBy(*keys, "field"))
    own = opened.where(acts & kind.isin("instr", "separate", "end")).withColumn("done", done).where("done is not null and at <= done")
    part = F.when(kind == "instr", F.struct("at", F.coalesce("text", F.lit("")).alias("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "")
    found = own.groupBy(*keys, "field", "done").agg(F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("instruction"))
    return found.where("instruction <> ''").select(*keys, F.col("done").alias("at"), "instruction")


def tail_cutoff(sections: DataFrame) -> DataFrame:
    """sections(doc_id, boundary, empty): the least boundary, one further where the section is not empty."""
    return sections.groupBy("doc_id").agg(F.min(F.when(F.col("empty"), F.col("boundary")).otherwise(F.col("boundary") + 1)).alias("cutoff"))


def next_id(ids: DataFrame, column: str) -> DataFrame:
    digits = F.when(F.rlike(column, F.lit("^[0-9]+$")), F.col(column).cast("long"))
    return ids.agg((F.coalesce(F.max(digits), F.lit(0)) + 1).alias("next_id"))


def first_cells(cells: DataFrame, keys: list[str], cell: str, order: list[str]) -> DataFrame:
    """Of merged cells the first in each table."""
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    return cells.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
