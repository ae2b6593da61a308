"""Numberings of headings: where they start, and new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import parts, word

#: Levels that headings may have, and how the first and the others are written.
MOST_LEVELS, CHAPTER = 4, "第%1章"


def heading_starts(found: dict[str, DataFrame], style: str = "heading 1") -> DataFrame:
    """numberings() -> doc_id, start of the documents whose ``style`` (by its name, in any case) names a numbering.

    A num that overrides the start of its first level has the last word; else the abstract numbering that it names tells. A branch that
    is taken and finds nothing gives null. Of nums or abstract numberings with the same id the first counts.
    """
    at = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    linked = found["links"].where((F.lower("style") == style) & F.col("num").isNotNull()).groupBy("doc_id").agg(F.first("num").alias("num"))
    num = found["nums"].withColumn("nth", at(["doc_id", "num"])).where("nth = 1").select("doc_id", "num", "ord", "abstract")
    over = found["overrides"].where("level = '0'").select("doc_id", "ord", F.col("start").alias("over"), F.lit(True).alias("overrides"))
    level = found["levels"].where("level = '0'").select("doc_id", "ord", F.col("start").alias("own"))
    abstract = found["abstracts"].join(level, ["doc_id", "ord"]).withColumn("nth", at(["doc_id", "abstract"])).where("nth = 1").select("doc_id", "abstract", "own")
    joined = linked.join(num, ["doc_id", "num"], "left").join(over, ["doc_id", "ord"], "left").join(abstract, ["doc_id", "abstract"], "left")
    return joined.select("doc_id", F.when(F.col("overrides"), F.col("over")).otherwise(F.col("own")).alias("start"))


def _level_text(level: Column) -> Column:
    return F.when(level == 0, F.lit(CHAPTER)).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), level + 1), lambda i: F.concat(F.lit("%"), i.cast("string"))), "."))


def rebuilt(found: dict[str, DataFrame], wanted: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """numberings(), wanted(doc_id, levels, chapter_start) -> numberings with one more of each wanted, and faults(doc_id, fault).

    Ids are the first above all of the document's that are integers, allocated by one aggregation a relation. The new numbering starts
    its first level at chapter_start, which is an override too unless it is 1; the styles of its headings name it instead of what
    they named, and are made if they are missing. Levels from 1 to 4 and starts from 1 are allowed; others are faults and change nothing.
    """
    levels, start = F.col("levels"), F.col("chapter_start")
    fault = F.when(levels.isNull() | ~levels.between(1, MOST_LEVELS), "heading_levels").when(start.isNull() | (start < 1), "chapter_start")
    asked = wanted.withColumn("fault", fault)
    good = asked.where("fault is null").select("doc_id", "levels", "chapter_start")
    top = lambda df, c: df.groupBy("doc_id").agg((F.coalesce(F.max(F.col(c).try_cast("int")), F.lit(0)) + 1).alias(f"new_{c}"))
    ids = good.join(top(found["abstracts"], "abstract"), "doc_id", "left").join(top(found["nums"], "num"), "doc_id", "left").fillna(1, ["new_abstract", "new_num"])
    # new rows stand before all abstract numberings and after all nums
    low = found["abstracts"].groupBy("doc_id").agg((F.min("ord") - 1).alias("low"))
    high = found["nums"].groupBy("doc_id").agg((F.max("ord") + 1).alias("high"))
    ids = ids.join(low, "doc_id", "left").join(high, "doc_id", "left").fillna(-1, ["low"]).fillna(1 << 30, ["high"])
    each = ids.select("*", F.explode(F.sequence(F.lit(0), levels - 1)).alias("level"))
    heading = F.concat(F.lit("Heading"), (F.col("level") + 1).cast("string"))
    out = dict(found)
    out["abstracts"] = found["abstracts"].unionByName(ids.select("doc_id", F.col("new_abstract").cast("string").alias("abstract"), F.col("low").alias("ord")))
    out["nums"] = found["nums"].unionByName(ids.select("doc_id", F.col("new_num").cast("string").alias("num"), F.col("high").alias("ord"), F.col("new_abstract").cast("string").alias("abstract")))
    out["overrides"] = found["overrides"].unionByName(ids.where("chapter_start <> 1").select("doc_id", F.col("high").alias("ord"), F.lit("0").alias("level"), F.col("chapter_start").cast("int").alias("start")))
    new_levels = each.select(
        "doc_id", F.col("low").alias("ord"), F.col("level").cast("string").alias("level"), F.when(F.col("level") == 0, start).otherwise(1).cast("int").alias("start"), F.lit("decimal").alias("format"),
        _level_text(F.col("level")).alias("text"), heading.alias("style"),
    )
    out["levels"] = found["levels"].unionByName(new_levels)
    name = F.concat(F.lit("heading "), (F.col("level") + 1).cast("string"))
    new = each.select("doc_id", heading.alias("new_id"), name.alias("name"), F.col("new_num").cast("string").alias("to_num"), F.col("level").cast("string").alias("to_level"))
    old = found["links"].withColumn("name", F.lower("style"))
    joined = old.join(new, ["doc_id", "name"], "full_outer")
    out["links"] = joined.select(
        "doc_id", F.coalesce("style_id", "new_id").alias("style_id"), F.coalesce("style", F.initcap("name")).alias("style"), F.coalesce("to_num", "num").alias("num"), F.coalesce("to_level", "level").alias("level")
    )
    return out, asked.where("fault is not null").select("doc_id", "fault")


def numbering_xml(found: dict[str, DataFrame]) -> DataFrame:
    """numberings() -> doc_id, name, content: the numbering part of each document, to be read again."""
    attr = lambda name, c: F.coalesce(F.concat(F.lit(f' w:{name}="'), word.escaped(c.cast("string")), F.lit('"')), F.lit(""))
    leaf = lambda tag, c: F.coalesce(F.concat(F.lit(f'<w:{tag} w:val="'), word.escaped(c.cast("string")), F.lit('"/>')), F.lit(""))
    joined = lambda df, by, order, xml: df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), xml.alias("x")))), lambda y: y["x"]), "").alias("inner"))
    level = F.concat(F.lit("<w:lvl"), attr("ilvl", F.col("level")), F.lit(">"), leaf("start", F.col("start")), leaf("numFmt", F.col("format")), leaf("pStyle", F.col("style")), leaf("lvlText", F.col("text")), F.lit("</w:lvl>"))
    abstracts = found["abstracts"].join(joined(found["levels"], ["doc_id", "ord"], "level", level), ["doc_id", "ord"], "left")
    a = F.concat(F.lit("<w:abstractNum"), attr("abstractNumId", F.col("abstract")), F.lit(">"), F.coalesce("inner", F.lit("")), F.lit("</w:abstractNum>"))
    over = F.concat(F.lit("<w:lvlOverride"), attr("ilvl", F.col("level")), F.lit(">"), leaf("startOverride", F.col("start")), F.lit("</w:lvlOverride>"))
    nums = found["nums"].join(joined(found["overrides"], ["doc_id", "ord"], "level", over), ["doc_id", "ord"], "left")
    n = F.concat(F.lit("<w:num"), attr("numId", F.col("num")), F.lit(">"), leaf("abstractNumId", F.col("abstract")), F.coalesce("inner", F.lit("")), F.lit("</w:num>"))
    rows = abstracts.select("doc_id", F.struct(F.lit(0).alias("k"), "ord").alias("at"), a.alias("xml")).unionByName(nums.select("doc_id", F.struct(F.lit(1).alias("k"), "ord").alias("at"), n.alias("xml")))
    whole = joined(rows, ["doc_id"], "at", F.col("xml"))
    return whole.select("doc_id", F.lit("word/numbering.xml").alias("name"), F.concat(F.lit(f"<w:numbering {parts.SPACES}>"), F.col("inner"), F.lit("</w:numbering>")).alias("content"))
