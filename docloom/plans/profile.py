"""An approved profile applied to documents: its rules one after the other, each on what those before it have left.

The rules of a profile are few and are one array a profile; each row of a document's relations folds over them, so that a later rule reads
the page, the style, the text or the flags that an earlier one has set. No relation is joined to itself, and the rows of a document
never meet in one place but to be counted. A document is changed as a whole or not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import authority, update
from docloom.operators.mapped import Keep
from docloom.sources.stored import stored

#: Lengths of a section, by the property that sets each.
LENGTHS = ["margin_top_mm", "margin_bottom_mm", "margin_left_mm", "margin_right_mm", "gutter_mm"]
#: Ratios, the length that each sets, and the side of the page that it is of.
RATIOS = {"margin_top_ratio": ("margin_top_mm", "h"), "margin_bottom_ratio": ("margin_bottom_mm", "h"), "margin_inner_ratio": ("margin_left_mm", "w"), "margin_outer_ratio": ("margin_right_mm", "w")}
#: How a table may stand.
TABLE_ALIGNMENTS = ["left", "center", "right"]


def _number(rule: Column, key: str) -> Column:
    return rule["props"][key].try_cast("double")


def _flag(rule: Column, key: str) -> Column:
    return authority.truthy(rule["props"][key])


def folded(rules: Column, state: dict[str, Column], step) -> Column:
    """An array of rules and a state by name; ``step`` gives of a state and a rule the columns that change, or the whole new state."""
    packed = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()])

    def merge(s: Column, r: Column) -> Column:
        new = step(s, r)
        return new if isinstance(new, Column) else packed({n: new.get(n, s[n]) for n in state})

    return F.aggregate(rules, packed(state), merge)


def section_step(s: Column, r: Column) -> dict[str, Column]:
    """A page after a rule: sizes that are given, an orientation that turns it where it is another and no size is given, margins, and
    ratios of the sides that it then has."""
    turn = F.lower(r["props"]["orientation"])
    sized = _number(r, "page_width_mm").isNotNull() | _number(r, "page_height_mm").isNotNull()
    turns = turn.isNotNull() & (turn != s["orientation"]) & ~sized
    w = F.when(turns, s["h"]).otherwise(F.coalesce(_number(r, "page_width_mm"), s["w"]))
    h = F.when(turns, s["w"]).otherwise(F.coalesce(_number(r, "page_height_mm"), s["h"]))
    out = {"w": w, "h": h, "orientation": F.coalesce(turn, s["orientation"])} | {c: F.coalesce(_number(r, c), s[c]) for c in LENGTHS}
    bad = F.coalesce(~turn.isin("portrait", "landscape"), F.lit(False))
    fault = F.when(F.coalesce(r["props"]["page_size_policy"], F.lit("preserve")) != "preserve", "page_size_policy").when(bad, "orientation")
    for ratio, (length, side) in RATIOS.items():
        n = _number(r, ratio)
        fault = fault.when((n < 0) | (n >= 0.5), ratio)
        out[length] = F.coalesce(n * (w if side == "w" else h), out[length])
    return out | {"fault": F.coalesce(s["fault"], fault)}


def _headed(style: Column, levels: Column) -> Column:
    level = F.regexp_extract(F.coalesce(style, F.lit("")), r"^Heading ([1-4])$", 1).try_cast("int")
    return F.when(level <= levels, level)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: an expression that stands twice in a fold is worked out twice, and so is all that it holds."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraph_step(s: Column, r: Column) -> Column:
    """A paragraph after a rule: targets of its own get its style; where a rule has none, the paragraphs of its style are its targets. A
    rule may strip the numbers of headings, and it may turn markers into fields."""
    entry = lambda n, markers: F.array(F.struct(r["ord"].alias("ord"), n.cast("long").alias("n"), markers.cast("long").alias("fields")))
    state = lambda style, text, hits, direct: F.struct(style.alias("style"), text.alias("text"), s["asked"].alias("asked"), hits.alias("hits"), direct.alias("direct"))

    hit = F.when(r["by_map"], F.array_contains(s["asked"], r["ord"])).otherwise(s["style"].eqNullSafe(r["style"]))
    styled = state(
        F.when(r["by_map"], r["style"]).otherwise(s["style"]), s["text"], F.concat(s["hits"], entry(F.lit(1), F.lit(0))), F.when(r["by_map"], F.concat(s["direct"], F.array(r["ord"]))).otherwise(s["direct"])
    )

    level = F.when(_flag(r, "strip_manual_heading_prefixes"), _headed(s["style"], F.coalesce(_number(r, "heading_levels").cast("int"), F.lit(4))))
    # what each marker begins with is looked for first
    markers = F.when(_flag(r, "convert_explicit_markers") & s["text"].contains("[["), F.regexp_count(s["text"], F.lit(K.FIELD_MARKER))).otherwise(F.lit(0))
    prefix = lambda text, level: F.coalesce(reduce(lambda c, k: c.when(level == k, F.length(T.heading_prefix(text, k))), (1, 2, 3, 4), F.when(level.isNull(), F.lit(0))), F.lit(0))

    def marked(x: Column) -> Column:
        text = F.when(x["markers"] > 0, T.without_markers(s["text"])).otherwise(s["text"])
        return F.struct(x["level"].alias("level"), x["markers"].alias("markers"), text.alias("text"), (prefix(s["text"], x["level"]) > 0).alias("strips"))

    def changed(x: Column) -> Column:
        # markers are converted before numbers are stripped
        text = F.when(x["strips"], F.substring(x["text"], prefix(x["text"], x["level"]) + 1, F.length(x["text"]))).otherwise(x["text"])
        n = x["strips"].cast("int") + x["markers"]
        return F.when(n > 0, state(s["style"], text, F.concat(s["hits"], entry(n, x["markers"])), s["direct"])).otherwise(s)

    fields = bound(F.struct(level.alias("level"), markers.alias("markers")), lambda x: F.when(x["level"].isNull() & (x["markers"] == 0), s).otherwise(bound(marked(x), changed)))
    return F.when(r["style"].isNotNull(), F.when(hit, styled).otherwise(s)).otherwise(fields)


def row_step(s: Column, r: Column) -> dict[str, Column]:
    """A row of a table after a rule: the listed rows, by default the first, repeat or no longer do; all but the caption's are kept whole or no longer are."""
    repeats, whole = r["props"]["repeat_header_row"], r["props"]["prevent_row_split"]
    header = repeats.isNotNull() & F.array_contains(s["listed"], s["row"])
    return {"is_header": F.when(header, authority.truthy(repeats)).otherwise(s["is_header"]), "cant_split": F.when(whole.isNotNull() & ~s["row"].eqNullSafe(s["caption_row"]), authority.truthy(whole)).otherwise(s["cant_split"])}


def table_step(s: Column, r: Column) -> dict[str, Column]:
    """A table after a rule: its style and place; its cells are centred by any rule."""
    to = r["props"]["alignment"]
    bad = F.when(F.coalesce(~to.isin(TABLE_ALIGNMENTS), F.lit(False)), "alignment")
    return {"style": F.coalesce(r["props"]["table_style"], s["style"]), "alignment": F.coalesce(to, s["alignment"]), "centred": F.lit(True), "fault": F.coalesce(s["fault"], bad)}


def document_step(s: Column, r: Column) -> dict[str, Column]:
    """What field rules set for a whole document. Fields that are made from markers are marked by later rules too; ``made`` has them by rule."""
    made = F.coalesce(F.element_at(s["made"], r["ord"]), F.lit(0).cast("long"))
    updates, dirty, rebuilds = r["props"]["update_on_open"], _flag(r, "mark_fields_dirty"), _flag(r, "rebuild_heading_numbering")
    levels = F.coalesce(_number(r, "heading_levels").cast("int"), F.lit(4))
    start = F.coalesce(s["chapter"], _number(r, "chapter_start").cast("int"), F.lit(1))
    n = updates.isNotNull().cast("long") + F.when(dirty, s["fields"]).otherwise(F.lit(0)) + F.when(rebuilds, levels).otherwise(F.lit(0))
    bad = F.when(rebuilds & ~levels.between(1, 4), "heading_levels").when(rebuilds & (start < 1), "chapter_start")
    return {
        "update_on_open": F.when(updates.isNotNull(), authority.truthy(updates)).otherwise(s["update_on_open"]), "dirty": F.when(dirty, s["fields"]).otherwise(s["dirty"]), "fields": s["fields"] + made,
        "levels": F.when(rebuilds, levels).otherwise(s["levels"]), "start": F.when(rebuilds, start).otherwise(s["start"]), "hits": F.concat(s["hits"], F.array(F.struct(r["ord"].alias("ord"), n.cast("long").alias("n")))), "fault": F.coalesce(s["fault"], bad),
    }


def apply_profile(document: dict[str, DataFrame], rules: DataFrame, props: DataFrame, keep: Keep = stored) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """document: of(doc_id, profile_id, chapter_start or null), paragraphs(doc_id, place, text, style), styles(doc_id, style, key, value), direct(doc_id, place, key, value), sections(doc_id,
    idx, page_width_mm, page_height_mm, orientation, LENGTHS), tables(doc_id, table, style, alignment, listed array<int>, caption_row), rows(doc_id, table, row, is_header, cant_split),
    counts(doc_id, fields, equations), and, where a map gives rules their paragraphs, targets(doc_id, ord, place);
    rules(profile_id, ord, id, status, application, selector_kind, selector_value, handler, style, by_map), props(profile_id, rule_id, key, value)
    -> the new relations, changes(doc_id, ord, rule_id, targets), manual(doc_id, ord, rule_id), faults(doc_id, fault).

    Approved rules act in the order of their profile; those for review are handed on. Rules with ``by_map`` act on the targets that a map
    gives them, which get their style and lose what they set themselves of its properties. Styles that a rule names are made where they
    are missing. A rule without a target has 0. Faults are of values that a rule may not have.
    """
    approved = rules.where("status = 'approved'")
    every = F.create_map().cast("map<string,string>")
    mapped_props = props.groupBy("profile_id", F.col("rule_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("value", F.lit(""))))).alias("props"))
    acting = keep(approved.where("application <> 'manual_review'").join(mapped_props, ["profile_id", "id"], "left").withColumn("props", F.coalesce("props", every)))

    def listed(condition: str) -> DataFrame:
        one = F.struct(F.col("ord").cast("int").alias("ord"), "style", "props", F.coalesce("by_map", F.lit(False)).alias("by_map"))
        return acting.where(condition).groupBy("profile_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["ord"] - b["ord"]).alias("rules"))  # the rules of a profile

    def with_rules(df: DataFrame, condition: str) -> DataFrame:
        return df.join(document["of"].select("doc_id", "profile_id", "chapter_start"), "doc_id").join(listed(condition), "profile_id", "left")

    def by(df: DataFrame, state: dict[str, Column], step, condition: str) -> DataFrame:
        empty = F.array().cast("array<struct<ord:int,style:string,props:map<string,string>,by_map:boolean>>")
        return with_rules(df, condition).withColumn("now", folded(F.coalesce("rules", empty), state, step)).drop("rules", "profile_id", "chapter_start")

    none = lambda kind: F.lit(None).cast(kind)
    pages = {"w": F.col("page_width_mm"), "h": F.col("page_height_mm"), "orientation": F.col("orientation")} | {c: F.col(c) for c in LENGTHS} | {"fault": none("string")}
    sections = keep(by(document["sections"], pages, section_step, "handler = 'sections'"))
    targets = document.get("targets")
    p = document["paragraphs"]
    p = p.withColumn("asked", F.array().cast("array<int>")) if targets is None else p.join(targets.groupBy("doc_id", "place").agg(F.collect_set(F.col("ord").cast("int")).alias("asked")), ["doc_id", "place"], "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<int>")))
    start = {"style": F.col("style"), "text": F.col("text"), "asked": F.col("asked"), "hits": F.array().cast("array<struct<ord:int,n:bigint,fields:bigint>>"), "direct": F.array().cast("array<int>")}
    paragraphs = keep(by(p, start, paragraph_step, "handler in ('styles', 'fields')"))
    of_tables = document["tables"].select("doc_id", "table", F.coalesce("listed", F.array(F.lit(0))).alias("listed"), "caption_row")
    rows = by(document["rows"].join(of_tables, ["doc_id", "table"], "left"), {c: F.col(c) for c in ("is_header", "cant_split", "row", "listed", "caption_row")}, row_step, "handler = 'tables'")
    tables = keep(by(document["tables"].withColumn("centred", F.lit(False)), {"style": F.col("style"), "alignment": F.col("alignment"), "centred": F.col("centred"), "fault": none("string")}, table_step, "handler = 'tables'"))
    hits = keep(paragraphs.select("doc_id", F.explode("now.hits").alias("x")).groupBy("doc_id", "x.ord").agg(F.sum("x.n").alias("n"), F.sum("x.fields").alias("fields")))
    made = hits.where("fields > 0").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "fields"))).alias("made"))
    counts = document["counts"].join(made, "doc_id", "left").withColumn("made", F.coalesce("made", F.create_map().cast("map<int,bigint>")))
    flags = {"update_on_open": F.lit(False), "dirty": F.lit(0).cast("long"), "fields": F.col("fields").cast("long"), "made": F.col("made"), "levels": none("int"), "start": none("int"), "chapter": F.col("chapter_start").cast("int"), "hits": F.array().cast("array<struct<ord:int,n:bigint>>"), "fault": none("string")}
    whole = keep(by(counts, flags, document_step, "handler = 'fields'"))

    faults = reduce(DataFrame.unionByName, [df.where("now.fault is not null").select("doc_id", F.col("now.fault").alias("fault")) for df in (sections, tables, whole)])
    faults = keep(faults.groupBy("doc_id").agg(F.min("fault").alias("fault")))
    failed = faults.select("doc_id")
    ruled = document["of"].select("doc_id", "profile_id").join(acting.select("profile_id", F.col("ord").cast("int").alias("ord"), F.col("id").alias("rule_id"), "handler", "style"), "profile_id")
    n_of = lambda df, handler, n: df.groupBy("doc_id").agg(n.cast("long").alias("n")).withColumn("handler", F.lit(handler))
    flat = reduce(DataFrame.unionByName, [n_of(document["sections"], "sections", F.count(F.lit(1))), n_of(document["tables"], "tables", F.count(F.lit(1))), n_of(document["counts"], "equations", F.sum("equations"))])
    each = hits.select("doc_id", "ord", "n").unionByName(whole.select("doc_id", F.explode("now.hits").alias("x")).select("doc_id", "x.*")).groupBy("doc_id", "ord").agg(F.sum("n").alias("own"))
    changes = ruled.join(flat, ["doc_id", "handler"], "left").join(each, ["doc_id", "ord"], "left").join(failed, "doc_id", "left_anti")
    changes = changes.select("doc_id", "ord", "rule_id", F.when(F.col("handler").isin("styles", "fields"), F.coalesce("own", F.lit(0))).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("targets"))
    manual = document["of"].select("doc_id", "profile_id").join(approved.where("application = 'manual_review'").select("profile_id", F.col("ord").cast("int").alias("ord"), F.col("id").alias("rule_id")), "profile_id").select("doc_id", "ord", "rule_id")

    good = document["of"].join(failed, "doc_id", "left_anti")
    styled = ruled.where("handler = 'styles'").join(good.select("doc_id"), "doc_id", "left_semi")
    set_ = acting.where("handler = 'styles'").select("profile_id", F.col("id").alias("rule_id"), F.explode("props").alias("key", "value"))
    of_style = styled.join(set_, ["profile_id", "rule_id"]).select("doc_id", "style", "key", "value", "ord")
    taken = paragraphs.select("doc_id", "place", F.explode("now.direct").alias("ord")).join(styled.select("doc_id", "ord", "style"), ["doc_id", "ord"])
    page = {"page_width_mm": "w", "page_height_mm": "h"}
    keys = lambda df, columns: df.select(*columns)
    new = {
        "sections": keys(sections, ["doc_id", "idx", *[F.col(f"now.{page.get(c, c)}").alias(c) for c in (*page, "orientation", *LENGTHS)]]),
        "paragraphs": keys(paragraphs, ["doc_id", "place", F.col("now.text").alias("text"), F.col("now.style").alias("style")]),
        "rows": keys(rows, ["doc_id", "table", "row", F.col("now.is_header").alias("is_header"), F.col("now.cant_split").alias("cant_split")]),
        "tables": keys(tables, ["doc_id", "table", F.col("now.style").alias("style"), F.col("now.alignment").alias("alignment"), F.col("now.centred").alias("centred")]),
        "flags": keys(whole, ["doc_id", *[F.col(f"now.{c}").alias(c) for c in ("update_on_open", "dirty", "fields", "levels", "start")]]),
    }
    old = {"sections": document["sections"], "paragraphs": p, "rows": document["rows"], "tables": document["tables"].withColumn("centred", F.lit(False))}
    out = {name: df.join(failed, "doc_id", "left_anti") for name, df in new.items()}
    for name, df in old.items():
        out[name] = out[name].unionByName(df.join(failed, "doc_id", "left_semi").select(*out[name].columns))
    out["styles"] = update.styles(document["styles"], of_style)
    out["made"] = styled.select("doc_id", "style").distinct().join(document["styles"].select("doc_id", "style").distinct(), ["doc_id", "style"], "left_anti")
    own = document["direct"].withColumnRenamed("place", "pos")
    out["direct"] = update.direct_formats(own, taken.join(failed, "doc_id", "left_anti").select("doc_id", F.col("place").alias("pos"), "style"), of_style).withColumnRenamed("pos", "place")
    return out, changes, manual, faults
