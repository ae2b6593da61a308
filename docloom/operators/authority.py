"""What rules and maps may do to a document: predicates, gates, counts and the dispatch of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import profiles

#: What a field rule sets where a document's text is to be derived anew.
DERIVING = ["convert_explicit_markers", "rebuild_heading_numbering", "strip_manual_heading_prefixes"]
#: Caption actions that change a text, and what does each kind of selector's work.
CHANGING = ["replace_identifier", "convert_to_seq", "move_caption"]
HANDLERS = {"document": "sections", "section_role": "sections", "table_role": "tables", "field_role": "fields", "equation_role": "equations"}


def truthy(value: Column) -> Column:
    """Of a property's value as a string: neither null nor empty, false, zero or null."""
    return ~F.coalesce(F.lower(value), F.lit("")).isin("", "false", "0", "0.0", "null")


def acting(rules: DataFrame) -> DataFrame:
    """Rules that are approved and applied without review."""
    return profiles.automatic(rules)[0]


def derives_text(rules: DataFrame, props: DataFrame) -> DataFrame:
    """rules(profile_id, id, status, application, selector_kind), props(profile_id, rule_id, key, value) -> profile_id, derives; one row a profile that has rules."""
    deriving = props.where(F.col("key").isin(DERIVING) & truthy(F.col("value"))).select("profile_id", F.col("rule_id").alias("id")).distinct().withColumn("yes", F.lit(True))
    field = (F.col("selector_kind") == "field_role") & (F.col("status") == "approved") & (F.col("application") == "automatic")
    return rules.join(deriving, ["profile_id", "id"], "left").groupBy("profile_id").agg(F.bool_or(F.coalesce(field, F.lit(False)) & F.col("yes").isNotNull()).alias("derives"))


def sequence_rights(captions: DataFrame, used: DataFrame, rules: DataFrame, props: DataFrame) -> DataFrame:
    """captions(map_id, approved, action), used(map_id, profile_id) -> map_id, profile_id, requests, allows, authorised: numbering fields are
    made only where an acting caption rule says so."""
    wide = props.where(F.col("key").isin("numbering_mode", "allow_automatic_renumbering")).groupBy("profile_id", F.col("rule_id").alias("id")).agg(
        F.bool_or((F.col("key") == "numbering_mode") & (F.col("value") == "seq_field")).alias("seq"),
        F.bool_or((F.col("key") == "allow_automatic_renumbering") & (F.col("value") == "true")).alias("renumbers"),
    )
    allowing = acting(rules).where("selector_kind = 'caption_role'").join(wide.where("seq and renumbers"), ["profile_id", "id"], "left_semi").select("profile_id").distinct()
    asking = captions.where(F.col("approved") & (F.col("action") == "convert_to_seq")).select("map_id").distinct()
    joined = used.join(asking.withColumn("asks", F.lit(True)), "map_id", "left").join(allowing.withColumn("may", F.lit(True)), "profile_id", "left")
    requests, allows = F.col("asks").isNotNull(), F.col("may").isNotNull()
    return joined.select("map_id", "profile_id", requests.alias("requests"), allows.alias("allows"), (~requests | allows).alias("authorised"))


def field_block(docs: DataFrame, rules: DataFrame, unresolved: DataFrame) -> DataFrame:
    """docs(doc_id, profile_id), unresolved(doc_id, name) -> doc_id, names of the documents that an acting field rule must not touch."""
    acted = docs.join(acting(rules).where("selector_kind = 'field_role'").select("profile_id").distinct(), "profile_id", "left_semi")
    names = unresolved.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    return acted.join(names, "doc_id").select("doc_id", "names")


def equation_block(equations: DataFrame, policies: DataFrame) -> DataFrame:
    """equations(doc_id, formula_image_candidates, legacy_equation_ole), policies(doc_id, required, legacy_policy) -> doc_id, block, n where a
    policy that asks for editable equations forbids the document."""
    legacy = (F.col("legacy_equation_ole") > 0) & (F.coalesce("legacy_policy", F.lit("qa")) == "qa")
    images = F.col("formula_image_candidates") > 0
    block = F.when(images, "formula_images").when(legacy, "legacy_equations")
    found = equations.join(policies.where("required"), "doc_id").withColumn("block", block).where("block is not null")
    return found.select("doc_id", "block", F.when(images, F.col("formula_image_candidates")).otherwise(F.col("legacy_equation_ole")).alias("n"))


def source_status(maps: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """maps(map_id, doc_id, content_fingerprint), fingerprints(doc_id, fingerprint) -> map_id, status: ok, changed or missing."""
    joined = maps.join(fingerprints, "doc_id", "left")
    status = F.when(F.col("fingerprint").isNull(), "missing").when(F.col("fingerprint") == F.col("content_fingerprint"), "ok").otherwise("changed")
    return joined.select("map_id", status.alias("status"))


def chapter_mismatch(numbering: DataFrame, headings: DataFrame) -> DataFrame:
    """numbering(map_id, approved, chapter_start), headings(map_id, ord, level, approved, chapter) -> map_id, chapter_start, detected of maps whose
    first approved chapter is another one. A chapter without a number counts as another."""
    first = headings.where("approved and level = 1").groupBy("map_id").agg(F.min_by(F.struct("chapter"), "ord").alias("first"))
    joined = numbering.where("approved").join(first, "map_id").withColumn("detected", F.col("first.chapter"))
    return joined.where(~F.col("detected").eqNullSafe(F.col("chapter_start"))).select("map_id", "chapter_start", "detected")


def moves_with_numbers(captions: DataFrame) -> DataFrame:
    """captions(map_id, approved, migrate_outside_table, in_cell, action, text_sha256) -> map_id, generates: whether captions leave cells that
    no manual move takes."""
    moved = F.when(F.col("approved") & F.col("migrate_outside_table"), F.col("text_sha256"))
    cells, manual = F.when(F.col("in_cell"), moved), F.when(F.col("action") == "move_caption", moved)
    sets = captions.groupBy("map_id").agg(F.collect_set(cells).alias("a"), F.collect_set(manual).alias("b"))
    return sets.select("map_id", (F.size(F.array_except("a", "b")) > 0).alias("generates"))


def sequences(fields: DataFrame) -> DataFrame:
    """fields(doc_id, instruction) -> doc_id, fields, sequences: how many there are, and the names of the sequences that number something."""
    name = F.when(T.field_kind(F.col("instruction")) == "SEQ", T.field_argument(F.col("instruction")))
    return fields.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("sequences"))


def action_counts(captions: DataFrame) -> DataFrame:
    return captions.where(F.col("approved") & F.col("action").isin(CHANGING)).groupBy("map_id", "action").agg(F.count(F.lit(1)).alias("n"))


def targets_per_rule(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """rules(rule_id), targets(rule_id, ...) -> rule_id, targets; none is 0."""
    n = targets.groupBy("rule_id").agg(F.count(F.lit(1)).alias("targets"))
    return rules.select("rule_id").join(n, "rule_id", "left").fillna(0, ["targets"])


def last_entries(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the approved entries of a place the last one, with all its columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return entries.where("approved").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "approved")


def by_path(errors: DataFrame, key: str) -> DataFrame:
    """errors(key, path, message) -> with place, from 1: by path, whose whole numbers count as numbers, then by message."""
    steps = F.transform(F.split("path", r"\."), lambda s: F.when(F.rlike(s, F.lit(r"^\d+$")), F.lpad(s, 12, "0")).otherwise(s))
    return errors.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(steps, "message")))


def gated(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The violations of ``first``, and those of ``second`` for keys that ``first`` has nothing against."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def dispatched(rules: DataFrame, props: DataFrame, allowed: DataFrame) -> DataFrame:
    """rules(rule_id, selector_kind, selector_value), props(rule_id, key), allowed(kind, key) -> rule_id, handler, style, error.

    A rule with a property that its kind may not set, or with a selector that names no style, is an error.
    """
    wrong = props.join(rules.select("rule_id", profiles.kind_of(F.col("selector_kind")).alias("kind")), "rule_id").join(allowed, ["kind", "key"], "left_anti")
    wrong = wrong.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("wrong"))
    handler = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv]), F.col("selector_kind")), F.lit("styles"))
    style = F.when(handler == "styles", T.style_of_selector(F.col("selector_kind"), F.col("selector_value")))
    error = F.when(F.col("wrong").isNotNull(), F.concat(F.lit("unsupported properties: "), "wrong")).when((handler == "styles") & style.isNull(), F.lit("unsupported selector"))
    return rules.join(wrong, "rule_id", "left").select("rule_id", handler.alias("handler"), style.alias("style"), error.alias("error"))


def equation_changes(rules: DataFrame, props: DataFrame, equations: DataFrame) -> DataFrame:
    """rules(doc_id, rule_id) of equations, props(rule_id, key, value), equations(doc_id, omml) -> doc_id, rule_id, valid, targets: nothing is
    changed, only counted. A rule is valid if each of its values is a boolean."""
    valid = props.groupBy("rule_id").agg(F.bool_and(F.coalesce(F.col("value").isin("true", "false"), F.lit(False))).alias("valid"))
    joined = rules.join(valid, "rule_id", "left").join(equations.select("doc_id", "omml"), "doc_id", "left")
    ok = F.coalesce("valid", F.lit(True))
    return joined.select("doc_id", "rule_id", ok.alias("valid"), F.when(ok, F.coalesce("omml", F.lit(0))).otherwise(0).alias("targets"))


def map_changes(targets: DataFrame, order: list[str]) -> DataFrame:
    """targets(map_id, kind, n) -> map_id, step, kind, targets: the kinds of ``order`` in their order, those without a target left out."""
    step = reduce(lambda c, kv: c.when(F.col("kind") == kv[1], F.lit(kv[0])), enumerate(order), F.when(F.lit(False), F.lit(0)))
    summed = targets.withColumn("step", step).where("step is not null").groupBy("map_id", "step", "kind").agg(F.sum("n").alias("targets"))
    return summed.where("targets > 0")


def data_tables(tables: DataFrame, deleted: DataFrame) -> DataFrame:
    """tables(map_id, table, kind, approved, header_rows, caption_row), deleted(map_id, table, row) -> the approved data tables: where a caption's
    row has gone, later header rows move up and there is no caption row."""
    gone = deleted.select("map_id", "table", F.col("row").alias("gone"))
    joined = tables.where(F.col("approved") & (F.col("kind") == "data")).join(gone, ["map_id", "table"], "left")
    moved = F.transform(F.filter("header_rows", lambda r: r != F.col("gone")), lambda r: F.when(r > F.col("gone"), r - 1).otherwise(r))
    return joined.select(
        "map_id", "table", F.when(F.col("gone").isNull(), F.col("header_rows")).otherwise(moved).alias("header_rows"),
        F.when(F.col("gone").isNull(), F.col("caption_row")).alias("caption_row"),
    )


def style_failures(rules: DataFrame, props: DataFrame, styles: DataFrame) -> DataFrame:
    """rules(doc_id, rule_id, style or null), props(rule_id, key, value), styles(doc_id, style, key, value) -> doc_id, rule_id, prop, expected, actual.

    A rule without a style, or whose style the document has not, fails as a whole: its property is ``*``.
    """
    known = styles.select("doc_id", "style").distinct().withColumn("there", F.lit(True))
    held = rules.join(known, ["doc_id", "style"], "left")
    missing = held.where("there is null").select(
        "doc_id", "rule_id", F.lit("*").alias("prop"), F.coalesce("style", F.lit("supported style selector")).alias("expected"),
        F.when(F.col("style").isNull(), "unsupported").otherwise("missing style").alias("actual"),
    )
    asked = held.where("there").join(props.where(F.col("key").isin(K.ALLOWED_PROPERTIES["style"])), "rule_id").withColumnRenamed("value", "expected")
    found = asked.join(styles.withColumnRenamed("value", "actual"), ["doc_id", "style", "key"], "left")
    same = F.coalesce(T.same_value(F.col("key"), F.col("expected"), F.col("actual")), F.lit(False))
    return missing.unionByName(found.where(~same).select("doc_id", "rule_id", F.col("key").alias("prop"), "expected", "actual"))


def paragraph_failures(targets: DataFrame, props: DataFrame, paragraphs: DataFrame, direct: DataFrame, styles: DataFrame) -> DataFrame:
    """targets(doc_id, rule_id, pos), props(rule_id, key, value), paragraphs(doc_id, pos, style), direct(doc_id, pos, key, value), styles(doc_id, style,
    key, value) -> doc_id, rule_id, pos, prop, expected, actual: what a paragraph sets itself counts, else what its style sets."""
    asked = targets.join(props.where(F.col("key").isin(K.ALLOWED_PROPERTIES["style"])).withColumnRenamed("value", "expected"), "rule_id")
    found = asked.join(paragraphs.select("doc_id", "pos", "style"), ["doc_id", "pos"]).join(direct.withColumnRenamed("value", "own"), ["doc_id", "pos", "key"], "left")
    found = found.join(styles.withColumnRenamed("value", "styled"), ["doc_id", "style", "key"], "left").withColumn("actual", F.coalesce("own", "styled"))
    same = F.coalesce(T.same_value(F.col("key"), F.col("expected"), F.col("actual")), F.lit(False))
    return found.where(~same).select("doc_id", "rule_id", "pos", F.col("key").alias("prop"), "expected", "actual")


def equation_failures(rules: DataFrame, equations: DataFrame) -> DataFrame:
    """rules(doc_id, rule_id, block_formula_images), equations(doc_id, formula_image_candidates): the only property of such rules that an audit can fail."""
    joined = rules.where(truthy(F.col("block_formula_images"))).join(equations.where("formula_image_candidates > 0"), "doc_id")
    return joined.select("doc_id", "rule_id", F.lit("block_formula_images").alias("prop"), F.lit("0").alias("expected"), F.col("formula_image_candidates").cast("string").alias("actual"))


def rows_kept_whole(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows(doc_id, table, row, cant_split), tables(doc_id, table, caption_row) -> doc_id, table, whole: no row but that of the caption may split."""
    joined = rows.join(tables, ["doc_id", "table"]).where(~F.col("row").eqNullSafe(F.col("caption_row")))
    n = joined.groupBy("doc_id", "table").agg(F.bool_and(F.coalesce("cant_split", F.lit(False))).alias("whole"))
    return tables.select("doc_id", "table").join(n, ["doc_id", "table"], "left").fillna(True, ["whole"])
