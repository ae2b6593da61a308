"""Rule profiles and structure maps: their constraints as queries that produce violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.operators import binding


def allowed_properties(spark: SparkSession) -> DataFrame:
    """kind, key of what a rule may set: a table of fixed values."""
    rows = [(kind, key) for kind, keys in K.ALLOWED_PROPERTIES.items() for key in keys]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("key")) for a, b in rows])).alias("x")).select("x.kind", "x.key")


def kind_of(selector: Column) -> Column:
    """The table of properties that a selector's rules draw on."""
    return (
        F.when(selector.isin("document", "section_role"), "section").when(selector == "table_role", "table").when(selector == "field_role", "field")
        .when(selector == "equation_role", "equation").when(selector == "caption_role", "caption").when(selector.isin("style_name", "paragraph_role", "bibliography_role"), "style")
    )


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, violation) for each check that a row does not meet, in the order of the checks; unknown counts as not met."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.select(key, F.explode(F.array_compact(found)).alias("violation"))


def first_violations(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """violations -> of each key the one that stands first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("violation"))
    return found.groupBy(key).agg(F.min_by("violation", rank).alias("violation"))


def profile_violations(profiles: DataFrame, sources: DataFrame, rules: DataFrame, props: DataFrame, conflicts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of profiles as relations (profile_id in each): repeated ids, unknown references, properties that a rule may not set, and what approval asks for."""
    each = []
    for name, df in (("source", sources), ("rule", rules), ("conflict", conflicts)):
        again = df.groupBy("profile_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        each.append(again.select("profile_id", F.concat(F.lit(f"duplicate_{name}:"), "id").alias("violation")))
    for name, df, ids, known in (("source", rules, "source_ids", sources), ("rule", conflicts, "rule_ids", rules)):
        used = df.select("profile_id", F.explode(ids).alias("id")).distinct()
        lost = used.join(known.select("profile_id", "id").distinct(), ["profile_id", "id"], "left_anti")
        each.append(lost.select("profile_id", F.concat(F.lit(f"unknown_{name}:"), "id").alias("violation")))
    keyed = props.join(rules.select("profile_id", F.col("id").alias("rule_id"), kind_of(F.col("selector_kind")).alias("kind")), ["profile_id", "rule_id"])
    named = keyed.withColumn("rule_id", F.struct("profile_id", "rule_id"))
    caption = allowed.where("kind = 'style'").select(F.lit("caption").alias("kind"), "key")
    wrong = binding.unsupported(named, allowed.unionByName(caption))
    each.append(wrong.select("rule_id.profile_id", F.concat(F.lit("unsupported:"), "rule_id.rule_id", F.lit("."), "key").alias("violation")))
    open_ = conflicts.where("status <> 'resolved'").select("profile_id", "id")
    approved = profiles.where("approval_status = 'approved'").select("profile_id")
    each.append(open_.join(approved, "profile_id", "left_semi").select("profile_id", F.concat(F.lit("open_conflict:"), "id").alias("violation")))
    unsigned = profiles.where("approval_status = 'approved' and (approved_by is null or approved_at is null)")
    each.append(unsigned.select("profile_id", F.lit("approval_without_a_name").alias("violation")))
    return reduce(DataFrame.unionByName, each)


def approval_violations(profiles: DataFrame, conflicts: DataFrame, questions: DataFrame, rules: DataFrame) -> DataFrame:
    """What an approved profile may not have: open conflicts, blocking questions without an answer, draft rules."""
    approved = profiles.where("approval_status = 'approved'").select("profile_id")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = [
        conflicts.where("status = 'open'").select("profile_id", F.concat(F.lit("open_conflict:"), "id").alias("violation")),
        questions.where(F.col("blocking") & blank(F.col("answer"))).select("profile_id", F.concat(F.lit("unanswered_question:"), "id").alias("violation")),
        rules.where("status = 'draft'").select("profile_id", F.concat(F.lit("draft_rule:"), "id").alias("violation")),
    ]
    return reduce(DataFrame.unionByName, found).join(approved, "profile_id", "left_semi")


def policy_violations(profiles: DataFrame) -> DataFrame:
    """profiles(profile_id, schema_version, runtime_policy, source_precedence): what version 1.1 asks for."""
    older = F.col("schema_version") != "1.1"
    return violations(
        profiles, "profile_id",
        {
            "caller_requirements_not_highest": older | F.col("runtime_policy.caller_requirements_highest"),
            "equations_not_editable": older | F.col("runtime_policy.editable_equations_required"),
            "formula_images_not_blocked": older | (F.col("runtime_policy.formula_image_policy") == "block"),
            "user_requirement_not_first": older | (F.try_element_at("source_precedence", F.lit(1)) == "user_requirement"),
        },
    )


def caption_rule_violations(rules: DataFrame, props: DataFrame) -> DataFrame:
    """Of caption rules, values that are out of range, and renumbering of manual text."""
    keys = ["numbering_mode", "domain_context", "preserve_identifier", "allow_automatic_renumbering", "preserve_table_cell_caption_position"]
    wide = props.groupBy("profile_id", "rule_id").pivot("key", keys).agg(F.first("value"))
    captions = rules.where("selector_kind = 'caption_role'").select("profile_id", F.col("id").alias("rule_id"))
    joined = captions.join(wide, ["profile_id", "rule_id"]).withColumn("rule", F.struct("profile_id", "rule_id"))
    flag = lambda c: F.col(c).isNull() | F.col(c).isin("true", "false")
    found = violations(
        joined, "rule",
        {
            "numbering_mode": F.col("numbering_mode").isNull() | F.col("numbering_mode").isin("manual_text", "seq_field"),
            "domain_context": F.col("domain_context").isNull() | F.col("domain_context").isin("general", "architecture", "civil_engineering", "mixed", "unknown"),
            **{c: flag(c) for c in keys[2:]},
            "renumbers_manual_text": ~(F.coalesce("numbering_mode", F.lit("")).eqNullSafe("manual_text") & F.coalesce(F.col("allow_automatic_renumbering") == "true", F.lit(False))),
        },
    )
    return found.select("rule.profile_id", F.concat("violation", F.lit(":"), "rule.rule_id").alias("violation"))


#: The order in which a map's faults are told.
MAP_CHECKS = [
    "version", "not_approved", "conflicts", "unknown_role_approved", "role_without_place", "incomplete_caption", "caption_action", "caption_numbering", "caption_semantics", "caption_domain",
    "relocation_without_move", "replacement_incomplete", "sequence_incomplete", "move_incomplete", "chapter_start", "open_anomalies",
]


def map_violations(maps: DataFrame) -> DataFrame:
    """maps as sources.rules.maps() reads them -> map_id, violation: what keeps a map from being applied, before it meets its document."""
    semantic = F.col("schema_version").isin(K.SEMANTIC_MAP_VERSIONS)
    none = lambda column, bad: ~F.exists(F.coalesce(column, F.array()), bad)
    on = lambda x: F.coalesce(x["approved"], F.lit(False))
    caps, second = F.col("captions"), F.col("schema_version") == "1.2"
    among = lambda x, c, *values: F.coalesce(x[c].isin(*values), F.lit(False))
    lacks = lambda x, *fields: reduce(lambda a, b: a | b, [x[f].isNull() for f in fields])
    act = lambda x, name: on(x) & F.coalesce(x["action"] == name, F.lit(False))
    moved = lambda x: F.coalesce(x["migrate_outside_table"], F.lit(False))
    return violations(
        maps, "map_id",
        {
            "version": F.col("schema_version").isin(K.MAP_VERSIONS),
            "not_approved": F.col("status") == "approved",
            "conflicts": F.size(F.coalesce("conflicts", F.array())) == 0,
            "unknown_role_approved": ~semantic | none(F.col("paragraph_roles"), lambda x: on(x) & (x["role"] == "unknown")),
            "role_without_place": ~semantic | none(F.col("paragraph_roles"), lambda x: lacks(x, "locator", "text_sha256")),
            "incomplete_caption": (F.col("schema_version") != "1.1") | none(caps, lambda x: on(x) & ~(among(x, "completeness", "complete") & among(x, "hierarchy_status", "match", "accepted"))),
            "caption_action": ~second | none(caps, lambda x: on(x) & ~among(x, "action", *K.CAPTION_ACTIONS)),
            "caption_numbering": ~second | none(caps, lambda x: on(x) & ~among(x, "numbering_mode", "manual_text", "seq_field")),
            "caption_semantics": ~second | none(caps, lambda x: on(x) & ~among(x, "identifier_semantics", "publication_number", "drawing_mark", "mixed", "unknown")),
            "caption_domain": ~second | none(caps, lambda x: on(x) & ~(among(x, "domain_context", "general", "architecture", "civil_engineering", "mixed", "unknown") & among(x, "domain_confidence", "high", "medium", "low"))),
            "relocation_without_move": ~second | none(caps, lambda x: on(x) & moved(x) & ~among(x, "action", "move_caption")),
            "replacement_incomplete": ~second | none(caps, lambda x: act(x, "replace_identifier") & (lacks(x, "identifier_span", "identifier_sha256", "identifier_prefix_sha256", "identifier_suffix_sha256", "title_text_sha256", "title_span_start", "replacement_identifier") | ~F.coalesce(x["replacement_confirmed"], F.lit(False)) | ~among(x, "numbering_mode", "manual_text"))),
            "sequence_incomplete": ~second | none(caps, lambda x: act(x, "convert_to_seq") & (lacks(x, "heading_level", "cached_hierarchy", "cached_sequence", "sequence_name") | ~among(x, "numbering_mode", "seq_field") | ~among(x, "hierarchy_status", "match", "accepted"))),
            "move_incomplete": ~second | none(caps, lambda x: act(x, "move_caption") & (~moved(x) | ~among(x, "numbering_mode", "manual_text"))),
            "chapter_start": ~semantic | ~F.coalesce("numbering.approved", F.lit(False)) | (F.col("numbering.chapter_start") >= 1),
            "open_anomalies": ~semantic | ~F.coalesce("numbering.approved", F.lit(False)) | none(F.col("numbering.anomalies"), lambda x: F.coalesce(x["status"], F.lit("open")) != "accepted"),
        },
    )


def caption_violations(captions: DataFrame) -> DataFrame:
    """captions(entry_id, approved, action, identifier_sha256, replacement_identifier, title_text_sha256, hierarchy, sequence, text_sha256)."""
    approved = F.col("approved")
    need = lambda action, *columns: ~(approved & (F.col("action") == action)) | reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return violations(
        captions,
        "entry_id",
        {
            "unknown_action": F.col("action").isin(K.CAPTION_ACTIONS),
            "no_hash": F.col("text_sha256").isNotNull(),
            "replacement_incomplete": need("replace_identifier", "identifier_sha256", "replacement_identifier", "title_text_sha256"),
            "sequence_incomplete": need("convert_to_seq", "hierarchy", "sequence"),
        },
    )


def automatic(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules to apply, and rules for review."""
    applies = (F.col("status") == "approved") & (F.col("application") == "automatic")
    return rules.where(applies), rules.where(~F.coalesce(applies, F.lit(False)))


def summary(rules: DataFrame, props: DataFrame) -> DataFrame:
    """One line a rule: its properties by name, and its sources."""
    pairs = props.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ", ").alias("pairs"))
    line = F.concat(F.col("id"), F.lit(": "), F.coalesce("pairs", F.lit("")), F.lit(". Sources: "), F.array_join("source_ids", ", "))
    return rules.join(pairs, rules.id == pairs.rule_id, "left").select("id", line.alias("summary"))
