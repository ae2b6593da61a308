"""Structure maps against documents: normalised texts, replacements, tables, and the audits of sections, fields and equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import audit, inventory

IDENTIFIER, MOVED = "[[CAPTION_IDENTIFIER]]", "[[MOVED_MANUAL_CAPTION]]"


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def _part(c: Column, start: Column, stop: Column | None = None) -> Column:
    """Characters from ``start`` to ``stop``, counted from 0."""
    return F.substring(c, start + 1, (stop - start) if stop is not None else F.length(c))


def without_identifiers(paragraphs: DataFrame, entries: DataFrame) -> DataFrame:
    """Approved replacements, entries(doc_id, ord, start, stop, text_sha256, prefix_sha256, identifier_sha256, suffix_sha256, replacement): a
    text in which the identifier stands, before or after its replacement, gets a placeholder; the first entry by ord that fits counts.

    Entries meet texts by the hashes of what stands before and after: a text is hashed once for each place at which an entry of its document
    starts, however many entries start there, and that is the key of the join.
    """
    starts = entries.select("doc_id", "start").distinct()
    tried = paragraphs.join(starts, "doc_id").withColumn("prefix_sha256", _sha(_part(F.col("text"), F.lit(0), F.col("start"))))
    joined = tried.join(entries, ["doc_id", "prefix_sha256", "start"])
    t, start, stop = F.col("text"), F.col("start"), F.col("stop")
    after = start + F.length("replacement")
    old = (_sha(t) == F.col("text_sha256")) & (_sha(_part(t, start, stop)) == F.col("identifier_sha256")) & (_sha(_part(t, stop)) == F.col("suffix_sha256"))
    new = (_part(t, start, after) == F.col("replacement")) & (_sha(_part(t, after)) == F.col("suffix_sha256"))
    end = F.when(old, stop).when(new, after)
    spliced = F.concat(_part(t, F.lit(0), start), F.lit(IDENTIFIER), _part(t, end))
    found = joined.withColumn("spliced", spliced).where("spliced is not null").groupBy("doc_id", "part", "pos").agg(F.min_by("spliced", "ord").alias("spliced"))
    return paragraphs.join(found, ["doc_id", "part", "pos"], "left").withColumn("text", F.coalesce("spliced", "text")).drop("spliced")


def normalised(paragraphs: DataFrame, cutoffs: DataFrame, replacements: DataFrame, moved: DataFrame, toc: DataFrame, headings: DataFrame, captions: DataFrame) -> DataFrame:
    """paragraphs(doc_id, part, pos, body_index or null, text, style) -> with the text that must not change when a map is applied.

    cutoffs(doc_id, cutoff): the tail that goes; moved(doc_id, text_sha256, manual): captions that leave their tables; toc(doc_id, body_index),
    headings(doc_id, body_index, level) and captions(doc_id, body_index): approved places. A text takes the first of these that applies.
    """
    df = paragraphs.join(cutoffs, "doc_id", "left").where("body_index is null or cutoff is null or body_index < cutoff").drop("cutoff")
    df = without_identifiers(df.withColumn("text", T.without_markers(F.col("text"))), replacements).withColumn("sha", _sha(F.col("text")))
    m = moved.groupBy("doc_id", F.col("text_sha256").alias("sha")).agg(F.bool_or("manual").alias("manual"), F.lit(True).alias("moves"))
    generated = moved.where("not manual").select("doc_id", F.lit(True).alias("generates")).distinct()
    df = df.join(m, ["doc_id", "sha"], "left").join(generated, "doc_id", "left")
    df = df.join(toc.select("doc_id", "body_index", F.lit(True).alias("in_toc")), ["doc_id", "body_index"], "left")
    df = df.join(headings.select("doc_id", "body_index", F.col("level").alias("heading")), ["doc_id", "body_index"], "left")
    df = df.join(captions.select("doc_id", "body_index", F.lit(True).alias("captioned")), ["doc_id", "body_index"], "left")
    t = F.col("text")
    short = lambda c: F.concat(T.extract(c, K.CAPTION, 1), F.lit(" "), T.extract(c, K.CAPTION, 4))
    dashed = r"^\s*(图|表)\s*[-－—–]\s*(.*)$"
    of_field = F.col("generates") & F.col("body_index").isNotNull() & (F.col("style") == "Caption") & F.rlike(t, F.lit(K.FLAGS + dashed))
    text = (
        F.when(F.coalesce("manual", F.lit(False)), F.lit(MOVED))
        .when(F.coalesce("moves", F.lit(False)) & short(t).isNotNull(), short(t))
        .when(F.coalesce(of_field, F.lit(False)), F.concat(F.regexp_extract(t, K.FLAGS + dashed, 1), F.lit(" "), F.regexp_extract(t, K.FLAGS + dashed, 2)))
        .otherwise(t)
    )
    df = df.withColumn("text", text)
    bare = t
    for level in (1, 2, 3, 4):
        bare = F.when(F.col("heading") == level, _part(t, F.length(T.heading_prefix(t, level)))).otherwise(bare)
    plain = F.coalesce(short(t), F.regexp_replace(t, K.FLAGS + r"^(图|表)\s+[-－—–]?\s*", "$1 "))
    text = F.when(F.col("in_toc"), "").when(F.col("heading").isNotNull(), bare).when(F.col("captioned"), plain).otherwise(t)
    return df.select("doc_id", "part", "pos", text.alias("text"))


def structure_fingerprint(normal: DataFrame) -> DataFrame:
    return inventory.ordered_hash(normal, ["doc_id"], ["part", "pos"], F.col("text"), "fingerprint")


def replacement_audit(before: DataFrame, after: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries(keys, start, stop, title_start, text_sha256, identifier_sha256, title_text_sha256, replacement) -> keys, changed, title_preserved, passed."""
    joined = entries.join(before.select(*keys, F.col("text").alias("old")), keys, "left").join(after.select(*keys, F.col("text").alias("new")), keys, "left")
    start, stop, title = F.col("start"), F.col("stop"), F.col("title_start")
    source = (_sha(F.col("old")) == F.col("text_sha256")) & (_sha(_part(F.col("old"), start, stop)) == F.col("identifier_sha256")) & (_sha(_part(F.col("old"), title)) == F.col("title_text_sha256"))
    expected = F.concat(_part(F.col("old"), F.lit(0), start), "replacement", _part(F.col("old"), stop))
    changed = F.coalesce(F.col("new") == expected, F.lit(False))
    kept = F.coalesce(_sha(_part(F.col("new"), title + start + F.length("replacement") - stop)) == F.col("title_text_sha256"), F.lit(False))
    return joined.select(*keys, changed.alias("changed"), kept.alias("title_preserved"), (F.coalesce(source, F.lit(False)) & changed & kept).alias("passed"))


def role_targets(roles: DataFrame, paragraphs: DataFrame, captions: DataFrame, wanted: str) -> DataFrame:
    """roles(doc_id, pos, role, text_sha256, approved), paragraphs(doc_id, pos, text, style), captions(doc_id, pos, action, approved): the
    approved places of a role, each once, with their status.

    Where a text is no longer that of its hash, a heading counts if its style is the one of its role, a caption if its own approved entry
    changes the text and its style is Caption; else it is a mismatch.
    """
    role = T.normalised_role(F.col("role"))
    any_caption = role.isin("figure_caption", "table_caption", "equation_caption")
    want = wanted if wanted not in K.ROLE_ALIASES else K.ROLE_ALIASES[wanted]
    matches = (role == want) | (any_caption if want == "all_captions" else F.lit(False))
    entries = roles.where(F.col("approved") & matches).withColumn("role", role)
    changing = captions.where(F.col("approved") & F.col("action").isin("replace_identifier", "convert_to_seq", "move_caption")).select("doc_id", "pos", F.lit(True).alias("changes")).distinct()
    joined = entries.join(paragraphs.select("doc_id", "pos", _sha(F.col("text")).alias("sha"), "style"), ["doc_id", "pos"], "left").join(changing, ["doc_id", "pos"], "left")
    styled = F.when(F.startswith("role", F.lit("heading_")), F.col("style") == F.concat(F.lit("Heading "), F.substring("role", 9, 1)))
    styled = styled.when(F.col("role").isin("figure_caption", "table_caption", "equation_caption"), F.coalesce("changes", F.lit(False)) & (F.col("style") == "Caption"))
    status = F.when(F.col("sha").isNull(), "missing").when(F.col("sha") == F.col("text_sha256"), "ok").when(F.coalesce(styled, F.lit(False)), "accepted").otherwise("mismatch")
    return joined.select("doc_id", "pos", status.alias("status")).distinct()


SECTION_VALUES = {
    "header_distance_ratio": ("header_distance_mm", "page_height_mm"), "footer_distance_ratio": ("footer_distance_mm", "page_height_mm"), "margin_inner_ratio": ("margin_left_mm", "page_width_mm"),
    "margin_outer_ratio": ("margin_right_mm", "page_width_mm"), "margin_top_ratio": ("margin_top_mm", "page_height_mm"), "margin_bottom_ratio": ("margin_bottom_mm", "page_height_mm"),
}


def section_failures(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """sections(doc_id, idx, sizes in mm, toggles), rules(rule_id, target, prop, expected) with target ``section`` -> failures of the derived values."""
    out = sections.withColumn("target", F.lit("section")).withColumn("page_size_policy", F.lit("preserve"))
    out = out.withColumn("orientation", F.when(F.col("page_width_mm") > F.col("page_height_mm"), "landscape").otherwise("portrait"))
    for name, (side, of) in SECTION_VALUES.items():
        if side in sections.columns:
            out = out.withColumn(name, F.col(side) / F.col(of))
    names = [c for c in out.columns if c in K.ALLOWED_PROPERTIES["section"]]
    values = audit.long_values(out.withColumn("key", F.struct("doc_id", "idx")), ["key", "target"], names)
    return audit.failures(rules, values, "key").select("key.doc_id", "key.idx", "rule_id", "prop", "expected", "actual")


def field_failures(paragraphs: DataFrame, styles: DataFrame, settings: DataFrame, levels: int = 4, chapter_start: int | None = None) -> DataFrame:
    """paragraphs(doc_id, pos, text, style), styles(doc_id, style, numbered), settings(doc_id, update_fields, start) -> doc_id, prop, actual.

    Of markers that stand alone in their paragraph the first ten are reported.
    """
    row = lambda df, prop, actual: df.select("doc_id", F.lit(prop).alias("prop"), actual.alias("actual"))
    marker = T.marker_instruction(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).isNotNull()
    left = audit.first_failures(paragraphs.where(marker), ["doc_id"], ["pos"])
    wanted = settings.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    numbered = styles.where("numbered").select("doc_id", F.regexp_extract("style", r"^Heading (\d+)$", 1).alias("l")).where("l <> ''").select("doc_id", F.col("l").cast("int").alias("level"))
    prefixed = F.lit(False)
    for level in range(1, levels + 1):
        prefixed = prefixed | ((F.col("style") == f"Heading {level}") & (T.heading_prefix(F.col("text"), level) != ""))
    out = row(settings.where("not update_fields"), "update_on_open", F.lit("false"))
    out = out.unionByName(row(left, "convert_explicit_markers", F.col("text")))
    out = out.unionByName(row(wanted.join(numbered, ["doc_id", "level"], "left_anti"), "rebuild_heading_numbering", F.concat(F.lit("Heading "), F.col("level").cast("string"))))
    out = out.unionByName(row(paragraphs.where(prefixed), "strip_manual_heading_prefixes", F.substring("text", 1, 80)))
    if chapter_start is not None:
        out = out.unionByName(row(settings.where(~F.col("start").eqNullSafe(F.lit(chapter_start))), "chapter_start", F.col("start").cast("string")))
    return out


def equations(objects: DataFrame) -> DataFrame:
    """objects(doc_id, kind omml, ole or image, prog_id, hint) -> counts of each kind of equation, and of those that can be edited."""
    ole = lambda name: F.count_if((F.col("kind") == "ole") & (inventory.ole_kind(F.col("prog_id")) == name)).alias(name)
    hinted = F.rlike(F.lower(F.coalesce("hint", F.lit(""))), F.lit("equation|formula|公式"))
    out = objects.groupBy("doc_id").agg(F.count_if(F.col("kind") == "omml").alias("omml"), ole("mathtype_ole"), ole("legacy_equation_ole"), ole("other_ole"), F.count_if((F.col("kind") == "image") & hinted).alias("formula_image_candidates"))
    return out.withColumn("editable_total", F.col("omml") + F.col("mathtype_ole") + F.col("legacy_equation_ole"))


def comments(rules: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """rules(doc_id, rule_id, style, summary), paragraphs(doc_id, pos, text, style) -> doc_id, rule_id, pos, comment: one at the first anchor of each rule.

    A rule's anchor is the first paragraph of its style that is not blank, else the first that is not blank.
    """
    filled = paragraphs.where(T.not_blank(F.col("text")))
    of_style = filled.groupBy("doc_id", "style").agg(F.min("pos").alias("styled"))
    of_doc = filled.groupBy("doc_id").agg(F.min("pos").alias("first"))
    joined = rules.join(of_doc, "doc_id").join(of_style, ["doc_id", "style"], "left")
    return joined.select("doc_id", "rule_id", F.coalesce("styled", "first").alias("pos"), F.col("summary").alias("comment"))
