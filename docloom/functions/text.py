"""Scalar functions on text, as Column expressions: all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import constants as K


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where the pattern or the group does not match."""
    got = F.regexp_extract(c, K.FLAGS + pattern, group)
    return F.when(F.rlike(c, F.lit(K.FLAGS + pattern)) & (got != ""), got)


def not_blank(c: Column) -> Column:
    """Whether anything but Unicode white space stands in the text."""
    return F.coalesce(F.rlike(c, F.lit(r"(?U)\S")), F.lit(False))


def heading_level(c: Column) -> Column:
    """4 to 1 by the first pattern that matches, else null."""
    out = F.lit(None).cast("int")
    for level in sorted(K.HEADING_LEVELS):
        out = F.when(F.rlike(c, F.lit(K.FLAGS + K.HEADING_LEVELS[level])), F.lit(level)).otherwise(out)
    return out


def chapter_number(c: Column) -> Column:
    """The number of a chapter heading: digits, or a numeral below one hundred. An unknown part left of ten counts 1, right of it 0."""
    token = extract(c, K.CHAPTER)
    digit = F.create_map(*[F.lit(x) for kv in K.NUMERALS.items() for x in kv])
    left = F.substring_index(token, "十", 1)
    rest = F.substring(token, F.locate("十", token) + 1, F.length(token))
    tens = F.coalesce(F.element_at(digit, left), F.lit(1)) * 10 + F.coalesce(F.element_at(digit, rest), F.lit(0))
    return (
        F.when(F.rlike(token, F.lit("^[0-9]+$")), token.cast("int"))
        .when(token == "十", F.lit(10))
        .when(F.contains(token, F.lit("十")), tens)
        .otherwise(F.element_at(digit, token))
    )


def heading_number(c: Column, level: Column) -> Column:
    """The numbers of a heading of that level as an array; null where they are missing."""
    numbered = F.lit(None).cast("array<int>")
    for n in (2, 3, 4):
        found = extract(c, rf"^\s*(\d+(?:[.-]\d+){{{n - 1}}})")
        numbered = F.when(level == n, F.transform(F.split(found, "[.-]"), lambda x: x.cast("int"))).otherwise(numbered)
    chapter = chapter_number(c)
    return F.when(level == 1, F.when(chapter.isNotNull(), F.array(chapter))).otherwise(numbered)


def heading_prefix(c: Column, level: int) -> Column:
    """What a heading of that level has before its title, with the gap that follows; empty if it has none."""
    return F.regexp_extract(c, K.FLAGS + (r"^\s*第\s*[0-9一二三四五六七八九十百]+\s*章\s*" if level == 1 else rf"^\s*\d+(?:[.-]\d+){{{level - 1}}}\s*"), 0)


def without_markers(c: Column) -> Column:
    return F.regexp_replace(c, K.FLAGS + K.FIELD_MARKER, "")


def normalised_derived(c: Column, style: Column) -> Column:
    """Text without field markers; in a numbered heading style also without its number."""
    bare = without_markers(c)
    out = bare
    for level in (1, 2, 3, 4):
        out = F.when(style == f"Heading{level}", F.substring(bare, F.length(heading_prefix(bare, level)) + 1, F.length(bare))).otherwise(out)
    return out


def any_of(c: Column, terms: list[str]) -> Column:
    return F.rlike(c, F.lit("|".join(terms)))


def caption_domain(c: Column, context: Column | None = None) -> Column:
    evidence = F.concat_ws("\n", c, context if context is not None else F.lit(""))
    architecture, civil = any_of(evidence, K.ARCHITECTURE_TERMS), any_of(evidence, K.CIVIL_ENGINEERING_TERMS)
    return F.when(architecture & civil, "mixed").when(architecture, "architecture").when(civil, "civil_engineering").otherwise("unknown")


def identifier_semantics(identifier: Column, title: Column, domain: Column) -> Column:
    dotted = F.rlike(identifier, F.lit("[.．]"))
    return (
        F.when(F.coalesce(identifier, F.lit("")) == "", "unknown")
        .when(F.rlike(F.coalesce(title, F.lit("")), F.lit(K.FLAGS + K.DRAWING_MARK)), F.when(dotted, "mixed").otherwise("drawing_mark"))
        .when((domain != "unknown") & F.contains(identifier, F.lit("-")) & ~dotted, "drawing_mark")
        .when(dotted, "publication_number")
        .otherwise("unknown")
    )


def caption(c: Column, context: Column | None = None) -> dict[str, Column]:
    """Columns of a candidate caption; label is null where the text is none. Spans count characters from 0."""
    label = extract(c, K.LOOSE_CAPTION)
    prefix, identifier, title = (extract(c, K.IDENTIFIED_CAPTION, g) for g in (1, 2, 4))
    start = F.when(identifier.isNotNull(), F.length(F.coalesce(prefix, F.lit(""))))
    stop = start + F.length(identifier)
    hierarchy = extract(c, K.CAPTION, 2)
    domain = caption_domain(c, context)
    return {
        "label": label,
        "sequence_name": F.when(label == "图", "Figure").when(label == "表", "Table"),
        "identifier": identifier,
        "identifier_start": start,
        "identifier_stop": stop,
        "title": title,
        "domain_context": F.when(label.isNotNull(), domain),
        "identifier_semantics": F.when(label.isNotNull(), identifier_semantics(identifier, title, domain)),
        "hierarchy": hierarchy,
        "sequence": extract(c, K.CAPTION, 3),
        "heading_level": F.when(hierarchy.isNotNull(), F.size(F.split(hierarchy, r"\."))),
    }


def role(c: Column, style: Column) -> Column:
    """By detected heading level, else by style."""
    level = heading_level(c)
    styled = F.when(F.rlike(style, F.lit("^Heading [1-4]$")), F.concat(F.lit("heading_"), F.substring(style, 9, 1)))
    named = F.when(style == "Title", "title").when(style == "Quote", "long_quote").when(style == "Bibliography", "reference_entry").otherwise("unknown")
    return F.coalesce(F.concat(F.lit("heading_"), level.cast("string")), styled, named)


def _lookup(c: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def normalised_role(c: Column) -> Column:
    return F.coalesce(_lookup(c, K.ROLE_ALIASES), c)


def style_of_selector(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "style_name", value)
        .when(kind == "paragraph_role", _lookup(value, K.ROLE_STYLES))
        .when(kind == "caption_role", "Caption")
        .when(kind == "bibliography_role", "Bibliography")
    )


def field_kind(c: Column) -> Column:
    return F.upper(F.coalesce(extract(c, K.FIELD), F.lit("UNKNOWN")))


def field_argument(c: Column) -> Column:
    return extract(c, K.FIELD, 2)


def marker_instruction(c: Column) -> Column:
    """The field instruction of a marker such as [[REF:name]]."""
    kind, name = extract(c, r"^\[\[([A-Z]+)"), extract(c, r"^\[\[[A-Z]+:([A-Za-z0-9_.-]+)\]\]$")
    return (
        F.when(c == "[[TOC]]", r'TOC \o "1-3" \h \z \u').when(c == "[[PAGE]]", "PAGE")
        .when(kind == "SEQ", F.concat(F.lit("SEQ "), name, F.lit(r" \* ARABIC \s 1")))
        .when(kind.isin("REF", "PAGEREF"), F.concat(kind, F.lit(" "), name, F.lit(r" \h")))
    )


def font_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s_-]+", ""))


def font_group(c: Column) -> Column:
    """The group of fonts that a name belongs to, or its own key."""
    keys = {a.replace("_", "").lower(): g for g, names in K.FONT_ALIASES.items() for a in names}
    return F.coalesce(_lookup(font_key(c), keys), font_key(c))


def close(a: Column, b: Column) -> Column:
    """Within the tolerance; null only equals null."""
    x, y = a.cast("double"), b.cast("double")
    near = F.abs(x - y) <= F.greatest(F.lit(K.TOLERANCE), 1e-9 * F.greatest(F.abs(x), F.abs(y)))
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)


def alignment(c: Column) -> Column:
    """The plain name within an alignment's name."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(x)), x) for x in ("left", "center", "right", "justify", "distributed")], low)


def same_value(key: Column, expected: Column, actual: Column) -> Column:
    """Whether a property's value is the one expected; both as strings. How depends on the property's name."""
    numeric = F.rlike(key, F.lit("(_pt|_mm|_ratio)$")) | key.isin("line_spacing", "first_line_indent_chars")
    colour = lambda c: F.upper(F.regexp_replace(c, "^#", ""))
    return (
        F.when(F.startswith(key, F.lit("font_name")), F.coalesce(font_group(expected) == font_group(actual), F.lit(False)))
        .when(numeric, close(expected.try_cast("double"), actual.try_cast("double")))
        .when(key == "color_hex", colour(expected).eqNullSafe(colour(actual)))
        .when(key == "alignment", F.lower(expected).eqNullSafe(alignment(actual)))
        .otherwise(expected.eqNullSafe(actual))
    )


def replaced_identifier(c: Column, start: Column, stop: Column, new: Column, sha: Column) -> Column:
    """The text with its identifier replaced if the identifier has that hash, else null."""
    old = F.substring(c, start + 1, stop - start)
    spliced = F.concat(F.substring(c, F.lit(1), start), new, F.substring(c, stop + 1, F.length(c)))
    return F.when(F.sha2(old, 256) == sha, spliced)
