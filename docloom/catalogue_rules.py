"""More queries over the driver's tables: packages, what rules and maps may do, updates and audits, each with the SQL that it must equal.

Rules, maps and documents of these queries are the rows of the driver's tables under other names, so that every operator meets whole
tables; words such as the kinds of selectors are dealt to rows by arithmetic that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalogue import LINES_SQL, lines, query, read
from docloom.functions import constants as K
from docloom.operators import authority, inventory, profiles, structure, update
from docloom.sources import docx, word


def pick(key, values: list[str]):
    """The value that a row's number deals it, as a Column."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(key: str, values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


KINDS = ["field_role", "caption_role", "style_name", "table_role", "equation_role", "paragraph_role"]
STATUSES, APPLICATIONS = ["approved", "approved", "draft"], ["automatic", "automatic", "automatic", "manual_review"]
KEYS = ["convert_explicit_markers", "numbering_mode", "font_name", "repeat_header_row", "block_formula_images", "bold"]
VALUES = ["true", "seq_field", "false", "0", "true"]

RULES_SQL = f"""
rules AS (SELECT p_size AS profile_id, 'r' || p_partkey AS id, {pick_sql('p_partkey', STATUSES)} AS status, {pick_sql('p_partkey', APPLICATIONS)} AS application,
  {pick_sql('(p_partkey // 2)', KINDS)} AS selector_kind, p_partkey AS k FROM part),
props AS (SELECT p_size AS profile_id, 'r' || p_partkey AS rule_id, {pick_sql('(p_partkey // 3)', KEYS)} AS key, {pick_sql('p_partkey', VALUES)} AS value FROM part
  UNION ALL SELECT p_size, 'r' || p_partkey, 'allow_automatic_renumbering', {pick_sql('(p_partkey // 5)', ['true', 'false'])} FROM part WHERE p_partkey % 2 = 0),
acting AS (SELECT * FROM rules WHERE status = 'approved' AND application = 'automatic')"""


def rules_of(spark, d) -> tuple[DataFrame, DataFrame]:
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("r"), k.cast("string"))
    rules = p.select(F.col("p_size").alias("profile_id"), name.alias("id"), pick(k, STATUSES).alias("status"), pick(k, APPLICATIONS).alias("application"), pick(F.floor(k / 2), KINDS).alias("selector_kind"))
    props = p.select(F.col("p_size").alias("profile_id"), name.alias("rule_id"), pick(F.floor(k / 3), KEYS).alias("key"), pick(k, VALUES).alias("value"))
    more = p.where(k % 2 == 0).select(F.col("p_size").alias("profile_id"), name.alias("rule_id"), F.lit("allow_automatic_renumbering").alias("key"), pick(F.floor(k / 5), ["true", "false"]).alias("value"))
    return rules, props.unionByName(more)


# -- packages


CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', chr(65533), 'g')"


def _packages(spark, d) -> DataFrame:
    """Each document as a package, a paragraph a line."""
    p = lines(spark, d)
    return word.packed(p.select("doc_id", F.col("pos").alias("seq"), word.paragraph_xml(F.col("text"), F.when(F.col("pos") == 0, "Title")).alias("xml")))


@query(f"WITH {LINES_SQL} SELECT doc_id::VARCHAR AS doc_id, pos::INT AS seq, CASE WHEN pos = 0 THEN 'Title' END AS style_id, sha256({CLEAN}) AS text_sha256 FROM lines")
def package_round_trip(spark, d):
    """Documents written as packages and read back: guard, open, parse, and paragraphs with their places."""
    n = docx.nodes(_packages(spark, d))
    return word.paragraphs(n).where("kind = 'body_paragraph'").select("doc_id", F.col("paragraph").alias("seq"), "style_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {LINES_SQL} SELECT doc_id::VARCHAR AS doc_id, count(*) AS paragraphs, count(*) FILTER (regexp_matches(text, '[^\\s\\x85\\x{{A0}}]')) AS filled FROM lines GROUP BY 1")
def package_payloads(spark, d):
    p = word.payloads(docx.nodes(_packages(spark, d)))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.count_if("payload").alias("filled"))


@query("SELECT c_nationkey::VARCHAR AS doc_id, row, cell, [c_name, c_mktsegment, c_address][cell + 1] AS text FROM (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS row FROM customer), (VALUES (0), (1), (2)) t(cell)".replace("c_address", "c_custkey::VARCHAR"))
def package_table_cells(spark, d):
    """A table a nation, a row a customer: cells and the locators that name them."""
    c = read(spark, d, "customer")
    row = word.row_xml(F.array("c_name", "c_mktsegment", F.col("c_custkey").cast("string")), F.lit(False)).alias("xml")
    first = c.select(F.col("c_nationkey").alias("doc_id")).distinct()
    parts = [c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("seq"), row)]
    parts += [first.select("doc_id", F.lit(at).cast("long").alias("seq"), F.lit(xml).alias("xml")) for at, xml in ((-1, "<w:tbl>"), (1 << 60, "</w:tbl>"))]
    n = docx.nodes(word.packed(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    return word.paragraphs(n).select("doc_id", "row", "cell", "text")


# -- predicates, gates and counts of rules and maps


@query(f"WITH {RULES_SQL}, t AS (SELECT rule_id FROM props WHERE key IN ('convert_explicit_markers', 'rebuild_heading_numbering', 'strip_manual_heading_prefixes') AND value NOT IN ('', 'false', '0')) SELECT profile_id, bool_or(status = 'approved' AND application = 'automatic' AND selector_kind = 'field_role' AND id IN (FROM t)) AS derives FROM rules GROUP BY profile_id")
def derives_text(spark, d):
    return authority.derives_text(*rules_of(spark, d))


@query(f"""WITH {RULES_SQL},
may AS (SELECT DISTINCT a.profile_id FROM acting a JOIN props x ON x.rule_id = a.id AND x.key = 'numbering_mode' AND x.value = 'seq_field' JOIN props y ON y.rule_id = a.id AND y.key = 'allow_automatic_renumbering' AND y.value = 'true' WHERE selector_kind = 'caption_role'),
asks AS (SELECT DISTINCT o_custkey AS map_id FROM orders WHERE o_orderkey % 3 <> 0 AND {pick_sql('o_orderkey', K.CAPTION_ACTIONS)} = 'convert_to_seq'),
used AS (SELECT c_custkey AS map_id, c_custkey % 50 + 1 AS profile_id FROM customer)
SELECT map_id, profile_id, map_id IN (FROM asks) AS requests, profile_id IN (FROM may) AS allows, NOT map_id IN (FROM asks) OR profile_id IN (FROM may) AS authorised FROM used""")
def sequence_rights(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("map_id"), (F.col("o_orderkey") % 3 != 0).alias("approved"), pick(F.col("o_orderkey"), K.CAPTION_ACTIONS).alias("action"))
    used = read(spark, d, "customer").select(F.col("c_custkey").alias("map_id"), (F.col("c_custkey") % 50 + 1).alias("profile_id"))
    return authority.sequence_rights(o, used, *rules_of(spark, d))


@query(f"""WITH {RULES_SQL}, u AS (SELECT o_custkey AS doc_id, o_orderpriority AS name FROM orders WHERE o_totalprice > 200000)
SELECT doc_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM u WHERE doc_id % 50 + 1 IN (SELECT profile_id FROM acting WHERE selector_kind = 'field_role') GROUP BY doc_id""")
def field_preflight(spark, d):
    docs = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 50 + 1).alias("profile_id"))
    lost = read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"))
    return authority.field_block(docs, rules_of(spark, d)[0], lost)


@query("""WITH e AS (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'error') AS images, count(*) FILTER (event_type = 'signup') AS legacy FROM events GROUP BY 1)
SELECT doc_id, CASE WHEN images > 0 THEN 'formula_images' ELSE 'legacy_equations' END AS block, CASE WHEN images > 0 THEN images ELSE legacy END AS n FROM e
WHERE doc_id % 3 <> 0 AND (images > 0 OR legacy > 0 AND coalesce([NULL, 'qa', 'allow'][doc_id % 3 + 1], 'qa') = 'qa')""")
def equation_preflight(spark, d):
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "error").alias("formula_image_candidates"), F.count_if(F.col("event_type") == "signup").alias("legacy_equation_ole"))
    policies = e.select("doc_id", (F.col("doc_id") % 3 != 0).alias("required"), F.when(F.col("doc_id") % 3 == 1, "qa").when(F.col("doc_id") % 3 == 2, "allow").alias("legacy_policy"))
    return authority.equation_block(e, policies)


@query("SELECT doc_id AS map_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def source_bind(spark, d):
    """Maps bound to the documents that they were made from, by fingerprints of whole texts."""
    prints = inventory.content_fingerprint(lines(spark, d))
    maps = prints.select(F.col("doc_id").alias("map_id"), F.when(F.col("doc_id") % 11 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("fingerprint")).alias("content_fingerprint"))
    return authority.source_status(maps, prints)


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderkey % 4, o_orderkey) AS detected FROM orders WHERE o_orderkey % 5 <> 0 AND o_shippriority = 0 AND o_orderkey % 2 = 0 GROUP BY 1)
SELECT o_custkey AS map_id, (o_custkey % 3)::BIGINT AS chapter_start, nullif(detected, 0)::BIGINT AS detected FROM f WHERE o_custkey % 4 <> 0 AND nullif(detected, 0) IS DISTINCT FROM o_custkey % 3""".replace("o_shippriority = 0 AND ", ""))
def chapter_mismatch(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    headings = o.select(F.col("o_custkey").alias("map_id"), k.alias("ord"), (F.when(k % 2 == 0, 1).otherwise(2)).alias("level"), (k % 5 != 0).alias("approved"), F.when(k % 4 != 0, k % 4).alias("chapter"))
    numbering = o.select(F.col("o_custkey").alias("map_id")).distinct().select("map_id", (F.col("map_id") % 4 != 0).alias("approved"), (F.col("map_id") % 3).alias("chapter_start"))
    return authority.chapter_mismatch(numbering, headings)


CAPTIONS_SQL = f"""
captions AS (SELECT l_orderkey AS map_id, l_quantity > 5 AS approved, l_linenumber % 2 = 1 AS migrate, l_suppkey % 3 <> 0 AS in_cell, {pick_sql('l_partkey', K.CAPTION_ACTIONS)} AS action, 'h' || l_partkey % 7 AS h FROM lineitem)"""


def _captions(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("map_id"), (F.col("l_quantity") > 5).alias("approved"), (F.col("l_linenumber") % 2 == 1).alias("migrate_outside_table"), (F.col("l_suppkey") % 3 != 0).alias("in_cell"),
        pick(F.col("l_partkey"), K.CAPTION_ACTIONS).alias("action"), F.concat(F.lit("h"), (F.col("l_partkey") % 7).cast("string")).alias("text_sha256"),
    )


@query(f"""WITH {CAPTIONS_SQL}, a AS (SELECT DISTINCT map_id, h FROM captions WHERE approved AND migrate AND in_cell), b AS (SELECT DISTINCT map_id, h FROM captions WHERE approved AND migrate AND action = 'move_caption')
SELECT DISTINCT map_id, map_id IN (SELECT map_id FROM (FROM a EXCEPT FROM b)) AS generates FROM captions""")
def moves_with_numbers(spark, d):
    return authority.moves_with_numbers(_captions(spark, d))


@query(f"WITH {CAPTIONS_SQL} SELECT map_id, action, count(*) AS n FROM captions WHERE approved AND action IN ('replace_identifier', 'convert_to_seq', 'move_caption') GROUP BY 1, 2")
def action_counts(spark, d):
    return authority.action_counts(_captions(spark, d))


@query("SELECT p_partkey AS rule_id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS targets FROM part")
def targets_per_rule(spark, d):
    return authority.targets_per_rule(read(spark, d, "part").select(F.col("p_partkey").alias("rule_id")), read(spark, d, "lineitem").select(F.col("l_partkey").alias("rule_id")))


@query("SELECT o_custkey, o_clerk, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_clerk ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'F') WHERE n = 1".replace("o_clerk", "o_orderpriority"))
def last_entries(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") != "F").alias("approved"))
    return authority.last_entries(o, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""WITH e AS (SELECT l_orderkey AS k, ['rules', 'sources'][l_suppkey % 2 + 1] AS a, l_linenumber * 3 % 20 AS b, strftime(l_shipdate, '%Y-%m-%d') AS m FROM lineitem)
SELECT k AS doc_id, a || '.' || b AS path, m AS message, row_number() OVER (PARTITION BY k ORDER BY a, b, m)::INT AS place FROM e""")
def errors_by_path(spark, d):
    i = read(spark, d, "lineitem")
    path = F.concat(pick(F.col("l_suppkey"), ["rules", "sources"]), F.lit("."), (F.col("l_linenumber") * 3 % 20).cast("string"))
    return authority.by_path(i.select(F.col("l_orderkey").alias("doc_id"), path.alias("path"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("message")), "doc_id")


@query("""WITH a AS (SELECT o_custkey AS k, 'schema:' || o_orderkey AS v FROM orders WHERE o_totalprice < 20000), b AS (SELECT o_custkey AS k, 'meaning:' || o_orderkey AS v FROM orders WHERE o_orderstatus = 'P')
SELECT k AS profile_id, v AS violation FROM a UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM a)""")
def schema_then_meaning(spark, d):
    o = read(spark, d, "orders")
    of = lambda name, cond: o.where(cond).select(F.col("o_custkey").alias("profile_id"), F.concat(F.lit(name), F.col("o_orderkey").cast("string")).alias("violation"))
    return authority.gated(of("schema:", "o_totalprice < 20000"), of("meaning:", "o_orderstatus = 'P'"), "profile_id")


ALLOWED_SQL = ", ".join(f"('{k}', '{p}')" for k, ps in K.ALLOWED_PROPERTIES.items() for p in ps)
ROLES = ["body_text", "chapter_title", "answer", "no_such_role"]


@query(f"""WITH {RULES_SQL}, allowed(kind, key) AS (VALUES {ALLOWED_SQL}),
r AS (SELECT id AS rule_id, selector_kind AS s, {pick_sql('k', ROLES)} AS v, CASE WHEN selector_kind IN ('style_name', 'paragraph_role') THEN 'style' ELSE replace(selector_kind, '_role', '') END AS kind FROM rules),
w AS (SELECT rule_id, string_agg(DISTINCT key, ', ' ORDER BY key) AS wrong FROM props JOIN r USING (rule_id) WHERE (kind, key) NOT IN (FROM allowed) GROUP BY 1),
h AS (SELECT *, CASE s WHEN 'table_role' THEN 'tables' WHEN 'field_role' THEN 'fields' WHEN 'equation_role' THEN 'equations' ELSE 'styles' END AS handler,
  CASE s WHEN 'style_name' THEN v WHEN 'paragraph_role' THEN CASE v WHEN 'body_text' THEN 'Normal' WHEN 'chapter_title' THEN 'Heading 1' WHEN 'answer' THEN 'Normal' END WHEN 'caption_role' THEN 'Caption' END AS style FROM r LEFT JOIN w USING (rule_id))
SELECT rule_id, handler, style, CASE WHEN wrong IS NOT NULL THEN 'unsupported properties: ' || wrong WHEN handler = 'styles' AND style IS NULL THEN 'unsupported selector' END AS error FROM h""")
def rule_dispatch(spark, d):
    rules, props = rules_of(spark, d)
    number = F.substring("id", 2, 20).cast("long")
    r = rules.select(F.col("id").alias("rule_id"), "selector_kind", pick(number, ROLES).alias("selector_value"))
    return authority.dispatched(r, props.select("rule_id", "key"), profiles.allowed_properties(spark))


@query(f"""WITH {RULES_SQL}, v AS (SELECT rule_id, bool_and(value IN ('true', 'false')) AS valid FROM props GROUP BY 1)
SELECT c_custkey AS doc_id, 'r' || c_custkey AS rule_id, coalesce(valid, true) AS valid, CASE WHEN coalesce(valid, true) THEN coalesce(n, 0) ELSE 0 END AS targets
FROM customer LEFT JOIN v ON rule_id = 'r' || c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def equation_changes(spark, d):
    r = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("rule_id"))
    formulas = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("omml"))
    return authority.equation_changes(r, rules_of(spark, d)[1], formulas)


@query(f"""WITH t AS (SELECT l_orderkey AS map_id, {pick_sql('l_partkey', ['captions', 'toc', 'tables', 'headings', 'comments'])} AS kind, l_linenumber % 3 AS n FROM lineitem)
SELECT map_id, list_position(['toc', 'headings', 'tables', 'captions', 'trailing_sections'], kind) - 1 AS step, kind, sum(n)::BIGINT AS targets FROM t WHERE kind <> 'comments' GROUP BY 1, 2, 3 HAVING sum(n) > 0""")
def map_changes(spark, d):
    i = read(spark, d, "lineitem")
    t = i.select(F.col("l_orderkey").alias("map_id"), pick(F.col("l_partkey"), ["captions", "toc", "tables", "headings", "comments"]).alias("kind"), (F.col("l_linenumber") % 3).alias("n"))
    return authority.map_changes(t, update.MAP_ORDER)


@query("""WITH t AS (SELECT c_nationkey AS map_id, c_custkey AS tab, c_custkey % 4 <> 0 AS approved, c_mktsegment <> 'BUILDING' AS data, [0, 1, 3] AS rows, c_custkey % 4 AS cap, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS gone FROM customer)
SELECT map_id, tab AS "table", array_to_string(CASE WHEN gone IS NULL THEN rows ELSE list_transform(list_filter(rows, lambda r: r <> gone), lambda r: CASE WHEN r > gone THEN r - 1 ELSE r END) END, ',') AS header_rows, (CASE WHEN gone IS NULL THEN cap END)::BIGINT AS caption_row FROM t WHERE approved AND data""")
def data_tables(spark, d):
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    tables = c.select(F.col("c_nationkey").alias("map_id"), k.alias("table"), F.when(F.col("c_mktsegment") != "BUILDING", "data").otherwise("layout").alias("kind"), (k % 4 != 0).alias("approved"), F.array(*[F.lit(i).cast("long") for i in (0, 1, 3)]).alias("header_rows"), (k % 4).alias("caption_row"))
    gone = c.where(k % 3 == 0).select(F.col("c_nationkey").alias("map_id"), k.alias("table"), (k % 4).alias("row"))
    return authority.data_tables(tables, gone).withColumn("header_rows", F.array_join(F.col("header_rows").cast("array<string>"), ","))


# -- audits


STYLE_SQL = "styles AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 10 < 3 THEN '' ELSE 'Other ' END || c_mktsegment AS style, max(c_acctbal) AS size FROM customer GROUP BY 1, 2)"


@query(f"""WITH {STYLE_SQL}, r AS (SELECT n_nationkey AS doc_id, 'r' || i AS rule_id, [NULL, 'BUILDING', 'MACHINERY', 'Absent'][i + 1] AS style FROM nation, range(4) t(i)),
j AS (SELECT r.*, size, s.style IS NOT NULL AS there FROM r LEFT JOIN styles s ON r.doc_id = s.doc_id AND r.style = s.style)
SELECT doc_id, rule_id, '*' AS prop, coalesce(style, 'supported style selector') AS expected, CASE WHEN style IS NULL THEN 'unsupported' ELSE 'missing style' END AS reason FROM j WHERE NOT there
UNION ALL SELECT doc_id, rule_id, 'font_size_pt', '9000', 'differs' FROM j WHERE there AND abs(size - 9000) > greatest(0.05, 1e-9 * greatest(abs(size), 9000.0))""")
def style_rule_audit(spark, d):
    c, name = read(spark, d, "customer"), F.concat(F.when(F.col("c_custkey") % 10 < 3, "").otherwise("Other "), "c_mktsegment")
    styles = c.groupBy(F.col("c_nationkey").alias("doc_id"), name.alias("style")).agg(F.max("c_acctbal").cast("string").alias("value")).withColumn("key", F.lit("font_size_pt"))
    named = F.explode(F.array(*[F.struct(F.lit(f"r{i}").alias("rule_id"), F.lit(s).cast("string").alias("style")) for i, s in enumerate([None, "BUILDING", "MACHINERY", "Absent"])])).alias("x")
    rules = read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), named).select("doc_id", "x.*")
    props = spark.range(4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), F.lit("font_size_pt").alias("key"), F.lit("9000").alias("value"))
    found = authority.style_failures(rules, props, styles)
    return found.select("doc_id", "rule_id", "prop", "expected", F.when(F.col("prop") == "*", F.col("actual")).otherwise("differs").alias("reason"))


@query("""SELECT user_id AS doc_id, 'r' || user_id % 4 AS rule_id, 'block_formula_images' AS prop, '0' AS expected, count(*)::VARCHAR AS actual FROM events WHERE event_type = 'error' AND user_id % 4 IN (0, 2) GROUP BY 1, 2""")
def equation_rule_audit(spark, d):
    e = read(spark, d, "events")
    counts = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "error").alias("formula_image_candidates"))
    rules = counts.select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 4).cast("string")).alias("rule_id"), pick(F.col("doc_id"), ["true", "false", "1", "0"]).alias("block_formula_images"))
    return authority.equation_failures(rules, counts)


@query("""WITH r AS (SELECT l_orderkey AS tab, l_linenumber AS row, bool_or(l_quantity > 10) AS cant FROM lineitem GROUP BY 1, 2)
SELECT o_custkey AS doc_id, o_orderkey AS "table", coalesce(bool_and(cant) FILTER (row IS DISTINCT FROM o_orderkey % 4), true) AS whole FROM orders LEFT JOIN r ON tab = o_orderkey GROUP BY 1, 2""")
def rows_kept_whole(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table"), (F.col("o_orderkey") % 4).alias("caption_row"))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row")).agg(F.bool_or(F.col("l_quantity") > 10).alias("cant_split"))
    return authority.rows_kept_whole(rows.join(o.select("doc_id", "table"), "table"), o)


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_partkey, l_suppkey, l_shipdate, 100 + l_quantity AS w, 100 + l_partkey % 50 AS h, l_quantity AS ml, l_returnflag = 'A' AS mirror FROM lineitem)
SELECT doc_id, idx, 'orientation' AS prop, count(*) AS n FROM s WHERE NOT w > h GROUP BY 1, 2 UNION ALL SELECT doc_id, idx, 'margin_inner_ratio', count(*) FROM s WHERE abs(ml / w - 0.15) > 0.05 GROUP BY 1, 2
UNION ALL SELECT doc_id, idx, 'page_width_mm', count(*) FROM s WHERE abs(w - 120) > 0.05 GROUP BY 1, 2 UNION ALL SELECT doc_id, idx, 'mirror_margins', count(*) FROM s WHERE NOT mirror GROUP BY 1, 2""")
def section_rule_audit(spark, d):
    i = read(spark, d, "lineitem")
    q = F.col("l_quantity").cast("double")
    s = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), (100 + q).alias("page_width_mm"), (100 + F.col("l_partkey") % 50).cast("double").alias("page_height_mm"), q.alias("margin_left_mm"), (F.col("l_returnflag") == "A").alias("mirror_margins"))
    asked = [("orientation", "landscape"), ("margin_inner_ratio", "0.15"), ("page_width_mm", "120"), ("mirror_margins", "true"), ("page_size_policy", "preserve")]
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit("r").alias("rule_id"), F.lit("section").alias("target"), F.lit(a).alias("prop"), F.lit(b).alias("expected")) for a, b in asked])).alias("x")).select("x.*")
    return structure.section_failures(s, rules).groupBy("doc_id", "idx", "prop").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES_SQL}, f AS (SELECT * FROM lines WHERE regexp_matches(text, '\\S')), r AS (SELECT doc_id, 'short' AS rule_id FROM documents UNION ALL SELECT doc_id, 'none' FROM documents),
s AS (SELECT doc_id, min(pos) FILTER (length(text) < 60) AS styled, min(pos) AS first FROM f GROUP BY 1)
SELECT doc_id, rule_id, (CASE WHEN rule_id = 'short' THEN coalesce(styled, first) ELSE first END)::INT AS pos, rule_id || ' rule' AS comment FROM r JOIN s USING (doc_id)""")
def rule_comments(spark, d):
    p = lines(spark, d).withColumn("style", F.when(F.length("text") < 60, "Short").otherwise("Long"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("style")) for a, b in (("short", "Short"), ("none", "Nowhere"))])).alias("x")
    rules = read(spark, d, "documents").select("doc_id", each).select("doc_id", "x.*").withColumn("summary", F.concat("rule_id", F.lit(" rule")))
    return structure.comments(rules, p)


KINDS_OF_FIELD = ["SEQ Figure", "REF b1", "seq Table", "PAGE", "SEQ Equation"]


@query(f"""WITH f AS (SELECT o_custkey AS doc_id, {pick_sql('o_orderkey', KINDS_OF_FIELD)} AS i FROM orders)
SELECT doc_id, count(*) AS fields, coalesce(string_agg(DISTINCT split_part(i, ' ', 2), ',' ORDER BY split_part(i, ' ', 2)) FILTER (lower(i) LIKE 'seq %'), '') AS sequences FROM f GROUP BY 1""")
def field_sequences(spark, d):
    o = read(spark, d, "orders")
    return authority.sequences(o.select(F.col("o_custkey").alias("doc_id"), pick(F.col("o_orderkey"), KINDS_OF_FIELD).alias("instruction")))


@query("""WITH n AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row FROM customer)
SELECT doc_id::VARCHAR AS doc_id, row::INT AS row, row = 0 AS is_header FROM n""")
def package_table_rows(spark, d):
    """The rows of tables in packages, their header rows first."""
    c = read(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("doc_id"), "c_custkey", F.col("c_name").alias("text"))
    first = rows.groupBy("doc_id").agg(F.min("c_custkey").alias("first"))
    xml = word.row_xml(F.array("text"), F.col("c_custkey") == F.col("first")).alias("xml")
    parts = [rows.join(first, "doc_id").select("doc_id", F.col("c_custkey").alias("seq"), xml)]
    parts += [first.select("doc_id", F.lit(at).cast("long").alias("seq"), F.lit(tag).alias("xml")) for at, tag in ((-1, "<w:tbl>"), (1 << 60, "</w:tbl>"))]
    n = docx.nodes(word.packed(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    return word.rows(n).select("doc_id", "row", "is_header")


@query("SELECT n_nationkey::VARCHAR AS doc_id, n_nationkey % 3 = 0 AS mirror_margins, n_nationkey % 2 = 0 AS landscape, (n_nationkey % 4)::INT AS starts_at, 0.1 * (n_nationkey % 5)::DOUBLE AS inner_mm FROM nation".replace("0.1 * (n_nationkey % 5)::DOUBLE", "round((n_nationkey % 5) * 127 / 360.0, 6)"))
def package_sections(spark, d):
    """Sections of packages in millimetres, and a toggle of the whole document."""
    k = F.col("n_nationkey")
    number = lambda c: c.cast("string")
    size = F.when(k % 2 == 0, F.lit('w:w="16838" w:h="11906"')).otherwise(F.lit('w:w="11906" w:h="16838"'))
    xml = F.concat(F.lit("<w:p/><w:sectPr><w:pgSz "), size, F.lit('/><w:pgMar w:left="'), number(k % 5 * 20), F.lit('"/><w:pgNumType w:start="'), number(k % 4), F.lit('"/></w:sectPr>'))
    n = docx.nodes(word.packed(read(spark, d, "nation").select(k.alias("doc_id"), F.lit(0).alias("seq"), xml.alias("xml"))))
    toggles = read(spark, d, "nation").where(k % 3 == 0).select(number(k).alias("doc_id"), F.lit("mirrorMargins").alias("name"))
    s = word.with_toggles(word.sections(n), toggles)
    return s.select("doc_id", "mirror_margins", (F.col("page_width_mm") > F.col("page_height_mm")).alias("landscape"), "starts_at", F.round("margin_left_mm", 6).alias("inner_mm"))
