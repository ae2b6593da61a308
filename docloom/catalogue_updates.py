"""Queries over the driver's tables that apply rules and maps to documents, and audit what came of it, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalogue import LINES_SQL, lines, query, read
from docloom.catalogue_rules import RULES_SQL, pick, pick_sql, rules_of
from docloom.functions import constants as K
from docloom.operators import authority, mapped, profiles, structure, update
from docloom.plans import apply, profile
from docloom.plans import audit as plan

sha = lambda c: F.sha2(c, 256)

# -- updates


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, 0 AS ord, doc_id % 3 AS a, doc_id % 3 + 2 AS b, doc_id % 4 + 1 AS levels FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, 1, 1 + doc_id % 4, 4 FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), g AS (SELECT r.*, b >= n AS out FROM r JOIN s USING (doc_id)),
c AS (SELECT doc_id, ord, a, levels, pos, text, row_number() OVER (PARTITION BY doc_id, pos ORDER BY ord) > 1 AS again FROM g JOIN lines USING (doc_id) WHERE NOT out AND pos BETWEEN a AND b),
f AS (SELECT doc_id, min(fault) AS fault FROM (SELECT doc_id, 'toc_out_of_bounds' AS fault FROM g WHERE out UNION ALL SELECT doc_id, 'toc_changed' FROM c WHERE doc_id % 7 = 0 AND pos = a OR again AND text <> '') GROUP BY 1),
i AS (SELECT doc_id, pos, coalesce(string_agg('TOC \\o "1-' || levels || '" \\h \\z \\u', '|' ORDER BY ord) FILTER (pos = a), '') AS fields FROM c GROUP BY 1, 2)
SELECT doc_id, pos::INT AS pos, sha256(CASE WHEN i.fields IS NULL THEN text ELSE '' END) AS text_sha256, coalesce(i.fields, '') AS fields, coalesce(fault, '') AS fault FROM lines LEFT JOIN i USING (doc_id, pos) LEFT JOIN f USING (doc_id)""")
def toc_update(spark, d):
    """Tables of contents cleared and made fields, their hashes checked paragraph by paragraph; what doesn't hold is told."""
    k = F.col("doc_id")
    p = _spotted(lines(spark, d).withColumn("style", F.lit("Normal")))
    docs = read(spark, d, "documents")
    ranges = docs.where(k % 2 == 0).select("doc_id", F.lit(0).alias("ord"), (k % 3).alias("first"), (k % 3 + 2).alias("last"), (k % 4 + 1).cast("int").alias("levels"))
    ranges = ranges.unionByName(docs.where(k % 5 == 0).select("doc_id", F.lit(1).alias("ord"), F.lit(1).cast("long").alias("first"), (1 + k % 4).alias("last"), F.lit(None).cast("int").alias("levels")))
    asked = F.when((k % 7 == 0) & (F.col("place") == F.col("first")), "other").otherwise(sha(F.col("text")))
    hashes = ranges.join(p, "doc_id").where(F.col("place").between(F.col("first"), F.col("last"))).groupBy("doc_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", asked.alias("h")))), lambda x: x["h"]).alias("hashes"))
    step = mapped.toc(p, ranges.join(hashes, ["doc_id", "ord"], "left").withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>"))))
    fields = step.fields.groupBy("doc_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "instruction"))), lambda x: x["instruction"]), "|").alias("fields"))
    faults = step.faults.groupBy("doc_id").agg(F.min("fault").alias("fault"))
    out = step.after.join(fields, ["doc_id", "place"], "left").join(faults, "doc_id", "left").fillna("", ["fields", "fault"])
    return out.select("doc_id", F.col("place").alias("pos"), sha(F.col("text")).alias("text_sha256"), "fields", "fault")


def _spotted(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("doc_id", F.col("pos").alias("place"), mapped.body_spot(F.col("pos")).alias("spot"), "text", "style")


NUMBERS = ["第3章 ", "2.1 ", "2.1.3 ", "2.1.3.4 "]


@query(f"""WITH {LINES_SQL}, h AS (SELECT doc_id, pos, pos % 4 + 1 AS level, pos % 3 <> 0 AND doc_id % 7 <> 0 AND pos % 11 <> 0 AS bound, {pick_sql('pos', NUMBERS)} || regexp_replace(text, '^\\s+', '') AS text FROM lines)
SELECT doc_id, pos::INT AS pos, sha256(text) AS text_sha256, CASE WHEN bound THEN 'Heading ' || level ELSE 'Normal' END AS style FROM h""")
def heading_update(spark, d):
    """Approved headings get the style of their level; their numbers stay in the text, and all other paragraphs are as they were."""
    p = lines(spark, d)
    p = _spotted(p.select("doc_id", "pos", F.concat(pick(F.col("pos"), NUMBERS), F.regexp_replace("text", "^[ \\t\\n\\f\\r]+", "")).alias("text"), F.lit("Normal").alias("style")))
    approved = p.where("place % 3 <> 0").select("doc_id", "spot", F.when(F.col("place") % 11 == 0, 5).otherwise(F.col("place") % 4 + 1).alias("level"), F.when(F.col("doc_id") % 7 != 0, sha(F.col("text"))).otherwise("other").alias("text_sha256"))
    return mapped.headings(p, approved).after.select("doc_id", F.col("place").alias("pos"), sha(F.col("text")).alias("text_sha256"), "style")


@query(f"""WITH p AS (SELECT p_size AS doc_id, p_partkey AS pos, CASE WHEN p_partkey % 10 = 9 THEN 'convert_to_seq' ELSE {pick_sql('p_partkey', K.CAPTION_ACTIONS)} END AS action, CASE WHEN p_partkey % 2 = 0 THEN '图' ELSE '表' END AS label, p_name FROM part),
f AS (SELECT *, pos % 6 = 0 OR action = 'replace_identifier' AND pos % 8 = 3 OR action = 'convert_to_seq' AND pos % 9 = 4 AS bad FROM p)
SELECT doc_id, pos, CASE WHEN NOT bad AND action = 'replace_identifier' THEN label || ' 9.9-9 ' || p_name WHEN NOT bad AND action = 'convert_to_seq' THEN label || ' - ' || p_name ELSE label || ' 3.2-1 ' || p_name END AS text,
  CASE WHEN NOT bad AND action IN ('convert_to_seq', 'move_caption') THEN 'Caption' ELSE 'Normal' END AS style,
  CASE WHEN NOT bad AND action = 'convert_to_seq' THEN '2:STYLEREF 2 \\s=3.2|3:SEQ ' || CASE label WHEN '图' THEN 'Figure' ELSE 'Table' END || ' \\* ARABIC \\s 2=1' ELSE '' END AS fields FROM f""")
def caption_update(spark, d):
    """The actions of captions: identifiers replaced where all around is as approved, sequences with the style of their chapter."""
    k = F.col("p_partkey")
    label = F.when(k % 2 == 0, "图").otherwise("表")
    p = _spotted(read(spark, d, "part").select(F.col("p_size").alias("doc_id"), k.alias("pos"), F.concat(label, F.lit(" 3.2-1 "), "p_name").alias("text"), F.lit("Normal").alias("style")))
    at, t = F.col("place"), F.col("text")
    none = lambda c: F.lit(None).cast("string").alias(c)
    approved = p.select(
        "doc_id", "spot", F.lit(0).alias("ord"), F.when(at % 10 == 9, "1.1").otherwise("1.2").alias("version"), pick(at, K.CAPTION_ACTIONS).alias("action"), F.when(at % 6 != 0, sha(t)).otherwise("other").alias("text_sha256"),
        F.lit(False).alias("migrate_outside_table"), F.lit(2).alias("start"), F.lit(7).alias("stop"), sha(F.lit("3.2-1")).alias("identifier_sha256"), sha(F.substring(t, 1, 2)).alias("identifier_prefix_sha256"),
        F.when(at % 8 != 3, sha(F.substring(t, F.lit(8), F.length(t)))).otherwise("other").alias("identifier_suffix_sha256"), F.lit("9.9-9").alias("replacement_identifier"),
        F.when(at % 9 == 4, "?").otherwise(F.substring(t, 1, 1)).alias("label"), F.when(at % 2 == 0, "Figure").otherwise("Table").alias("sequence_name"), F.lit(2).alias("heading_level"), none("cached_hierarchy"), none("cached_sequence"),
    )
    rows = spark.createDataFrame([], "doc_id int, table int, row int, cells int")
    step, _, _ = mapped.captions(p, rows, rows.select("doc_id", "table", F.lit(None).cast("long").alias("place")), approved)
    one = F.concat(F.col("at").cast("string"), F.lit(":"), "instruction", F.lit("="), "shown")
    fields = step.fields.groupBy("doc_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", one.alias("f")))), lambda x: x["f"]), "|").alias("fields"))
    return step.after.join(fields, ["doc_id", "place"], "left").fillna("", ["fields"]).select("doc_id", F.col("place").alias("pos"), "text", "style", "fields")


@query("""WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, l_partkey AS cell, min(l_suppkey % 3) AS id, min(l_suppkey)::VARCHAR AS text FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT t, r, arg_min(text, cell) AS text FROM c WHERE r = t % 4 + 1 GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT t AS "table", (CASE WHEN r > t % 4 + 1 AND t IN (SELECT t FROM m) THEN r - 1 ELSE r END)::BIGINT AS row, cell, c.text FROM c WHERE (t, r) NOT IN (SELECT t, r FROM m) UNION ALL SELECT t, -1, -1, text FROM m""")
def caption_row_move(spark, d):
    cells = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").cast("long").alias("row"), F.col("l_partkey").alias("cell")).agg(F.min(F.col("l_suppkey") % 3).alias("cell_id"), F.min("l_suppkey").cast("string").alias("text"))
    cells = cells.withColumn("doc_id", F.lit(1))
    approved = cells.select("doc_id", "table", (F.col("table") % 4 + 1).alias("caption_row")).distinct()
    left, moved = update.caption_rows_moved(cells, approved)
    none = F.lit(-1).cast("long")
    return left.select("table", "row", "cell", "text").unionByName(moved.select("table", none.alias("row"), none.alias("cell"), "text"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS idx FROM lineitem), g AS (SELECT *, (doc_id + idx) % 4 <> 0 AND doc_id % 3 <> 0 AND idx > 1 AS goes FROM s)
SELECT doc_id, idx FROM g WHERE idx <= coalesce((SELECT max(idx) FROM g x WHERE x.doc_id = g.doc_id AND NOT x.goes), 0)""")
def trailing_sections(spark, d):
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).distinct()
    return update.without_trailing(s, s.where((F.col("doc_id") + F.col("idx")) % 4 != 0), s.where((F.col("doc_id") % 3 != 0) & (F.col("idx") > 1)))


@query("""WITH s AS (SELECT o_orderkey AS doc_id, 100.0::DOUBLE + o_orderkey % 70 AS w, 140.0::DOUBLE AS h, 20.0::DOUBLE AS ml, o_orderkey % 3 AS k FROM orders),
t AS (SELECT doc_id, k, CASE k WHEN 0 THEN h WHEN 1 THEN 210.0 ELSE w END AS nw, CASE k WHEN 0 THEN w ELSE h END AS nh, ml, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS o, w, h FROM s)
SELECT doc_id, CASE WHEN k = 0 AND o = 'landscape' THEN w ELSE nw END AS page_width_mm, CASE WHEN k = 0 AND o = 'landscape' THEN h ELSE nh END AS page_height_mm,
  CASE k WHEN 1 THEN 0.1 * 210.0 ELSE ml END AS margin_left_mm, CASE k WHEN 0 THEN 'landscape' ELSE o END AS orientation FROM t""")
def section_update(spark, d):
    k = F.col("o_orderkey")
    s = read(spark, d, "orders").select(k.alias("doc_id"), (100.0 + k % 70).alias("page_width_mm"), F.lit(140.0).alias("page_height_mm"), F.lit(20.0).alias("margin_left_mm"))
    s = s.withColumn("orientation", F.when(F.col("page_width_mm") > F.col("page_height_mm"), "landscape").otherwise("portrait"))
    of = F.col("doc_id") % 3
    props = s.select("doc_id", F.when(of == 0, "landscape").alias("orientation"), F.when(of == 1, 210.0).alias("page_width_mm"), F.when(of == 1, 0.1).alias("margin_inner_ratio"))
    return update.sections(s, props)


@query("""WITH r AS (SELECT l_orderkey AS tab, l_linenumber - 1 AS row, bool_or(l_returnflag = 'A') AS h, bool_or(l_returnflag = 'R') AS c FROM lineitem GROUP BY 1, 2)
SELECT o_custkey AS doc_id, tab AS "table", row::INT AS row, CASE o_orderkey % 3 WHEN 0 THEN h WHEN 1 THEN row = 0 ELSE row IN (0, 1) END AS is_header, CASE o_orderkey % 3 WHEN 0 THEN c WHEN 1 THEN true ELSE row <> 2 END AS cant_split FROM r JOIN orders ON tab = o_orderkey""")
def table_update(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table"))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") - 1).alias("row")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("is_header"), F.bool_or(F.col("l_returnflag") == "R").alias("cant_split"))
    k = F.col("table") % 3
    tables = o.where(k != 0).select("doc_id", "table", F.when(k == 2, F.array(F.lit(0), F.lit(1))).alias("header_rows"), F.when(k == 2, 2).alias("caption_row"))
    return update.table_rows(rows.join(o, "table"), tables)


@query("""WITH m AS (SELECT p_partkey AS pos, unnest(['[[REF:b' || p_partkey % 50 || ']]', '[[PAGE]]', '[[SEQ:Figure]]']) AS marker, generate_subscripts([1, 2, 3], 1) - 1 AS nth, p_partkey % 50 AS b FROM part)
SELECT 1 AS doc_id, pos, nth::INT AS nth, marker, CASE nth WHEN 0 THEN 'REF b' || b || ' \\h' WHEN 1 THEN 'PAGE' ELSE 'SEQ Figure \\* ARABIC \\s 1' END AS instruction, nth > 0 OR b IN (SELECT n_nationkey FROM nation) AS known FROM m""")
def marker_fields(spark, d):
    b = F.concat(F.lit("b"), (F.col("p_partkey") % 50).cast("string"))
    p = read(spark, d, "part").select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("see [[REF:"), b, F.lit("]], [[PAGE]]; [[SEQ:Figure]] [[other]]")).alias("text"))
    marks = read(spark, d, "nation").select(F.lit(1).alias("doc_id"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("name"))
    return update.fields_from_markers(p, marks)


PROPS_SQL = "p AS (SELECT o_custkey AS doc_id, o_orderpriority AS style, o_orderstatus AS key, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2, 3), e AS (SELECT o_custkey AS doc_id, o_orderpriority AS style, o_orderstatus AS key, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1, 2, 3)"


def _style_props(spark, d) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("style"), F.col("o_orderstatus").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"))
    return o.where("ord % 4 = 0").groupBy("doc_id", "style", "key").agg(F.max("value").alias("value")), o.where("ord % 4 <> 0")


@query(f"WITH {PROPS_SQL} SELECT doc_id, style, key, coalesce(p.v, e.v) AS value FROM e FULL JOIN p USING (doc_id, style, key)")
def style_update(spark, d):
    """Rules in their order set properties of styles; the later one wins, missing styles are made."""
    return update.styles(*_style_props(spark, d))


@query(f"WITH {PROPS_SQL}, f AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, unnest(['F', 'O', 'P']) AS key, o_orderpriority AS style FROM orders) SELECT doc_id, pos, key, pos AS value FROM f WHERE (doc_id, style, key) NOT IN (SELECT doc_id, style, key FROM p)")
def direct_formats(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("style"))
    direct = o.select("doc_id", "pos", F.explode(F.array(*map(F.lit, "FOP"))).alias("key"), F.col("pos").alias("value"))
    return update.direct_formats(direct, o, _style_props(spark, d)[1])


@query("""WITH a AS (SELECT o_orderkey * 3 + (o_orderkey % 5 = 0)::INT AS k, o_orderstatus AS s, o_custkey::VARCHAR AS c FROM orders), b AS (SELECT o_orderkey * 3 + 2 * (o_orderkey % 7 = 0)::INT AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_custkey::VARCHAR AS c FROM orders),
j AS (SELECT k, unnest(['s', 'c']) AS "column", unnest([a.s, a.c]) AS old, unnest([b.s, b.c]) AS new FROM a FULL JOIN b USING (k)) SELECT * FROM j WHERE old IS DISTINCT FROM new""")
def row_changes(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    named = lambda moved, s: o.select((k * 3 + moved).alias("k"), s.alias("s"), F.col("o_custkey").alias("c"))
    before = named((k % 5 == 0).cast("int"), F.col("o_orderstatus"))
    return update.changes(before, named(2 * (k % 7 == 0).cast("int"), F.when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus"))), ["k"], ["s", "c"])


# -- what must not change, and audits of what did


@query("""SELECT p_partkey AS pos, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS changed, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS title_preserved, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AS passed FROM part""")
def replacement_audit(spark, d):
    """Identifiers replaced as approved: some by another number, some with another title, some from another text."""
    k = F.col("pos")
    p = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), "p_name")
    before = p.select("pos", F.concat(F.lit("图 3.2-1 "), "p_name").alias("text"))
    after = p.select("pos", F.concat(F.lit("图 "), F.when(k % 5 == 0, "8.8-88").otherwise("9.9-9"), F.lit(" "), F.when(k % 7 == 0, "x").otherwise(""), "p_name").alias("text"))
    entries = p.select("pos", F.lit(2).alias("start"), F.lit(7).alias("stop"), F.lit(8).alias("title_start"), F.when(k % 3 == 0, "other").otherwise(sha(F.concat(F.lit("图 3.2-1 "), "p_name"))).alias("text_sha256"), sha(F.lit("3.2-1")).alias("identifier_sha256"), sha(F.col("p_name")).alias("title_text_sha256"), F.lit("9.9-9").alias("replacement"))
    return structure.replacement_audit(before, after, entries, ["pos"])


ROLES = ["chapter_title", "heading_1", "body", "figure_caption"]


@query(f"""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, {pick_sql('o_orderkey', ROLES)} AS role, o_orderkey % 3 AS k FROM orders WHERE o_orderkey % 7 <> 0)
SELECT DISTINCT doc_id, pos, CASE WHEN pos % 11 = 0 THEN 'missing' WHEN k = 0 THEN 'ok' WHEN k = 1 THEN 'accepted' ELSE 'mismatch' END AS status FROM r WHERE role IN ('chapter_title', 'heading_1')""")
def role_targets(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.col("o_orderpriority").alias("text"), F.when(k % 3 == 1, "Heading 1").otherwise("Normal").alias("style"))
    roles = o.select("doc_id", "pos", pick(F.col("pos"), ROLES).alias("role"), F.when(F.col("pos") % 3 == 0, sha(F.col("text"))).otherwise("other").alias("text_sha256"), (F.col("pos") % 7 != 0).alias("approved"))
    captions = o.select("doc_id", "pos", F.lit("preserve").alias("action"), F.lit(True).alias("approved"))
    return structure.role_targets(roles, o.where("pos % 11 <> 0"), captions, "heading_1")


@query("""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderkey % 4 AS k FROM orders), s AS (SELECT DISTINCT o_custkey AS doc_id FROM orders)
SELECT doc_id, 'update_on_open' AS prop, 'false' AS actual FROM s WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'convert_explicit_markers', ' [[PAGE]] ' FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM p WHERE k = 0) WHERE n <= 10
UNION ALL SELECT doc_id, 'rebuild_heading_numbering', 'Heading ' || l FROM s, range(1, 3) t(l) WHERE NOT (l = 1 AND doc_id % 2 = 0)
UNION ALL SELECT doc_id, 'strip_manual_heading_prefixes', '1.' || pos || ' T' FROM p WHERE k = 1 UNION ALL SELECT doc_id, 'chapter_start', '3' FROM s WHERE doc_id % 5 = 0""")
def field_rule_audit(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"))
    k = F.col("pos") % 4
    p = o.select("doc_id", "pos", F.when(k == 0, " [[PAGE]] ").when(k == 1, F.concat(F.lit("1."), F.col("pos").cast("string"), F.lit(" T"))).otherwise("T").alias("text"), F.when(k == 1, "Heading 2").otherwise("Normal").alias("style"))
    s = o.select("doc_id").distinct()
    settings = s.select("doc_id", (F.col("doc_id") % 3 != 0).alias("update_fields"), F.when(F.col("doc_id") % 5 == 0, 3).otherwise(1).alias("start"))
    return structure.field_failures(p, s.select("doc_id", F.lit("Heading 1").alias("style"), (F.col("doc_id") % 2 == 0).alias("numbered")), settings, levels=2, chapter_start=1)


@query("""WITH p AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderpriority AS style, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS own FROM orders),
s AS (SELECT o_custkey AS doc_id, o_orderpriority AS style, max(o_totalprice) AS styled FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), f AS (SELECT doc_id, pos, coalesce(own, styled) AS v FROM p LEFT JOIN s USING (doc_id, style))
SELECT doc_id, pos, 'font_size_pt' AS prop, v IS NULL AS missing FROM f WHERE NOT coalesce(abs(v - 100000) <= greatest(0.05, 1e-9 * greatest(abs(v), 100000.0)), false)""")
def paragraph_rule_audit(spark, d):
    """What paragraphs set themselves, else what their styles set, against a rule."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("style"), F.col("o_totalprice").cast("string").alias("value"))
    key, rule = F.lit("font_size_pt").alias("key"), F.lit("r").alias("rule_id")
    styles = o.where("pos % 2 = 0").groupBy("doc_id", "style").agg(F.max(F.col("value").cast("double")).cast("string").alias("value")).withColumn("key", key)
    props = spark.range(1).select(rule, key, F.lit("100000").alias("value"))
    found = authority.paragraph_failures(o.select("doc_id", rule, "pos"), props, o, o.where("pos % 3 = 0").select("doc_id", "pos", key, "value"), styles)
    return found.select("doc_id", "pos", "prop", F.col("actual").isNull().alias("missing"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT doc_id, pos, doc_id % 4 AS k, text FROM lines), c AS (SELECT doc_id, count(*) - 2 AS cutoff FROM lines WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT doc_id, pos::INT AS pos, sha256(CASE WHEN k = 0 AND pos = 0 THEN '' ELSE text END) AS text_sha256 FROM p LEFT JOIN c USING (doc_id) WHERE cutoff IS NULL OR pos < cutoff""")
def normalised_texts(spark, d):
    """Texts that a map must leave alone: the tail that it cuts and its table of contents do not count, nor do field markers."""
    p = lines(spark, d)
    counts = p.groupBy("doc_id").agg((F.count(F.lit(1)) - 2).alias("cutoff"))
    marked = p.select("doc_id", F.lit("word/document.xml").alias("part"), "pos", F.col("pos").alias("body_index"), F.concat("text", F.when(F.col("pos") % 2 == 1, "[[PAGE]]").otherwise("")).alias("text"), F.lit("Normal").alias("style"))
    none = lambda schema: spark.createDataFrame([], schema)
    toc = p.where("doc_id % 4 = 0 and pos = 0").select("doc_id", F.col("pos").alias("body_index"))
    entries = none("doc_id long, ord int, start int, stop int, text_sha256 string, prefix_sha256 string, identifier_sha256 string, suffix_sha256 string, replacement string")
    out = structure.normalised(marked, counts.where("doc_id % 3 = 0"), entries, none("doc_id long, text_sha256 string, manual boolean"), toc, none("doc_id long, body_index int, level int"), none("doc_id long, body_index int"))
    return out.select("doc_id", "pos", sha(F.col("text")).alias("text_sha256"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_returnflag AS kind, l_partkey::VARCHAR AS name, l_suppkey::VARCHAR AS h FROM lineitem), b AS (SELECT doc_id, kind, name, CASE WHEN doc_id % 6 = 0 AND kind = 'A' THEN 'x' ELSE h END AS h FROM a),
lost AS (SELECT doc_id FROM (FROM a EXCEPT ALL FROM b) UNION SELECT doc_id FROM (FROM b EXCEPT ALL FROM a))
SELECT o_orderkey AS doc_id, o_orderkey % 4 <> 0 AS content, o_orderkey NOT IN (FROM lost) AS objects, o_orderkey % 5 <> 0 AS rules, o_orderkey % 4 <> 0 AND o_orderkey NOT IN (FROM lost) AND o_orderkey % 5 <> 0 AS passed FROM orders""")
def document_verdicts(spark, d):
    """Two versions of documents: texts by fingerprint, protected objects as multisets, and failures of rules."""
    o, i = read(spark, d, "orders"), read(spark, d, "lineitem")
    p = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("m").alias("part"), F.lit(0).alias("pos"), F.col("o_orderpriority").alias("text"))
    after = p.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    objects = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("sha256"))
    changed = objects.withColumn("sha256", F.when((F.col("doc_id") % 6 == 0) & (F.col("kind") == "A"), "x").otherwise(F.col("sha256")))
    return plan.verdicts(p, after, objects, changed, p.where("doc_id % 5 = 0").select("doc_id"))


@query("""SELECT c_custkey AS doc_id, '# Format report' || chr(10) || chr(10) || '## Rules' || chr(10) || chr(10) || '- x (' || c_custkey % 9 || ' targets)' || chr(10) || '- y (0 targets)' || chr(10) || chr(10) || '## Failures' || chr(10) || chr(10) ||
  CASE WHEN c_custkey % 2 = 0 THEN '- a: bold' ELSE 'None.' END || chr(10) || chr(10) || '## Unresolved references' || chr(10) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '- n1' || chr(10) || '- n2' ELSE 'None.' END AS report FROM customer""")
def format_report(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    rule = lambda id_, summary, n: c.select("doc_id", F.lit(id_).alias("id"), F.lit(summary).alias("summary"), n.alias("targets"))
    rules = rule("b", "y", F.lit(0).cast("long")).unionByName(rule("a", "x", F.col("doc_id") % 9))
    names = c.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("n2"), F.lit("n1"))).alias("name"))
    return plan.report(rules, c.where("doc_id % 2 = 0").select("doc_id", F.lit("a").alias("rule_id"), F.lit("bold").alias("prop")), names)


@query("""WITH r AS (SELECT o_custkey AS doc_id, count(*) FILTER (o_totalprice > 300000) AS u FROM orders GROUP BY 1), e AS (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type = 'signup') AS l FROM events GROUP BY 1),
j AS (SELECT doc_id, coalesce(u, 0) AS u, coalesce(f, 0) AS f, coalesce(l, 0) AS l FROM r FULL JOIN e USING (doc_id))
SELECT doc_id, CASE WHEN u > 0 THEN 'unresolved_references' WHEN f > 0 THEN 'formula_images' ELSE 'legacy_equations' END AS block FROM j WHERE u > 0 OR f > 0 OR l > 0 AND doc_id % 2 = 0""")
def preflight(spark, d):
    refs = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count_if(F.col("o_totalprice") > 300000).alias("unresolved"))
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "error").alias("formula_images"), F.count_if(F.col("event_type") == "signup").alias("legacy"))
    return plan.preflight(refs, e.withColumn("policy", F.when(F.col("doc_id") % 2 == 1, "allow")))


# -- constraints of profiles and maps


@query(f"""WITH {RULES_SQL}, profiles AS (SELECT DISTINCT p_size AS profile_id, p_size % 2 = 0 AS approved, p_size % 4 = 0 AS named FROM part),
sources AS (SELECT p_size AS profile_id, 's' || p_partkey % 5 AS id FROM part), conflicts AS (SELECT p_size AS profile_id, 'c' || p_partkey AS id, p_partkey % 3 = 0 AS open FROM part WHERE p_partkey % 10 = 0),
allowed(kind, key) AS (VALUES {", ".join(f"('{k}', '{p}')" for k, ps in K.ALLOWED_PROPERTIES.items() for p in ps)}, {", ".join(f"('caption', '{p}')" for p in K.ALLOWED_PROPERTIES['style'])}),
kinds AS (SELECT profile_id, id AS rule_id, CASE WHEN selector_kind IN ('style_name', 'paragraph_role') THEN 'style' ELSE replace(selector_kind, '_role', '') END AS kind FROM rules)
SELECT profile_id, 'duplicate_source:' || id AS violation FROM sources GROUP BY profile_id, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT profile_id, 'unknown_source:s' || k % 7 FROM rules WHERE (profile_id, 's' || k % 7) NOT IN (SELECT profile_id, id FROM sources)
UNION ALL SELECT profile_id, 'unsupported:' || rule_id || '.' || key FROM props JOIN kinds USING (profile_id, rule_id) WHERE (kind, key) NOT IN (FROM allowed)
UNION ALL SELECT profile_id, 'open_conflict:' || id FROM conflicts JOIN profiles USING (profile_id) WHERE open AND approved
UNION ALL SELECT profile_id, 'approval_without_a_name' FROM profiles WHERE approved AND NOT named""")
def profile_constraints(spark, d):
    rules, props = rules_of(spark, d)
    number = F.substring("id", 2, 20).cast("long")
    rules = rules.withColumn("source_ids", F.array(F.concat(F.lit("s"), (number % 7).cast("string"))))
    p, k = read(spark, d, "part"), F.col("p_partkey")
    size = F.col("p_size").alias("profile_id")
    sources = p.select(size, F.concat(F.lit("s"), (k % 5).cast("string")).alias("id"))
    conflicts = p.where(k % 10 == 0).select(size, F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "open").otherwise("resolved").alias("status"), F.array(F.concat(F.lit("r"), k.cast("string"))).alias("rule_ids"))
    heads = p.select(size).distinct().select("profile_id", F.when(F.col("profile_id") % 2 == 0, "approved").otherwise("draft").alias("approval_status"), F.when(F.col("profile_id") % 4 == 0, "me").alias("approved_by"), F.lit("now").alias("approved_at"))
    return profiles.profile_violations(heads, sources, rules, props, conflicts, profiles.allowed_properties(spark))


@query(f"""WITH {RULES_SQL}, on_ AS (SELECT DISTINCT p_size AS profile_id FROM part WHERE p_size % 2 = 0)
SELECT p_size AS profile_id, v.violation FROM part JOIN on_ ON profile_id = p_size, (VALUES (1)) t(x), LATERAL (SELECT unnest(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'open_conflict:' || p_partkey END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'unanswered_question:' || p_partkey END,
  CASE WHEN p_partkey % 3 = 2 THEN 'draft_rule:r' || p_partkey END], lambda z: z IS NOT NULL)) AS violation) v""")
def approval_constraints(spark, d):
    rules, _ = rules_of(spark, d)
    p, k = read(spark, d, "part"), F.col("p_partkey")
    size, name = F.col("p_size").alias("profile_id"), k.cast("string").alias("id")
    heads = p.select(size).distinct().withColumn("approval_status", F.when(F.col("profile_id") % 2 == 0, "approved").otherwise("draft"))
    conflicts = p.select(size, name, F.when(k % 3 == 0, "open").otherwise("resolved").alias("status"))
    questions = p.select(size, name, (k % 2 == 0).alias("blocking"), F.when(k % 5 == 0, "yes").otherwise(" ").alias("answer"))
    return profiles.approval_violations(heads, conflicts, questions, rules)


@query("""SELECT c_custkey AS profile_id, unnest(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'caller_requirements_not_highest' END, CASE WHEN c_custkey % 3 = 0 THEN 'equations_not_editable' END, CASE WHEN c_custkey % 5 = 0 THEN 'formula_images_not_blocked' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'user_requirement_not_first' END], lambda z: z IS NOT NULL)) AS violation FROM customer WHERE c_custkey % 4 <> 0""")
def policy_constraints(spark, d):
    k = F.col("c_custkey")
    policy = F.struct((k % 2 != 0).alias("caller_requirements_highest"), (k % 3 != 0).alias("editable_equations_required"), F.when(k % 5 != 0, "block").otherwise("warn").alias("formula_image_policy"))
    first = F.when(k % 7 != 0, F.array(F.lit("user_requirement"))).otherwise(F.array().cast("array<string>"))
    return profiles.policy_violations(read(spark, d, "customer").select(k.alias("profile_id"), F.when(k % 4 == 0, "1.0").otherwise("1.1").alias("schema_version"), policy.alias("runtime_policy"), first.alias("source_precedence")))


@query("""WITH m AS (SELECT c_custkey AS map_id, c_custkey % 5 AS v, c_custkey % 3 = 0 AS open, c_custkey AS k FROM customer)
SELECT map_id, unnest(list_filter([CASE WHEN v = 4 THEN 'version' END, CASE WHEN k % 2 = 0 THEN 'not_approved' END, CASE WHEN open THEN 'conflicts' END, CASE WHEN v IN (1, 2) AND k % 7 = 0 THEN 'unknown_role_approved' END,
  CASE WHEN v IN (1, 2) AND k % 11 = 0 THEN 'role_without_place' END, CASE WHEN v = 2 AND k % 4 = 0 THEN 'caption_action' END, CASE WHEN v = 2 AND k % 4 <> 0 AND k % 3 = 0 THEN 'relocation_without_move' END, CASE WHEN v IN (1, 2) AND k % 6 = 0 THEN 'chapter_start' END,
  CASE WHEN v IN (1, 2) AND k % 13 = 0 THEN 'open_anomalies' END], lambda z: z IS NOT NULL)) AS violation FROM m""")
def map_constraints(spark, d):
    k = F.col("c_custkey")
    version = F.element_at(F.array(*map(F.lit, ["1.0", "1.1", "1.2", "1.0", "9.9"])), (k % 5 + 1).cast("int"))
    text = F.lit(None).cast("string")
    place = F.when(k % 11 != 0, F.struct(F.lit("body_paragraph").alias("kind")))
    role = F.struct(place.alias("locator"), F.lit("h").alias("text_sha256"), F.when(k % 7 == 0, "unknown").otherwise("body").alias("role"), F.lit(True).alias("approved"))
    names = ["identifier_sha256", "identifier_prefix_sha256", "identifier_suffix_sha256", "title_text_sha256", "replacement_identifier", "cached_hierarchy", "cached_sequence", "sequence_name"]
    numbers = ["title_span_start", "heading_level", "identifier_span"]
    fields = {"completeness": "complete", "hierarchy_status": "match", "numbering_mode": "manual_text", "identifier_semantics": "unknown", "domain_context": "general", "domain_confidence": "low"}
    caption = F.struct(
        F.lit(True).alias("approved"), F.when(k % 4 == 0, "shout").otherwise("style_only").alias("action"), ((k % 3 == 0) & (k % 4 != 0)).alias("migrate_outside_table"), F.lit(False).alias("replacement_confirmed"),
        *[F.lit(v).alias(n) for n, v in fields.items()], *[text.alias(n) for n in names], *[F.lit(None).cast("int").alias(n) for n in numbers],
    )
    anomaly = F.struct(F.lit("gap").alias("kind"), F.when(k % 13 == 0, "open").otherwise("accepted").alias("status"))
    numbering = F.struct(F.lit(True).alias("approved"), F.when(k % 6 == 0, 0).otherwise(1).alias("chapter_start"), F.array(anomaly).alias("anomalies"))
    conflicts = F.when(k % 3 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    maps = read(spark, d, "customer").select(
        k.alias("map_id"), version.alias("schema_version"), F.when(k % 2 != 0, "approved").otherwise("draft").alias("status"), conflicts.alias("conflicts"), F.array(role).alias("paragraph_roles"), F.array(caption).alias("captions"), numbering.alias("numbering")
    )
    return profiles.map_violations(maps)


@query("""WITH m AS (SELECT c_custkey AS map_id, c_custkey % 5 AS v, c_custkey AS k FROM customer)
SELECT * FROM (SELECT map_id, CASE WHEN v = 4 THEN 'version' WHEN k % 2 = 0 THEN 'not_approved' WHEN k % 3 = 0 THEN 'conflicts' WHEN v IN (1, 2) AND k % 7 = 0 THEN 'unknown_role_approved' WHEN v IN (1, 2) AND k % 11 = 0 THEN 'role_without_place'
  WHEN v IN (1, 2) AND k % 13 = 0 THEN 'open_anomalies' END AS violation FROM m) WHERE violation IS NOT NULL""")
def first_map_fault(spark, d):
    """The first thing that keeps each map from being applied."""
    return profiles.first_violations(map_constraints(spark, d), "map_id", profiles.MAP_CHECKS)


@query(f"WITH {RULES_SQL}, p AS (SELECT rule_id, string_agg(key || '=' || value, ', ' ORDER BY key, value) AS pairs FROM props GROUP BY 1) SELECT id, id || ': ' || coalesce(pairs, '') || '. Sources: s1, s2' AS summary FROM rules LEFT JOIN p ON rule_id = id")
def rule_summary(spark, d):
    rules, props = rules_of(spark, d)
    return profiles.summary(rules.withColumn("source_ids", F.array(F.lit("s1"), F.lit("s2"))), props)


@query(f"WITH {RULES_SQL} SELECT id, id IN (SELECT id FROM acting) AS applies FROM rules")
def automatic_rules(spark, d):
    applied, review = profiles.automatic(rules_of(spark, d)[0])
    return applied.select("id", F.lit(True).alias("applies")).unionByName(review.select("id", F.lit(False).alias("applies")))


# -- a whole map


MAPPED_SQL = f"""{LINES_SQL}, p AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN '2.1 ' ELSE '' END || regexp_replace(text, '^\\s+', '') AS text FROM lines), z AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
bad AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n < 3 THEN 0 ELSE 2 END AS step, CASE WHEN doc_id % 2 = 0 AND n < 3 THEN 'toc_out_of_bounds' ELSE 'table_changed' END AS fault FROM z WHERE doc_id % 2 = 0 AND n < 3 OR doc_id % 15 = 0)"""


@query(f"""WITH {MAPPED_SQL}, t AS (SELECT doc_id, 0 AS step, 'toc' AS kind, 2 AS n FROM z WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, 'headings', count(*) FROM p WHERE pos % 4 = 3 AND doc_id % 3 <> 0 GROUP BY 1
  UNION ALL SELECT doc_id, 2, 'tables', 1 FROM z WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 3, 'captions', 1 FROM z WHERE doc_id % 10 = 5)
SELECT doc_id, step::INT AS step, kind, n::BIGINT AS targets FROM t WHERE doc_id NOT IN (SELECT doc_id FROM bad) UNION ALL SELECT doc_id, step::INT, 'fault ' || fault, 0 FROM bad""")
def map_application(spark, d):
    """A map applied in its fixed order: the kinds of change that it makes in each document, or the first fault, which leaves it as it was."""
    _, changes, faults = apply.apply_map(*_mapped(spark, d))
    return changes.unionByName(faults.select("doc_id", "step", F.concat(F.lit("fault "), "fault").alias("kind"), F.lit(0).cast("long").alias("targets")))


@query(f"""WITH {MAPPED_SQL}, x AS (SELECT p.*, doc_id % 2 = 0 AND pos IN (1, 2) AS cleared, pos % 4 = 3 AND doc_id % 3 <> 0 AS h, doc_id IN (SELECT doc_id FROM bad) AS bad FROM p),
c AS (SELECT doc_id, doc_id % 10 = 5 AND doc_id NOT IN (SELECT doc_id FROM bad) AS moved, doc_id IN (SELECT doc_id FROM bad) AS bad FROM z WHERE doc_id % 5 = 0)
SELECT doc_id, 'b/' || pos AS what, pos AS place, sha256(CASE WHEN cleared AND NOT bad THEN '' ELSE text END) AS value, CASE WHEN h AND NOT bad THEN 'Heading 2' ELSE 'Normal' END AS style FROM x
UNION ALL SELECT doc_id, 'c/0/0/0/0', CASE WHEN moved THEN 1000000 ELSE 1000001 END, sha256('表 1.1-1 t'), CASE WHEN moved THEN 'Caption' ELSE 'Normal' END FROM c
UNION ALL SELECT doc_id, 'c/0/1/0/0', 1000002, sha256('head'), 'Normal' FROM c
UNION ALL SELECT doc_id, 'row', CASE WHEN moved THEN i - 1 ELSE i END, CASE WHEN i = 1 AND NOT bad THEN 'header' ELSE '' END, CASE WHEN i > 0 AND NOT bad THEN 'whole' ELSE '' END FROM c, range(3) t(i) WHERE NOT (moved AND i = 0)""")
def map_result(spark, d):
    """The paragraphs and rows after a whole map: cleared, styled, and captions before their tables."""
    after, _, _ = apply.apply_map(*_mapped(spark, d))
    p = after["paragraphs"].select("doc_id", F.col("spot").alias("what"), F.col("place").cast("long").alias("place"), sha(F.col("text")).alias("value"), "style")
    flag = lambda c, name: F.when(F.col(c), name).otherwise("")
    return p.unionByName(after["rows"].select("doc_id", F.lit("row").alias("what"), F.col("row").cast("long").alias("place"), flag("is_header", "header").alias("value"), flag("cant_split", "whole").alias("style")))


def _mapped(spark, d) -> tuple[dict, dict]:
    k = F.col("doc_id")
    bare = F.regexp_replace("text", "^[ \\t\\n\\f\\r]+", "")
    p = _spotted(lines(spark, d).select("doc_id", "pos", F.concat(F.when(F.col("pos") % 4 == 3, "2.1 ").otherwise(""), bare).alias("text"), F.lit("Normal").alias("style"))).withColumn("place", F.col("place").cast("long"))
    docs = read(spark, d, "documents").select("doc_id")
    tabled = docs.where(k % 5 == 0)
    cell = lambda place, spot, text: F.struct(F.lit(place).cast("long").alias("place"), F.lit(spot).alias("spot"), F.lit(text).alias("text"))
    cells = tabled.select("doc_id", F.explode(F.array(cell(1_000_001, "c/0/0/0/0", "表 1.1-1 t"), cell(1_000_002, "c/0/1/0/0", "head"))).alias("x"))
    rows = tabled.select("doc_id", F.lit(0).alias("table"), F.explode(F.array(*map(F.lit, range(3)))).alias("row"), F.lit(False).alias("is_header"), F.lit(False).alias("cant_split"), F.lit(1).alias("cells"))
    tables = tabled.select("doc_id", F.lit(0).alias("table"), F.lit(1_000_000).cast("long").alias("place"), F.lit(3).alias("rows"), F.lit("t").alias("table_text_sha256"), F.lit("f").alias("first_row_sha256"))
    toc = p.where((k % 2 == 0) & F.col("place").isin(1, 2)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", sha(F.col("text")).alias("h")))), lambda x: x["h"]).alias("hashes"))
    toc = docs.where(k % 2 == 0).join(toc, "doc_id", "left").select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("first"), F.lit(2).alias("last"), F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"), F.lit(3).alias("levels"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    move = docs.where(k % 10 == 5).select(
        "doc_id", F.lit("c/0/0/0/0").alias("spot"), F.lit(0).alias("ord"), F.lit("1.2").alias("version"), F.lit("move_caption").alias("action"), sha(F.lit("表 1.1-1 t")).alias("text_sha256"), F.lit(True).alias("migrate_outside_table"),
        *none("int", "start", "stop", "heading_level"), *none("string", "identifier_sha256", "identifier_prefix_sha256", "identifier_suffix_sha256", "replacement_identifier", "label", "sequence_name", "cached_hierarchy", "cached_sequence"),
    )
    approved = {
        "toc": toc,
        "headings": p.where("place % 4 = 3 and doc_id % 3 <> 0").select("doc_id", "spot", F.lit(2).alias("level"), sha(F.col("text")).alias("text_sha256")),
        "tables": tabled.select("doc_id", F.lit(True).alias("semantic"), F.lit(0).alias("table"), F.lit("data").alias("kind"), F.lit("t").alias("table_text_sha256"), F.when(k % 15 == 0, "other").otherwise("f").alias("first_row_sha256"),
                                F.array(F.lit(1)).alias("repeat_header_rows"), F.lit(False).alias("repeat_header"), F.lit(True).alias("prevent_normal_row_split"), F.lit(0).alias("caption_row")),
        "captions": move,
    }
    paragraphs = p.unionByName(cells.select("doc_id", "x.place", "x.spot", "x.text", F.lit("Normal").alias("style")))
    return {"paragraphs": paragraphs, "rows": rows, "tables": tables}, approved


#: Rules of four profiles in their order: what each is for, what it sets, and the profiles that have it.
PROFILE_RULES = [
    ("sections", None, False, "automatic", {"page_width_mm": "210", "page_height_mm": "297"}, (0, 1, 2, 3)), ("sections", None, False, "automatic", {"orientation": "landscape"}, (0, 2)),
    ("sections", None, False, "automatic", {"margin_top_ratio": "0.1"}, (0, 1, 2, 3)), ("styles", "Heading 2", True, "automatic", {"bold": "true"}, (0, 1, 2, 3)),
    ("fields", None, False, "automatic", {"convert_explicit_markers": "true", "strip_manual_heading_prefixes": "true"}, (0, 1, 2, 3)), ("styles", "Heading 2", False, "automatic", {"italic": "true"}, (0, 1, 2, 3)),
    ("tables", None, False, "automatic", {"repeat_header_row": "true", "prevent_row_split": "true"}, (0, 1, 2, 3)), ("tables", None, False, "automatic", {"repeat_header_row": "false"}, (1,)),
    ("fields", None, False, "automatic", {"mark_fields_dirty": "true", "rebuild_heading_numbering": "true", "heading_levels": "2"}, (0, 1, 2)), ("fields", None, False, "automatic", {"rebuild_heading_numbering": "true", "heading_levels": "9"}, (3,)),
    ("styles", "Quote", False, "manual_review", {}, (0, 1, 2, 3)), ("equations", None, False, "automatic", {}, (0, 1)),
]


def _profiled(spark, d):
    k = F.col("doc_id")
    rules = [(p, i, f"r{i}", "approved", how, handler, style, by_map) for i, (handler, style, by_map, how, _, of) in enumerate(PROFILE_RULES) for p in of]
    props = [(p, f"r{i}", key, value) for i, (*_, values, of) in enumerate(PROFILE_RULES) for p in of for key, value in values.items()]
    rules = spark.createDataFrame(rules, "profile_id long, ord int, id string, status string, application string, handler string, style string, by_map boolean")
    props = spark.createDataFrame(props, "profile_id long, rule_id string, key string, value string")
    docs = read(spark, d, "documents").select("doc_id")
    p = lines(spark, d).select("doc_id", F.col("pos").alias("place"), F.concat(F.when(F.col("pos") % 4 == 3, "2.1 ").otherwise(""), F.regexp_replace("text", "^[ \\t\\n\\f\\r]+", ""), F.when(F.col("pos") % 4 == 3, "[[PAGE]]").otherwise("")).alias("text"), F.lit("Normal").alias("style"))
    page = {"page_width_mm": 100.0, "page_height_mm": 140.0, "orientation": "portrait"} | dict.fromkeys(profile.LENGTHS, 20.0)
    tabled = docs.where(k % 5 == 0).withColumn("table", F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    document = {
        "of": docs.select("doc_id", (k % 4).alias("profile_id"), none("int").alias("chapter_start")), "paragraphs": p,
        "styles": docs.where(k % 2 == 0).select("doc_id", F.lit("Heading 2").alias("style"), F.lit("bold").alias("key"), F.lit("false").alias("value")),
        "direct": p.where("place % 2 = 1").select("doc_id", "place", F.explode(F.array(F.lit("bold"), F.lit("size"))).alias("key"), F.lit("x").alias("value")),
        "sections": docs.select("doc_id", F.lit(0).alias("idx"), *[F.lit(v).alias(c) for c, v in page.items()]),
        "tables": tabled.select("doc_id", "table", none("string").alias("style"), none("string").alias("alignment"), none("array<int>").alias("listed"), F.when(k % 2 == 0, 1).alias("caption_row")),
        "rows": tabled.select("doc_id", "table", F.explode(F.array(F.lit(0), F.lit(1))).alias("row"), F.lit(False).alias("is_header"), F.lit(False).alias("cant_split")),
        "counts": docs.select("doc_id", (k % 7).alias("fields"), (k % 2).alias("equations")), "targets": p.where("place % 4 = 3 and doc_id % 3 <> 0").select("doc_id", F.lit(3).alias("ord"), "place"),
    }
    return profile.apply_profile(document, rules, props)


PROFILED_SQL = f"""{LINES_SQL}, z AS (SELECT doc_id, doc_id % 4 AS k, count(*) FILTER (pos % 4 = 3) AS m FROM lines GROUP BY 1), n AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN m ELSE 0 END AS h, (doc_id % 5 = 0)::INT AS t FROM z)"""


@query(f"""WITH {PROFILED_SQL}, c AS (SELECT doc_id, k, unnest([1, CASE WHEN k % 2 = 0 THEN 1 END, 1, h, m + h, h, t, CASE WHEN k = 1 THEN t END, doc_id % 7 + m + 2, NULL, NULL, CASE WHEN k < 2 THEN doc_id % 2 END]) AS targets, unnest(range(12)) AS ord FROM n)
SELECT doc_id, ord::INT AS ord, 'r' || ord AS what, targets::BIGINT AS targets FROM c WHERE k < 3 AND targets IS NOT NULL UNION ALL SELECT doc_id, 10, 'manual', 0 FROM n UNION ALL SELECT doc_id, -1, 'heading_levels', 0 FROM n WHERE k = 3""")
def profile_application(spark, d):
    """The rules of a profile one after the other: how much each has changed, what is left for review, and faults."""
    _, changes, manual, faults = _profiled(spark, d)
    zero = F.lit(0).cast("long").alias("targets")
    out = changes.select("doc_id", "ord", F.col("rule_id").alias("what"), "targets").unionByName(manual.select("doc_id", "ord", F.lit("manual").alias("what"), zero))
    return out.unionByName(faults.select("doc_id", F.lit(-1).alias("ord"), F.col("fault").alias("what"), zero))


@query(f"""WITH {PROFILED_SQL}, p AS (SELECT doc_id, pos, k, pos % 4 = 3 AS mark, pos % 4 = 3 AND doc_id % 3 <> 0 AND k < 3 AS h, regexp_replace(text, '^\\s+', '') AS text FROM lines JOIN n USING (doc_id))
SELECT doc_id, 'paragraph' AS what, pos::BIGINT AS place, sha256(CASE WHEN mark AND NOT h THEN '2.1 ' ELSE '' END || text || CASE WHEN mark AND k = 3 THEN '[[PAGE]]' ELSE '' END) AS value, CASE WHEN h THEN 'Heading 2' ELSE 'Normal' END AS style FROM p
UNION ALL SELECT doc_id, 'page', 0, CASE k WHEN 3 THEN '100.0 140.0 20.0' WHEN 1 THEN '210.0 297.0 29.7' ELSE '297.0 210.0 21.0' END, CASE WHEN k % 2 = 0 THEN 'landscape' ELSE 'portrait' END FROM n
UNION ALL SELECT doc_id, 'row', i, CASE WHEN i = 0 AND k IN (0, 2) THEN 'header' ELSE '' END, CASE WHEN k < 3 AND NOT (i = 1 AND doc_id % 2 = 0) THEN 'whole' ELSE '' END FROM n, range(2) r(i) WHERE t = 1
UNION ALL SELECT doc_id, 'direct ' || key, pos, 'x', '' FROM p, (SELECT unnest(['bold', 'size']) AS key) WHERE pos % 2 = 1 AND NOT (h AND key = 'bold')
UNION ALL SELECT doc_id, 'style ' || key, 0, CASE WHEN k = 3 THEN 'false' ELSE 'true' END, 'Heading 2' FROM n, (SELECT unnest(['bold', 'italic']) AS key) WHERE k < 3 OR doc_id % 2 = 0 AND key = 'bold'""")
def profile_result(spark, d):
    """Paragraphs, pages, rows, styles and what paragraphs set themselves after a whole profile."""
    out, *_ = _profiled(spark, d)
    flag = lambda c, name: F.when(F.col(c), name).otherwise("")
    row = lambda df, what, place, value, style: df.select("doc_id", what.alias("what"), place.cast("long").alias("place"), value.alias("value"), style.alias("style"))
    one = lambda c: F.round(c, 3).cast("string")
    page = F.concat_ws(" ", one("page_width_mm"), one("page_height_mm"), one("margin_top_mm"))
    found = [
        row(out["paragraphs"], F.lit("paragraph"), F.col("place"), sha(F.col("text")), F.col("style")), row(out["sections"], F.lit("page"), F.lit(0), page, F.col("orientation")),
        row(out["rows"], F.lit("row"), F.col("row"), flag("is_header", "header"), flag("cant_split", "whole")), row(out["direct"], F.concat(F.lit("direct "), "key"), F.col("place"), F.col("value"), F.lit("")),
        row(out["styles"], F.concat(F.lit("style "), "key"), F.lit(0), F.col("value"), F.col("style")),
    ]
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole


#: Lines in runs of seven characters; each run stands for itself, every eleventh holds something besides text.
RUNS_SQL = f"""{LINES_SQL}, l AS (SELECT doc_id, pos, text, pos % 5 + 3 AS a, pos % 5 + 12 AS b FROM lines WHERE length(text) > 0),
r AS (SELECT doc_id, pos, a, b, length(text) AS n, i AS run, substr(text, 7 * i + 1, 7) AS text, 7 * i AS s, least(7 * i + 7, length(text)) AS e FROM l, range(0, 3000) t(i) WHERE 7 * i < length(text)),
f AS (SELECT doc_id, pos, CASE WHEN b > max(n) THEN 'span' WHEN bool_or((run + doc_id) % 11 = 0 AND greatest(a, s) < least(b, e)) THEN 'unsupported_object' ELSE '' END AS fault FROM r GROUP BY doc_id, pos, a, b)"""


@query(f"""WITH {RUNS_SQL} SELECT doc_id, pos::INT AS pos, run::INT AS run, CASE WHEN fault = '' AND greatest(a, s) < least(b, e) THEN substr(text, 1, greatest(a, s) - s) || CASE WHEN a >= s THEN '<new>' ELSE '' END || substr(text, least(b, e) - s + 1) ELSE text END AS text, fault
FROM r JOIN f USING (doc_id, pos)""")
def run_edits(spark, d):
    """A span of each line replaced in its runs: the first that it meets gets the new text, the others lose their parts."""
    runs, edits = _runs(spark, d)
    after, faults = update.spliced(runs, edits)
    return after.join(faults, ["doc_id", "place"], "left").select("doc_id", F.col("place").alias("pos"), "run", "text", F.coalesce("fault", F.lit("")).alias("fault"))


@query(f"""WITH {RUNS_SQL} SELECT doc_id, pos::INT AS pos, sha256(CASE WHEN fault = '' THEN substr(text, 1, a) || '<new>' || substr(text, b + 1) ELSE text END) AS text_sha256 FROM l JOIN f USING (doc_id, pos)""")
def run_edit_texts(spark, d):
    """The joined text of the runs after the edits, which is that of the paragraph with the span replaced."""
    after, _ = update.spliced(*_runs(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "")
    return after.groupBy("doc_id", F.col("place").alias("pos")).agg(sha(text).alias("text_sha256"))


def _runs(spark, d):
    p = lines(spark, d).where(F.length("text") > 0)
    run = F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / 7).cast("int"))).alias("run")
    runs = p.select("doc_id", F.col("pos").alias("place"), "text", run).select("doc_id", "place", "run", F.substring(F.col("text"), 7 * F.col("run") + 1, F.lit(7)).alias("text"), ((F.col("run") + F.col("doc_id")) % 11 != 0).alias("plain"))
    k = F.col("pos") % 5
    return runs, p.select("doc_id", F.col("pos").alias("place"), (k + 3).alias("start"), (k + 12).alias("stop"), F.lit("<new>").alias("replacement"))
