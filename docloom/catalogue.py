"""Queries over the driver's tables that apply the operators, and the SQL that each must agree with.

Every query reads its whole tables. Where an integer may be missing, -1 or 0 stands for it, so that it stays one. Order within a document is total, so that results do not depend on
how Spark has dealt the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import constants as K
from docloom.functions import text as T
from docloom.operators import audit, binding, inventory, ordered, profiles

QUERIES: dict = {}
SQL: dict[str, str] = {}

LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
NOT_BLANK = r"regexp_matches({}, '\S')"
#: A total order of lineitem.
ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return inventory.paragraphs(read(spark, d, "documents"))


# -- scans, counts and fingerprints


@query(f"WITH {LINES_SQL} SELECT doc_id, pos::INT AS pos, length(text)::INT AS n_chars, {NOT_BLANK.format('text')} AS filled FROM lines")
def paragraph_explode(spark, d):
    return lines(spark, d).select("doc_id", "pos", F.length("text").alias("n_chars"), T.not_blank(F.col("text")).alias("filled"))


@query("SELECT coalesce(lang, '<none>') AS style, count(*) AS n FROM documents GROUP BY 1")
def style_counts(spark, d):
    return inventory.style_counts(read(spark, d, "documents"), "lang")


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS paragraphs, count(*) FILTER ({NOT_BLANK.format('text')}) AS non_empty FROM lines GROUP BY doc_id")
def nonempty_counts(spark, d):
    return inventory.paragraph_counts(lines(spark, d))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_sha256(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {LINES_SQL} SELECT doc_id, sha256(string_agg(sha256(text), ',' ORDER BY pos)) AS fingerprint FROM lines GROUP BY doc_id")
def content_fingerprint(spark, d):
    return inventory.content_fingerprint(lines(spark, d))


@query("""
WITH cells AS (SELECT n_regionkey, n_nationkey, unnest([0, 1]) AS cell, unnest([n_name, n_nationkey::VARCHAR]) AS text FROM nation),
rows_ AS (SELECT n_regionkey, n_nationkey, string_agg(text, '␟' ORDER BY cell) AS text FROM cells GROUP BY ALL)
SELECT n_regionkey, sha256(string_agg(text, '␞' ORDER BY n_nationkey)) AS text_sha256 FROM rows_ GROUP BY n_regionkey""")
def table_text_hash(spark, d):
    cells = F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("cell", "text")
    return inventory.table_text_hash(read(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("row"), cells), "n_regionkey")


@query("""
WITH a AS (SELECT doc_id * 3 + (doc_id % 7 = 0)::INT AS doc_id, sha256(text) AS h FROM documents),
b AS (SELECT doc_id * 3 + 2 * (doc_id % 11 = 0)::INT AS doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (doc_id)""")
def protected_manifest_diff(spark, d):
    """Two versions of a collection, made from one: some texts have another name in one of them, so they are removed and added, some are changed."""
    docs, doc = read(spark, d, "documents"), F.col("doc_id")
    before = docs.select((doc * 3 + (doc % 7 == 0).cast("int")).alias("doc_id"), F.sha2("text", 256).alias("h"))
    after = docs.select((doc * 3 + 2 * (doc % 11 == 0).cast("int")).alias("doc_id"), F.sha2(F.when(doc % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return inventory.manifest_diff(before, after, "doc_id", "h")


@query("SELECT sha256(text) AS text_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return inventory.duplicates(text_sha256(spark, d), "text_sha256")


ELEMENTS = ["p", "a", "h1", "li", "div", "script"]


@query("SELECT page_id, " + ", ".join(rf"len(regexp_extract_all(html, '<{e}[\s>/]'))::BIGINT AS n_{e}" for e in ELEMENTS) + " FROM pages")
def element_counts(spark, d):
    return inventory.element_counts(read(spark, d, "pages"), "page_id", "html", ELEMENTS)


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY event_type")
def events_json(spark, d):
    k = F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


@query("SELECT upper(regexp_extract(event_type || ' ' || user_id, '^\\s*([A-Za-z]+)', 1)) AS kind, count(*) AS n FROM events GROUP BY 1")
def field_types(spark, d):
    return inventory.kind_counts(read(spark, d, "events").select(F.concat_ws(" ", "event_type", "user_id").alias("instruction")), "instruction")


@query("""
WITH kinds AS (SELECT part_id, unnest(['word/document.xml', 'word/header1.xml', 'word/media/x.png', 'word/footnotes.xml', 'docProps/app.xml', 'word/header.xml', 'word/styles.xml']) AS part
  FROM (SELECT p_partkey AS part_id FROM part))
SELECT part, count(*) AS n FROM kinds WHERE regexp_full_match(part, 'word/(document|header\\d+|footer\\d+|footnotes|endnotes)\\.xml') GROUP BY part""")
def content_parts(spark, d):
    names = ["word/document.xml", "word/header1.xml", "word/media/x.png", "word/footnotes.xml", "docProps/app.xml", "word/header.xml", "word/styles.xml"]
    parts = read(spark, d, "part").select(F.explode(F.array(*map(F.lit, names))).alias("part"))
    return parts.where(F.rlike("part", F.lit(K.CONTENT_PART))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN contains(x, 'dsmt') OR contains(x, 'mathtype') THEN 'mathtype_ole' WHEN x IN ('equation.3', 'equation.2', 'equation') THEN 'legacy_equation_ole' ELSE 'other_ole' END AS kind, count(*) AS n
FROM (SELECT lower(CASE p_size % 4 WHEN 0 THEN 'Equation.DSMT4' WHEN 1 THEN 'Equation.3' WHEN 2 THEN p_type ELSE 'MathType ' || p_name END) AS x FROM part) GROUP BY 1""")
def equation_kinds(spark, d):
    size = F.col("p_size") % 4
    prog = F.when(size == 0, "Equation.DSMT4").when(size == 1, "Equation.3").when(size == 2, F.col("p_type")).otherwise(F.concat(F.lit("MathType "), "p_name"))
    return read(spark, d, "part").groupBy(inventory.ole_kind(prog).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- references and bindings


@query("SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unresolved_refs(spark, d):
    return binding.unresolved(read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("""
SELECT p_partkey, id FROM (SELECT DISTINCT p_partkey, unnest([p_partkey % 130, p_partkey % 90, p_size]) AS id FROM part) WHERE id NOT IN (SELECT s_suppkey FROM supplier)""")
def rule_source_anti(spark, d):
    """Parts as rules, with three source ids each; suppliers are the sources that are known."""
    key = F.col("p_partkey")
    parts = read(spark, d, "part").select("p_partkey", F.array(key % 130, key % 90, F.col("p_size").cast(key_type(spark, d))).alias("ids"))
    return binding.unknown_ids(parts, "p_partkey", "ids", read(spark, d, "supplier"), "s_suppkey")


def key_type(spark: SparkSession, d: str) -> str:
    return dict(read(spark, d, "part").dtypes)["p_partkey"]


ALLOWED_SQL = ", ".join(f"('{kind}', '{key}')" for kind, keys in K.ALLOWED_PROPERTIES.items() for key in keys)
KEYS = sorted({key for keys in K.ALLOWED_PROPERTIES.values() for key in keys} | {"unknown_key"})
KINDS = list(K.ALLOWED_PROPERTIES)


def _rule_props(spark, d):
    kinds, keys = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, KEYS))
    at = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("int") + 1
    return read(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.element_at(kinds, at("p_size", len(KINDS))).alias("kind"), F.element_at(keys, at("p_partkey", len(KEYS))).alias("key"))


@query(f"""
WITH props AS (SELECT p_partkey AS rule_id, ({KINDS})[(p_size % {len(KINDS)}) + 1] AS kind, ({KEYS})[(p_partkey % {len(KEYS)}) + 1] AS key FROM part),
allowed(kind, key) AS (VALUES {ALLOWED_SQL})
SELECT rule_id, key FROM props ANTI JOIN allowed USING (kind, key)""")
def unsupported_properties(spark, d):
    return binding.unsupported(_rule_props(spark, d), profiles.allowed_properties(spark))


@query("SELECT doc_id, lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def approved_semi(spark, d):
    return binding.approved(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), "doc_id", F.col("quality") == 1)


@query("""
WITH entries AS (SELECT doc_id * 2 AS doc_id, sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS h FROM documents),
texts AS (SELECT doc_id * 2 + (doc_id % 5 = 0)::INT AS doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, CASE WHEN texts.h IS NULL THEN 'missing' WHEN texts.h = entries.h THEN 'ok' ELSE 'mismatch' END AS status FROM entries LEFT JOIN texts USING (doc_id)""")
def hash_bound_join(spark, d):
    docs, doc = read(spark, d, "documents"), F.col("doc_id")
    entries = docs.select((doc * 2).alias("doc_id"), F.sha2(F.when(doc % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return binding.hash_bound(entries, docs.select((doc * 2 + (doc % 5 == 0).cast("int")).alias("doc_id"), "text"), "doc_id")


@query(f"""
WITH {LINES_SQL},
entries AS (SELECT doc_id, (doc_id % 9)::INT AS pos, sha256(text) AS h FROM lines WHERE pos = doc_id % 4)
SELECT e.doc_id, e.pos AS paragraph, CASE WHEN l.text IS NULL THEN 'missing' WHEN sha256(l.text) = e.h THEN 'ok' ELSE 'mismatch' END AS status
FROM entries e LEFT JOIN lines l ON e.doc_id = l.doc_id AND e.pos = l.pos""")
def locator_binding(spark, d):
    """Entries at a paragraph of each document with the hash of another one, which is the same in some."""
    nulls = [F.lit(None).cast("int").alias(c) for c in ("table", "row", "cell")]
    there = lines(spark, d).select("doc_id", F.lit("body_paragraph").alias("kind"), *nulls, F.col("pos").alias("paragraph"), "text")
    entries = there.where(F.col("paragraph") == F.col("doc_id") % 4)
    entries = entries.select("doc_id", "kind", *nulls, (F.col("doc_id") % 9).cast("int").alias("paragraph"), F.sha2("text", 256).alias("text_sha256"))
    return binding.bound(entries, there).select("doc_id", "paragraph", "status")


@query("""
WITH styles AS (SELECT n_nationkey AS style, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey + 10 END AS size FROM nation)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 END, s.size, -1)::BIGINT AS size FROM customer LEFT JOIN styles s ON c_nationkey = s.style""")
def effective_format(spark, d):
    nation, n = read(spark, d, "nation"), F.col("n_nationkey")
    styles = nation.select(n.alias("style"), F.when(n % 4 != 0, F.col("n_regionkey") + 10).cast("bigint").alias("size"))
    direct = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("style"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 20).cast("bigint").alias("size"))
    return binding.effective(direct, styles, "c_custkey", "style", "size").fillna(-1, ["size"])


@query(f"""
WITH {LINES_SQL}, ranges AS (SELECT doc_id, doc_id % 3 AS first, doc_id % 3 + 2 AS last FROM documents UNION ALL SELECT doc_id, 2, 3 FROM documents WHERE doc_id % 2 = 0)
SELECT DISTINCT l.doc_id, l.pos::INT AS pos FROM lines l JOIN ranges r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first AND r.last""")
def toc_range_join(spark, d):
    docs, doc = read(spark, d, "documents"), F.col("doc_id")
    ranges = docs.select("doc_id", (doc % 3).alias("first"), (doc % 3 + 2).alias("last"))
    ranges = ranges.union(docs.where(doc % 2 == 0).select("doc_id", F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))
    return binding.in_ranges(lines(spark, d).select("doc_id", "pos"), ranges)


@query(f"""
WITH {LINES_SQL},
runs AS (SELECT doc_id, sum(length(text)) OVER w - length(text) AS start, sum(length(text)) OVER w AS stop FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT doc_id, doc_id % 50 AS s, doc_id % 50 + 40 AS e FROM documents)
SELECT s.doc_id, s.s, s.e, count(*) FILTER (start <= s AND e <= stop) AS holding, count(*) FILTER (least(stop, e) > greatest(start, s)) AS overlapping
FROM spans s LEFT JOIN runs r ON s.doc_id = r.doc_id GROUP BY ALL""")
def span_containment(spark, d):
    runs = ordered.run_offsets(lines(spark, d), ["doc_id"], "pos")
    spans = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("s"), (F.col("doc_id") % 50 + 40).alias("e"))
    return binding.contained(spans, runs, ["doc_id"])


@query(f"""
WITH {LINES_SQL}, runs AS (SELECT doc_id, pos, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(text) AS start FROM lines)
SELECT doc_id, pos::INT AS pos, sha256(substring(text, greatest(1, 25 - start + 1)::INT)) AS h FROM runs""")
def prefix_removal(spark, d):
    runs = ordered.without_prefix(ordered.run_offsets(lines(spark, d), ["doc_id"], "pos"), F.lit(25))
    return runs.select("doc_id", "pos", F.sha2("text", 256).alias("h"))


@query("""
SELECT c_custkey, coalesce(CASE WHEN r.r_regionkey % 2 = 0 THEN r.r_name END, 'default') AS level FROM customer
LEFT JOIN nation n ON c_nationkey = n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 1000 ELSE 0 END LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def numbering_lookup(spark, d):
    key = F.col("n_nationkey")
    nation, region = read(spark, d, "nation").withColumn("n_nationkey", F.when(key % 5 == 0, key + 1000).otherwise(key)), read(spark, d, "region")
    region = region.withColumn("r_name", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")))
    start = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("level"))
    return binding.looked_up(start, [(nation, "n_nationkey", "n_regionkey"), (region, "r_regionkey", "r_name")], F.lit("default"), "level").select("c_custkey", "level")


FONT_SQL = " ".join(f"WHEN k IN ({', '.join(repr(n.replace('_', '')) for n in names)}) THEN '{g}'" for g, names in K.FONT_ALIASES.items())
THERE = ["SimSun", "楷体", "Times New Roman", "Brand#1", "Brand 2"]


@query(f"""
WITH wanted AS (SELECT DISTINCT unnest([p_brand, CASE p_size % 3 WHEN 0 THEN '宋体' WHEN 1 THEN 'KaiTi' ELSE 'Sim-Hei' END]) AS font FROM part),
there AS (SELECT unnest({THERE}) AS font),
a AS (SELECT font, k, CASE {FONT_SQL} ELSE k END AS g FROM (SELECT font, lower(regexp_replace(font, '[\\s_-]+', '', 'g')) AS k FROM wanted)),
b AS (SELECT k, CASE {FONT_SQL} ELSE k END AS g FROM (SELECT lower(regexp_replace(font, '[\\s_-]+', '', 'g')) AS k FROM there))
SELECT font, CASE WHEN bool_or(b.k = a.k) THEN 'exact' WHEN count(b.k) > 0 THEN 'verified_alias' ELSE 'missing' END AS match FROM a LEFT JOIN b USING (g) GROUP BY font""")
def alias_resolution(spark, d):
    size = F.col("p_size") % 3
    fonts = F.array("p_brand", F.when(size == 0, "宋体").when(size == 1, "KaiTi").otherwise("Sim-Hei"))
    there = spark.range(1).select(F.explode(F.array(*map(F.lit, THERE))).alias("font"))
    return inventory.resolved_fonts(read(spark, d, "part").select(F.explode(fonts).alias("font")).distinct(), there)


@query("""
WITH props AS (SELECT p_partkey, ['font_name', 'font_size_pt', 'color_hex', 'bold'][p_partkey % 4 + 1] AS key,
  CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN '12' WHEN 2 THEN NULL ELSE '  ' END AS value FROM part)
SELECT DISTINCT trim(value) AS font FROM props WHERE key LIKE 'font_name%' AND regexp_matches(value, '\\S')""")
def required_fonts(spark, d):
    key = F.col("p_partkey") % 4
    name = F.element_at(F.array(*map(F.lit, ["font_name", "font_size_pt", "color_hex", "bold"])), key.cast("int") + 1)
    value = F.when(key == 0, F.col("p_brand")).when(key == 1, "12").when(key == 3, "  ")
    return inventory.fonts_of(read(spark, d, "part").select(name.alias("key"), value.alias("value")))


# -- text


@query("""
WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '第' || l_orderkey || '章 T' WHEN 2 THEN l_orderkey || '.2 T' WHEN 3 THEN l_orderkey || '.3.1. T'
  WHEN 4 THEN l_orderkey || '.4.1.2T' WHEN 5 THEN ' ' || l_orderkey || '.5' ELSE 'plain ' || l_orderkey END AS t FROM lineitem),
v AS (SELECT *, CASE WHEN regexp_matches(t, '^\\s*\\d+\\.\\d+\\.\\d+\\.\\d+\\.?\\s*\\S') THEN 4 WHEN regexp_matches(t, '^\\s*\\d+\\.\\d+\\.\\d+\\.?\\s*\\S') THEN 3
  WHEN regexp_matches(t, '^\\s*\\d+\\.\\d+\\.?\\s*\\S') THEN 2 WHEN regexp_matches(t, '^\\s*第\\s*[0-9]+\\s*章\\s*\\S') THEN 1 END AS level FROM h)
SELECT l_orderkey, l_linenumber, coalesce(level, 0)::INT AS level, array_to_string(CASE level WHEN 1 THEN [regexp_extract(t, '[0-9]+')] WHEN 2 THEN string_split(regexp_extract(t, '^\\s*(\\d+(?:[.-]\\d+){1})', 1), '.')
  WHEN 3 THEN string_split(regexp_extract(t, '^\\s*(\\d+(?:[.-]\\d+){2})', 1), '.') WHEN 4 THEN string_split(regexp_extract(t, '^\\s*(\\d+(?:[.-]\\d+){3})', 1), '.') END, '.') AS number FROM v""")
def heading_level(spark, d):
    n, order = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    t = F.when(n == 1, F.concat(F.lit("第"), order, F.lit("章 T"))).when(n == 2, F.concat(order, F.lit(".2 T"))).when(n == 3, F.concat(order, F.lit(".3.1. T")))
    t = t.when(n == 4, F.concat(order, F.lit(".4.1.2T"))).when(n == 5, F.concat(F.lit(" "), order, F.lit(".5"))).otherwise(F.concat(F.lit("plain "), order))
    h = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t")).distinct().withColumn("level", T.heading_level(F.col("t")))
    number = F.array_join(T.heading_number(F.col("t"), F.col("level")).cast("array<string>"), ".")
    return h.select("l_orderkey", "l_linenumber", F.coalesce("level", F.lit(0)).alias("level"), number.alias("number"))


NUMERALS = ["一", "九", "十", "十二", "二十", "九十九", "百", "一百二十", "12", "007"]
NUMERAL_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.NUMERALS.items())


@query(f"""
WITH t AS (SELECT p_partkey, ({NUMERALS})[p_size % {len(NUMERALS)} + 1] AS token FROM part),
s AS (SELECT *, string_split(token, '十')[1] AS l, substring(token, instr(token, '十') + 1) AS r FROM t)
SELECT p_partkey, coalesce(CASE WHEN regexp_matches(token, '^[0-9]+$') THEN try_cast(token AS INT) WHEN token = '十' THEN 10
  WHEN contains(token, '十') THEN coalesce(CASE l {NUMERAL_SQL} END, 1) * 10 + coalesce(CASE r {NUMERAL_SQL} END, 0) ELSE CASE token {NUMERAL_SQL} END END, -1)::INT AS chapter FROM s""")
def chapter_numeral(spark, d):
    token = F.element_at(F.array(*map(F.lit, NUMERALS)), (F.col("p_size") % len(NUMERALS)).cast("int") + 1)
    return read(spark, d, "part").select("p_partkey", F.coalesce(T.chapter_number(F.concat(F.lit(" 第"), token, F.lit(" 章 x"))), F.lit(-1)).alias("chapter"))


CAPTION_SQL = """
WITH c AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '图 ' || p_size || '.' || p_partkey % 7 + 1 || '-' || p_partkey % 9 + 1 || ' ' || p_name WHEN 1 THEN '表' || p_size || '.2.1 - 3 ' || p_name
  WHEN 2 THEN '图 ' || p_size || '-' || p_partkey % 5 || ' 结构 ' || p_name WHEN 3 THEN '图 3-3 2-2剖面 ' || p_name WHEN 4 THEN '表' ELSE 'Figure ' || p_name END AS t FROM part),
i AS (SELECT *, CASE WHEN regexp_matches(t, '^\\s*(图|表)\\s*(\\S.*)?$') THEN substring(t, 1, 1) END AS label,
  nullif(regexp_extract(t, '^\\s*(?:图|表)\\s*([0-9]+(?:[.．-][0-9]+)*)(?:\\s+|\\s*[-－—–]\\s*)([^\\s].*)$', 1), '') AS identifier,
  nullif(regexp_extract(t, '^\\s*(图|表)\\s*(\\d+(?:\\.\\d+){1,3})\\s*[-－—–]\\s*(\\d+)\\s*(\\S.*)$', 2), '') AS hierarchy,
  nullif(regexp_extract(t, '^\\s*(图|表)\\s*(\\d+(?:\\.\\d+){1,3})\\s*[-－—–]\\s*(\\d+)\\s*(\\S.*)$', 3), '') AS sequence,
  regexp_matches(t, '建筑|平面图|立面图|剖面图|详图|大样') AS arch, regexp_matches(t, '土木|结构|钢结构|混凝土|梁|柱|桁架|基础|节点|截面|断面') AS civil FROM c)
"""


def _captions(spark, d):
    key, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name")
    text = lambda x: x.cast("string")
    t = F.when(key % 6 == 0, F.concat(F.lit("图 "), size, F.lit("."), text(key % 7 + 1), F.lit("-"), text(key % 9 + 1), F.lit(" "), name))
    t = t.when(key % 6 == 1, F.concat(F.lit("表"), size, F.lit(".2.1 - 3 "), name)).when(key % 6 == 2, F.concat(F.lit("图 "), size, F.lit("-"), text(key % 5), F.lit(" 结构 "), name))
    t = t.when(key % 6 == 3, F.concat(F.lit("图 3-3 2-2剖面 "), name)).when(key % 6 == 4, "表").otherwise(F.concat(F.lit("Figure "), name))
    return read(spark, d, "part").select("p_partkey", t.alias("t"))


@query(CAPTION_SQL + """SELECT p_partkey, label, identifier, hierarchy, sequence, coalesce(len(string_split(hierarchy, '.')), -1)::INT AS heading_level,
  coalesce(CASE WHEN identifier IS NOT NULL THEN instr(t, identifier) - 1 END, -1)::INT AS identifier_start FROM i""")
def caption_parse(spark, d):
    c = T.caption(F.col("t"))
    return _captions(spark, d).select("p_partkey", *[c[n].alias(n) for n in ("label", "identifier", "hierarchy", "sequence", "heading_level", "identifier_start")]).fillna(-1)


@query(CAPTION_SQL + """, s AS (SELECT *, CASE WHEN arch AND civil THEN 'mixed' WHEN arch THEN 'architecture' WHEN civil THEN 'civil_engineering' ELSE 'unknown' END AS domain FROM i)
SELECT p_partkey, CASE WHEN label IS NOT NULL THEN domain END AS domain_context, CASE WHEN label IS NULL THEN NULL WHEN identifier IS NULL THEN 'unknown'
  WHEN regexp_matches(substring(t, instr(t, identifier) + length(identifier)), '\\s\\d+(-\\d+)+\\s*(剖面|断面|截面|节点|详图|大样|立面|平面)') THEN CASE WHEN regexp_matches(identifier, '[.．]') THEN 'mixed' ELSE 'drawing_mark' END
  WHEN domain <> 'unknown' AND contains(identifier, '-') AND NOT regexp_matches(identifier, '[.．]') THEN 'drawing_mark' WHEN regexp_matches(identifier, '[.．]') THEN 'publication_number' ELSE 'unknown' END AS identifier_semantics FROM s""")
def caption_semantics(spark, d):
    c = T.caption(F.col("t"))
    return _captions(spark, d).select("p_partkey", c["domain_context"].alias("domain_context"), c["identifier_semantics"].alias("identifier_semantics"))


@query(CAPTION_SQL + """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN regexp_replace(t, '^(\\s*(?:图|表)\\s*)[0-9]+(?:[.．-][0-9]+)*', '\\19.9-9') END AS replaced FROM i WHERE identifier IS NOT NULL""")
def identifier_replace(spark, d):
    """Identifiers replaced where the hash of the entry is theirs; that of every fourth is not."""
    c = T.caption(F.col("t"))
    found = _captions(spark, d).select("p_partkey", "t", *[c[n].alias(n) for n in ("identifier", "identifier_start", "identifier_stop")]).where("identifier is not null")
    sha = F.sha2(F.when(F.col("p_partkey") % 4 == 0, F.lit("other")).otherwise(F.col("identifier")), 256)
    return found.select("p_partkey", T.replaced_identifier(F.col("t"), F.col("identifier_start"), F.col("identifier_stop"), F.lit("9.9-9"), sha).alias("replaced"))


@query("""
WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '[[TOC]]' WHEN 1 THEN '[[PAGE]]' WHEN 2 THEN '[[REF:b' || p_size || ']]' WHEN 3 THEN '[[SEQ:Figure]]' ELSE '[[NOPE:x]]' END AS t FROM part)
SELECT p_partkey, CASE WHEN t = '[[TOC]]' THEN 'TOC \\o "1-3" \\h \\z \\u' WHEN t = '[[PAGE]]' THEN 'PAGE' WHEN t LIKE '[[REF:%' THEN 'REF ' || t[7:-3] || ' \\h' WHEN t LIKE '[[SEQ:%' THEN 'SEQ ' || t[7:-3] || ' \\* ARABIC \\s 1' END AS instruction,
  regexp_replace('a' || t || 'b', '\\[\\[(?:TOC|PAGE|(?:REF|PAGEREF|SEQ):[A-Za-z0-9_.-]+)\\]\\]', '', 'g') AS bare FROM m""")
def marker_instructions(spark, d):
    key = F.col("p_partkey") % 5
    t = F.when(key == 0, "[[TOC]]").when(key == 1, "[[PAGE]]").when(key == 2, F.concat(F.lit("[[REF:b"), F.col("p_size").cast("string"), F.lit("]]"))).when(key == 3, "[[SEQ:Figure]]").otherwise("[[NOPE:x]]")
    m = read(spark, d, "part").select("p_partkey", t.alias("t"))
    return m.select("p_partkey", T.marker_instruction(F.col("t")).alias("instruction"), T.without_markers(F.concat(F.lit("a"), "t", F.lit("b"))).alias("bare"))


ROLES = ["body_text", "chapter_title", "caption", "title", "long_quote", "heading2", "none"]


@query(f"""
WITH t AS (SELECT p_partkey, ({ROLES})[p_partkey % {len(ROLES)} + 1] AS value, ['style_name', 'paragraph_role', 'caption_role', 'bibliography_role', 'document'][p_size % 5 + 1] AS kind FROM part)
SELECT p_partkey, CASE value {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ROLE_ALIASES.items())} ELSE value END AS role,
  CASE kind WHEN 'style_name' THEN value WHEN 'paragraph_role' THEN CASE value {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ROLE_STYLES.items())} END WHEN 'caption_role' THEN 'Caption' WHEN 'bibliography_role' THEN 'Bibliography' END AS style FROM t""")
def role_styles(spark, d):
    value = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("p_partkey") % len(ROLES)).cast("int") + 1)
    kind = F.element_at(F.array(*map(F.lit, ["style_name", "paragraph_role", "caption_role", "bibliography_role", "document"])), (F.col("p_size") % 5).cast("int") + 1)
    return read(spark, d, "part").select("p_partkey", T.normalised_role(value).alias("role"), T.style_of_selector(kind, value).alias("style"))


# -- order


@query("""
WITH h AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS pos,
  CASE WHEN l_linenumber = 1 THEN [l_orderkey % 9 + 1] WHEN l_linenumber > 6 THEN CAST([] AS BIGINT[]) ELSE [l_orderkey % 9 + 1, l_linenumber - 1] END AS number FROM lineitem),
g AS (SELECT *, number[:-2] AS parent, number[-1] AS last FROM h WHERE len(number) > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) AS nth, lag(last) OVER (PARTITION BY doc_id, parent ORDER BY pos) AS sibling FROM g),
f AS (SELECT w.*, x.pos AS first_pos FROM w LEFT JOIN (SELECT doc_id, number, pos FROM w WHERE nth = 1) x ON w.doc_id = x.doc_id AND w.parent = x.number)
SELECT doc_id, pos::INT AS pos, array_to_string(number, '.') AS number, 'duplicate_number' AS kind, 0 AS expected_last FROM f WHERE nth > 1
UNION ALL SELECT doc_id, pos, array_to_string(number, '.'), 'missing_parent', 0 FROM f WHERE len(number) > 1 AND NOT coalesce(first_pos < pos, false)
UNION ALL SELECT doc_id, pos, array_to_string(number, '.'), 'sequence_gap', coalesce(sibling + 1, 1)::INT FROM f WHERE len(number) > 1 AND last <> coalesce(sibling + 1, 1)""")
def numbering_anomalies(spark, d):
    """Line items as numbered headings, a supplier's as those of a document."""
    w = ordered.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    chapter, n = (F.col("l_orderkey") % 9 + 1).cast("int"), F.col("l_linenumber").cast("int")
    number = F.when(n == 1, F.array(chapter)).when(n > 6, F.array().cast("array<int>")).otherwise(F.array(chapter, n - 1))
    h = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.row_number().over(w) - 1).alias("pos"), number.alias("number"))
    found = ordered.numbering_anomalies(h)
    return found.withColumn("number", F.array_join(F.col("number").cast("array<string>"), ".")).fillna(0, ["expected_last"])


@query(f"""
WITH {LINES_SQL} SELECT doc_id, pos::INT AS pos, sha256(string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_sha256 FROM lines""")
def nearby_context(spark, d):
    return ordered.nearby(lines(spark, d)).select("doc_id", "pos", F.sha2("context", 256).alias("context_sha256"))


@query(f"""
WITH {LINES_SQL}, s AS (SELECT *, CASE WHEN length(text) < 60 THEN 'Caption' ELSE 'Normal' END AS style FROM lines WHERE {NOT_BLANK.format('text')})
SELECT doc_id, pos::INT AS pos, style FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (style = 'Caption')::INT DESC, pos) AS r FROM s) WHERE r = 1""")
def first_anchor(spark, d):
    styled = lines(spark, d).withColumn("style", F.when(F.length("text") < 60, "Caption").otherwise("Normal"))
    return ordered.first_anchor(styled, "Caption").select("doc_id", "pos", "style")


@query(f"""
WITH {LINES_SQL}, s AS (SELECT doc_id, pos, length(text) > 150 AS payload FROM lines)
SELECT doc_id, pos::INT AS idx FROM (SELECT *, bool_or(payload) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS used FROM s) WHERE NOT used AND pos > 0""")
def trailing_empty(spark, d):
    """Lines as sections; those of up to 150 characters count as empty."""
    sections = lines(spark, d).select("doc_id", F.col("pos").alias("idx"), (F.length("text") > 150).alias("payload"))
    return ordered.trailing_empty(sections).select("doc_id", "idx")


@query(f"WITH {LINES_SQL} SELECT doc_id, pos::INT AS pos, (sum((length(text) % 3 <> 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS body_index FROM lines")
def body_index(spark, d):
    return ordered.body_index(lines(spark, d), F.length("text") % 3 != 0).select("doc_id", "pos", "body_index")


TOKENS = {"click": "begin", "view": "text", "purchase": "separate", "error": "end", "signup": "instr"}


def _tokens(spark, d):
    """Events of a user as tokens of a paragraph."""
    names = F.create_map(*[F.lit(x) for kv in TOKENS.items() for x in kv])
    kind = F.coalesce(F.element_at(names, F.col("event_type")), F.lit("tab"))
    return read(spark, d, "events").select("user_id", F.col("event_id").alias("at"), kind.alias("kind"), F.concat(F.lit("x"), (F.col("event_id") % 10).cast("string")).alias("text"))


#: A stack a user, one event after the other; for each open field the parts of its instruction and whether its result has begun.
STACKS_SQL = f"""RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TOKENS.items())} ELSE 'tab' END AS kind,
  'x' || event_id % 10 AS text FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS kind, ''::VARCHAR AS text, []::BOOLEAN[] AS done, []::VARCHAR[] AS parts, NULL::VARCHAR AS ready FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.i, e.event_id, e.kind, e.text,
    CASE WHEN e.kind = 'begin' THEN list_append(done, false) WHEN e.kind = 'separate' AND len(done) > 0 THEN list_append(done[:-2], true) WHEN e.kind = 'end' THEN done[:-2] ELSE done END,
    CASE WHEN e.kind = 'begin' THEN list_append(parts, '') WHEN e.kind = 'end' THEN parts[:-2] WHEN e.kind = 'instr' AND len(done) > 0 AND NOT done[-1] THEN list_append(parts[:-2], parts[-1] || e.text) ELSE parts END,
    CASE WHEN e.kind IN ('separate', 'end') AND len(done) > 0 AND NOT done[-1] AND parts[-1] <> '' THEN parts[-1] END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)"""


@query(f"""WITH {STACKS_SQL} SELECT user_id, sha256(coalesce(string_agg(CASE WHEN kind = 'text' AND NOT list_contains(done, true) THEN text WHEN kind = 'tab' THEN chr(9) END, '' ORDER BY i), '')) AS text_sha256,
  coalesce(string_agg(ready, '|' ORDER BY i), '') AS instructions FROM s GROUP BY user_id""")
def field_stack(spark, d):
    """The text that the tokens of each user show, and the instructions of their fields; no user's tokens are one array."""
    opened = ordered.open_fields(_tokens(spark, d), ["user_id"])
    joined = lambda df, c: df.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("x")))), lambda y: y["x"]), "" if c == "shown" else "|").alias(c))
    text = joined(opened.withColumn("shown", ordered.shown(opened)).where("shown is not null"), "shown")
    ready = joined(ordered.completed_fields(opened, ["user_id"]), "instruction")
    users = read(spark, d, "events").select("user_id").distinct().join(text, "user_id", "left").join(ready, "user_id", "left").fillna("", ["shown", "instruction"])
    return users.select("user_id", F.sha2("shown", 256).alias("text_sha256"), F.col("instruction").alias("instructions"))


@query(f"WITH {STACKS_SQL} SELECT user_id, event_id, len(done)::INT AS depth, list_contains(done, true) AS inside FROM s WHERE i > 0")
def open_fields(spark, d):
    """How many fields are open after each event, and whether a result has begun."""
    return ordered.open_fields(_tokens(spark, d), ["user_id"]).select("user_id", F.col("at").alias("event_id"), "depth", "inside")


@query(f"WITH {LINES_SQL} SELECT doc_id, min(CASE WHEN {NOT_BLANK.format('text')} THEN pos + 1 ELSE pos END)::INT AS cutoff FROM lines WHERE length(text) < 40 GROUP BY doc_id")
def tail_cutoff(spark, d):
    short = lines(spark, d).where(F.length("text") < 40)
    return ordered.tail_cutoff(short.select("doc_id", F.col("pos").alias("boundary"), (~T.not_blank(F.col("text"))).alias("empty")))


@query("SELECT max(CASE WHEN regexp_matches(x, '^[0-9]+$') THEN x::BIGINT ELSE 0 END) + 1 AS next_id FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'n' || p_partkey ELSE p_partkey::VARCHAR END AS x FROM part)")
def next_id(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return ordered.next_id(read(spark, d, "part").select(x.alias("x")), "x")


@query("SELECT c_nationkey, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n = 1")
def merged_cells(spark, d):
    return ordered.first_cells(read(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", ["c_custkey"]).select("c_nationkey", "c_custkey", "c_mktsegment")


@query("""
WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderkey % 3 AS chapter FROM orders)
SELECT doc_id, CASE WHEN count(DISTINCT chapter) = 1 THEN 'single_chapter' ELSE 'whole_book' END AS mode, arg_min(chapter, pos) AS chapter_start FROM h GROUP BY doc_id""")
def mode_from_chapters(spark, d):
    return inventory.chapter_mode(read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 3).alias("chapter")))


# -- rules, audits and updates

RULES = [
    ("r1", "ECONOMY", "font_size_pt", "1500.02"), ("r2", "ECONOMY", "font_name", "Brand#2"), ("r3", "STANDARD", "font_size_pt", "900"),
    ("r4", "PROMO", "font_name", "brand-5"), ("r5", "PROMO", "width_mm", "11.04"), ("r6", "LARGE", "bold", "true"), ("r7", "MEDIUM", "width_mm", "20"),
]
RULES_SQL = ", ".join(str(r) for r in RULES)


def _rules(spark):
    return spark.range(1).select(F.explode(F.array(*[F.struct(*map(F.lit, r)) for r in RULES])).alias("r")).select(*[F.col(f"r.col{i + 1}").alias(n) for i, n in enumerate(("rule_id", "target", "prop", "expected"))])


def _audit(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.col("p_type").alias("target"), F.col("p_retailprice").alias("font_size_pt"), F.col("p_brand").alias("font_name"), F.col("p_size").cast("double").alias("width_mm"), F.lit(None).cast("string").alias("bold"))
    return audit.failures(_rules(spark), audit.long_values(parts, ["p_partkey", "target"], ["font_size_pt", "font_name", "width_mm", "bold"]), "p_partkey")


AUDIT_SQL = f"""
WITH rules(rule_id, target, prop, expected) AS (VALUES {RULES_SQL}),
vals AS (SELECT p_partkey, p_type AS target, unnest(['font_size_pt', 'font_name', 'width_mm', 'bold']) AS prop, unnest([NULL, p_brand, NULL, NULL]) AS s, unnest([p_retailprice, NULL, p_size::DOUBLE, NULL]) AS n FROM part),
fails AS (SELECT p_partkey, rule_id, prop, expected FROM vals JOIN rules USING (target, prop) WHERE NOT coalesce(CASE WHEN prop = 'font_name' THEN lower(regexp_replace(s, '[\\s_-]+', '', 'g')) = lower(regexp_replace(expected, '[\\s_-]+', '', 'g'))
  WHEN prop = 'bold' THEN s = expected ELSE abs(n - expected::DOUBLE) <= greatest(0.05, 1e-9 * greatest(abs(n), abs(expected::DOUBLE))) END, false))
"""


@query(AUDIT_SQL.replace("expected::DOUBLE", "try_cast(expected AS DOUBLE)") + "SELECT * FROM fails")
def rule_cross_compare(spark, d):
    return _audit(spark, d).drop("actual")


@query(AUDIT_SQL.replace("expected::DOUBLE", "try_cast(expected AS DOUBLE)") + "SELECT rule_id, p_partkey, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY p_partkey) AS r FROM fails) WHERE r <= 10")
def topk_failures(spark, d):
    """The first ten failures of each rule: a report's limit."""
    return audit.first_failures(_audit(spark, d), ["rule_id"], ["p_partkey"]).select("rule_id", "p_partkey", F.col("place").cast("bigint").alias("place"))


@query("""
WITH s AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'header' ELSE 'footer' END AS kind, value > 95 AS payload, event_type = 'signup' AND value > 90 AS page_start, value < 0.05 AS title_page FROM events)
SELECT user_id, count(*) FILTER (kind = 'header') AS headers, count(*) FILTER (kind = 'footer') AS footers, bool_or(payload) AS payload, bool_or(page_start) AS page_start, bool_or(title_page) AS title_page,
  NOT (bool_or(payload) OR bool_or(page_start) OR bool_or(title_page)) AS safe FROM s GROUP BY user_id""")
def section_evidence(spark, d):
    value, kind = F.col("value"), F.col("event_type")
    s = read(spark, d, "events").select("user_id", F.when(kind.isin("click", "view"), "header").otherwise("footer").alias("kind"), (value > 95).alias("payload"), ((kind == "signup") & (value > 90)).alias("page_start"), (value < 0.05).alias("title_page"))
    return audit.section_evidence(s, ["user_id"])


@query("SELECT o_custkey, bool_and(o_totalprice > 20000) AS passed, count(*) FILTER (NOT (o_totalprice > 20000)) AS failed FROM orders GROUP BY o_custkey")
def verdict(spark, d):
    return audit.verdict(read(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 20000)


@query("SELECT coalesce(bool_and(o_totalprice > 0), true) AS passed FROM orders WHERE o_orderkey < 0")
def verdict_of_nothing(spark, d):
    return audit.overall(read(spark, d, "orders").where("o_orderkey < 0"), F.col("o_totalprice") > 0)


@query("""
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS tab, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE [0, 1] END AS header_rows FROM orders),
r AS (SELECT DISTINCT l_orderkey AS tab, l_linenumber - 1 AS row FROM lineitem),
x AS (SELECT doc_id, tab, unnest(CASE WHEN len(header_rows) = 0 THEN [NULL] ELSE header_rows END) AS row FROM t)
SELECT x.doc_id, x.tab AS "table", bool_and(r.row IS NOT NULL) AS repeats FROM x LEFT JOIN r ON x.tab = r.tab AND x.row = r.row GROUP BY x.doc_id, x.tab""")
def header_repeats(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table"))
    tables = orders.withColumn("header_rows", F.when(F.col("table") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1))))
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("table"), (F.col("l_linenumber") - 1).cast("int").alias("row")).distinct()
    return audit.header_repeats(items.join(orders, "table").select("doc_id", "table", "row", F.lit(True).alias("is_header")), tables)


@query("""
SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 4 = 0 THEN [0, 2, 3, 5] ELSE list_transform(list_filter([0, 2, 3, 5], lambda r: r <> p_partkey % 6), lambda r: CASE WHEN r > p_partkey % 6 THEN r - 1 ELSE r END) END, ',') AS rows FROM part""")
def index_shift(spark, d):
    gone = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 6).cast("int")
    rows = binding.shifted_rows(F.array(*[F.lit(i) for i in (0, 2, 3, 5)]), gone)
    return read(spark, d, "part").select("p_partkey", F.array_join(rows.cast("array<string>"), ",").alias("rows"))


@query("""
WITH docs AS (SELECT doc_id, lang, n_chars FROM documents)
SELECT doc_id, 'style' AS origin, 'lang' AS prop FROM docs WHERE lang <> 'en' UNION ALL SELECT doc_id, 'paragraph', 'n_chars' FROM docs WHERE n_chars > 2000
UNION ALL SELECT doc_id, 'document', 'source' FROM documents WHERE source = 'src0'""")
def audit_union(spark, d):
    docs = read(spark, d, "documents")
    part = lambda origin, prop, bad: docs.where(bad).select("doc_id", F.lit(origin).alias("origin"), F.lit(prop).alias("prop"))
    return part("style", "lang", F.col("lang") != "en").unionByName(part("paragraph", "n_chars", F.col("n_chars") > 2000)).unionByName(part("document", "source", F.col("source") == "src0"))
