import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import authority, mapped, profiles, structure
from docloom.plans import apply, audit, inspect
from docloom.sources import docx, rules, word
from docloom.streaming import arrivals
from test_docx import FIELD, package


def test_candidates(spark):
    texts = ["第1章 A", "1.1 B", "1.3 C", "图 1.1-1 梁", "body", " "]
    p = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(texts)], "doc_id int, pos int, text string, style string")
    c = inspect.candidates(p)
    assert sorted((r.pos, r.role) for r in c["roles"].collect()) == [(0, "heading_1"), (1, "heading_2"), (2, "heading_2"), (3, "figure_caption"), (4, "unknown")]
    assert [(r.pos, r.kind, r.expected_last) for r in c["anomalies"].collect()] == [(2, "sequence_gap", 2)]
    assert c["modes"].collect()[0]["mode"] == "single_chapter" and not any(r.approved for r in c["captions"].collect())
    moved = p.where("pos <> 2").unionByName(p.where("pos = 2").withColumn("text", F.lit("1.2 C")))
    assert {r.pos: r.status for r in inspect.bound(c["headings"], moved).collect()} == {0: "ok", 1: "ok", 2: "mismatch"}


def test_inventory_and_verdicts(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(FIELD, word__media__x_dot_png=b"1"))
    (tmp_path / "b.docx").write_bytes(package("<w:p/>"))
    files = docx.packages(spark, str(tmp_path))
    got = inspect.inventory_of(files)
    assert [r.name for r in got["unresolved"].collect()] == ["there"] and got["fingerprints"].count() == 2
    assert [(r.fields, r.sequences) for r in got["sequences"].collect()] == [(2, "")] and got["headings"].count() == got["sections"].count() == got["tables"].count() == 0
    kept = inspect.inventory_of(files, keep=lambda df: df.cache())
    assert sorted(map(tuple, kept["counts"].collect())) == sorted(map(tuple, got["counts"].collect()))
    text, objects = docx.paragraphs(files), got["objects"]
    none = spark.createDataFrame([], "doc_id string, rule_id string")
    assert all(r.passed for r in audit.verdicts(text, text, objects, objects, none).collect())
    worse = audit.verdicts(text, text.withColumn("text", F.concat("text", F.lit("!"))), objects, objects.where("kind <> 'media'"), none).collect()
    assert sorted((r.content, r.objects, r.passed) for r in worse) == [(False, False, False), (False, True, False)]


def test_checked_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id int, h string")
    audit.write_checked(df, f"{tmp_path}/out", "doc_id", "h")
    with pytest.raises(Exception, match="(?i)exists"):
        audit.write_checked(df, f"{tmp_path}/out", "doc_id", "h")
    audit.write_checked(df, f"{tmp_path}/out", "doc_id", "h", overwrite=True)
    blocks = audit.preflight(spark.createDataFrame([(1, 0), (2, 1)], "doc_id int, unresolved int"), spark.createDataFrame([(1, 0, 1, None)], "doc_id int, formula_images int, legacy int, policy string"))
    assert sorted(map(tuple, blocks.collect())) == [(1, "legacy_equations"), (2, "unresolved_references")]
    r = audit.report(spark.createDataFrame([(1, "r1", "r1: bold=true", 2)], "doc_id int, id string, summary string, targets int"), spark.createDataFrame([], "doc_id int, rule_id string, prop string"), spark.createDataFrame([(1, "x")], "doc_id int, name string"))
    assert r.first()["report"] == "# Format report\n\n## Rules\n\n- r1: bold=true (2 targets)\n\n## Failures\n\nNone.\n\n## Unresolved references\n\n- x"
    more = spark.createDataFrame([(1, "m2"), (1, "m1")], "doc_id int, name string")
    none = spark.createDataFrame([], "doc_id int, rule_id string, prop string")
    r = audit.report(spark.createDataFrame([(1, "r1", "s", 2)], "doc_id int, id string, summary string, targets int"), none, more.where("false"), manual_items=more)
    assert r.first()["report"].endswith("\n\n## Unresolved references\n\nNone.\n\n## Manual items\n\n- m1\n- m2")


def test_profiles_and_maps_from_json(spark, tmp_path):
    profile = {"schema_version": "1.1", "profile_id": "p", "runtime_policy": {"caller_requirements_highest": True, "editable_equations_required": True, "formula_image_policy": "keep"}, "source_precedence": ["user_requirement"],
               "sources": [{"id": "s"}], "rules": [{"id": "r", "selector": {"kind": "caption_role", "value": "all"}, "properties": {"numbering_mode": "manual_text", "allow_automatic_renumbering": True, "font_size_pt": 9.5}, "source_ids": ["s"], "status": "draft", "application": "automatic"}],
               "conflicts": [], "open_questions": [{"id": "q", "blocking": True}], "approval": {"status": "approved", "approved_by": "A", "approved_at": "2020"}}
    (tmp_path / "p.json").write_text(json.dumps(profile))
    t = rules.profiles(spark, str(tmp_path / "p.json"))
    assert {(r.key, r.value) for r in t["rule_props"].collect()} == {("numbering_mode", "manual_text"), ("allow_automatic_renumbering", "true"), ("font_size_pt", "9.5")}
    assert [r.violation for r in profiles.policy_violations(t["profiles"]).collect()] == ["formula_images_not_blocked"]
    assert [r.violation for r in profiles.caption_rule_violations(t["rules"], t["rule_props"]).collect()] == ["renumbers_manual_text:r"]
    assert sorted(r.violation for r in profiles.approval_violations(t["profiles"], t["conflicts"], t["questions"], t["rules"]).collect()) == ["draft_rule:r", "unanswered_question:q"]
    good = {"schema_version": "1.2", "status": "approved", "captions": [{"approved": True, "action": "preserve", "numbering_mode": "manual_text", "identifier_semantics": "unknown", "domain_context": "mixed", "domain_confidence": "low"}]}
    bad = {"schema_version": "1.2", "status": "draft", "captions": [good["captions"][0] | {"action": "move_caption"}], "numbering": {"approved": True, "chapter_start": 0, "anomalies": [{"kind": "x"}]}}
    for name, value in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.map").write_text(json.dumps(value))
    found = profiles.map_violations(rules.maps(spark, str(tmp_path / "*.map"))).collect()
    assert {r.map_id.rsplit("/", 1)[-1] for r in found} == {"bad.map"} and [r.violation for r in found] == ["not_approved", "move_incomplete", "chapter_start", "open_anomalies"]
    (tmp_path / "x.json").write_text("{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        rules.profiles(spark, str(tmp_path / "x.json"))["rules"].collect()


def test_packages_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.docx").write_bytes(package(FIELD))
        q = arrivals.write_each(arrivals.arrivals(spark, f"{tmp_path}/in"), docx.paragraphs, f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_outputs_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1"))], "doc_id string, content binary")
    reports = spark.createDataFrame([("a", "# r")], "doc_id string, report string")
    paths = audit.write_outputs(f"file://{tmp_path}/o", df, df, reports)
    assert sorted(paths) == ["format-report", "formatted", "review"] and spark.read.parquet(paths["format-report"]).first().report == "# r"
    with pytest.raises(FileExistsError):
        audit.write_outputs(f"file://{tmp_path}/o", df, df, reports)
    assert audit.write_outputs(f"file://{tmp_path}/o", df, df, reports, overwrite=True) == paths


def test_inspect_apply_and_audit_a_package(spark):
    """A package is inspected, its candidates approved, the map applied and the result audited."""
    texts = [("目录", None), ("1.1 old entry", None), ("第1章 总则", None), ("1.1 范围", None), ("正文。", None), ("图 1.1-1 梁", None)]
    rows = [("a", i, t, s) for i, (t, s) in enumerate(texts)]
    p = spark.createDataFrame(rows, "doc_id string, seq int, text string, style string")
    files = word.packed(p.select("doc_id", "seq", word.paragraph_xml(F.col("text"), F.col("style")).alias("xml")))
    read = word.paragraphs(docx.nodes(files)).select("doc_id", F.col("paragraph").alias("pos"), "text", F.coalesce("style_id", F.lit("Normal")).alias("style")).cache()
    found = inspect.candidates(read)
    spot = mapped.body_spot(F.col("pos")).alias("spot")
    headings = found["headings"].where("pos > 1").select("doc_id", spot, "level", "text_sha256")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    captions = found["captions"].select(
        "doc_id", spot, F.lit(0).alias("ord"), F.lit("1.2").alias("version"), F.lit("replace_identifier").alias("action"), "text_sha256", F.lit(False).alias("migrate_outside_table"), F.col("identifier_start").alias("start"),
        F.col("identifier_stop").alias("stop"), "identifier_sha256", "identifier_prefix_sha256", "identifier_suffix_sha256", F.lit("1.1-9").alias("replacement_identifier"), *none("string", "label", "sequence_name", "cached_hierarchy", "cached_sequence"), *none("int", "heading_level"),
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    paragraphs = read.select("doc_id", F.col("pos").alias("place"), spot, "text", "style")
    document = {
        "paragraphs": paragraphs, "rows": empty("doc_id string, table int, row int, is_header boolean, cant_split boolean, cells int"),
        "tables": empty("doc_id string, table int, place int, rows int, table_text_sha256 string, first_row_sha256 string"),
    }
    hashes = [hashlib.sha256(t.encode()).hexdigest() for t in ("目录", "1.1 old entry")]
    tables = "doc_id string, semantic boolean, table int, kind string, table_text_sha256 string, first_row_sha256 string, repeat_header_rows array<int>, repeat_header boolean, prevent_normal_row_split boolean, caption_row int"
    approved = {"toc": spark.createDataFrame([("a", 0, 0, 1, hashes, None)], "doc_id string, ord int, first int, last int, hashes array<string>, levels int"), "headings": headings, "captions": captions, "tables": empty(tables)}
    result, changes, faults = apply.apply_map(document, approved)
    after = result["paragraphs"].select("doc_id", F.col("place").alias("pos"), "text", "style")
    assert [tuple(r) for r in after.orderBy("pos").collect()] == [
        ("a", 0, "", "Normal"), ("a", 1, "", "Normal"), ("a", 2, "第1章 总则", "Heading 1"), ("a", 3, "1.1 范围", "Heading 2"), ("a", 4, "正文。", "Normal"), ("a", 5, "图 1.1-9 梁", "Normal"),
    ]
    assert [(r.place, r.instruction) for r in result["fields"].collect()] == [(0, 'TOC \\o "1-4" \\h \\z \\u')] and faults.count() == 0
    assert [(r.step, r.kind, r.targets) for r in changes.orderBy("step").collect()] == [(0, "toc", 2), (1, "headings", 2), (3, "captions", 1)]
    entries = found["captions"].select("doc_id", "pos", F.col("identifier_start").alias("start"), F.col("identifier_stop").alias("stop"), F.lit(8).alias("title_start"), "text_sha256", "identifier_sha256", "title_text_sha256", F.lit("1.1-9").alias("replacement"))
    (r,) = structure.replacement_audit(read, after, entries, ["doc_id", "pos"]).collect()
    assert r.passed
    rules = spark.createDataFrame([("a", "r", "Heading 1"), ("a", "q", "Missing")], "doc_id string, rule_id string, style string")
    styles = spark.createDataFrame([("a", "Heading 1", "bold", "true")], "doc_id string, style string, key string, value string")
    props = spark.createDataFrame([("r", "bold", "true"), ("q", "bold", "true")], "rule_id string, key string, value string")
    assert [(x.rule_id, x.prop, x.actual) for x in authority.style_failures(rules, props, styles).collect()] == [("q", "*", "missing style")]
