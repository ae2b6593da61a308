"""Rule profiles and structure maps (JSON) as relations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def schema_path() -> str:
    """Where the schema of rule profiles lies, as text."""
    return os.path.join(os.path.dirname(__file__), "profile.ddl")


with open(schema_path(), encoding="utf-8") as _file:
    PROFILE = _file.read()
LOCATOR = "struct<kind:string,table:int,row:int,cell:int,paragraph:int>"
EVIDENCE = """struct<header_reference_count:int,footer_reference_count:int,header_footer_has_payload:boolean,page_number_start:string,different_first_page:boolean,section_type:string,
  has_page_geometry:boolean,empty_header_footer_references:boolean,safe_to_delete:boolean>"""
#: The fields of structure maps as they are written (fixed values: their names and kinds), of all their versions.
MAP = f"""
schema_version string, status string, source_content_fingerprint_sha256 string, conflicts array<string>,
paragraph_roles array<struct<locator:{LOCATOR},text_sha256:string,role:string,source_style:string,direct_format_sha256:string,approved:boolean>>,
headings array<struct<paragraph:int,locator:{LOCATOR},level:int,cached_number:array<int>,text_sha256:string,approved:boolean>>,
captions array<struct<paragraph:int,locator:{LOCATOR},text_sha256:string,label:string,sequence_name:string,numbering_mode:string,identifier_semantics:string,domain_context:string,domain_confidence:string,action:string,completeness:string,
  hierarchy_status:string,heading_level:int,cached_hierarchy:string,cached_sequence:string,identifier_span:struct<start:int,end:int>,identifier_sha256:string,identifier_prefix_sha256:string,identifier_suffix_sha256:string,
  title_text_sha256:string,title_span_start:int,replacement_identifier:string,replacement_confirmed:boolean,migrate_outside_table:boolean,approved:boolean>>,
tables array<struct<table:int,kind:string,table_text_sha256:string,first_row_sha256:string,caption_row:int,header_rows:array<int>,repeat_header_rows:array<int>,repeat_header:boolean,prevent_normal_row_split:boolean,approved:boolean>>,
toc_ranges array<struct<start_paragraph:int,end_paragraph:int,paragraph_sha256:array<string>,levels:int,approved:boolean>>,
trailing_empty_sections array<struct<section:int,previous_boundary_paragraph:int,previous_boundary_sha256:string,approved_delete:boolean,confidence:string,evidence:{EVIDENCE}>>,
numbering struct<mode:string,chapter_start:int,heading_levels:int,expected_progression:string,approved:boolean,anomalies:array<struct<kind:string,status:string>>>"""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; a file that is no such document fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def profiles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """profiles, sources, rules, rule_props, conflicts and questions, each keyed by profile_id."""
    whole = _read(spark, path, PROFILE)
    each = lambda column: whole.select("profile_id", F.posexplode(column).alias("ord", "x")).select("profile_id", "ord", "x.*")
    rules = each("rules").withColumns({"selector_kind": F.col("selector.kind"), "selector_value": F.col("selector.value")}).drop("selector")
    return {
        "profiles": whole.select("profile_id", "schema_version", "name", "locale", "source_precedence", "runtime_policy", F.col("approval.status").alias("approval_status"), "approval.approved_by", "approval.approved_at"),
        "sources": each("sources"),
        "rules": rules.drop("properties"),
        "rule_props": rules.select("profile_id", F.col("id").alias("rule_id"), F.explode("properties").alias("key", "value")),
        "conflicts": each("conflicts"),
        "questions": each("open_questions"),
    }


def maps(spark: SparkSession, path: str) -> DataFrame:
    """One row a structure map, keyed by map_id (the file)."""
    return _read(spark, path, MAP).withColumn("map_id", F.input_file_name())
