"""Audit of two versions of a collection, and checked writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import inventory


def fingerprints(paragraphs: DataFrame) -> DataFrame:
    return inventory.ordered_hash(paragraphs, ["doc_id"], ["part", "pos"], F.col("text"), "fingerprint")


def verdicts(before: DataFrame, after: DataFrame, objects_before: DataFrame, objects_after: DataFrame, failures: DataFrame) -> DataFrame:
    """Paragraphs and objects of both versions, failures(doc_id, ...) of rules -> doc_id, content, objects, rules, passed.

    Objects compare as multisets of (kind, name, hash); formulas have no name.
    """
    a, b = fingerprints(before), fingerprints(after).withColumnRenamed("fingerprint", "new")
    text = a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce(F.col("fingerprint") == F.col("new"), F.lit(False)).alias("content"))
    named = lambda df: df.select("doc_id", "kind", F.when(F.col("kind") != "omml", F.col("name")).alias("name"), "sha256")
    x, y = named(objects_before), named(objects_after)
    changed = x.exceptAll(y).union(y.exceptAll(x)).select("doc_id").distinct().withColumn("lost", F.lit(True))
    failed = failures.select("doc_id").distinct().withColumn("bad", F.lit(True))
    out = text.join(changed, "doc_id", "left").join(failed, "doc_id", "left")
    objects, rules = F.col("lost").isNull(), F.col("bad").isNull()
    return out.select("doc_id", "content", objects.alias("objects"), rules.alias("rules"), (F.col("content") & objects & rules).alias("passed"))


def preflight(references: DataFrame, equations: DataFrame) -> DataFrame:
    """references(doc_id, unresolved), equations(doc_id, formula_images, legacy, policy) -> doc_id, block: what keeps a document from being changed."""
    legacy = (F.col("legacy") > 0) & (F.coalesce("policy", F.lit("qa")) == "qa")
    blocked = F.when(F.col("unresolved") > 0, "unresolved_references").when(F.col("formula_images") > 0, "formula_images").when(legacy, "legacy_equations")
    joined = references.join(equations, "doc_id", "full_outer").fillna(0, ["unresolved", "formula_images", "legacy"])
    return joined.select("doc_id", blocked.alias("block")).where("block is not null")


def write_checked(df: DataFrame, path: str, key: str, digest: str, overwrite: bool = False) -> None:
    """Write, read back and compare; what does not agree is deleted. An existing output is an error unless ``overwrite``.

    The comparison joins the digests of both sides; none is gathered.
    """
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    spark = df.sparkSession
    back = spark.read.parquet(path).select(key, F.col(digest).alias("written"))
    differs = df.select(key, digest).join(back, key, "full_outer").where(~F.col(digest).eqNullSafe(F.col("written")))
    if not differs.isEmpty():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        raise ValueError(f"{path} does not hold what was written")


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a line, its keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_outputs(folder: str, formatted: DataFrame, review: DataFrame, reports: DataFrame, overwrite: bool = False) -> dict[str, str]:
    """The three results of a run below ``folder``: formatted and reviewed packages (doc_id, content) and reports (doc_id, report), each checked
    after it is written. -> their paths by name. None is written if one of them is there and may not be overwritten."""
    spark = formatted.sparkSession
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in ("formatted", "review", "format-report")}
    for path in paths.values():
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not overwrite and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            raise FileExistsError(path)
    for (path, df, what) in zip(paths.values(), (formatted, review, reports), ("content", "content", "report"), strict=True):
        write_checked(df.withColumn("sha256", F.sha2(F.col(what).cast("binary"), 256)), path, "doc_id", "sha256", overwrite)
    return paths


def report(rules: DataFrame, failures: DataFrame, unresolved: DataFrame, **more: DataFrame) -> DataFrame:
    """rules(doc_id, id, summary, targets), failures(doc_id, rule_id, prop), unresolved(doc_id, name) -> doc_id, report: Markdown of a document.

    ``more``: further sections by name, such as manual items or anchors that were not found, each (doc_id, name).
    """
    line = lambda df, order, text: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    a = line(rules, "id", F.concat(F.lit("- "), "summary", F.lit(" ("), F.col("targets").cast("string"), F.lit(" targets)"))).withColumnRenamed("t", "rules")
    b = line(failures, "rule_id", F.concat(F.lit("- "), "rule_id", F.lit(": "), "prop")).withColumnRenamed("t", "failures")
    c = line(unresolved, "name", F.concat(F.lit("- "), "name")).withColumnRenamed("t", "unresolved")
    part = lambda title, column: F.concat(F.lit(f"## {title}\n\n"), F.coalesce(column, F.lit("None.")))
    joined = a.join(b, "doc_id", "full_outer").join(c, "doc_id", "full_outer")
    for name, df in more.items():
        joined = joined.join(line(df, "name", F.concat(F.lit("- "), "name")).withColumnRenamed("t", name), "doc_id", "full_outer")
    parts = [part("Rules", F.col("rules")), part("Failures", F.col("failures")), part("Unresolved references", F.col("unresolved"))]
    parts += [part(name.replace("_", " ").capitalize(), F.col(name)) for name in more]
    return joined.select("doc_id", F.concat_ws("\n\n", F.lit("# Format report"), *parts).alias("report"))
