"""Operator 3: mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source has a target number of words; each of its documents expects ``target / source size``
copies. Within a source the expected copies are prefix-summed, one offset is added, and a document is
taken once for each integer that its interval crosses.

Scale: the prefix sum has two levels. A source is dealt by a hash of doc_id into buckets of about
``ROWS_PER_BUCKET`` rows, so that a source with a third of all rows is many tasks; the sums of the
buckets, a few numbers a source, are prefix-summed next. Within a bucket documents stand by size, so
that systematic sampling takes each size in its proportion and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import free_name, kept, small_or_none, table

#: A document's copies stop at this many times its own.
MOST_COPIES = 3
#: Expected copies are integers in this unit, so that their sums are exact in any order.
UNIT = 1 << 24
ROWS_PER_BUCKET = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def _hash31(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> weight, target. Weights 1, 2, 3 repeat over sources by code point, null last.

    A target stops at MOST_COPIES times the source's size and the excess is shared by weight among the
    rest: with the sources in order of the share at which each stops, all up to some point stop and the
    others get the same share a weight. One row a source; no row of a document comes here.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    limits = (
        sizes.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1)
        .withColumn("most", MOST_COPIES * F.col("source_size"))
        .withColumn("stop", F.col("most") / F.col("weight"))
    )
    order = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    # the first source in this order that does not stop fixes the share; from there on ``share`` only falls
    open_share = F.max(F.when(F.col("share") <= F.col("stop"), F.col("share"))).over(every)
    return (
        limits.withColumn("share", share)
        .withColumn("level", open_share)
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("stop") < F.col("level")), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.col("target").cast("double").alias("target"))
    )


def sampled_copies(docs: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """docs(doc_id, source, size, ...), targets(source, source_size, target) -> docs with taken words and copies."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"))
    rates = (
        targets.join(counts, targets.source.eqNullSafe(counts.source)).drop(counts.source)
        .withColumn("expected", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
        .withColumn("offset", _hash31(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))) % UNIT)
        .withColumn("buckets", F.ceil(F.col("source_rows") / ROWS_PER_BUCKET).cast("long"))
        .withColumnRenamed("source", "rate_source")
    )
    joined = docs.join(small_or_none(rates), docs.source.eqNullSafe(F.col("rate_source"))).drop("rate_source")
    joined = joined.withColumn("bucket", _hash31(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % F.col("buckets"))
    of_bucket = joined.groupBy("source", "bucket").agg(F.sum("expected").alias("bucket_sum"))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_bucket.select(
        F.col("source").alias("start_source"), F.col("bucket").alias("start_bucket"), F.coalesce(F.sum("bucket_sum").over(by_source), F.lit(0)).alias("bucket_start")
    )
    joined = joined.join(small_or_none(starts), joined.source.eqNullSafe(F.col("start_source")) & (joined.bucket == F.col("start_bucket")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("bucket_start") + F.sum("expected").over(in_bucket) + F.col("offset")
    crossed = F.expr(f"end div {UNIT}") - F.expr(f"(end - expected) div {UNIT}")
    return joined.withColumn("end", end).withColumn("copies", crossed).select(
        *docs.columns, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs(doc_id, source, text, ...) -> doc_id, source, size, text_hash, source_size, target, copies, taken.

    One pass of global windows over a row a source sets the targets; documents are dealt by hashes of their
    doc_ids, null ones as the empty text. A null text has size 0; texts of any length are counted whole; a null source is a source of its own, the last; a source without words has
    target 0 and gives nothing; equal doc_ids are rows of their own. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = kept(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sampled_copies(sized, kept(source_targets(sizes)), seed)


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of docs, with all their columns of any names, each as often as the mix takes it.

    Rows equal in doc_id and text stand for one another: what the mix takes of them is taken of one. Nulls,
    empty texts and empty tables as in mix().
    """
    id_, hash_, copies_, rows_, copy_ = (free_name(docs, x) for x in ("mix_id", "mix_hash", "mix_copies", "mix_rows", "mix_copy"))
    copies = mix(docs, seed).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias(copies_), F.count(F.lit(1)).alias(rows_))
    copies = kept(copies.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), copies_, rows_).where(F.col(copies_) > 0))
    own = free_name(docs, "own_hash")
    hashed = docs.withColumn(own, F.xxhash64("text"))
    # copies has a row for about every document, so it is never a side to broadcast
    taken = hashed.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_)))
    if not copies.where(F.col(rows_) > 1).isEmpty():  # equal rows: one of them stands for all
        taken = taken.where(F.col(rows_) == 1).unionByName(taken.where(F.col(rows_) > 1).dropDuplicates(["doc_id", own]))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies_))).alias(copy_)).drop(copy_)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


OP3_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sized GROUP BY source),
limits AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, {MOST_COPIES} * source_size AS most FROM sizes),
stops AS (SELECT *, most / weight AS stop FROM limits),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY stop, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM stops),
levels AS (SELECT *, max(CASE WHEN share <= stop THEN share END) OVER () AS level FROM shares),
targets AS (
  SELECT *, CASE WHEN level IS NULL OR stop < level THEN most::DOUBLE ELSE level * weight END AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * {UNIT}) ELSE 0 END::BIGINT AS expected,
    ('0x' || substr(md5('mix:' || coalesce('s' || source, 'null')), 1, 7))::BIGINT % {UNIT} AS start,
    ceil(source_rows / {ROWS_PER_BUCKET})::BIGINT AS buckets FROM targets),
dealt AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.expected, r.start,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 7))::BIGINT % r.buckets AS bucket
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
summed AS (
  SELECT *, start + sum(expected) OVER (PARTITION BY source ORDER BY bucket, size, doc_id ROWS UNBOUNDED PRECEDING) AS until FROM dealt),
taken AS (SELECT *, ((until // {UNIT}) - ((until - expected) // {UNIT}))::BIGINT AS copies FROM summed)
SELECT doc_id, source, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM taken
"""
