"""Operator 13: a Merkle manifest of a dataset, by a monoid of sparse forests.

Leaves are digests of rows, made by Spark's own functions; no text moves. They are put in order by ranges, and from a row a
partition the driver knows the place of each leaf in the tree of its source and the size of every tree, so the number of
siblings of every run is known before any is made.

A fragment of the forest is the set of its unresolved nodes, keyed by tree, level and index; fragments merge in any
grouping: as soon as all siblings of a run are there, they become their parent, and the root of a source's tree becomes a
leaf of the tree of all sources. A task folds its range of leaves to a fragment of at most two runs a level and source
that it does not hold whole. Fragments are reduced as a tree, FAN at a time, in rounds that also write the runs that they
complete; RDD.treeReduce would send these to the driver. The last fragment is the root.

Proofs go down again: each run joins the one above it, sixteenth by sixteenth, and the runs of leaves join their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import forget, kept, small_or_none, table

#: Siblings of a run, fragments that merge at once, and the tree of all sources beside those of each, which are 0 and up.
ARITY, FAN, TOP = 16, 16, -1
#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a leaf is tampered with: those whose crc32 this divides.
TAMPERED = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runs that are broadcast to those below them, at most; each has some kilobytes with its path.
SMALL_RUNS = 2_000

NODE, RUN, ROOT = 0, 1, 2
FOREST = pa.schema([("fragment", pa.int64()), ("kind", pa.int32()), ("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digests", pa.binary())])
FOREST_DDL = "fragment long, kind int, tree long, size long, level int, index long, digests binary"


def field(value: Column) -> Column:
    """The bytes' number, a colon and the value as text; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, source, leaf, tampered: the digests of each row and of the row as tampered with, null if it is not."""
    columns = {c: F.col(c) for c in FIELDS}
    lowered = columns | {"text": F.translate("text", UPPER, LOWER)}
    whole, other = (F.unhex(F.sha2(F.concat(*(field(x) for x in values.values())).cast("binary"), 256)) for values in (columns, lowered))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select("doc_id", "source", whole.alias("leaf"), F.when(hit, other).alias("tampered"))


def located(found: DataFrame) -> DataFrame:
    """leaves() -> doc_id, leaf, tampered, tree, size, index, place: the number of the source in its order, the leaves of the
    source, the leaf's place among them, and a number that is in order over all rows.

    Rows equal in source and doc_id go by their leaf, and the same rows by where they were read, so ties are spread too.
    """
    order = ["source", "doc_id", "leaf", "row"]
    numbered = kept(found.withColumn("row", F.monotonically_increasing_id()))
    ordered = kept(numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id()))
    forget(numbered)
    part = F.shiftright("place", 33)
    runs = kept(ordered.groupBy(part.alias("part"), F.col("source").alias("of")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    # a row a partition: how many sources it holds, and its share of the first and the last of them
    ends = runs.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("of", "n")).alias("low"), F.max(F.struct("of", "n")).alias("high")).sort("part").collect()
    before, sizes = {}, {}
    tree, seen, last = -1, 0, None
    for x in ends:
        goes_on = last is not None and last == (x.low.of,)
        tree += not goes_on
        before[x.part] = (tree, seen if goes_on else 0)
        tree += x.k - 1
        seen = x.high.n + (seen if goes_on and x.k == 1 else 0)
        last = (x.high.of,)
        sizes[tree] = seen
        if x.k > 1:  # a source that ends here
            sizes[before[x.part][0]] = before[x.part][1] + x.low.n
    at = found.sparkSession.createDataFrame([(p, t, n, sizes[t], sizes[t + x.k - 1], x.k) for (p, (t, n)), x in zip(before.items(), ends, strict=True)], "part long, tree0 long, before long, size0 long, size1 long, k long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("of").asc_nulls_first())) - 1
    runs = runs.join(F.broadcast(at), "part").withColumn("nth", rank)  # at: a row a partition
    inside = kept(runs.select(
        F.col("part").alias("of_part"), "of", (F.col("tree0") + F.col("nth")).alias("tree"),
        F.when(F.col("nth") == 0, F.col("size0")).when(F.col("nth") == F.col("k") - 1, F.col("size1")).otherwise(F.col("n")).alias("size"),
        (F.when(F.col("nth") == 0, F.col("before")).otherwise(0) - F.col("first")).alias("shift"),
    ))
    rows = ordered.withColumn("of_part", part).join(small_or_none(inside).withColumnRenamed("of_part", "p"), (F.col("of_part") == F.col("p")) & ordered.source.eqNullSafe(F.col("of")))
    return rows.select("doc_id", "leaf", "tampered", "tree", "size", (F.col("place") + F.col("shift")).alias("index"), "place")


def _digest(children: bytes) -> bytes:
    """The parent of children given as raw digests: H takes them as hex."""
    return hashlib.sha256(children.hex().encode()).digest()


class Forest:
    """Unresolved nodes. A fragment plus a fragment is the fragment of both; the order in which they come doesn't matter."""

    def __init__(self, trees: int):
        self.trees = trees
        self.open: dict[tuple[int, int, int, int], dict[int, bytes]] = {}
        self.done: list[tuple[int, int, int, int, bytes]] = []
        self.root: bytes | None = None

    def put(self, tree: int, size: int, level: int, index: int, digest: bytes) -> None:
        """A node of a tree of ``size`` leaves; a run that it completes becomes its parent."""
        while True:
            nodes = -(-size // ARITY**level)
            if nodes == 1:
                if tree == TOP:
                    self.root = digest
                    return
                tree, size, level, index = TOP, self.trees, 0, tree
                continue
            run, at = divmod(index, ARITY)
            held = self.open.setdefault((tree, size, level, run), {})
            held[at] = digest
            if len(held) < min(ARITY, nodes - ARITY * run):
                return
            del self.open[tree, size, level, run]
            index, digest = run, self.resolve(tree, size, level, run, b"".join(held[i] for i in range(len(held))))
            level += 1

    def resolve(self, tree: int, size: int, level: int, run: int, children: bytes) -> bytes:
        self.done.append((tree, size, level, run, children))
        return _digest(children)

    def rows(self, fragment: int, last: bool) -> Iterator[pa.RecordBatch]:
        """The runs made since the last call, and at the end the nodes that are left."""
        out = [(fragment, RUN, *x) for x in self.done]
        self.done = []
        if last:
            out += [(fragment, NODE, tree, size, level, run * ARITY + i, digest) for (tree, size, level, run), held in self.open.items() for i, digest in held.items()]
            out += [(fragment, ROOT, TOP, self.trees, 0, 0, self.root)] if self.root else []
        for i in range(0, len(out), 5_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[i : i + 5_000], strict=True), FOREST, strict=True)], schema=FOREST)


def _folded(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Leaves in their order -> the fragment of the task."""
    forest, fragment = Forest(trees), TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, size, index = (batch.column(c).to_numpy() for c in ("tree", "size", "index"))
        leaf = batch.column("leaf").to_pylist()
        run = index // ARITY
        at = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (tree[1:] != tree[:-1])])
        for a, b in pairwise([*at.tolist(), len(run)]):
            t, n, r = int(tree[a]), int(size[a]), int(run[a])
            if n > 1 and b - a == min(ARITY, n - ARITY * r):  # a whole run
                forest.put(t, n, 1, r, forest.resolve(t, n, 0, r, b"".join(leaf[a:b])))
            else:
                for i in range(a, b):
                    forest.put(t, n, 0, int(index[i]), leaf[i])
        yield from forest.rows(fragment, False)
    yield from forest.rows(fragment, True)


def _merged(group: pa.Table, trees: int) -> pa.Table:
    """The sum of some fragments."""
    forest = Forest(trees)
    for tree, size, level, index, digest in zip(*(group.column(c).to_pylist() for c in FOREST.names[2:]), strict=True):
        forest.put(tree, size, level, index, digest)
    return pa.Table.from_batches(list(forest.rows(group.column("fragment")[0].as_py(), True)), FOREST)


def forest(rows: DataFrame, trees: int) -> tuple[DataFrame, bytes]:
    """located() of ``trees`` sources -> all runs of all trees (tree, size, level, index, digests), and the root."""
    ordered = rows.select("tree", "size", "index", "leaf", "place").repartitionByRange("place").sortWithinPartitions("place").drop("place")
    made = kept(ordered.mapInArrow(partial(_folded, trees=trees), FOREST_DDL))
    runs = [made]
    while not (root := made.where(f"kind = {ROOT}").select("digests").head(1)):
        nodes = made.where(f"kind = {NODE}").withColumn("fragment", F.expr(f"fragment div {FAN}"))
        made = kept(nodes.groupBy("fragment").applyInArrow(lambda group: _merged(group, trees), FOREST_DDL))
        runs.append(made)
    every = [x.where(f"kind = {RUN}").select("tree", "size", "level", "index", "digests") for x in runs]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out, bytes(root[0].digests)


def _above(runs: DataFrame) -> DataFrame:
    """All runs -> for those of leaves of sources and of the tree of sources: tree, index, digests, path, the runs above
    with the place in each of them."""
    spark = runs.sparkSession
    levels = {r.top: r.n for r in runs.groupBy((F.col("tree") == TOP).alias("top")).agg(F.max("level").alias("n")).collect()}
    nothing = "array<struct<at:int,digests:binary>>"

    def stepped(here: DataFrame, above: DataFrame) -> DataFrame:
        """here(tree, index, digests, up_tree, up_index, at) under above(tree, index, digests, path)."""
        up = small_or_none(above, SMALL_RUNS).select(F.col("tree").alias("t"), F.col("index").alias("i"), F.col("digests").alias("d"), "path")
        path = F.when(F.col("d").isNotNull(), F.concat(F.array(F.struct(F.col("at").cast("int").alias("at"), F.col("d").alias("digests"))), "path")).otherwise(F.array().cast(nothing))
        return here.join(up, (F.col("up_tree") == F.col("t")) & (F.col("up_index") == F.col("i")), "left").select("tree", "index", "digests", path.cast(nothing).alias("path"))

    above = spark.createDataFrame([], f"tree long, index long, digests binary, path {nothing}")
    for level in range(levels.get(True, -1), -1, -1):
        here = runs.where((F.col("tree") == TOP) & (F.col("level") == level)).withColumns({"up_tree": F.lit(TOP).cast("long"), "up_index": F.expr(f"index div {ARITY}"), "at": F.col("index") % ARITY})
        above = kept(stepped(here, above))
    top, level = above, levels.get(False, -1)
    while level >= 0:
        here = runs.where((F.col("tree") != TOP) & (F.col("level") == level))
        alone = F.col("size") <= ARITY ** (level + 1)  # the one run of its level: the tree's root is above it
        up = {"up_tree": F.when(alone, TOP).otherwise(F.col("tree")).cast("long"), "up_index": F.when(alone, F.expr(f"tree div {ARITY}")).otherwise(F.expr(f"index div {ARITY}")), "at": F.when(alone, F.col("tree") % ARITY).otherwise(F.col("index") % ARITY)}
        above = stepped(here.withColumns(up), above if above is top else above.unionByName(top))
        above = kept(above) if level else above
        level -= 1
    return top if above is top else above.unionByName(top)


OUT_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    """Runs with their rows and what is above them -> a row for each of their rows."""
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    whole = root.hex()
    for batch in batches:
        out = []
        for tree, digests, path, rows in zip(*(batch.column(c).to_pylist() for c in ("key_tree", "digests", "path", "rows")), strict=True):
            above = [(x["at"], x["digests"].hex()) for x in path or ()]
            own = digests.hex() if digests is not None else None
            for row in rows:
                leaf, at = row["leaf"].hex(), row["at"]
                frames = above if own is None else [(at, own), *above]
                siblings, folded = [], (row["tampered"] or row["leaf"]).hex()
                for i, run in frames:
                    left, right = run[: 64 * i], run[64 * i + 64 :]
                    siblings += left, right
                    folded = hashlib.sha256(f"{left}{folded}{right}".encode()).hexdigest()
                if row["depth"] == len(frames):  # one source: its root is the root
                    subroot = whole
                else:
                    i, run = frames[row["depth"]]
                    subroot = run[64 * i : 64 * i + 64]
                out.append((row["doc_id"], leaf, subroot, whole, hashlib.sha256("".join(siblings).encode()).hexdigest(), folded, folded == whole))
            if len(out) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT_DDL.split(", ")])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT_DDL.split(", ")])


def manifest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row is a leaf of its source's tree, by doc_id, null first; rows that share source and doc_id go by their leaves. A
    null source is a source of its own, the first. Nulls are a field's ``-``, empty texts ``0:``; texts are hashed whole. A
    null doc_id is not tampered with. Other columns don't count. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = kept(located(leaves(docs)))
    trees = rows.agg(F.max("tree")).first()[0]
    if trees is None:
        return spark.createDataFrame([], OUT_DDL)
    trees += 1
    runs, root = forest(rows, trees)
    alone = F.col("size") == 1  # a leaf without siblings is its tree's root
    depth = sum((F.col("size") > ARITY**k).cast("int") for k in range(15))  # levels of the source's tree
    keyed = rows.select(
        F.when(alone, TOP).otherwise(F.col("tree")).cast("long").alias("key_tree"), F.expr(f"(CASE WHEN size = 1 THEN tree ELSE index END) div {ARITY}").alias("key_index"),
        F.struct((F.when(alone, F.col("tree")).otherwise(F.col("index")) % ARITY).cast("int").alias("at"), "doc_id", "leaf", "tampered", depth.alias("depth")).alias("row"),
    )
    of_run = keyed.groupBy("key_tree", "key_index").agg(F.collect_list("row").alias("rows"))  # at most ARITY rows
    above = _above(runs)
    joined = of_run.join(above, (F.col("key_tree") == F.col("tree")) & (F.col("key_index") == F.col("index")), "left").select("key_tree", "digests", "path", "rows")
    return joined.mapInArrow(partial(_proved, root=root), OUT_DDL)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, keys: str, levels: int) -> str:
    """Nodes ``name``0(keys, idx, h, n) -> the runs and nodes of each level, as common table expressions."""
    by = f"{keys}, " if keys else ""
    return ",\n".join(
        f"{name}run{i} AS (SELECT {by}idx // {ARITY} AS idx, string_agg(h, '' ORDER BY idx) AS run, any_value(n) AS n FROM {name}{i} WHERE n > 1 GROUP BY {by}idx // {ARITY}),\n"
        f"{name}{i + 1} AS (SELECT {by}idx, sha256(run) AS h, (n + {ARITY - 1}) // {ARITY} AS n FROM {name}run{i})"
        for i in range(levels)
    )


def _climb_sql(into: str, name: str, start: str, on: str, at: str, levels: int) -> str:
    """Rows with x (a digest), proof and an index -> through all levels of ``name``."""
    out, last = [], start
    for i in range(levels):
        place = f"({at} // {ARITY**i}) % {ARITY}"
        left, right = f"left(r.run, 64 * ({place}))", f"substr(r.run, 64 * ({place}) + 65)"
        out.append(
            f"{into}{i + 1} AS (SELECT d.* EXCLUDE (x, proof), CASE WHEN r.run IS NULL THEN d.x ELSE sha256({left} || d.x || {right}) END AS x,\n"
            f"  CASE WHEN r.run IS NULL THEN d.proof ELSE d.proof || {left} || {right} END AS proof\n"
            f"  FROM {last} d LEFT JOIN {name}run{i} r ON {on} r.idx = {at} // {ARITY ** (i + 1)})"
        )
        last = f"{into}{i + 1}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END" for x in (*FIELDS[:-1], text)) + ")"


_LEVELS, _TOP_LEVELS = 8, 4
OP13_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS of_byte
  FROM (SELECT unnest(range(256)) AS i)),
hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(of_byte[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {TAMPERED} = 0
      THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents, crc),
s0 AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_levels_sql("s", "tree", _LEVELS)},
t0 AS (SELECT tree AS idx, h, count(*) OVER () AS n FROM ({" UNION ALL ".join(f"SELECT tree, h FROM s{i} WHERE n = 1" for i in range(_LEVELS + 1))})),
{_levels_sql("t", "", _TOP_LEVELS)},
root AS ({" UNION ALL ".join(f"SELECT h AS root FROM t{i} WHERE n = 1" for i in range(_TOP_LEVELS + 1))}),
d0 AS (SELECT doc_id, leaf, tree, idx AS at_, coalesce(tampered, leaf) AS x, '' AS proof FROM s0),
{_climb_sql("d", "s", "d0", "r.tree = d.tree AND", "d.at_", _LEVELS)},
{_climb_sql("e", "t", f"d{_LEVELS}", "", "d.tree", _TOP_LEVELS)}
SELECT e.doc_id, e.leaf, t0.h AS subroot, root.root, sha256(e.proof) AS proof_sha256, e.x AS folded_root, e.x = root.root AS verified
FROM e{_TOP_LEVELS} e JOIN t0 ON t0.idx = e.tree, root
"""
