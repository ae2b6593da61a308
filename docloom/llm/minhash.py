"""Operator 1: near duplicates by DartMinHash signatures, bands and exact verification.

A document is the weighted set of its five-word shingles: a shingle that stands c times has weight c,
that is c unit cells. Darts fall on (cell, rank) at rate one, placed by hashes of the cell alone; ranks
are opened slab by slab, each as large as all before, until every coordinate of the signature has a
dart, and the earliest dart of a coordinate is its value. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. A long text needs few darts a cell and stops after
the first thin slabs, so a signature costs about K log K darts whatever the length.

Candidates share a band of ROWS coordinates. In a bucket every text is compared with the bucket's
first and with its neighbour, so that pairs grow with the rows of a bucket; what this links becomes a
component. Buckets that then still hold several components are compared in full across components,
block by block inside tasks: first the signatures alone, in blocks of thousands of rows, then the rows
that have a likely partner with their shingles. Only links leave the tasks. Every link is verified on
the cells of both documents, by 32 bits of each: two of n cells agree in one by chance with probability n * n / 2 ** 32.
Texts of few words share a band only if all 64 bits of a cell agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import kept, mix64, rows_that_stay, small_or_none, steps, table, text_buffers
from docloom.llm.components import components
from docloom.llm.words import shingles

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
#: Pairs whose signatures agree less than SIMILARITY by this many standard deviations are not verified.
SLACK = 4.5
FIRST_SLAB = 2.0**-6
#: Bytes of texts that are signed at once, and parts of a slab that are opened at once; both bound a worker's memory.
SIGN_BYTES, PARTS_AT_ONCE = 1 << 17, 32
#: Rows of a block of a bucket in the comparison across components: of signatures alone, and of whole rows, and about
#: how many bytes of cells a block of these has.
SKETCH_BLOCK, BLOCK, BLOCK_BYTES = 2048, 1024, 16 << 20

SIGNED = "doc_id long, text_hash long, row_id long, n_cells long, f1 long, f2 long, sketch binary, bands array<long>, cells binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cells_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Document and hash of each unit cell: the c-th time that a shingle stands in a document is its cell c. And two sums
    over each document's shingles, which texts of the same shingles share."""
    doc, element, other = shingles(data, offsets, width)
    n = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(n + 1))
    with np.errstate(over="ignore"):
        sums = [np.r_[np.uint64(0), np.cumsum(mix64(x), dtype=np.uint64)] for x in (element, other)]
        prints = tuple((p[at[1:]] - p[at[:-1]]).view(np.int64) for p in sums)
    if not len(doc):
        return doc, element, prints
    order = np.argsort(element)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, element = doc[order], element[order]
    new = np.r_[True, (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])]
    at = np.arange(len(element))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return doc, mix64(element + nth.astype(np.uint64) * _ODD), prints


def _slabs():
    """Lower rank, area of a part, parts of each slab; parts have an area of one at most."""
    low, area = 0.0, FIRST_SLAB
    while True:
        yield low, min(area, 1.0), max(1, round(area))
        low += area
        area = low


def signatures(doc: np.ndarray, cells: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate (n_docs, k); zeros for a document without cells."""
    best = np.full(n_docs * k, np.inf)
    value = np.zeros(n_docs * k, np.uint64)
    with np.errstate(over="ignore"):
        for number, (low, area, parts) in enumerate(_slabs()):
            if not len(doc):
                break
            p, cdf = math.exp(-area), []
            term = p
            while len(cdf) < 16 and p < 1 - 1e-15:
                cdf.append(p)
                term *= area / (len(cdf))
                p += term
            for first in range(0, parts, PARTS_AT_ONCE):
                n = min(PARTS_AT_ONCE, parts - first)
                part = np.arange(first, first + n, dtype=np.uint64)
                ids = mix64((cells[:, None] ^ mix64(part + np.uint64(number << 32))[None, :]).ravel())
                u = (ids >> np.uint64(11)).astype(np.float64) * 2.0**-53
                on = np.flatnonzero(u >= cdf[0])
                n_darts = np.searchsorted(cdf, u[on], "right")
                which = np.repeat(on, n_darts)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n_darts) - n_darts, n_darts)
                dart = mix64(ids[which] + (nth.astype(np.uint64) + np.uint64(1)) * _ODD)
                slot = doc[which // n] * k + ((dart >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
                inside = (which % n + first) if parts > 1 else 0
                rank = low + area * (inside + (dart & np.uint64((1 << 40) - 1)).astype(np.float64) * 2.0**-40)
                np.minimum.at(best, slot, rank)
                won = rank == best[slot]
                value[slot[won]] = mix64(dart[won])
            done = np.isfinite(best.reshape(n_docs, k)).all(axis=1)
            left = ~done[doc]
            doc, cells = doc[left], cells[left]
    return value.reshape(n_docs, k)


def _sign(batches):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("row_id", pa.int64()), ("n_cells", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("cells", pa.binary())]
    )
    row_id = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in steps(batch, step_bytes=SIGN_BYTES):
            n = part.num_rows
            doc, cells, (f1, f2) = cells_of(*text_buffers(part.column("text")))
            value = signatures(doc, cells, n)
            sizes = np.bincount(doc, minlength=n)
            at = np.cumsum(np.r_[0, sizes])
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
                for r in range(ROWS):
                    key = mix64(key * _ODD + value[:, r::ROWS])
            small = (cells >> np.uint64(32)).astype("<u4")
            sketch = (value & np.uint64(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), key.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(np.arange(row_id, row_id + n)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(f1),
                    pa.array(f2),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                    bands,
                    pa.array([np.sort(small[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                ],
                schema=schema,
            )
            row_id += n


def least_agreement(similarity: float = SIMILARITY, k: int = K) -> int:
    return math.floor(k * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / k)))


def _agreeing(least: int):
    """Pairs with both sketches -> the pairs that agree in ``least`` coordinates."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, K) for c in ("sketch_a", "sketch_b"))
                good = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], schema=schema)

    return run


def _similar(similarity: float):
    """Pairs with both documents' cells -> the pairs of at least that weighted Jaccard similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "cells_a", "cells_b")), strict=True):
                if (j := _jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))) >= similarity:
                    rows.append((a, b, j))
            a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], schema=schema)

    return run


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of cells, none empty."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(x) + len(y) - common)


def _groups(batches, columns: tuple[str, ...]):
    """Rows sorted by (key, left, right) -> (key, rows) of each group with more than one row."""
    group, rows = None, []
    for batch in batches:
        for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "left", "right", *columns)), strict=True):
            if (key, i, j) != group:
                if len(rows) > 1:
                    yield group[0], rows
                group, rows = (key, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield group[0], rows


def _partners(i: int, right: np.ndarray, node: np.ndarray, comp: np.ndarray, side: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Of the rows on the right those of other components that row i has to meet here, and whose size leaves them a chance."""
    other = right[(comp[right] != comp[i]) & ((side[right] != 3) | (node[right] > node[i]))]
    return other[np.minimum(size[other], size[i]) >= similarity * np.maximum(size[other], size[i])]


def _partnered(least: int, similarity: float):
    """Rows of blocks, sorted by group -> the rows of each bucket whose signature agrees with one of another component."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for key, rows in _groups(batches, ("node", "component", "side", "n_cells", "sketch")):
            node, comp, side, size = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), K)
            left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            some = np.zeros(len(rows), bool)
            for i in left.tolist():
                other = _partners(i, right, node, comp, side, size, similarity)
                other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
                some[other] = True
                some[i] |= len(other) > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), key)), pa.array(node[some])], schema=schema)

    return run


def _across(least: int, similarity: float):
    """Rows of blocks, sorted by group -> links between different components.

    A pair is looked at in the first of its common bands only; its signatures are compared before its
    cells, and not at all once links of this group have joined its components.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def links_of(rows):
        band, node, comp, side, size = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), K)
        keys = np.array([r[6] for r in rows], np.int64)[:, : band[0]]
        cells = [np.frombuffer(r[7], "<u4") for r in rows]
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        out = []
        for i in left.tolist():
            other = _partners(i, right, node, comp, side, size, similarity)
            other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
            other = other[~(keys[other] == keys[i]).any(axis=1)]
            for j in other.tolist():
                if comp[i] != comp[j] and (s := _jaccard(cells[i], cells[j])) >= similarity:
                    out.append((int(node[i]), int(node[j]), s))
                    comp[comp == comp[j]] = comp[i]
        return out

    def run(batches):
        for _, rows in _groups(batches, ("band", "node", "component", "side", "n_cells", "sketch", "bands", "cells")):
            a, b, s = zip(*found, strict=True) if (found := links_of(rows)) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], schema=schema)

    return run


def _only(signed: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The columns of the rows of some nodes; where these can be broadcast, no other row moves."""
    return signed.join(small_or_none(ids), "node", "left_semi").select("node", *columns)


def _with_both(pairs: DataFrame, signed: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with a column of both nodes. A node in very many pairs is split by the joins."""
    ids = kept(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    values = _only(signed, ids, column)
    with_a = pairs.join(values.select(F.col("node").alias("a"), F.col(column).alias(f"{column}_a")), "a")
    return with_a.join(values.select(F.col("node").alias("b"), F.col(column).alias(f"{column}_b")), "b")


def links(nodes: DataFrame, signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Nodes and the table (node, n_cells, sketch, bands, cells) that holds them -> a, b, similarity: verified links that join all that belong together."""
    least = least_agreement(similarity)
    keyed = F.expr("transform(bands, (x, i) -> struct(i as band, x as key, bands[(i + 1) % size(bands)] as next_key))")
    banded = _only(signed, nodes, "n_cells", "bands").select("node", "n_cells", F.explode(keyed).alias("x")).select("node", "n_cells", "x.band", "x.key", "x.next_key")
    in_bucket = Window.partitionBy("key")
    ordered = in_bucket.orderBy("next_key", "node")
    # what stands alone in its bucket, nearly all, goes before anything is written
    placed = kept(
        banded.select(
            "key", "band", "node", "n_cells", F.first("node").over(ordered).alias("leader"), F.lag("node").over(ordered).alias("neighbour"),
            F.count(F.lit(1)).over(in_bucket).alias("n"), F.sum("n_cells").over(in_bucket).alias("bucket_cells"),
        ).where("n > 1")
    )
    near = placed.where("neighbour is not null").select("node", F.explode(F.array_distinct(F.array("leader", "neighbour"))).alias("other"))
    tried = kept(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    likely = kept(_with_both(tried, signed, "sketch").mapInArrow(_agreeing(least), "a long, b long"))
    found = kept(_with_both(likely, signed, "cells").mapInArrow(_similar(similarity), "a long, b long, similarity double"))

    # of two rows a bucket has no pair that was not tried
    label = components(found.select("a", "b")).withColumnRenamed("node", "labelled")
    rows = placed.where("n > 2").join(label, F.col("node") == F.col("labelled"), "left")
    rows = kept(rows.select("key", "band", "node", "n_cells", "n", "bucket_cells", F.coalesce("component", "node").alias("component")))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = rows.join(kept(mixed), "key")
    # first the signatures alone, in large blocks: which rows have a likely partner in another component
    blocks = F.ceil(F.col("n") / SKETCH_BLOCK)
    sketched = _in_blocks(rows, blocks).join(_only(signed, kept(rows.select("node").distinct()), "sketch"), "node")
    partnered = kept(_grouped(sketched).mapInArrow(_partnered(least, similarity), "key long, node long"))
    # then those rows with all that a decision takes, in blocks of bounded rows and bytes
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bucket_cells") * 4 / BLOCK_BYTES))
    rows = kept(_in_blocks(rows.join(partnered, ["key", "node"], "left_semi"), blocks))
    rows = rows.join(_only(signed, kept(rows.select("node").distinct()), "sketch", "bands", "cells"), "node")
    return found.union(_grouped(rows).mapInArrow(_across(least, similarity), "a long, b long, similarity double"))


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of buckets -> a row for each pair of blocks that its block stands in; side says on which side."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        "key", "band", "node", "n_cells", "component",
        F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"),
        F.when(F.col("block") == F.col("with"), 3).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, class_id, class_size, text_id, kept, text_hash; one row a document.

    text_id is the smallest doc_id of those with the same shingles, told by two sums of independent hashes of 64 bits
    over them, class_id the smallest of all that
    links of at least ``similarity`` join, directly or by others. kept marks one row of each class, that
    of class_id. Words stand between spaces and bytes 9 to 13. A text of one to four words is one
    shingle; a null text or one without words is a class of its own. A null doc_id is the largest.
    """
    signed = kept(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_sign, SIGNED))
    worded = signed.where("n_cells > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    texts = worded.groupBy("f1", "f2").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).select("f1", "f2", F.col("first.row_id").alias("node"), F.col("first.doc_id").alias("text_id"), "n")
    texts = kept(texts)
    joined = components(kept(links(texts.select("node"), worded.withColumnRenamed("row_id", "node"), similarity)).select("a", "b"))
    classed = texts.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "node"))
    classes = classed.groupBy("component").agg(least.alias("least"), F.sum("n").alias("class_size")).select(
        "component", F.col("least.text_id").alias("class_id"), F.col("least.node").alias("kept_row"), "class_size"
    )
    of_text = kept(classed.join(classes, "component").select("f1", "f2", "text_id", "class_id", "class_size", "kept_row"))
    with_words = worded.select("doc_id", "text_hash", "row_id", "f1", "f2").join(of_text, ["f1", "f2"]).select(
        "doc_id", "class_id", "class_size", "text_id", (F.col("row_id") == F.col("kept_row")).alias("kept"), "text_hash"
    )
    without = signed.where("n_cells = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("text_id"), F.lit(True).alias("kept"), "text_hash"
    )
    return with_words.union(without)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each class, with all their columns of any names. Nulls, empty and long texts,
    ties, repeated rows and empty tables as in near_duplicates()."""
    found = near_duplicates(docs).select("doc_id", "text_hash", F.col("kept").alias("stays"))
    return rows_that_stay(docs, kept(found))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


#: By all pairs that share a shingle; for small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
u AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) AS nth FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.s = b.s AND a.nth = b.nth AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT a, b, common / (x.n + y.n - common) AS j FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id),
e AS (SELECT a, b FROM j WHERE j >= 0.8 UNION ALL SELECT b, a FROM j WHERE j >= 0.8),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
k AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
t AS (SELECT b AS doc_id, min(a) AS text_id FROM j WHERE j = 1 GROUP BY b)
SELECT k.doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(text_id, k.doc_id) AS text_id, k.doc_id = class_id AS kept FROM k LEFT JOIN t USING (doc_id)
"""
