"""Operator 4: exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are after the deletion of every space and every byte from 9 to 13.

1. Map tasks hash each normalised text, chain equal texts of their own rows by comparing bytes, and
   write one entry for each text (key, bytes, best row, rows) and one member row for each document to
   shared files. However many copies a text has, a task writes it once.
2. The directory starts as one bucket and doubles while a bucket is overfull and can be split by one
   more bit of the key; each bucket owns a range of keys. The driver holds the first DRIVER_BITS bits; a
   slot that is still overfull is split on by the executors, as deep as its count asks for.
3. Owner tasks take whole buckets, sorted by key, chain the entries of a key and compare their bytes:
   entries of different bytes under one key are different chains.
4. Members join their entry's chain by the entry's id: at most the rows of one map task have it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, kept, rows_that_stay, steps, table

#: Entries of a bucket before it splits.
CAPACITY = 512
#: Bits of the directory that the driver holds.
DRIVER_BITS = 16
#: Bytes of texts that a map task holds before it writes its entries and starts anew.
HELD_BYTES = 24 << 20
KEY_BITS = 64

ENTRY_SCHEMA = "kind int, entry long, key long, text binary, sha string, chars long, best_doc long, best_row long, n long, row_id long, doc_id long, text_hash long"
CHAIN_SCHEMA = "entry long, keep_row long, keep_id long, group_size long, text_sha256 string"


def _better(a: tuple, b: tuple) -> bool:
    """(chars, doc_id, row): most code points, then the smallest doc_id (null last), then the first row."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _entries(key_bits: int):
    schema = _arrow_schema(ENTRY_SCHEMA)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        row, entry = base, base
        local: dict[bytes, list] = {}
        members: list[tuple] = []
        held = 0

        def flush():
            rows = []
            for text, (eid, best, n) in local.items():
                sha = hashlib.sha256(text).digest()
                key = int.from_bytes(sha[:8], "big", signed=True)
                if key_bits < KEY_BITS:
                    key &= -1 << (KEY_BITS - key_bits)
                rows.append((0, eid, key, text, sha.hex(), *best, n, None, None, None))
            rows += [(1, eid, None, None, None, None, None, None, None, r, d, h) for r, d, h, eid in members]
            local.clear()
            members.clear()
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 2000], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in steps(batch):
                texts = part.column("text").cast(pa.large_binary())
                chars = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_pylist()
                for text, c, doc, text_hash in zip(texts, chars, part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), strict=True):
                    norm = (text.as_py() or b"").translate(None, SPACE)
                    mine = (c, doc, row)
                    if (old := local.get(norm)) is None:
                        local[norm] = old = [entry, mine, 0]
                        entry += 1
                        held += len(norm)
                    elif _better(mine, old[1]):
                        old[1] = mine
                    old[2] += 1
                    members.append((row, doc, text_hash, old[0]))
                    row += 1
                if held > HELD_BYTES or len(members) > 500_000:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def directory(counts: dict[int, int], capacity: int, max_depth: int = DRIVER_BITS) -> tuple[int, list[int]]:
    """Entries by the first ``max_depth`` bits of their key -> depth used, and the bucket of each slot."""
    below = np.zeros((1 << max_depth) + 1, np.int64)
    for prefix, n in counts.items():
        below[prefix + 1] += n
    below = np.cumsum(below)
    depth, slots = 0, [0]
    bits, lows = [0], [0]  # by bucket: its own depth, and the first prefix of its range
    queue = [0]
    while queue:
        b = queue.pop()
        width = 1 << (max_depth - bits[b])
        if bits[b] == max_depth or below[lows[b] + width] - below[lows[b]] <= capacity:
            continue
        if bits[b] == depth:  # no slot is left to tell the halves apart: the directory doubles
            slots = [x for x in slots for _ in range(2)]
            depth += 1
        new = len(bits)
        bits[b] += 1
        bits.append(bits[b])
        lows.append(lows[b] + width // 2)
        first, n = lows[new] >> (max_depth - depth), 1 << (depth - bits[new])
        slots[first : first + n] = [new] * n
        queue += [b, new]
    return depth, slots


def deeper(n: int, capacity: int) -> int:
    """By how many more bits to split n entries, so that about ``capacity`` stay together; key bits are as good as random."""
    return max(0, math.ceil(math.log2(n / capacity))) if n else 0


def _chains(batches):
    """Rows in the order of their key -> for each entry, the row that its text keeps."""
    schema = _arrow_schema(CHAIN_SCHEMA)
    key, chains, out = None, {}, []

    def close():
        for sha, best, n, entries in chains.values():
            out.extend((e, best[2], best[1], n, sha) for e in entries)
        chains.clear()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        names = ("key", "text", "entry", "sha", "chars", "best_doc", "best_row", "n")
        for k, text, entry, sha, *best, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if k != key:
                close()
                key = k
            if (chain := chains.get(text)) is None:  # a dictionary compares the bytes of what it finds
                chains[text] = [sha, tuple(best), n, [entry]]
            else:
                chain[1] = tuple(best) if _better(best, chain[1]) else chain[1]
                chain[2] += n
                chain[3].append(entry)
        if len(out) > 5000:
            yield batch_of(out)
            out = []
    close()
    if out:
        yield batch_of(out)


def duplicates(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS, driver_bits: int = DRIVER_BITS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256, text_hash; one row a document.

    A null text is the empty text. Of equal texts the row with the most code points stays, then the
    smallest doc_id (a null doc_id is the largest), then, of rows that agree in both, exactly one. Rows
    that share a doc_id are rows of their own. An empty table gives an empty one. ``key_bits`` shortens
    the keys, for tests of chains, and ``driver_bits`` the driver's part of the directory.
    """
    spark = docs.sparkSession
    index = kept(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_entries(key_bits), ENTRY_SCHEMA), "zstd")
    entries = index.where("kind = 0").drop("kind", "row_id", "doc_id", "text_hash")
    prefix = F.shiftrightunsigned("key", KEY_BITS - driver_bits)
    counts = {r[0]: r[1] for r in entries.groupBy(prefix.alias("prefix")).count().collect()}  # at most 2 ** DRIVER_BITS rows
    depth, slots = directory(counts, capacity, driver_bits)
    # a slot of the full depth is one prefix
    more = [min(deeper(counts.get(i, 0), capacity), KEY_BITS - driver_bits) if depth == driver_bits else 0 for i in range(len(slots))]
    buckets = F.broadcast(spark.createDataFrame(list(zip(range(len(slots)), slots, more, strict=True)), "slot long, bucket long, more int"))  # at most 2 ** DRIVER_BITS rows
    slot = F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")
    part = F.when(F.col("more") > 0, F.expr(f"shiftrightunsigned(shiftleft(key, {driver_bits}), {KEY_BITS} - more)")).otherwise(F.lit(0))
    owned = entries.withColumn("slot", slot).join(buckets, "slot").withColumn("part", part).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")
    chains = owned.drop("slot", "bucket", "more", "part").mapInArrow(_chains, CHAIN_SCHEMA)
    members = index.where("kind = 1").select("row_id", "doc_id", "text_hash", "entry")
    return members.join(chains, "entry").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "text_hash")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns of any names. Nulls, empty and long texts, ties, repeated
    rows and empty tables as in duplicates()."""
    return rows_that_stay(docs, kept(duplicates(docs).select("doc_id", "text_hash", F.col("kept").alias("stays"))))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP4_SQL = r"""
WITH normal AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM normal)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""
