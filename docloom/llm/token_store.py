"""Operator 8: token-ID output as a content-addressed store.

Each text becomes its token ids and an end id. A rolling hash of the ids cuts the stream of a document
into chunks, so that equal passages give equal chunks wherever they stand; a chunk is stored once, under
the hash of its ids. A document is a recipe, the list of its chunks. Recipes lie in ascending doc_id
order in segments; a segment's manifest holds the root of a Merkle tree over its recipes and its ids.

Files below the store's folder, all Parquet:

- ``data/kind=0``: objects (hash, n_ids, payload: ids as little-endian integers, 16-bit if the vocabulary
  fits, else 32-bit);
- ``recipes/kind=1``: segment, place, doc_id, row_id, n_ids, start_in_segment, hashes (of 16 bytes), lengths;
- ``recipes/kind=2``: manifests: segment, n_docs (place), n_ids, root (hashes).

Scale: a map task stores a chunk once, so that a passage in a third of all documents reaches its owner
once from each task; recipes never meet by chunk except in a join that Spark may split. Reading back
checks every object and combines the CRCs of chunks, so that payloads are not moved again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import mix64, shared_dir, small_or_none, steps, table, text_buffers
from docloom.llm.word_cache import WordCache

MODEL = "byte_bpe_50k.json"
END_ID = 0
HASH = 16
#: A cut stands where the hash of the last WINDOW ids has CUT_BITS zero bits.
WINDOW, CUT_BITS, LEAST, MOST = 8, 8, 64, 2048
DOCS_PER_SEGMENT = 2048
#: Text bytes that are encoded together.
ENCODE_BYTES = 4 << 20
#: Bytes of the pieces that a worker remembers, in each of two generations.
CACHE_BYTES = 128 << 20

STAGED = "kind int, owner long, hash binary, payload binary, n_ids long, doc_id long, row_id long, hashes binary, lengths binary"
RECIPES = "kind int, segment long, place long, doc_id long, row_id long, n_ids long, start_in_segment long, hashes binary, lengths binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


#: Of each byte: whether it opens a gap, ends a character that is white space to nobody, is a letter or punctuation (no apostrophe).
_GAP, _CLEAN, _LETTER, _POINT, _NEWLINE = (1 << i for i in range(5))
#: Bytes that open characters of two and three bytes which are no white space, and Latin letters of two; the ends of such letters.
_TWO, _THREE, _LATIN, _TAIL = (1 << i for i in range(4))
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND, _LEAD = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _bytes, _flag in ((b" \n", _GAP), (bytes(range(0x21, 0x7F)), _CLEAN), (bytes(x for x in range(128) if chr(x).isalpha()), _LETTER), (PUNCTUATION, _POINT), (b"\n", _NEWLINE)):
    _KIND[list(_bytes)] |= _flag
for _bytes, _flag in ((range(0xC3, 0xE0), _TWO), (range(0xE4, 0xEE), _THREE), (range(0xC3, 0xC9), _LATIN), (set(range(0x80, 0xC0)) - {0x97, 0xB7}, _TAIL)):
    _LEAD[list(_bytes)] |= _flag
#: Pieces that the file's pattern never divides.
SINGLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+|[" + re.escape(PUNCTUATION) + rb"]+)|\n").fullmatch
#: Pieces of more bytes are not remembered.
LONG_PIECE = 256


def _letters_of_bytes() -> np.ndarray:
    """The characters by which a byte-level vocabulary file writes each byte; a zero byte stays."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    letters = np.array([b if b in own else next(others) for b in range(256)], "<u2")
    letters[0] = 0
    return letters


_LETTERS = _letters_of_bytes()


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte. ``at``: where texts start, and the end. Within a text, pieces start at a space or newline
    after a character that is no white space, at punctuation after a letter, and at a letter after such a newline. No match of a byte-level
    file's pattern goes across such a place, and none looks beyond it, so a text's ids are those of its pieces."""
    starts = np.zeros(len(data) + 1, bool)
    whole = data.tobytes()
    kind, lead = (np.frombuffer(whole.translate(x.tobytes()), np.uint8) for x in (_KIND, _LEAD))
    clean, letter = kind & _CLEAN != 0, kind & _LETTER != 0
    clean[1:] |= lead[:-1] & _TWO != 0
    clean[2:] |= lead[:-2] & _THREE != 0
    letter_ends = letter.copy()
    letter_ends[1:] |= (lead[:-1] & _LATIN != 0) & (lead[1:] & _TAIL != 0)
    starts[1:-1] = (kind[1:] & _GAP != 0) & clean[:-1]
    after = starts[1:-2] & (kind[1:-1] & _NEWLINE != 0) & letter[2:]
    starts[1:-1] |= (kind[1:] & _POINT != 0) & letter_ends[:-1]
    starts[2:-1] |= after
    starts[at[:-1]] = True
    starts[-1] = False
    return starts


def _as_bytes(column: pa.Array) -> list[bytes]:
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[: len(column) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """The ids that the tokenizers library gives with the file at ``path``.

    All ids come from the library. Where the file cuts a text whatever stands round it, a text is the join of its
    pieces (see piece_starts()); each piece that a worker remembers is asked for once, and the library's merges get
    pieces that its pattern would not divide as they are. Texts with a special token, and all texts of files that cut
    otherwise, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        within = any(SINGLE(x.encode()) or x.isspace() for x in self.special)
        self.wide = self.library.get_vocab_size() > 1 << 16
        level = file.get("pre_tokenizer") or {}
        plain = not within and not any(file.get(x) for x in ("normalizer", "truncation", "padding"))
        self.by_pieces = plain and level.get("type") == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"]
        self.cache = WordCache(self._ids_of_pieces, CACHE_BYTES)

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        single = list(filter(SINGLE, pieces)) if self.by_pieces else []
        found, flat, ends = {}, [], [0]
        if single:
            tokenize = self.library.model.tokenize
            for word in _LETTERS[np.frombuffer(b"\0".join(single), np.uint8)].tobytes().decode("utf-16-le").split("\0"):
                flat += [t.id for t in tokenize(word)]
                ends.append(len(flat))
            raw, ends = np.array(flat, "<u4").tobytes(), [4 * x for x in ends]
            found = {p: raw[a:b] for p, a, b in zip(single, ends, ends[1:])}
        others = [p for p in pieces if p not in found]
        return found | dict(zip(others, self.by_library([p.decode() for p in others]), strict=True))

    def encode_column(self, texts: pa.Array, last: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with ``last`` (little-endian) behind it, and where each text's ids end."""
        data, at = text_buffers(texts)
        full = np.unique(at)
        starts = piece_starts(data, full) if self.by_pieces and len(data) else np.zeros(len(data) + 1, bool)
        starts[full[:-1]] = True
        for special in self.special if self.by_pieces else []:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)).tolist():
                starts[at[i] + 1 : at[i + 1]] = False
        begins = np.flatnonzero(starts)
        offsets = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = _as_bytes(pieces.dictionary)
        long = {p: self.by_library([p.decode()])[0] for p in distinct if len(p) > LONG_PIECE}
        ids = self.cache.look_up(distinct, long)
        # pieces up to the end of each text; behind them stands ``last``
        ends = np.searchsorted(begins, at[1:], "left")
        order = np.insert(pieces.indices.to_numpy(), ends, len(distinct))
        flat = pa.array([*ids, last], pa.large_binary()).take(pa.array(order))
        _, where, raw = flat.buffers()
        bounds = np.frombuffer(where, np.int64)[: len(flat) + 1]
        out = np.frombuffer(raw, "<u4", int(bounds[-1]) // 4) if raw is not None else np.zeros(0, "<u4")
        return out, bounds[ends + np.arange(len(ends)) + 1] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    path = model_path(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_ID_HASH = mix64(np.arange(1 << 16, dtype=np.uint64))
#: Windows that one numpy step works on.
MARK_STEP = 1 << 17


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash asks for a cut."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(ids) - WINDOW + 1, MARK_STEP):
        part = ids[at : at + MARK_STEP + WINDOW - 1]
        with np.errstate(over="ignore"):
            # a sum of mixed ids over a window, rolled on by prefix sums; equal windows have equal sums
            mixed = _ID_HASH[part] if int(part.max()) < len(_ID_HASH) else mix64(part.astype(np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
            rolled = mix64(total[WINDOW:] - total[:-WINDOW])
        found.append(np.flatnonzero(rolled & np.uint64((1 << CUT_BITS) - 1) == 0) + at + WINDOW)
    return np.concatenate(found)


def cuts(marked: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of a document's ids, which lie from ``start`` to ``stop``; the last one is their end. ``marked``: the marks
    between. A mark nearer to the start than LEAST is no cut, so windows that reach into the document before are none."""
    ends, last = [], start
    for m in [*marked, stop]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST or m == stop and m > last:
            ends.append(m)
            last = m
    return ends


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _stage(path: str | None):
    schema = _schema(STAGED)

    def run(batches):
        tokenizer = encoder(path)
        unit, end = "<u4" if tokenizer.wide else "<u2", np.array([END_ID], "<u4").tobytes()
        row_id = TaskContext.get().partitionId() << 33
        seen: set[bytes] = set()
        for batch in batches:
            for part in steps(batch, step_bytes=ENCODE_BYTES):
                rows = []
                ids, stops = tokenizer.encode_column(part.column("text"), end)
                raw, packed, marked = memoryview(ids).cast("B"), ids.astype(unit), marks(ids)
                bounds = np.searchsorted(marked, stops).tolist()
                marked, start, first = marked.tolist(), 0, 0
                for doc, stop, below in zip(part.column("doc_id").to_pylist(), stops.tolist(), bounds, strict=True):
                    hashes, lengths, n = [], [], stop - start
                    for at in cuts(marked[first:below], start, stop):
                        digest = hashlib.blake2b(raw[4 * start : 4 * at], digest_size=HASH).digest()
                        if digest not in seen:
                            seen.add(digest)
                            rows.append((0, _signed(digest), digest, packed[start:at].tobytes(), at - start, None, None, None, None))
                        hashes.append(digest)
                        lengths.append(at - start)
                        start = at
                    owner, first = _signed(hashlib.blake2b(b"%d" % row_id, digest_size=8).digest()), below
                    rows.append((1, owner, None, None, n, doc, row_id, b"".join(hashes), np.array(lengths, "<u4").tobytes()))
                    row_id += 1
                if len(seen) > 1_000_000:
                    seen.clear()
                yield _batch(rows, schema)

    return run


def _once(batches):
    """Rows sorted by kind and hash: the first of each hash; others must have its bytes. Recipes pass."""
    last_hash, last_payload = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column("hash")
        before = pa.concat_arrays([pa.array([last_hash], hashes.type), hashes.slice(0, len(hashes) - 1)])
        again = pc.fill_null(pc.equal(hashes, before), False)  # a recipe has no hash
        payloads = batch.column("payload")
        for i in np.flatnonzero(again.to_numpy(zero_copy_only=False)).tolist():
            if payloads[i].as_py() != (payloads[i - 1].as_py() if i else last_payload):
                raise ValueError(f"two chunks have the hash {hashes[i].as_py().hex()}")
        last_hash, last_payload = hashes[-1].as_py(), payloads[-1].as_py()
        yield batch.filter(pc.invert(again))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves pair by pair up to one root; an odd last one goes up as it is. No leaves: the hash of nothing."""
    level = leaves or [hashlib.blake2b(b"", digest_size=HASH).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=HASH).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def leaf(hashes: bytes, lengths: bytes) -> bytes:
    return hashlib.blake2b(hashes + b"|" + lengths, digest_size=HASH).digest()


def _segments(batches):
    """The recipes of one range of doc_id, in order -> the same with their places, and the segment's manifest."""
    schema, segment = _schema(RECIPES), TaskContext.get().partitionId()
    place, start, leaves = 0, 0, []
    for batch in batches:
        rows = []
        for doc, row, n, hashes, lengths in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_id", "n_ids", "hashes", "lengths")), strict=True):
            rows.append((1, segment, place, doc, row, n, start, hashes, lengths))
            leaves.append(leaf(hashes, lengths))
            place, start = place + 1, start + n
        if rows:
            yield _batch(rows, schema)
    if place:
        yield _batch([(2, segment, place, None, None, start, 0, merkle_root(leaves), None)], schema)


def write_store(docs: DataFrame, folder: str, path: str | None = None) -> str:
    """docs(doc_id, text, ...) into a store in ``folder``.

    A null text has only the end id; a null doc_id stands last; rows that share a doc_id stand side by side,
    each with its own ids; texts of any length are encoded whole; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    staged = docs.select("doc_id", "text").mapInArrow(_stage(path), STAGED)
    owned = staged.repartition("owner").sortWithinPartitions("kind", "hash").mapInArrow(_once, STAGED)
    owned.drop("owner").write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/data")
    recipes = _read(spark, f"{folder}/data", STAGED).where("kind = 1").select("doc_id", "row_id", "n_ids", "hashes", "lengths")
    rows = recipes.count()
    segments = max(1, -(-rows // DOCS_PER_SEGMENT))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    ordered = recipes.repartitionByRange(segments, *order).sortWithinPartitions(*order).mapInArrow(_segments, RECIPES)
    ordered.write.partitionBy("kind").option("compression", "snappy").parquet(f"{folder}/recipes")
    return folder


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)


def _shift_tables() -> np.ndarray:
    """For k: what 2 ** k zero bytes after a message do to its CRC-32, by byte of the CRC."""
    def product(m: list[int], v: int) -> int:
        out = 0
        for bit in range(32):
            if v >> bit & 1:
                out ^= m[bit]
        return out

    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    matrix = one_bit
    for _ in range(3):
        matrix = [product(matrix, matrix[i]) for i in range(32)]
    tables = []
    for _ in range(40):
        tables.append([[product(matrix, b << 8 * q) for b in range(256)] for q in range(4)])
        matrix = [product(matrix, matrix[i]) for i in range(32)]
    return np.array(tables, np.uint32)


_SHIFT: list[np.ndarray] = []


def crc_shift(crcs: np.ndarray, zero_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of each message followed by zero bytes, less the CRC of as many zero bytes alone: CRCs of parts combine by xor."""
    if not _SHIFT:
        _SHIFT.append(_shift_tables())
    out, left, k = crcs.astype(np.uint32), zero_bytes.astype(np.int64), 0
    while (left >> k).any():
        on = np.flatnonzero(left >> k & 1)
        c, t = out[on], _SHIFT[0][k]
        out[on] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        k += 1
    return out


def _checked_objects(wide: bool):
    schema = _schema("hash binary, n_ids long, crc long")

    def run(batches):
        for batch in batches:
            rows = []
            for digest, payload, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "payload", "n_ids")), strict=True):
                raw = np.frombuffer(payload, "<u4" if wide else "<u2").astype("<u4").tobytes()
                if hashlib.blake2b(raw, digest_size=HASH).digest() != digest or len(raw) != 4 * n:
                    raise ValueError(f"the object {digest.hex()} does not have the ids of its hash")
                rows.append((digest, n, zlib.crc32(raw)))
            if rows:
                yield _batch(rows, schema)

    return run


PARTS = "segment long, place long, hash binary, n_part long, ids_after long, doc_parts long"


def _parts(batches):
    """Recipes -> a row for each chunk of each document, with the number of ids that follow it."""
    schema = _schema(PARTS)
    for batch in batches:
        rows = []
        for segment, place, hashes, lengths in zip(*(batch.column(c).to_pylist() for c in ("segment", "place", "hashes", "lengths")), strict=True):
            ns = np.frombuffer(lengths, "<u4").astype(np.int64)
            after = ns.sum() - np.cumsum(ns)
            rows += [(segment, place, hashes[HASH * i : HASH * (i + 1)], n, a, len(ns)) for i, (n, a) in enumerate(zip(ns.tolist(), after.tolist(), strict=True))]
            if len(rows) > 20_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _shifted(batches):
    schema = _schema("segment long, place long, n_part long, doc_parts long, crc long")
    for batch in batches:
        crc, after = batch.column("crc").to_numpy().astype(np.uint32), batch.column("ids_after").to_numpy()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("segment", "place", "n_part", "doc_parts")), pa.array(crc_shift(crc, 4 * after).astype(np.int64))], schema=schema)


def _roots(key, group):
    import pandas as pd

    group = group.sort_values("place")
    root = merkle_root([leaf(bytes(h), bytes(n)) for h, n in zip(group["hashes"], group["lengths"], strict=True)])
    return pd.DataFrame({"segment": [key[0]], "read_docs": [len(group)], "read_root": [root]})


def read_index(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """A store's files -> doc_id, start, n_tokens, ids_crc32. Every object is checked against its hash, every
    chunk of a recipe must be there, and every segment must have its manifest's root; else the query fails."""
    objects = _read(spark, f"{folder}/data", STAGED).where("kind = 0").select("hash", "payload", "n_ids")
    checked = objects.mapInArrow(_checked_objects(encoder(path).wide), "hash binary, n_ids long, crc long")
    stored = _read(spark, f"{folder}/recipes", RECIPES)
    recipes, manifests = stored.where("kind = 1"), stored.where("kind = 2")
    parts = recipes.select("segment", "place", "hashes", "lengths").mapInArrow(_parts, PARTS)
    found = parts.join(checked, "hash").where("n_ids = n_part").select("segment", "place", "n_part", "doc_parts", "ids_after", "crc")
    crcs = (
        found.mapInArrow(_shifted, "segment long, place long, n_part long, doc_parts long, crc long")
        .groupBy("segment", "place")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n_part").alias("read_ids"), F.count(F.lit(1)).alias("parts"), F.max("doc_parts").alias("doc_parts"))
    )
    roots = recipes.select("segment", "place", "hashes", "lengths").groupBy("segment").applyInPandas(_roots, "segment long, read_docs long, read_root binary")
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifests.select(
        "segment", F.col("hashes").alias("root"), F.col("place").alias("n_docs"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("segment_start")
    )
    segments = starts.join(roots, "segment", "left").select(
        "segment",
        F.when(F.col("root").eqNullSafe(F.col("read_root")) & F.col("n_docs").eqNullSafe(F.col("read_docs")), F.col("segment_start"))
        .otherwise(F.raise_error(F.lit("a segment does not have the root of its manifest")).cast("long"))
        .alias("segment_start"),
    )
    index = recipes.select("segment", "place", "doc_id", "n_ids", "start_in_segment")
    whole = (F.col("parts") == F.col("doc_parts")) & (F.col("read_ids") == F.col("n_ids"))
    return (
        index.join(crcs, ["segment", "place"], "left")
        .join(small_or_none(segments), "segment", "left")
        .select(
            "doc_id",
            (F.col("segment_start") + F.col("start_in_segment")).alias("start"),
            F.col("n_ids").alias("n_tokens"),
            F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document has chunks that the store has not")).cast("long")).alias("ids_crc32"),
        )
    )


def read_ids(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """A store's files -> doc_id, ids array<int>: each document put together again from its chunks."""
    wide = encoder(path).wide
    objects = _read(spark, f"{folder}/data", STAGED).where("kind = 0").select("hash", "payload")
    recipes = _read(spark, f"{folder}/recipes", RECIPES).where("kind = 1")
    parts = recipes.select("segment", "place", "hashes", "lengths").mapInArrow(_parts, PARTS)
    pieces = parts.join(objects, "hash").groupBy("segment", "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("ids_after")).alias("at"), "payload"))).alias("pieces"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in row), "<u4" if wide else "<u2").astype(np.int32).tolist() for row in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, schema.field("ids").type)], schema=schema)

    joined = recipes.select("segment", "place", "doc_id").join(pieces, ["segment", "place"])
    return joined.select("doc_id", "pieces").mapInArrow(run, "doc_id long, ids array<int>")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_index(spark, write_store(table(spark, sf_dir, "documents"), shared_dir(spark)))
