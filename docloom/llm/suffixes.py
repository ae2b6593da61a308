"""Operator 10: repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or
earlier in the same text. Whole copies of a text are found first and go whole.

1. Anchors. Of every string of LENGTH bytes the position of the least hash among its runs of SEED bytes
   (the leftmost of equals) is its anchor. Equal strings have their anchor at the same place, so it is
   enough to sort the suffixes at anchors, one in about forty, and no string is missed.
2. Duplicate detection. Only suffixes whose first SEED bytes stand twice can matter. A task settles the
   runs that it has twice itself and sends the hashes of the others once.
3. Runs. A task sorts the suffixes that are left, with the bytes before them that strings of their
   anchor can reach, keeps the first of equal ones, front-codes the sorted run (length of the prefix
   common with the one before, and the rest) and sends each part to its owner. Owners are dealt by the
   hash of the first SEED bytes, so that no range of text is hot. Suffixes of a seed that stands very
   often are dealt by more of their bytes: their strings are parted by how far before the anchor they
   start, and all strings of a part share at least CORE bytes, which then choose the owner.
4. Merge. An owner merges its runs with a loser tree whose nodes know the prefix that loser and winner
   share; bytes that are known to agree are never compared again. The merge leaves the prefix that
   neighbours share; suffixes that share SEED bytes are a group.
5. In a group, strings of the same bytes are found by their hash and compared byte by byte; all but the
   first start a span that goes. A passage in very many texts reaches its owner once from each task.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import kept, mix64, small_or_none, steps, table, text_buffers
from docloom.llm.words import powers, prefix_hash, span_hash

LENGTH, SEED = 100, 24
#: Hashes of SEED bytes in a string of LENGTH.
REACH = LENGTH - SEED
#: Bytes of documents for each owner, and of suffixes in a task's run.
OWNER_BYTES, RUN_BYTES = 4 << 20, 24 << 20
#: Strings that an owner looks at together; a group is not cut.
STRINGS = 1_000_000
LAST = (1 << 63) - 1
#: Parts of the strings of an anchor whose seed stands very often: least and most bytes before the anchor; and the
#: bytes that all strings of a part share.
PARTS = ((0, 18), (19, 37), (38, 56), (57, REACH))
CORE = LENGTH - max(b - a for a, b in PARTS)
#: A seed stands very often from so many anchors on, more where otherwise more than MOST_HOT seeds could be; it is
#: looked for in one text of HOT_SAMPLE, and in a task that meets it HOT_LEAST times. Results do not depend on it.
HOT, MOST_HOT, HOT_SAMPLE, HOT_LEAST = 50_000, 100_000, 8, 4

#: t8: a hash of the text's key. Texts that share one get each other's anchors too, which costs work and changes nothing.
ANCHORS = "h long, known boolean, t8 long, packed long"
#: In place of an anchor: a bare hash.
BARE = -1


def _pack(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """An anchor's place, and how far before it the strings of this anchor start, at least and at most."""
    return place.astype(np.int64) << 16 | lo.astype(np.int64) << 8 | hi.astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray):
    """document, place in data, least and most reach of each anchor, and the hash of its SEED bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    prefix = prefix_hash(data)
    with np.errstate(over="ignore"):
        m = n - SEED + 1
        h = (prefix[SEED:] - prefix[:-SEED]) * powers(n + 1)[1][:m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= REACH + 1:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # for each start of a string, its anchor
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.repeat(offsets[:-1], sizes) + np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = at[start]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else none
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    hashes = span_hash(prefix, place, place + SEED).view(np.int64)
    return doc[first], place, place - start[last] if len(at) else none, place - start[first] if len(at) else none, hashes


def _find_anchors(batches):
    """Rows of texts -> anchors that the task has once, one bare hash for each that it has more often, and these as known."""
    schema = pa.schema([("h", pa.int64()), ("known", pa.bool_()), ("t8", pa.int64()), ("packed", pa.int64())])
    h, t8, packed = [], [], []

    def flush():
        hashes, keys, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, t8, packed))
        h.clear(), t8.clear(), packed.clear()
        order = np.argsort(hashes, kind="stable")
        hashes, keys, places = hashes[order], keys[order], places[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        often = ~new | np.r_[~new[1:], False] if len(hashes) else new
        # known anchors are dealt by a hash of their place, for they may be very many of one kind
        spread = np.where(often, mix64(places.view(np.uint64) ^ keys.view(np.uint64)).view(np.int64), hashes)
        marks = hashes[new & often]
        out = [np.r_[spread, marks], np.r_[often, np.zeros(len(marks), bool)], np.r_[keys, np.zeros(len(marks), np.int64)], np.r_[places, np.full(len(marks), BARE)]]
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], schema=schema)

    for batch in batches:
        for part in steps(batch):
            data, offsets = text_buffers(part.column("text"))
            doc, place, lo, hi, hashes = anchors(data, offsets)
            h.append(hashes)
            t8.append(part.column("t8").to_numpy()[doc])
            packed.append(_pack(place - offsets[:-1][doc], lo, hi))
        if sum(map(len, h)) > 2_000_000:
            yield from flush()
    yield from flush()


def _repeated(batches):
    """Anchors sorted by hash -> those that are known or whose hash stands twice."""
    schema = pa.schema([("t8", pa.int64()), ("packed", pa.int64())])
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column("h").to_numpy()
        if not len(h):
            continue
        # the last hash may go on in the next batch: of its rows two are enough to know that it stands twice
        cut = int(np.searchsorted(h, h[-1]))
        tail = batch.slice(cut)
        yield from _of_hashes(batch.slice(0, cut), schema)
        if tail.num_rows > 50_000:
            yield from _of_hashes(tail.slice(2), schema, True)
            tail = tail.slice(0, 2)
        held = tail
    if held is not None:
        yield from _of_hashes(held, schema)


def _of_hashes(batch, schema, all_=False):
    if batch.num_rows:
        h, known = batch.column("h").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)
        same = np.r_[False, h[1:] == h[:-1]]
        good = known | same | np.r_[same[1:], False] | all_
        mask = pa.array(good & (batch.column("packed").to_numpy() != BARE))
        yield pa.RecordBatch.from_arrays([batch.column("t8").filter(mask), batch.column("packed").filter(mask)], schema=schema)


# -- runs: front-coded blocks

#: Of an entry: prefix common with the entry before, rest of the suffix, bytes before the anchor, least reach, doc_id, place.
HEAD = struct.Struct("<BBBBqI")
#: kind 0: a block of a run, for an owner; kind 1: a span of the document ``tid`` that goes.
SENT = "kind int, owner long, run long, tid binary, block binary, start long, stop long"


def entry_bytes(shared: int, suffix: bytes, left: bytes, lo: int, doc: int, tid: bytes, place: int) -> bytes:
    return b"".join((HEAD.pack(shared, len(suffix) - shared, len(left), lo, doc, place), tid, suffix[shared:], left))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def _rows(rows: list[tuple], schema: pa.Schema):
    for i in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 5000], strict=True), schema, strict=True)], schema=schema)


def _seeds(batches):
    """Rows of texts -> seed, n of the seeds that the task meets at least HOT_LEAST times."""
    schema = pa.schema([("seed", pa.binary()), ("n", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    for batch in batches:
        for part in steps(batch):
            data, offsets = text_buffers(part.column("text"))
            _, place, *_ = anchors(data, offsets)
            if len(place):
                windows = np.lib.stride_tricks.sliding_window_view(data, SEED)[place]
                held.append(np.unique(np.ascontiguousarray(windows).view(f"V{SEED}").ravel(), return_counts=True))
            if len(held) > 64:
                held = [merged()]
    if held:
        keys, n = merged()
        often = np.flatnonzero(n >= HOT_LEAST)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i].tobytes() for i in often.tolist()], pa.binary()), pa.array(n[often])], schema=schema)


def hot_seeds(texts: DataFrame, total_bytes: int, hot: int = HOT) -> set[bytes]:
    """texts(t8, text) -> the seeds that stand very often, at most about MOST_HOT of SEED bytes each."""
    least = max(hot, total_bytes // 40 // MOST_HOT)  # there is an anchor for about forty bytes
    some = texts.where(F.pmod("t8", F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(_seeds, "seed binary, n long")
    found = some.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SAMPLE >= least)
    return {bytes(r["seed"]) for r in found.select("seed").collect()}


def _send(owners: int, shared=None):
    """Texts with their repeated anchors -> blocks of sorted runs, and spans that the task can settle."""
    schema = _schema(SENT)

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        hot = shared.value if shared is not None else ()
        entries: list[tuple] = []  # suffix, bytes before, least reach, doc_id, tid, place, what chooses the owner
        held = 0

        def flush():
            nonlocal number
            number += 1  # runs of a task are told apart
            entries.sort(key=lambda e: (e[0], e[1], e[3], e[4], e[5]))
            out, blocks, before = [], {}, {}
            last = None
            for e in entries:
                suffix, left, lo, doc, tid, place, key = e
                if last is not None and suffix == last[0] and left == last[1] and lo == last[2]:
                    # the same bytes stand in an earlier place of this run: all strings of this anchor go;
                    # the spans of one text are dealt apart, for they may be very many
                    out.append((1, int.from_bytes(tid[:7], "little") + place, 0, tid, None, place - len(left), place - lo + LENGTH))
                    continue
                last = e
                owner = int.from_bytes(hashlib.blake2b(key or suffix[:SEED], digest_size=6).digest(), "little") % owners
                if (prior := before.get(owner)) is None:
                    block, prior = blocks.setdefault(owner, []), b""
                else:
                    block = blocks[owner]
                n, most = 0, min(len(prior), len(suffix))
                if prior[:most] == suffix[:most]:
                    n = most
                else:
                    while prior[n : n + 8] == suffix[n : n + 8]:
                        n += 8
                    while prior[n] == suffix[n]:
                        n += 1
                before[owner] = suffix
                block.append(entry_bytes(n, suffix, left, lo, doc, tid, place))
            entries.clear()
            out += [(0, owner, number, None, b"".join(block), None, None) for owner, block in blocks.items()]
            yield from _rows(out, schema)

        for batch in batches:
            for tid, doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("tid", "doc_id", "text", "places")), strict=True):
                data = text.encode()
                for packed in places:
                    place, lo, hi = packed >> 16, packed >> 8 & 255, packed & 255
                    if place < hi or place - lo + LENGTH > len(data):
                        continue  # of another text with the same t8
                    doc = LAST if doc is None else doc
                    if not hot or data[place : place + SEED] not in hot:
                        entries.append((data[place : place - lo + LENGTH], data[place - hi : place], lo, doc, tid, place, None))
                        continue
                    for first, last in PARTS:
                        a, b = max(lo, first), min(hi, last)
                        if a <= b:
                            core = data[place - first : place - last + LENGTH] + b"%d" % first
                            entries.append((data[place : place - a + LENGTH], data[place - b : place], a, doc, tid, place, core))
                            held += 140
                held += 140 * len(places)
                if held > RUN_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def read_block(block: bytes):
    """The entries of a block in order: (common prefix, suffix, bytes before, least reach, doc_id, tid, place)."""
    at, suffix, size = 0, b"", HEAD.size
    while at < len(block):
        n, rest, left, lo, doc, place = HEAD.unpack_from(block, at)
        at += size
        tid = block[at : at + 16]
        at += 16
        suffix = suffix[:n] + block[at : at + rest]
        at += rest
        yield n, suffix, block[at : at + left], lo, doc, tid, place
        at += left


def merged(runs: list):
    """Entries of sorted runs in the order of their suffixes, each with the prefix it shares with the one before.

    A loser tree: of each run waits its first entry and the length of the prefix that it shares with the
    last entry put out. The one that shares more is the smaller; only of equals are bytes compared, from
    that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [iter(r) for r in runs]
    heads = [next(s, None) for s in sources] + [None] * (k - len(runs))
    common = [0 if h is not None else -1 for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length is then that of the prefix it shares with the winner."""
        x, y = common[a], common[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t, i = heads[a][1], heads[b][1], x
        if s[i:] == t[i:]:
            common[b] = len(s)
            return a, b
        while s[i : i + 8] == t[i : i + 8] and i < len(s):
            i += 8
        while i < len(s) and i < len(t) and s[i] == t[i]:
            i += 1
        if s[i : i + 1] < t[i : i + 1]:
            common[b] = i
            return a, b
        common[a] = i
        return b, a

    losers = [0] * k
    round_ = list(range(k))
    level = k // 2
    while level:
        nxt = []
        for i in range(0, len(round_), 2):
            w, lose = play(round_[i], round_[i + 1])
            losers[level + i // 2] = lose
            nxt.append(w)
        round_, level = nxt, level // 2
    winner = round_[0]
    while (entry := heads[winner]) is not None:
        yield common[winner], entry
        heads[winner] = nxt = next(sources[winner], None)
        common[winner] = -1 if nxt is None else nxt[0]  # what a run knows of its next entry is with the one just put out
        node = (k + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def spans_of(entries: list[tuple], group: np.ndarray) -> list[tuple[bytes, int, int]]:
    """Entries in groups that share SEED bytes -> (tid, start, stop) of the runs of strings that stand earlier elsewhere."""
    m = len(entries)
    order = sorted(range(m), key=lambda i: (entries[i][4], entries[i][5], entries[i][6]))
    entries, group = [entries[i] for i in order], group[order]  # now in the order of their places
    lo = np.array([e[3] for e in entries], np.int64)
    hi = np.array([len(e[2]) for e in entries], np.int64)
    width = REACH + LENGTH
    context = np.frombuffer(b"".join(e[2].rjust(REACH, b"\0") + e[1].ljust(LENGTH, b"\0") for e in entries), np.uint8).reshape(m, width)
    counts = hi - lo + 1
    row = np.repeat(np.arange(m), counts)
    back = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    key = np.empty(len(row), np.uint64)
    for first in range(0, m, 4096):
        last = min(m, first + 4096)
        prefix = prefix_hash(context[first:last].ravel())
        a, b = int(np.searchsorted(row, first)), int(np.searchsorted(row, last))
        start = (row[a:b] - first) * width + REACH - back[a:b]
        key[a:b] = span_hash(prefix, start, start + LENGTH)
    with np.errstate(over="ignore"):
        key ^= mix64(group[row].astype(np.uint64) * np.uint64(128) + back.astype(np.uint64))
    by = np.argsort(key, kind="stable")  # rows stand in the order of their places, so the first of a class is the earliest
    new = np.r_[True, key[by][1:] != key[by][:-1]]
    first_of = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    again = by[~new]
    if not len(again):
        return []
    pair = np.unique(np.stack([row[again], row[first_of[~new]]], axis=1), axis=0)
    gone_row, gone_back = [], []
    for i in range(0, len(pair), 20_000):
        x, y = pair[i : i + 20_000].T
        differs = context[x] != context[y]
        right = np.where(differs[:, REACH:].any(axis=1), differs[:, REACH:].argmax(axis=1), LENGTH)
        left = differs[:, :REACH][:, ::-1]
        left = np.where(left.any(axis=1), left.argmax(axis=1), REACH)
        most = np.minimum(np.minimum(left, hi[x]), hi[y])
        least = np.maximum(np.maximum(LENGTH - right, lo[x]), lo[y])
        good = np.flatnonzero(least <= most)
        gone_row.append(x[good])
        gone_back.append(np.stack([least[good], most[good]], axis=1))
    rows, backs = np.concatenate(gone_row), np.concatenate(gone_back)
    return [(entries[r][5], entries[r][6] - int(b), entries[r][6] - int(a) + LENGTH) for r, (a, b) in zip(rows.tolist(), backs, strict=True)]


def _merge(batches):
    """Blocks sorted by owner and run, and spans -> tid, start, stop of what goes."""
    schema = _schema("tid binary, start long, stop long")
    owner, blocks = None, {}

    def close():
        out, group, entries, strings, pending = [], [], [], 0, []
        number = 0

        def settle():
            nonlocal pending
            if len(pending) > 1:
                entries.extend(pending)
                group.extend([number] * len(pending))
            pending = []

        for shared, entry in merged([(e for b in run for e in read_block(b)) for run in blocks.values()]):
            if shared < SEED:
                settle()
                number += 1
                if strings > STRINGS:
                    out += spans_of(entries, np.array(group, np.int64))
                    entries, group, strings = [], [], 0
            pending.append(entry)
            strings += len(entry[2]) - entry[3] + 1
        settle()
        if entries:
            out += spans_of(entries, np.array(group, np.int64))
        blocks.clear()
        yield from _rows(out, schema)

    for batch in batches:
        if batch.num_rows:
            spans = batch.filter(pa.array(np.equal(batch.column("kind").to_numpy(), 1)))
            if spans.num_rows:
                yield pa.RecordBatch.from_arrays([spans.column(c) for c in ("tid", "start", "stop")], schema=schema)
        for kind, own, run, block in zip(*(batch.column(c).to_pylist() for c in ("kind", "owner", "run", "block")), strict=True):
            if kind == 0:
                if own != owner:
                    if blocks:
                        yield from close()
                    owner = own
                blocks.setdefault(run, []).append(block)
    if blocks:
        yield from close()


def _joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    """Texts with the spans that go (or null) -> their row of the result, and the bytes that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())])
    for batch in batches:
        for part in steps(batch):
            rows = []
            for doc, tid, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "tid", "text", "spans")), strict=True):
                data = text.encode()
                joined = _joined_spans([(s["start"], s["stop"]) for s in spans or () if s["tid"] == tid])
                stay, at = [], 0
                for a, b in joined:
                    stay.append(data[at:a])
                    at = b
                stay = b"".join([*stay, data[at:]])
                rows.append((doc, tid, len(data), len(data) - len(stay), len(joined), hashlib.sha256(stay).hexdigest(), stay))
            yield from _rows(rows, schema)


def remove_repeats(docs: DataFrame, with_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes), one row a document.

    A null text is the empty one. A null doc_id is the largest. Rows with equal doc_ids stand in the order
    of their texts' hashes; of rows that are equal in both, the first is the original of the others. Texts
    shorter than LENGTH bytes lose nothing; longer ones are worked on whole, whatever their length. An empty
    table gives an empty one. ``hot``: from how many anchors on a seed is dealt by more bytes.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.unhex(F.md5("text")).alias("tid"))
    size = F.octet_length("text").cast("long")
    rows = texts.select("doc_id", "tid", size.alias("n_bytes"), F.when(size < LENGTH, F.sha2("text", 256)).alias("short_sha"), F.when(size < LENGTH, F.col("text").cast("binary")).alias("short_bytes"))
    rows = kept(rows.groupBy("doc_id", "tid", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.first("short_sha").alias("short_sha"), F.first("short_bytes").alias("short_bytes")))
    long_rows = rows.where(F.col("n_bytes") >= LENGTH)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    firsts = long_rows.groupBy("tid").agg(first.alias("first"), F.count(F.lit(1)).alias("ids")).select(F.col("tid").alias("first_tid"), F.col("first.doc_id").alias("first_id"), "ids")
    placed = kept(long_rows.join(firsts, F.col("tid") == F.col("first_tid")).select("doc_id", "tid", "n_bytes", "n", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("is_first")))
    copies = small_or_none(placed.where("not is_first").select(F.col("doc_id").alias("copy_id"), F.col("tid").alias("copy_tid")))
    originals = texts.where(size >= LENGTH).join(copies, texts.doc_id.eqNullSafe(F.col("copy_id")) & (texts.tid == F.col("copy_tid")), "left_anti")
    if not placed.where("is_first and n > 1").isEmpty():
        originals = originals.dropDuplicates(["tid"])
    total = rows.agg(F.sum(F.col("n_bytes") * F.col("n"))).first()[0] or 0
    owners = max(16, total // OWNER_BYTES)
    keyed = originals.withColumn("t8", F.xxhash64("tid")).where("t8 is not null")  # the inner join's filter, so that both joins share one exchange
    by_text = keyed.repartition("t8")

    often = docs.sparkSession.sparkContext.broadcast(hot_seeds(keyed.select("t8", "text"), total, hot))
    found = keyed.select("t8", "text").mapInArrow(_find_anchors, ANCHORS).repartition("h").sortWithinPartitions("h")
    places = found.mapInArrow(_repeated, "t8 long, packed long").groupBy("t8").agg(F.collect_list("packed").alias("places"))
    sent = by_text.join(places, "t8").select("tid", "doc_id", "text", "places").mapInArrow(_send(owners, often), SENT)
    gone = sent.repartition("owner").sortWithinPartitions("kind", "owner", "run").mapInArrow(_merge, "tid binary, start long, stop long")
    spans = gone.groupBy(F.xxhash64("tid").alias("t8")).agg(F.collect_list(F.struct("tid", "start", "stop")).alias("spans"))
    cut = by_text.join(spans, "t8", "left").select("doc_id", "tid", "text", "spans")
    cut = cut.mapInArrow(_cut, f"doc_id long, tid binary, {RESULT.partition(', ')[2]}, kept_bytes binary")

    columns = [x.split()[0] for x in RESULT.split(", ")] + ["kept_bytes"] * with_bytes
    empty = F.sha2(F.lit(""), 256)
    copy = placed.withColumn("copies", F.col("n") - F.col("is_first").cast("long")).where("copies > 0")
    copy = copy.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), F.lit(b"").alias("kept_bytes"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    short = rows.where(F.col("n_bytes") < LENGTH)
    short = short.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("short_sha").alias("kept_sha256"), F.col("short_bytes").alias("kept_bytes"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return cut.select(*columns).unionByName(copy.select(*columns)).unionByName(short.select(*columns))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: By all strings of LENGTH bytes; for small tables.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS p FROM d WHERE length(h) >= 200),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM p)),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true)::INT AS new FROM f WHERE nth > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(stay.h, d.h))) AS kept_sha256
FROM d LEFT JOIN stay USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
