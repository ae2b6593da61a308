import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from docloom.llm import suffixes

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tid", T.StringType()), T.StructField("h", T.LongType())])


def brute(rows):
    """By a dictionary of all strings; rows in the order of doc_id."""
    seen, out = set(), []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            else:
                seen.add(s)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (18, 30, 60, 25)]
    texts = [None, "", "short", "short", "x" * 99, "x" * 99, "x" * 250, "x" * 251, "ab" * 300, "And " * 200, "\0" * 130, "\0" * 128 + "a"]
    for _ in range(120):
        parts = [text(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts.insert(rng.randrange(len(parts) + 1), p if rng.random() < 0.5 else p[a:b])
        texts.append(rng.choice(["\n", " "]).join(parts))
    texts += [texts[30]] * 40 + [texts[31] + "!", texts[32][5:], texts[33] * 3]
    base = text(80).split()
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = word()
        texts.append(" ".join(w))
    texts.append(text(9000) + passages[2])
    rng.shuffle(texts)
    return [(3 * i - 50, t, "clash", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 4])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SAMPLE", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seeds = suffixes.hot_seeds(docs.where("text is not null").selectExpr("xxhash64(text) as t8", "text"), 0, hot)
    assert bool(seeds) == (hot == 4) and all(len(s) == suffixes.SEED for s in seeds)
    got = suffixes.remove_repeats(docs, hot=hot).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


class Shared:
    def __init__(self, value):
        self.value = value

    @staticmethod
    def get():
        return Shared

    @staticmethod
    def partitionId():
        return 0


def sent(texts, hot):
    """Entries by owner of texts that hold one anchor in their middle, from one task."""
    places = [[suffixes._pack(np.array([150]), np.array([0]), np.array([76])).item()] for _ in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([hashlib.md5(t.encode()).digest() for t in texts]), pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(places, pa.list_(pa.int64()))], names=["tid", "doc_id", "text", "places"]
    )
    owners = {}
    for part in suffixes._send(64, Shared(hot))(iter([batch])):
        for kind, owner, block in zip(*(part.column(c).to_pylist() for c in ("kind", "owner", "block")), strict=True):
            if kind == 0:
                owners[owner] = owners.get(owner, 0) + sum(1 for _ in suffixes.read_block(block))
    return owners


def test_a_phrase_with_many_surroundings_has_many_owners(monkeypatch):
    monkeypatch.setattr(suffixes, "TaskContext", Shared)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    phrase = text(24)
    texts = [text(150) + phrase + text(150) for _ in range(5000)]
    whole, parted = sent(texts, set()), sent(texts, {phrase.encode()})
    assert len(whole) == 1 and sum(whole.values()) == 5000
    assert len(parted) == 64 and sum(parted.values()) == 4 * 5000 and max(parted.values()) < 0.03 * 4 * 5000


def test_repeated_ids_null_ids_and_empty(spark):
    t = "".join(random.Random(1).choices("abcdef ", k=150))
    rows = [(1, t, "", 0), (1, t, "", 0), (None, t, "", 0), (None, "z" + t, "", 0), (2, None, "", 0), (2, "", "", 0)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 1, 150, 0, 0), (False, 1, 150, 150, 1), (False, 2, 0, 0, 0), (False, 2, 0, 0, 0), (True, 0, 150, 150, 1), (True, 0, 151, 150, 1)]
    assert suffixes.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_keeps_order_and_common_prefixes():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choices("ab", k=100)).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]

    def coded(run):
        before = None
        for s in run:
            n = 0
            while before is not None and n < 100 and s[n] == before[n]:
                n += 1
            yield (n, s)
            before = s

    out = list(suffixes.merged([coded(r) for r in runs]))
    assert [e[1] for _, e in out] == sorted(s for r in runs for s in r)
    for (_, (_, a)), (n, (_, b)) in zip(out, out[1:]):
        assert a[:n] == b[:n] and (n == 100 or a[n] != b[n])
    assert list(suffixes.merged([])) == []
