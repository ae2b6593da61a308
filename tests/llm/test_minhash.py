import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm import components, minhash
from docloom.llm.common import text_buffers

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.LongType())])


def shingles(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", " \n", "one", "one two three", "one  two three", "a b c d e", "hey " * 400, "hey " * 390]
    for size, copies, edits in ((150, 60, 12), (40, 30, 3), (600, 20, 25), (120, 120, 20)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(size)] = word()
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 3
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(100)) for _ in range(80)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(200)]
    return texts


@pytest.mark.parametrize("block", [512, 7])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SKETCH_BLOCK", 2 * block)
    texts = corpus()
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    bags = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and similarity(a, bags[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert {i: root(i) for i in range(len(texts))} == {i: r.class_id for i, r in got.items()}
    assert sum(r.kept for r in got.values()) == len({root(i) for i in range(len(texts))})
    assert all(r.class_size == sum(o.class_id == r.class_id for o in got.values()) for r in got.values())


def test_agreement_is_the_weighted_similarity():
    a = " ".join(f"w{i % 70}" for i in range(400))
    b = " ".join(f"w{i % 70}" for i in range(100, 420)) + " " + " ".join(f"v{i}" for i in range(80))
    import pyarrow as pa

    doc, cells, _ = minhash.cells_of(*text_buffers(pa.array([a, b])))
    hits = np.mean([np.mean(np.equal(*minhash.signatures(doc, cells ^ np.uint64(s * 2**20), 2, 400))) for s in range(1, 9)])
    assert abs(hits - similarity(shingles(a), shingles(b))) < 0.04


def test_rows_that_stay_and_empty(spark):
    long = "p q r s t u v w x y z a b c d e f g h i j k l m n o"
    rows = [(5, long, "a", 1), (2, long + " 1", "b", 1), (2, long + " 1", "b", 1), (None, long, "c", 1), (8, None, "d", 1), (9, "", "e", 1)]
    out = minhash.without_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.key) for r in out) == [(2, "b"), (8, "d"), (9, "e")]
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2, 2), (7, 6)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_short_texts_whose_hashes_shared_40_bits_stay_apart(spark):
    rows = [(1, "item 2705127", "", 0), (2, "item 3297559", "", 0), (3, "item  2705127", "", 0)]
    got = {r.doc_id: (r.class_id, r.text_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1, True), 2: (2, 2, True), 3: (1, 1, False)}


def test_identities_of_many_short_texts():
    import pyarrow as pa

    texts = pa.array([f"item {i}" for i in range(1_000_000)])
    doc, cells, (f1, f2) = minhash.cells_of(*text_buffers(texts))
    assert len(doc) == len(np.unique(cells)) == len(np.unique(f1)) == len(np.unique(f2)) == 1_000_000
    assert np.abs(np.corrcoef(f1.astype(float), f2.astype(float))[0, 1]) < 0.01


def test_very_long_texts_and_a_hot_bucket(spark):
    """Texts with a long common part, so that many stand in the same buckets and are no near duplicates."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    long = [word() for _ in range(30_000)]
    part = [word() for _ in range(70)]
    rows = [(1, " ".join(long), "", 0), (2, " ".join([*long[:29_000], *(word() for _ in range(500))]), "", 0), (3, " ".join(long[:15_000]), "", 0)]
    rows += [(10 + i, " ".join([*part, *(word() for _ in range(25))]), "", 0) for i in range(300)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3
    bags = {i: shingles(t) for i, t, *_ in rows if i >= 10}
    near = [(a, b) for a in bags for b in bags if a < b and similarity(bags[a], bags[b]) >= 0.8]
    assert not near and all(got[i] == i for i in bags)
