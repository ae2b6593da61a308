import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm import toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.StringType()), T.StructField("id", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
CLEAN, STEMS = "ba ke lo mi nu ta se ri po du".split(), ("zorg", "vexi")


def prose(rng, n, toxic=0):
    words = ["".join(rng.choices(CLEAN, k=rng.randint(1, 4))) for _ in range(n)]
    for _ in range(toxic):
        words.insert(rng.randint(0, len(words)), rng.choice(STEMS) + "".join(rng.choices(CLEAN, k=rng.randint(1, 3))))
    return " ".join(words).capitalize() + "."


def corpus(rng, n, first=0):
    docs, labels = [], []
    for i in range(first, first + n):
        toxic = int(rng.random() < 0.15)
        docs.append((i, prose(rng, rng.randint(8, 120), 6 * toxic), "clash", 1))
        labels.append((i, toxic, "x"))
    return docs, labels


def plain_segments(scores, at=0):
    """The best segment, and those left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    s, _, i, j = best
    return [*plain_segments(scores[:i], at), (at + i, at + j, s), *plain_segments(scores[j:], at + j)]


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    scores = [rng.uniform(-2, 1.8) for _ in range(rng.randint(0, 40))]
    got, want = toxicity.segments(np.array(scores)), plain_segments(scores)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_segments_are_found_in_linear_time():
    scores = np.where(np.arange(1_000_000) % 2, -1.0, 1.0 - 1e-7 * np.arange(1_000_000))
    assert len(toxicity.segments(scores)) > 100_000
    assert toxicity.segments(-np.ones(5)) == []


def test_held_out_documents_and_odd_texts(spark):
    rng = random.Random(3)
    docs, labels = corpus(rng, 900)
    truth = {i: t for i, t, _ in labels}
    docs += [(2000, None, "", 1), (2001, "", "", 1), (2002, "123 !!", "", 1), (None, prose(rng, 40, 8), "", 1), (2003, prose(rng, 60_000), "", 1), (2004, prose(rng, 60_000) + prose(rng, 3, 9), "", 1)]
    docs += [docs[5]] * 3
    labels += [(5, truth[5], "again"), (None, 1, ""), (99_999, 1, ""), (7, None, "")]
    got = toxicity.scores(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    of = {r.doc_id: r for r in got}
    assert not any(of[i].predicted for i in (2000, 2001, 2002, 2003)) and of[None].predicted and of[2004].predicted
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.98 * len(held) and sum(t for _, t in held) > 10


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(4)
    docs, labels = corpus(rng, 300)
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, "y") for i, t, _ in labels]
    a, b = (sorted(map(str, toxicity.scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, other))
    assert a == b


def test_passages_are_spans_of_the_text(spark):
    rng = random.Random(5)
    docs, labels = corpus(rng, 500)
    docs.append((9_000, "É " + prose(rng, 30) + " Zorgba, vexike ZORGLO!  " + prose(rng, 30) + " zorgmi vexita", "", 1))
    found = toxicity.passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("doc_id = 9000").sort("start").collect()
    assert [r.passage for r in found] == ["Zorgba, vexike ZORGLO", "zorgmi vexita"]
    raw = docs[-1][1].encode()
    assert all(raw[r.start : r.stop].decode() == r.passage and r.expected < toxicity.EXPECTED for r in found)
    assert [r.terms for r in found] == [3, 2]


def test_copies_count_once(spark):
    """A toxic document with three hundred copies teaches no more of its ordinary words than one does."""
    rng = random.Random(6)
    docs, labels = corpus(rng, 400)
    odd = prose(rng, 60, 5)
    docs += [(5_000 + i, odd + f" {prose(rng, 1)}", "", 1) for i in range(300)]
    labels += [(5_000 + i, 1, "") for i in range(300)]
    clean = " ".join(w for w in odd.split() if not w.lower().startswith(STEMS))
    docs.append((9_999, clean, "", 1))
    got = toxicity.scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).where("doc_id = 9999").first()
    assert not got.predicted


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.scores(spark.createDataFrame([], DOCS), none).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "", 1)], DOCS)
    assert toxicity.scores(docs, none).first().predicted == 0
    assert toxicity.scores(docs, spark.createDataFrame([(i, 1, "") for i in range(9)], LABELS)).first().predicted == 1


def test_extreme_values():
    """L and K of scores for which they are known: +1 or -1, so that the best segment of m terms is about a Gumbel."""
    rng = np.random.default_rng(1)
    p = 0.2
    steps = np.where(rng.random((400, 3_000)) < p, 1.0, -1.0)
    best = np.array([max(s for *_, s in toxicity.segments(row)) for row in steps])
    scale, log_k = toxicity.extreme_values(np.array([(1 - p) * 1e6, p * 1e6]), np.array([-1.0, 1.0]), np.full(400, 3_000.0), best)
    assert abs(scale - np.log((1 - p) / p)) < 1e-6
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0))
    model.scale, model.log_k = scale, log_k
    bound = (np.log(3_000) + log_k + np.log(20)) / scale  # one in twenty documents
    assert 0.01 < (best >= bound).mean() < 0.12
