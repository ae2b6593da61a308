import math

import numpy as np
from pyspark.sql import types as T

from docloom.llm import nearest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("shard", T.StringType()), T.StructField("rank", T.LongType())])


def rows(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20 + 1, dim))
    return [(i, [float(v) for v in (centres[i // 20] + rng.standard_normal(dim)).astype(np.float32)], "clash", 0) for i in range(n)]


def unit(x):
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def brute(data, every, k):
    good = [(i, np.array(x, np.float64)) for i, x, *_ in data if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            near = sorted((-(unit(q) @ unit(x)), j) for b, (j, x) in enumerate(good) if b != at and len(x) == len(q))
            out[i] = near[:k]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 700)
    data = rows(3000)
    data[50] = (50, None, "", 0)
    data[60] = (60, [0.0] * 16, "", 0)
    data[70] = (70, [1.0] * 15 + [float("nan")], "", 0)
    data[80] = (80, [1.0] * 15 + [None], "", 0)
    want = brute(data, 50, 5)
    got = {}
    for r in nearest.search(spark.createDataFrame(data, SCHEMA).repartition(3), 50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and 50 not in got
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        true = {j: -s for s, j in want[q]}
        hits += sum(j in true for _, j, _ in found)
        assert all(abs(true[j] - s) < 1e-12 for _, j, s in found if j in true)
    assert hits >= 0.9 * 5 * len(want)


def test_few_rows_ties_and_repeats(spark):
    same = [1.0, 2.0, 3.0]
    data = [(0, same, "", 0), (9, same, "", 0), (3, same, "", 0), (3, same, "", 0), (5, [1.0, 1.0], "", 0), (None, same, "", 0), (7, [], "", 0)]
    got = nearest.search(spark.createDataFrame(data, SCHEMA), 50).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 3), (0, 2, 3), (0, 3, 9)]
    assert all(abs(r.score - 1) < 1e-12 for r in got)
    assert nearest.search(spark.createDataFrame([], SCHEMA), 50).count() == 0


def test_extreme_components(spark):
    wide = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    data = [(0, [1e-200, 2e-200]), (1, [1e200, 1e200]), (2, [3e-320, -1e-320]), (3, [1.7e308, 1.7e308]), (4, [-1.0, 1e-300]), (50, [5e-324, 0.0]), (5, [1e-200, 2e-200])]
    want = brute(data, 50, 5)
    for r in nearest.search(spark.createDataFrame(data, wide), 50).collect():
        cosine, vec_id = want[r.query_id][r["rank"] - 1]
        assert abs(-cosine - r.score) < 1e-12 and (vec_id == r.vec_id or abs(dict((j, c) for c, j in want[r.query_id])[r.vec_id] - cosine) < 1e-12)


def test_candidates_do_not_grow_with_the_rows():
    assert [nearest.budget(n) * n for n in (1, 4, 16)] == [1024, 4 * 320, 16 * 96]
    recall = []
    for n in (4000, 16000):
        vectors = nearest.unit(np.random.default_rng(n).standard_normal((n, 64)))
        index, verified, hits = nearest.ShardIndex(vectors), 0, 0
        levels = list(index.windows(vectors[:40] @ index.axes))
        for i in range(40):
            found = index.candidates([(lo[i], hi[i]) for lo, hi in levels], nearest.budget(1))
            verified += len(found)
            hits += len(set(found) & set(np.argsort(-(vectors @ vectors[i]))[1:6]))
        recall.append(hits / 200)
        assert verified < 40 * 2 * nearest.CANDIDATES
    assert min(recall) >= 0.9, recall
