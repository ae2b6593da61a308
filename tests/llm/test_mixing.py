import math

from pyspark.sql import types as T

from docloom.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType())])


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else left * weight[s] / free for s in names}
        above = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        stopped |= above


def test_targets_and_copies(spark):
    rows, k = [], 0
    for source, n in ((None, 30), ("a", 400), ("b", 5), ("c", 60), ("é", 2), ("empty", 3)):
        for i in range(n):
            rows.append((k, source, None if source == "empty" else "w " * (1 + (i * 7) % 23) + " ", "clash"))
            k += 1
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    want = water_fill(sizes)
    for s, t in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], t, rel_tol=1e-12, abs_tol=1e-9) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 60
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "a", "x y", ""), (1, "a", "x y", ""), (None, "a", None, None)]
    assert len(mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()) == 3
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_that_clash_and_very_long_texts(spark):
    names = "doc_id long, text string, source string, id_ long, mix_id long, copies_ int, own_hash string, copy_ int"
    rows = [(i, "w " * (i + 1), "ab"[i % 2], 5, 6, 1, "x", 2) for i in range(40)] + [(99, "long " * 400_000, "c", 5, 6, 1, "x", 2)]
    docs = spark.createDataFrame(rows, names)
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in taken.items() if n}
