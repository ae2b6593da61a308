import hashlib
import random

import pytest
from pyspark.sql import types as T

from docloom.llm import exact_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("entry", T.LongType())])


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(text or ""), doc))
    out = []
    for norm, g in groups.items():
        keep = min(g)[1]
        out += [(doc, keep, len(g), doc == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, doc in g]
    return sorted(out)


@pytest.mark.parametrize(("key_bits", "driver_bits"), [(64, 16), (3, 16), (64, 2), (64, 1)])
def test_against_brute_force(spark, key_bits, driver_bits):
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "ab", "a b", "x" * 200_000, "é\n\tà", "éà  "] + ["".join(rng.choices("ab \n", k=rng.randint(0, 6))) for _ in range(400)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts + ["hot copy"] * 300)]
    got = exact_dedup.duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=4, key_bits=key_bits, driver_bits=driver_bits)
    assert sorted(map(tuple, got.drop("text_hash").collect())) == brute(rows)


def test_rows_that_stay(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (1, "c", "x", 1), (2, "ab ", "y", 2), (3, "c", "y", 2), (None, "c", "z", 3), (4, None, "z", 3), (5, "", "z", 3)]
    out = exact_dedup.without_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, "a b"), (1, "c"), (4, None)], key=str)
    assert exact_dedup.without_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_directory_covers_all_slots():
    depth, slots = exact_dedup.directory({0: 50, 1: 60, 40000: 5}, 100)
    assert len(slots) == 1 << depth and depth == 16
    assert slots[0] != slots[1] and set(slots) == set(range(max(slots) + 1))
    assert exact_dedup.directory({}, 5) == (0, [0])
    assert [exact_dedup.deeper(n, 512) for n in (0, 512, 513, 5_000, 10**9)] == [0, 0, 1, 4, 21]


def test_names_that_clash(spark):
    names = "doc_id long, text string, other_id long, stay_id long, text_hash string, stay_hash int, text_hash_ int"
    rows = [(1, "a b", 5, 6, "x", 1, 2), (2, "ab", 5, 6, "x", 1, 2), (3, "c", 5, 6, "y", 1, 2), (3, "c", 5, 6, "y", 1, 2)]
    out = exact_dedup.without_duplicates(spark.createDataFrame(rows, names))
    assert out.columns == [x.split()[0] for x in names.split(", ")] and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
