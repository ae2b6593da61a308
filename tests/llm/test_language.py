import random
import zlib

from pyspark.sql import types as T

from docloom.llm import language

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("order_", T.LongType())])
SOUNDS = {"xx": "ba ke lo mi nu", "yy": "sch ung ein ach ver", "zz": "éa oux ch tion ê"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang].split(), k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang, "clash", 1) for i, lang in enumerate(rng.choices(list(SOUNDS), k=900))]
    truth = {r[0]: r[2] for r in rows}
    rows += [(1000, None, "xx", "", 1), (1001, "123 !!", "yy", "", 1), (1002, "", None, "", 1), (None, prose(rng, "yy", 30), None, "", 1), (1003, prose(rng, "zz", 20_000), None, "", 1)]
    rows += [(5, prose(rng, "xx", 20), "xx", "", 1)] * 2
    got = language.identify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    of = {r.doc_id: r for r in got}
    assert [of[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert of[None].lang_pred == "yy" and of[1003].lang_pred == "zz"
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert right >= 0.97
    assert abs(sum(r.score for r in held) / len(held) - right) < 0.1  # calibrated


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, 20), lang, "", 1) for i, lang in enumerate(rng.choices(list(SOUNDS), k=300))]
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, "q", 1) for i, t, lang, *_ in rows]
    a, b = (sorted(map(str, language.identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, other))
    assert a == b


def test_nothing_to_learn_from(spark):
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    got = language.identify(spark.createDataFrame([(2, "abc", None, "", 1)], SCHEMA)).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_a_rare_language_is_sampled_whole(spark):
    """One document in 150, with a sample of a tenth of the corpus."""
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 25), lang, "", 1) for i, lang in enumerate(rng.choices(["xx", "yy"], k=6000))]
    rows += [(10_000 + i, prose(rng, "zz", 25), "zz", "", 1) for i in range(40)]
    got = language.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), most=600).collect()
    right = [r.lang_pred == "zz" for r in got if r.doc_id >= 10_000 and r.held_out]
    assert right and all(right)
    large = [r.lang_pred != "zz" for r in got if r.doc_id < 10_000 and r.held_out]
    assert sum(large) / len(large) > 0.995
    assert language.rates({"xx": 9_000_000, "zz": 500}, 12_000)["zz"] == 1
