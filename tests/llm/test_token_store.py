import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm import token_store as store

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("n_ids", T.LongType())])


def texts():
    rng = random.Random(3)
    letters = "ab the inrst  \n\t.éß日😀01\x1c\x85 '’s,"
    fixed = [None, "", " ", "a  b", "\n \n", "x\n  b ", "it's we'll", "<|endoftext|>", "a <|endoftext|> b", "x" * 3000, "word " * 9000, " " * 30_000 + "x", "\u00b2\u0301a\u200b\u3000b"]
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000))
    return fixed + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(300)] + [long[:5000] + f" {i} " + long for i in range(20)]


def test_ids_like_the_library():
    library = tokenizers.Tokenizer.from_file(store.model_path())
    some = [t or "" for t in texts()]
    assert [np.frombuffer(x, "<u4").tolist() for x in store.encoder().encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_pieces_like_the_library_whatever_stands_round_them():
    library = tokenizers.Tokenizer.from_file(store.model_path())
    rng = random.Random(5)
    parts = ["a", "'s", "don't", "\n", "\n\n", "\t", " ", "  ", "\x85", "\x1c", "\u3000", "\u200b", "é", "ß!", "日本", "3", "²", "…", "<|endof", "text|>", "_", "-", "\u0301"]
    some = ["".join(rng.choices(parts, k=rng.randint(1, 12))) + rng.choice(["", " "]) for _ in range(4000)]
    some += [" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)]
    own = store.Encoder(store.model_path())
    for i in range(0, len(some), 500):
        part = some[i : i + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, library):
        self.library, self.model, self.given = library, self, 0

    def encode_batch_fast(self, texts, **how):
        self.given += sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **how)

    def tokenize(self, word):
        self.given += len(word)
        return self.library.model.tokenize(word)


def test_a_word_is_asked_for_once_whatever_stands_round_it():
    own = store.Encoder(store.model_path())
    library, texts = own.library, ["the word, word. word;  word\n\nword:\nword" * 50, " word! the word? "]
    own.library = Counting(library)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < own.library.given < 120  # of 1,967 characters


def test_places_where_a_text_is_cut():
    library = tokenizers.Tokenizer.from_file(store.model_path())
    rng = random.Random(11)
    parts = ["a", "Bc", "\u00e9", "\u00d7", "\u00f7", "\u00df", "\u0131", "\u01c2", "\u023f", "\u0250", "\u0436", "\u05d0", "\u0301", "\u65e5", "\ud55c", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "\ufeff", "\u00a0", "\u0085", "\U0001f600"]
    parts += ["'", "'s", "'ll", ".'s", ",", "...", "!'", "-", "_", "1", "\u00b2", " ", " ", "  ", "\n", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x00", "\x0b", "\x1c", "\x7f", "<|endoftext|>", "<|end"]
    own = store.Encoder(store.model_path())
    for _ in range(12):
        some = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(1500)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_a_file_with_words_of_its_own_and_one_that_cuts_otherwise(tmp_path):
    for name, change in (("added", lambda x: x.add_tokens(["word", "!!"])), ("space", lambda x: setattr(x, "pre_tokenizer", tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=True)))):
        library = tokenizers.Tokenizer.from_file(store.model_path())
        change(library)
        library.save(f"{tmp_path}/{name}.json")
        own, texts = store.Encoder(f"{tmp_path}/{name}.json"), ["word", "a word, swords", "x!!", "", "!!!", "a  b\nC", "long " * 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_do_not_depend_on_the_documents_before():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * store.MARK_STEP).astype("<u4")
    ends = store.cuts(store.marks(ids).tolist(), 0, len(ids))
    assert ends[-1] == len(ids) and all(0 < b - a <= store.MOST for a, b in zip([0, *ends], ends))
    for at in (5, 700, store.MARK_STEP + 3):
        before = np.concatenate([ids[-at:], ids])
        marked = store.marks(before)
        assert [e - at for e in store.cuts(marked[marked >= at].tolist(), at, len(before))] == ends


def test_very_long_runs(spark, tmp_path):
    library = tokenizers.Tokenizer.from_file(store.model_path())
    texts = ["a" + " " * 1_200_000, " " * 3_000_000 + "x", "\n" * 2_000_000 + "a", "b" * 3_000_000, "!" * 1_000_000]
    folder = store.write_store(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), f"file://{tmp_path}/long")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in store.read_index(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_store_and_index(spark, tmp_path):
    rows = [(7 * i % 1000 - 5, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "no id", "", 1), (3, "again", "", 1), (3, "again", "", 1)]
    folder = store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/s")
    ids = {i: [*store.encoder().library.encode(t or "", add_special_tokens=False).ids, 0] for i, (_, t, *_) in enumerate(rows)}
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in store.read_index(spark, folder).collect())
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert got[-1][1] is None and [g[1] for g in got[:-1]] == sorted(r[0] for r in rows if r[0] is not None)
    want = sorted((r[0] is None, r[0] or 0, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, r in enumerate(rows))
    assert sorted((g[1] is None, g[1] or 0, *g[2:]) for g in got) == want
    back = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in store.read_ids(spark, folder).collect())
    assert back == sorted((r[0] is None, r[0] or 0, ids[i]) for i, r in enumerate(rows))
    objects = spark.read.parquet(f"{folder}/data").where("kind = 0")
    assert objects.count() == objects.select("hash").distinct().count()
    stored = objects.selectExpr("sum(n_ids)").first()[0]
    assert stored < 0.5 * sum(map(len, ids.values()))  # the shared passage is there once


def test_empty_table_and_damage(spark, tmp_path):
    folder = store.write_store(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert store.read_index(spark, folder).count() == 0
    folder = store.write_store(spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(9)], SCHEMA), f"file://{tmp_path}/d")
    stored = spark.read.parquet(f"{folder}/recipes")
    stored.where("kind = 2 or doc_id <> 4").write.partitionBy("kind").parquet(f"file://{tmp_path}/d2/recipes")
    spark.read.parquet(f"{folder}/data").write.partitionBy("kind").parquet(f"file://{tmp_path}/d2/data")
    with pytest.raises(Exception, match="root of its manifest"):
        store.read_index(spark, f"file://{tmp_path}/d2").collect()


def test_crcs_combine():
    a, b = b"abc" * 50, b"xyz!" * 33
    shifted = store.crc_shift(np.array([zlib.crc32(a), zlib.crc32(b)], np.uint32), np.array([len(b), 0]))
    assert int(shifted[0] ^ shifted[1]) == zlib.crc32(a + b)
