import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm import sentencepiece_bpe as bpe

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=bpe.model_path())


def texts():
    rng = random.Random(5)
    letters = "ab theinrst  ▁\n\t.éßñ日😀ﬁ01\x00́<>s/"
    fixed = [None, "", " ", "  ", "▁", "a▁b", "x" * 5000, "ab" * 3000, "日本" * 200, "<s>a</s>", "<0x41>", "\r\n \x0b"]
    return fixed + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(800)]


def test_against_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    ids = bpe.encode(df)
    plain = {r.doc_id: r.ids for r in ids.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(ids).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert plain[i] == want and back[i] == library.decode(want)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_any_ids(library):
    rng, pieces = random.Random(6), bpe.piece_table()
    for _ in range(2000):
        ids = [rng.randrange(400) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_long_words_merge_alike(monkeypatch, library):
    pieces = bpe.piece_table()
    words = [w for t in texts() if t for w in pieces.words(pieces.processor.normalize(t))]
    rounds = pieces.merge_words(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert pieces.merge_words(words) == rounds
    monkeypatch.setattr(pieces, "apart", 1 << 40)  # one pair of a word in a round
    monkeypatch.setattr(pieces, "unsafe", np.ones_like(pieces.unsafe))
    assert pieces.merge_words(words[:300]) == rounds[:300]


def test_very_long_words(library):
    rng = random.Random(7)
    pieces = bpe.piece_table()
    for _ in range(300):
        word = "".join(rng.choices(["th", "ing", "some", "hat", "t", "h", "e", "in", "g", " ", "▁▁▁", "to", "rad"], k=rng.randint(20, 200)))
        assert np.frombuffer(pieces.encode([word])[0], "<u4").tolist() == library.encode(word, add_bos=True, add_eos=True)
    words = ["a" * 1_000_000, "ab" * 100_001, "".join(rng.choices("theinrsoa", k=60_000)), "".join(rng.choices("0123456789abcdef", k=60_000)), "日本語" * 50_000, "." * 99_999, "e" * 65_537, " " * 100_003 + "the", "  the" * 9_999, "\t" * 50_000]
    for word in words:
        assert np.frombuffer(pieces.encode([word])[0], "<u4").tolist() == library.encode(word, add_bos=True, add_eos=True)


def test_the_older_words_go(library):
    pieces = bpe.PieceTable(bpe.model_path())
    pieces.cache.most = 2000
    for t in texts()[1:200]:
        assert np.frombuffer(pieces.encode([t])[0], "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)
    assert len(pieces.cache.young) + len(pieces.cache.older) < 100
