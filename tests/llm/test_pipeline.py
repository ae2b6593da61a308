import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from docloom.llm import mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('p')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def junk(text):
    words = text.split()
    marked = sum(bool(re.search(r"(!!|\*\*\*|###|\$\$\$|%%%|&&&|\|)$", w)) for w in words)
    return marked + sum(a == b for a, b in zip(words, words[1:])) > 0.5 * len(words)


def test_quality_keeps_clean_and_drops_junk(stages):
    before, after = stages[0], stages[1]
    assert list(after.columns) == COLUMNS
    left = set(after.doc_id)
    clean = [d for d, t in zip(before.doc_id, before.text) if not re.search(r"!!|\*\*\*|###|\$\$\$|%%%|&&&|\|", t) and not junk(t) and len(t) > 200]
    dirty = [d for d, t in zip(before.doc_id, before.text) if junk(t) and len(t) > 200]
    assert sum(d in left for d in clean) >= 0.99 * len(clean) and sum(d in left for d in dirty) <= 0.2 * len(dirty)


def test_exact_copies(stages):
    before, after = stages[1], stages[2]
    best = {}
    for d, t in zip(before.doc_id, before.text):
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), d))
    assert sorted(after.doc_id) == sorted(d for _, d in best.values()) and list(after.columns) == COLUMNS


def test_near_copies(stages):
    before, after = stages[2], stages[3]
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in before.text]
    label = list(before.doc_id)
    for i in range(len(bags)):
        for j in range(i):
            if 0.8 * max(bags[i].total(), bags[j].total()) <= min(bags[i].total(), bags[j].total()) and 5 * (bags[i] & bags[j]).total() >= 4 * (bags[i] | bags[j]).total():
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert sorted(after.doc_id) == sorted(set(label)) and list(after.columns) == COLUMNS


def test_mixing_and_tokens(stages, spark):
    before, mixed, last = stages[3], stages[4], stages[5]
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert mixed.doc_id.value_counts().to_dict() == {d: c for d, c in want.items() if c}
    assert len(last) == len(mixed) and list(mixed.columns) == COLUMNS
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    texts = dict(zip(mixed.doc_id, mixed.text))
    for r in last.itertuples():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_gives_the_last_stage(stages, spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, stages[-1].itertuples(index=False)))
