import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from docloom.llm import divergence

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "term", "n_terms")] + [T.StructField("doc_id", T.LongType())])
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [x.translate(LOWER) for x in TERM.findall(text or "")]
        df.update((lang, x) for x in set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        stays = [x for (l, x), n in df.items() if l == lang and n >= least]
        size = {s: sum(counts[lang, s][x] for x in stays) for s in sources}
        p = {s: {x: 1 + 10**9 * (counts[lang, s][x] + 2) // (size[s] + 2 * len(stays)) for x in stays} for s in sources}
        whole = {x: 1 + 10**9 * (sum(counts[lang, s][x] for s in sources) + 2) // (sum(size.values()) + 2 * len(stays)) for x in stays}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][x], p[o][x]) for x in stays), o.encode()) for o in sources if o != s)
            firsts = sorted((-f(p[s][x], whole[x]), x.encode()) for x in stays if counts[lang, s][x] and p[s][x] > whole[x])[:top]
            for part, found in (("pair", pairs), ("term", firsts)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def got(spark, rows, least=3, top=4, parts=3):
    df = divergence.divergence(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts), least, top)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def corpus(rng, n):
    words = ["The", "the", "THE", "é", "É", "naïve", "a1b", "x_y", "日本", "K", "K", "o'clock", *("w" * k for k in range(1, 9))]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "", "ü", "Z"])) for _ in range(n)]


def test_equals_a_plain_version(spark):
    rng = random.Random(1)
    rows = corpus(rng, 300)
    rows += rows[:40] + [(None, "xx", "a"), (None, "xx", "b"), ("only once", "yy", "a"), ("", None, None), ("word " * 300_000 + "x" * 500_000, "en", "a")]
    assert got(spark, rows) == plain(rows, 3, 4)
    assert got(spark, rows, parts=11) == plain(rows, 3, 4)


def test_sums_of_pairs_written_early(spark):
    rows = corpus(random.Random(11), 150)
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).fillna("")
    runs = divergence.term_runs(docs, 3).toArrow()
    groups = {}
    for lang, source in sorted({(lang or "", source or "") for _, lang, source in rows}):
        known = groups.setdefault(lang, (0, [], []))
        known[1].append(source)
        known[2].append(100)
    added = [Counter(), Counter()]
    for most, total in zip((1 << 22, 1), added):
        for b in divergence._parts(iter(runs.to_batches(5)), groups, 4, most):
            for x in b.to_pylist():
                total[tuple(x[c] for c in ("lang", "source", "part", "item"))] += x["value"] if x["part"] == "pair" else 0
    assert {k: v for k, v in added[0].items() if v} == {k: v for k, v in added[1].items() if v} != {}


def test_a_run_over_many_batches_and_in_many_tasks(spark):
    rng = random.Random(3)
    rows = corpus(rng, 250)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(spark, rows, parts=17) == plain(rows, 3, 4)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_runs_and_no_rows(spark):
    rng = random.Random(5)
    rows = corpus(rng, 120)
    runs = divergence.term_runs(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).fillna(""), 2).collect()
    assert all(r.docs >= 2 and sum(r.counts) >= r.docs and len(set(r.sources)) == len(r.sources) for r in runs)
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark, [("!!", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_large_counts():
    rng = random.Random(7)
    pairs = [(c := rng.randrange(1, 10**15), c + rng.randrange(10**14)) for _ in range(500)] + [(2, 2), (3, 7)]
    want = [1 + 10**9 * c // d for c, d in pairs]
    assert divergence.share(np.array([c for c, _ in pairs]), np.array([d for _, d in pairs])).tolist() == want


def test_pieces_sum_to_the_counts_however_small_the_bound(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_PIECES", 4)
    monkeypatch.setattr(divergence.TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 2})()))
    rows = corpus(random.Random(9), 60)
    batch = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows]})
    pieces = [x for b in divergence._pieces(iter([batch.slice(i, 7) for i in range(0, 60, 7)])) for x in b.to_pylist()]
    docs, n = Counter(), Counter()
    for x in pieces:
        docs[x["lang"], x["term"], x["source"]] += x["docs"]
        n[x["lang"], x["term"], x["source"]] += x["n"]
    want_docs, want_n = Counter(), Counter()
    for text, lang, source in rows:
        found = [(lang or "", x.translate(LOWER), source or "") for x in TERM.findall(text)]
        want_n.update(found)
        want_docs.update(set(found))
    assert (docs, n) == (want_docs, want_n) and len(pieces) > len(n)
    assert min(x["document"] for x in pieces) >= 2 << 33
