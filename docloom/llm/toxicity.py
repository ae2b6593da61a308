"""Operator 11: toxic passages by a maximum-scoring segment search over token log-odds, and a score for each document.

1. Terms, and their first bytes as features behind them, are counted in a bounded sample of labelled documents of each
   class, of which each group of near copies counts once. A feature's share of toxic documents has a Dirichlet prior around
   the share of the feature before it, one letter shorter, down to the share of all documents; its score is what this adds
   to the log-odds. So words that no document had go by how they begin.
2. A term's score less SHIFT is negative for ordinary words. One pass over a document's scores finds all maximal segments
   (Ruzzo and Tompa): none is cut, and none holds a part that would lower it.
3. The best segment of a clean document of m terms has an extreme-value distribution, 1 - exp(-K m exp(-L s)): L solves
   E[exp(L s)] = 1 over clean terms, and K is fitted to clean documents that nothing was counted in. A segment is significant if fewer than
   EXPECTED such ones are expected in a clean document as long. What the significant ones exceed by, in sum, is calibrated
   to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import kept, mix64, small_or_none, steps, table, text_buffers
from docloom.llm.language import fold
from docloom.llm.terms import spanned_terms
from docloom.llm.words import prefix_hash, span_hash

#: Labelled documents of each class that the model is fitted on, at most about.
LEARN_DOCS = 20_000
#: One part in so many of them calibrates.
CALIBRATE = 5
#: Bytes of the first letters that are features, and the weight of a feature's prior, in documents.
FIRST_BYTES, PRIOR = (3, 4, 5, 6, 7, 8), 4.0
#: What a term costs; segments of which a clean document has fewer than this are significant; the score from which one is toxic.
SHIFT, EXPECTED, TOXIC = 1.0, 0.01, 0.7
#: A feature is told apart from the one before it if their scores differ by so much, and known if so many documents have it.
LEAST_STEP, LEAST_DOCS = 0.25, 3
#: Bounds of L: scores are log-odds, for which it is about 1, and more where clean documents have no high ones.
SCALE = (0.2, 2.0)
#: Share of labels that the calibration takes for wrong, and the slopes that it tries.
NOISE, SLOPES = 0.02, (1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
#: Steps of the histogram of scores that L is fitted on.
BINS = 20
TEXT_BYTES = 4 << 20
LEVELS = len(FIRST_BYTES) + 1


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words -> hashes of their first bytes and of each whole, 0 where a word is shorter; and of each whole."""
    data, at = text_buffers(pc.utf8_lower(words))
    prefix = prefix_hash(data)
    out = np.zeros((len(words), LEVELS), np.uint64)
    size = np.diff(at)
    for k, n in enumerate(FIRST_BYTES):
        has = np.flatnonzero(size >= n)
        out[has, k] = span_hash(prefix, at[:-1][has], at[:-1][has] + n)
    whole = span_hash(prefix, at[:-1], at[1:])
    out[:, -1] = mix64(whole ^ np.uint64(1))  # a word isn't the first bytes of others
    return out, whole


def sketches(whole: np.ndarray, code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The least two hashes of each text's runs of three terms, of two kinds: equal for most near copies."""
    word = whole[code]
    out = np.empty((n, 2), np.uint64)
    for k in range(2):
        with np.errstate(over="ignore"):
            run = mix64(word + np.uint64(k))
            for j in (1, 2):
                there = np.minimum(np.arange(len(word)) + j, max(len(word) - 1, 0))
                run = mix64(run * np.uint64(3) + np.where(doc[there] == doc, word[there], np.uint64(0)))
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        out[:, k] = np.uint64(k)
        if len(starts):
            out[doc[starts], k] = np.minimum.reduceat(run, starts)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            words, code, doc, *_ = spanned_terms(part.column("text"))
            least = sketches(word_features(words)[1], code, doc, part.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least[:, 0]), pa.array(least[:, 1])], names=[*part.schema.names, "sketch0", "sketch1"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their class -> feature, the feature before it, its level, and the documents of each class that have it."""
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            words, code, doc, *_ = spanned_terms(part.column("text"))
            if not len(code):
                continue
            found = word_features(words)[0]
            before, level = np.zeros_like(found), np.broadcast_to(np.arange(LEVELS), found.shape)
            before[:, 1:] = np.maximum.accumulate(np.where(found[:, :-1] > 0, level[:, :-1] + 1, 0), axis=1)
            before = np.where(before > 0, np.take_along_axis(np.c_[np.zeros(len(found), np.uint64), found], before.astype(np.int64), axis=1), np.uint64(0))
            ids, first, inverse = np.unique(found, return_index=True, return_inverse=True)
            inverse = inverse.reshape(found.shape)
            pair = np.unique(doc * len(words) + code)
            of_doc, of_word = np.divmod(pair, len(words))
            seen = np.unique(np.concatenate([of_doc * len(ids) + inverse[of_word, k] for k in range(LEVELS)]))
            of_doc, of_id = np.divmod(seen, len(ids))
            toxic = part.column("toxic").to_numpy()[of_doc]
            counts = [np.bincount(of_id[toxic == y], minlength=len(ids)) for y in (0, 1)]
            real = ids > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[real]) for x in (ids.view(np.int64), before.ravel()[first].view(np.int64), level.ravel()[first].astype(np.int32), *counts)], names=["feature", "before", "level", "clean", "toxic"]
            )


class Model:
    """Scores of features, in order of their hashes; what is left is the calibration."""

    def __init__(self, features: np.ndarray, scores: np.ndarray):
        self.features, self.scores = features, scores
        self.scale, self.log_k, self.curve = 1.0, 0.0, (-3.0, 1.0)

    def of_words(self, words: pa.Array) -> np.ndarray:
        """The score of each word's longest known feature, less SHIFT."""
        found = word_features(words)[0]
        out = np.zeros(len(words))
        if len(self.features):
            for k in range(LEVELS):
                at = np.minimum(np.searchsorted(self.features, found[:, k]), len(self.features) - 1)
                known = self.features[at] == found[:, k]
                out[known] = self.scores[at[known]]
        return out - SHIFT

    def excess(self, score: float | np.ndarray, m: int) -> float | np.ndarray:
        """Minus the logarithm of how many segments of this score a clean document of m terms has."""
        return self.scale * score - self.log_k - np.log(max(m, 1))

    def probability(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log1p(total))))


def scored(clean: np.ndarray, toxic: np.ndarray, feature: np.ndarray, before: np.ndarray, level: np.ndarray, n_clean: int, n_toxic: int) -> Model:
    """Counts of features -> the model, without its calibration."""
    share = n_toxic / max(n_clean + n_toxic, 1)
    if not 0 < share < 1 or not len(feature):
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    order = np.argsort(feature)
    feature, before, level, clean, toxic = (x[order] for x in (feature, before, level, clean, toxic))
    theta, score, seen_as = np.empty(len(feature)), np.empty(len(feature)), np.empty(len(feature))
    stays = np.zeros(len(feature), bool)
    base = np.log(share / (1 - share))
    for k in range(LEVELS):
        at = np.flatnonzero(level == k)
        if not len(at):
            continue
        up = np.minimum(np.searchsorted(feature, before[at]), len(feature) - 1)
        has = feature[up] == before[at]
        prior = np.where(has, theta[up], share)
        told = np.where(has, seen_as[up], 0.0)  # what a word with nothing longer known would get
        theta[at] = (toxic[at] + PRIOR * prior) / (clean[at] + toxic[at] + PRIOR)
        score[at] = np.log(theta[at] / (1 - theta[at])) - base
        stays[at] = np.abs(score[at] - told) >= LEAST_STEP
        seen_as[at] = np.where(stays[at], score[at], told)
    return Model(feature[stays], score[stays])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments: start, stop and score. Linear: each positive term is pushed once and merged once."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    stack: list[tuple[int, int, float, float, int]] = []  # start, stop, sum before, sum at its end, the nearest one that begins lower
    for a, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, stop = a, a + 1
        while True:
            lower = len(stack) - 1
            while lower >= 0 and stack[lower][2] >= left:
                lower = stack[lower][4]
            if lower < 0 or stack[lower][3] >= right:
                stack.append((start, stop, left, right, lower))
                break
            start, _, left, _, _ = stack[lower]
            del stack[lower:]
    return [(start, stop, right - left) for start, stop, left, right, _ in stack]


def _of_documents(part: pa.RecordBatch, model: Model):
    """For each text: its terms' scores, and where they start and end."""
    words, code, doc, start, stop = spanned_terms(part.column("text"))
    scores = model.of_words(words)[code] if len(code) else np.zeros(0)
    again = np.flatnonzero((code[1:] == code[:-1]) & (doc[1:] == doc[:-1])) + 1
    scores[again] = np.minimum(scores[again], -SHIFT)  # counts are of documents, so the same term again adds nothing
    at = np.searchsorted(doc, np.arange(part.num_rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield scores[a:b], start[a:b], stop[a:b]


def significant(scores: np.ndarray, model: Model) -> list[tuple[int, int, float]]:
    """Segments of which a clean document has fewer than EXPECTED, with what they exceed an expectation of one by."""
    bound = -np.log(EXPECTED)
    return [(a, b, float(x)) for a, b, s in segments(scores) if (x := model.excess(s, len(scores))) >= bound]


def _clean_maxima(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Clean documents -> kind 0: their terms and best segment; kind 1: how many terms have a score, in steps of 1 / BINS."""
    hist: dict[int, int] = {}
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            sizes, best = [], []
            for scores, *_ in _of_documents(part, model):
                for k, n in zip(*(x.tolist() for x in np.unique(np.round(scores * BINS).astype(np.int64), return_counts=True)), strict=True):
                    hist[k] = hist.get(k, 0) + n
                if len(scores):
                    sizes.append(len(scores))
                    best.append(max((s for *_, s in segments(scores)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), pa.array(sizes, pa.int64()), pa.array(best, pa.float64())], names=["kind", "n", "score"])
    yield pa.RecordBatch.from_arrays([pa.array([1] * len(hist), pa.int32()), pa.array(hist.values(), pa.int64()), pa.array([k / BINS for k in hist], pa.float64())], names=["kind", "n", "score"])


def _totals(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            total = [sum(x for *_, x in significant(s, model)) for s, *_ in _of_documents(part, model)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(total, pa.float64())], names=["toxic", "total"])


def extreme_values(n: np.ndarray, score: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """A histogram of clean terms' scores, and clean documents' terms and best segments -> L and the logarithm of K."""
    low, high = SCALE
    if len(n) and n.sum():
        p = n / n.sum()
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if (p * np.exp(mid * score)).sum() > 1 else (mid, high)
    scale = (low + high) / 2
    if not len(sizes):
        return scale, 0.0
    # each m exp(-L s) has an exponential distribution with mean 1 / K
    return scale, float(np.log(len(sizes)) - np.log((sizes * np.exp(-scale * best)).sum()))


def fitted_curve(total: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The likeliest logistic curve over log1p(total) of a fine grid, where one label in 1 / NOISE is wrong: so a few odd
    documents don't flatten it."""
    x = np.log1p(total)
    best, found = -np.inf, (-3.0, 1.0)
    for slope in SLOPES:
        for middle in np.arange(0.1, 8.0, 0.1):
            p = NOISE + (1 - 2 * NOISE) / (1 + np.exp(-slope * (x - middle)))
            fit_ = float((weights * np.where(toxic > 0, np.log(p), np.log(1 - p))).sum())
            if fit_ > best:
                best, found = fit_, (float(-slope * middle), float(slope))
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> Model:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) -> the model, from the labelled documents of the folds other than
    1. What reaches the driver are counts of the sample's features, and numbers of the documents that calibrate."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = kept(known)
    of_class = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if not all(of_class.get(y) for y in (0, 1)):
        empty.curve = (-20.0 if not of_class.get(1) else 20.0, 0.0)
        return empty
    order = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    rate = {y: min(1.0, most / n) for y, n in of_class.items()}
    ids = known.where(order < F.when(F.col("toxic") == 1, int((1 << 30) * rate[1])).otherwise(int((1 << 30) * rate[0])))
    ids = ids.withColumnRenamed("doc_id", "id")  # about 2 * most rows at most
    rows = docs.select("doc_id", "text").join(small_or_none(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    sample = kept(rows.mapInArrow(_sketched, "doc_id long, text string, toxic int, sketch0 long, sketch1 long"), "zstd")
    once = sample.select("doc_id", "sketch0", "sketch1", "toxic")
    for k in ("sketch0", "sketch1"):  # of near copies the one of the least doc_id counts
        once = once.groupBy(k).agg(F.min_by(F.struct("doc_id", "sketch0", "sketch1", "toxic"), "doc_id").alias("x")).select("x.*")
    once = kept(once.select(F.col("doc_id").alias("id"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(CALIBRATE)) == 0).alias("calibrates")))
    sizes = {(r.toxic, r.calibrates): r.n for r in once.groupBy("toxic", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = once.withColumnRenamed("toxic", "toxic_")
    chosen = sample.join(small_or_none(apart), F.col("doc_id") == F.col("id")).select("text", "toxic", "calibrates")
    counted = chosen.where("not calibrates").select("text", "toxic").mapInArrow(_features, "feature long, before long, level int, clean long, toxic long")
    counts = counted.groupBy("feature").agg(F.first("before").alias("before"), F.first("level").alias("level"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = kept(counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS))
    # only what stands out, and what stands behind such a beginning, reaches the driver; all others score 0
    share = sizes.get((1, False), 0) / max(sizes.get((0, False), 0) + sizes.get((1, False), 0), 1)
    theta = (F.col("toxic") + PRIOR * share) / (F.col("clean") + F.col("toxic") + PRIOR)
    out = F.log(theta / (1 - theta)) - float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) >= LEAST_STEP
    begins = counts.where(out).select(F.col("feature").alias("begins"))
    counts = counts.where(out).unionByName(counts.where(~out).join(begins, F.col("before") == F.col("begins"), "left_semi")).toPandas()
    feature, before = (counts[c].to_numpy(np.int64).view(np.uint64) for c in ("feature", "before"))
    model = scored(*(counts[c].to_numpy(np.float64) for c in ("clean", "toxic")), feature, before, counts["level"].to_numpy(), sizes.get((0, False), 0), sizes.get((1, False), 0))
    held = kept(chosen.where("calibrates").select("text", "toxic"), "zstd")
    found = held.where("toxic = 0").mapInArrow(partial(_clean_maxima, model=model), "kind int, n long, score double").toPandas()
    terms_, docs_ = (found[found["kind"] == k] for k in (1, 0))
    model.scale, model.log_k = extreme_values(terms_["n"].to_numpy(float), terms_["score"].to_numpy(), docs_["n"].to_numpy(float), docs_["score"].to_numpy())
    totals = held.mapInArrow(partial(_totals, model=model), "toxic int, total double").toPandas()
    toxic = totals["toxic"].to_numpy(float)
    by_share = np.where(toxic > 0, 1 / rate[1], 1 / rate[0])  # the sample has a rare class more often
    model.curve = fitted_curve(totals["total"].to_numpy(), toxic, by_share / by_share.mean() if len(toxic) else by_share)
    return model


def _predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            total, n, best = [], [], []
            for scores, *_ in _of_documents(part, model):
                found = significant(scores, model)
                total.append(sum(x for *_, x in found))
                n.append(len(found))
            score = model.probability(np.array(total))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), pa.array(n, pa.int32())], names=["doc_id", "held_out", "score", "predicted", "passages"]
            )


def _passages(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("terms", pa.int32()), ("expected", pa.float64()), ("passage", pa.string())])
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            out = []
            for doc_id, text, (scores, start, stop) in zip(part.column("doc_id").to_pylist(), part.column("text"), _of_documents(part, model), strict=True):
                found = significant(scores, model)
                raw = text.as_buffer().to_pybytes() if found else b""
                out += [(doc_id, int(start[a]), int(stop[b - 1]), b - a, float(np.exp(-x)), raw[start[a] : stop[b - 1]].decode()) for a, b, x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)


def scores(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) -> doc_id, held_out, score, predicted, passages; one row a document.

    Rows whose fold() is 1 are held out: nothing is learned from them. A null text is an empty one and, as any text without
    a significant passage, gets the score of those. Labels that are null or of no document don't count; of several for a doc_id the highest does. Rows
    that share a doc_id are rows of their own. If no document of either class can be learned from, all get the other one's
    extreme. An empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), "text")
    return rows.mapInArrow(partial(_predicted, shared=model), "doc_id long, held_out boolean, score double, predicted int, passages int")


def passages(docs: DataFrame, labels: DataFrame, most: int = LEARN_DOCS) -> DataFrame:
    """-> doc_id, start, stop, terms, expected, passage: each significant toxic passage of docs, by the bytes of its text at
    which it starts and ends, and how many such ones a clean document as long has."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    return docs.select("doc_id", "text").mapInArrow(partial(_passages, shared=model), "doc_id long, start long, stop long, terms int, expected double, passage string")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
