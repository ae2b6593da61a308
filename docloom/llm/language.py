"""Operator 5: language by a sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of one to three letters, texts in lower case, everything between letters one
space. Document frequencies are counted over all documents to learn from. The regression is fitted on a
bounded sample of them by follow-the-regularised-leader with elastic-net penalties: each of SHARDS
groups of the sample fits its own weights, which are averaged, and a temperature calibrates the scores
on a part of the sample that no shard has seen.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import kept, mix64, steps, table, text_buffers

#: About how many documents the regression is fitted on, and the groups that fit it.
TRAIN_DOCS, SHARDS, EPOCHS = 12_000, 16, 2
#: A language has all its documents in the sample up to so many, whatever share of the corpus they are.
LEAST_OF_LANG = 1_000
#: A language with fewer documents to fit on than this for each shard is fitted in every shard.
LEAST_OF_SHARD = 8
#: Hashed features.
FEATURES = 1 << 15
#: Follow-the-regularised-leader: step size, its offset, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
#: One part in so many of the sample calibrates.
CALIBRATE = 8
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    """Code points -> 0 where no letter stands, else the letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return np.where(_LETTER[0][points], points, 0)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts -> hashed n-grams of all, and the texts' offsets into them. A text without a letter has none."""
    column = column.cast(pa.large_string()).fill_null("")
    import pyarrow.compute as pc

    data, offsets = text_buffers(pc.utf8_lower(column))
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    at = heads[offsets]
    points = _letters(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"))
    n = len(at) - 1
    # a gap before each text, and of each run of gaps only the first
    doc = np.repeat(np.arange(n), np.diff(at))
    stream = np.zeros(len(points) + n + 1, np.uint64)
    stream[np.arange(len(points)) + doc + 1] = points
    owner = np.zeros(len(stream), np.int64)
    owner[np.arange(len(points)) + doc + 1] = doc
    owner[at + np.arange(n + 1)] = np.arange(n + 1)
    keep = (stream > 0) | np.r_[True, stream[:-1] > 0] | np.r_[True, owner[1:] != owner[:-1]]
    stream, owner = stream[keep], owner[keep]
    grams, of = [], []
    with np.errstate(over="ignore"):
        one = mix64(stream + np.uint64(1))
        two = mix64(one[:-1] * np.uint64(3) + one[1:])
        three = mix64(two[:-1] * np.uint64(5) + one[2:])
    letter = stream > 0
    for size, g in ((1, one), (2, two), (3, three)):
        m = len(stream) - size + 1
        if m <= 0:
            continue
        good = letter[:m].copy()
        for i in range(1, size):
            good |= letter[i : i + m]
        good &= owner[:m] == owner[size - 1 :]
        where = np.flatnonzero(good)
        grams.append((g[where] & np.uint64(FEATURES - 1)).astype(np.int64))
        of.append(owner[where])
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return grams[order], np.r_[0, np.cumsum(np.bincount(of, minlength=n)[:n])]


def counted(column: pa.Array):
    """For each text, its features and how often each stands."""
    grams, at = features(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 4000:
            n = np.bincount(grams[a:b], minlength=FEATURES)
            found = np.flatnonzero(n)
            yield found, n[found]
        else:
            yield np.unique(grams[a:b], return_counts=True)


def weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; term frequencies count by their logarithm."""
    x = (1 + np.log(n)) * idf[found]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def _frequencies(batches):
    """Rows of texts -> feature, documents that have it; feature -1 counts the documents. A task adds up what it has read."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for part in steps(batch):
            for found, _ in counted(part.column("text")):
                total[found] += 1
                total[-1] += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(found == FEATURES, -1, found)), pa.array(total[found])], names=["feature", "n"])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit_shard(group: pd.DataFrame, idf: np.ndarray, langs: list[str]) -> pd.DataFrame:
    """A shard of the sample -> its weights other than zero. The last feature is the intercept, without a penalty on its size."""
    size = FEATURES + 1
    z, n = np.zeros((size, len(langs))), np.zeros((size, len(langs)))
    l1 = np.full(size, L1)
    l1[-1] = 0.0
    index = {x: i for i, x in enumerate(langs)}
    group = group.sort_values(["order_", "doc_id"])
    rows = [(np.r_[f, FEATURES], np.r_[weighted(f, c, idf), 1.0], index[lang]) for (f, c), lang in zip(counted(pa.array(group["text"], pa.string())), group["lang"], strict=True) if len(f)]

    def weights(at: np.ndarray) -> np.ndarray:
        zz, reg = z[at], l1[at, None]
        return np.where(np.abs(zz) <= reg, 0.0, -(zz - np.sign(zz) * reg) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in rows:
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error[None]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    at, lang = np.nonzero(w)
    return pd.DataFrame({"feature": at.astype(np.int64), "lang_id": lang.astype(np.int64), "w": w[at, lang]})


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.temperature = langs, idf, weights, temperature

    def logits(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weighted(found, n, self.idf) @ self.weights[found] + self.weights[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature of the least (weighted) mean cost, on a fine grid of powers."""
    if not len(labels):
        return 1.0
    grid = 2.0 ** np.linspace(-5, 3, 161)
    cost = [np.average(-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)), weights=weights) for t in grid]
    return float(grid[int(np.argmin(cost))])


def _logits(batches, model=None):
    for batch in batches:
        for part in steps(batch):
            out = [model.logits(f, n).tolist() if len(f) else None for f, n in counted(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(out, pa.list_(pa.float64()))], names=["lang", "logits"])


def _predict(batches, shared=None):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    model = shared.value
    for batch in batches:
        for part in steps(batch):
            lang, score = [], []
            for found, n in counted(part.column("text")):
                if len(found) and model.langs:
                    p = softmax(model.logits(found, n) / model.temperature)
                    best = int(p.argmax())
                    lang.append(model.langs[best])
                    score.append(float(p[best]))
                else:
                    lang.append(UNKNOWN)
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score)], schema=schema)


def fold() -> Column:
    """crc32 of the doc_id as text modulo 3; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def rates(of_lang: dict[str, int], most: int = TRAIN_DOCS) -> dict[str, float]:
    """Documents by language -> the share of each language to sample: the flat one, or more for LEAST_OF_LANG documents."""
    flat = min(1.0, most / max(sum(of_lang.values()), 1))
    return {lang: max(flat, min(1.0, LEAST_OF_LANG / n)) for lang, n in of_lang.items()}


def shift(true: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """What to add to the intercepts of a model fitted on ``fitted`` rows of each language where the corpus has ``true`` ones."""
    ratio = np.log(np.maximum(true, 1)) - np.log(np.maximum(fitted, 1))
    return ratio - ratio.max(initial=-np.inf) if len(ratio) else ratio


def fit(learn: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """learn(doc_id, text, lang) -> the model. What reaches the driver is a number a feature and language, and the calibration part's logits."""
    frequencies = learn.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    total = int(frequencies.loc[frequencies["feature"] == -1, "n"].sum())
    frequencies = frequencies[frequencies["feature"] >= 0]
    seen = np.zeros(FEATURES, np.int64)
    seen[frequencies["feature"].to_numpy()] = frequencies["n"].to_numpy()
    idf = np.log((1 + total) / (1 + seen)) + 1
    of_lang = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(of_lang)
    if not langs:
        return Model([], idf, np.zeros((FEATURES + 1, 0)))
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    bounds = learn.sparkSession.createDataFrame([(lang, int((1 << 30) * r)) for lang, r in rates(of_lang, most).items()], "lang_ string, below_ long")
    sample = learn.withColumn("order_", order).join(F.broadcast(bounds), F.col("lang") == F.col("lang_")).where(F.col("order_") < F.col("below_"))  # bounds: a row a language
    sample = kept(sample.select("doc_id", "text", "lang", "order_", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(CALIBRATE * SHARDS)).alias("part")))
    sampled = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a rare language goes to every shard, and one of very few documents has none to spare for the calibration
    few = F.col("lang").isin([lang for lang in langs if sampled.get(lang, 0) < 2 * CALIBRATE])
    rare = F.col("lang").isin([lang for lang in langs if sampled.get(lang, 0) < LEAST_OF_SHARD * SHARDS])
    shards = F.when(rare, F.sequence(F.lit(0), F.lit(SHARDS - 1))).otherwise(F.array((F.col("part") % SHARDS).cast("int")))
    train = sample.where(few | (F.col("part") >= SHARDS)).withColumn("shard", F.explode(shards))
    fitted = train.groupBy("shard").applyInPandas(lambda group: _fit_shard(group, idf, langs), "feature long, lang_id long, w double")
    averaged = fitted.groupBy("feature", "lang_id").agg((F.sum("w") / max(train.select("shard").distinct().count(), 1)).alias("w")).toPandas()
    weights = np.zeros((FEATURES + 1, len(langs)))
    weights[averaged["feature"].to_numpy(np.int64), averaged["lang_id"].to_numpy(np.int64)] = averaged["w"].to_numpy()
    # intercepts by the true shares: the sample has rare languages more often than the corpus
    seen_as = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights[-1] += shift(np.array([of_lang[x] for x in langs], float), np.array([seen_as.get(x, 0) for x in langs], float))
    model = Model(langs, idf, weights)
    rest = sample.where(~few & (F.col("part") < SHARDS)).select("lang", "text").mapInArrow(partial(_logits, model=model), "lang string, logits array<double>").where("logits is not null").collect()
    labels = np.array([langs.index(r["lang"]) for r in rest], np.int64)
    by_share = np.array([of_lang[x] / max(sampled.get(x, 0), 1) for x in langs])[labels]
    model.temperature = best_temperature(np.array([r["logits"] for r in rest]).reshape(-1, len(langs)), labels, by_share)
    return model


def identify(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score; one row a document.

    Rows whose fold() is 1 are held out: nothing is learned from them. A null text or one without a
    letter is ``und`` with score 0, as is every text if there is nothing to learn from. Rows that share
    a doc_id are rows of their own.
    """
    learn = docs.where((fold() != 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(learn, most))
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), "text")
    return rows.mapInArrow(partial(_predict, shared=model), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
