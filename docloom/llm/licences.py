"""Operator 2: licence families of paragraphs. DataFrame and SQL functions only.

A multinomial logistic regression with an elastic net over word one- and two-grams tells the families
and an unknown class apart. It is trained here on windows of the notices below against all paragraphs of the
corpus; its temperature is fitted on rows that it has not seen. A prediction
counts only if the paragraph also holds most of the distinctive n-grams of a notice of that family.

Scale: the n-grams of notices, a few hundred, are the only ones that count, and a fixed set that expressions hold. One scan
of the texts writes which of them each paragraph has; the fit counts these, and since paragraphs with the same
features are one weighted row, it meets far fewer rows than paragraphs. N-grams that are common in the corpus are no features,
so few rows are left to shuffle. Notices may be wrapped: what is scored are windows of up to WRAPPED neighbouring
lines, of the features found only, and only near lines that have enough of one family.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import kept, table

UNKNOWN = "unknown"
#: An n-gram in more than this share of the paragraphs is no feature; those with a notice add nothing to its count.
COMMON = 0.003
#: The least probability of a family, and the least share of a notice's n-grams.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6
#: The most lines that one wrapped notice may take.
WRAPPED = 12
#: Rows of the training table for each task that fits on them.
TRAINING_ROWS = 20_000
TEMPERATURES = [0.25 * 1.1**i for i in range(40)]

#: Notices of each family (fixed values: the usual wording of public licences).
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD License",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Dedicated to the public domain under CC0 1.0 Universal"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "proprietary": ["All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher"],
}
#: What stands after FRAME where a file names its licence by an identifier, but for versions (fixed values: SPDX identifiers).
IDENTIFIERS = {
    "apache-2.0": "Apache-2.0", "mit": "MIT", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL", "bsd": "BSD", "mpl": "MPL", "cc-by-nc": "CC-BY-NC", "cc-by-sa": "CC-BY-SA",
    "cc-by": "CC-BY", "cc0": "CC0-1.0", "unlicense": "Unlicense",
}
#: The words before an identifier. They and their pairs are in every such line, so they are no features.
FRAME = "SPDX-License-Identifier"
#: Paragraphs that speak of such things and are no notice.
NO_NOTICES = [
    "The MIT researchers published their results this year", "The Apache helicopter landed", "He lost his driving license in the city",
    "This work is hard and it is under review", "The general public may visit the library", "All rights and duties are described in the contract",
    "Permission to leave was granted", "The software is in version 2", "The foundation published a free book", "Creative people use common tools",
    "SPDX-License-Identifier: see the file beside", "The identifier of the licence is listed in SPDX", "The source of the river is under the hill", "A copy of the letter was reserved for the author", "Copyright law is taught here", "The public domain of the state",
]


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(words: str) -> Column:
    """Hashes of the words and pairs of neighbours in the array column ``words``, one for each place."""
    pairs = F.expr(f"transform(slice({words}, 2, size({words})), (w, i) -> xxhash64({words}[i], w))")
    return F.concat(F.transform(F.col(words), lambda w: F.xxhash64(w)), pairs)


def _among(grams: Column, known: list[int]) -> Column:
    """The distinct ones of an array that are known."""
    return F.array_distinct(F.filter(grams, lambda g: g.isin(known)))


def _every_notice() -> dict[str, list[str]]:
    return {family: texts + [f"{FRAME}: {x}" for x in [IDENTIFIERS.get(family)] if x] for family, texts in NOTICES.items()}


def _notices(spark: SparkSession) -> DataFrame:
    rows = [(family, i, text) for family, texts in _every_notice().items() for i, text in enumerate(texts)]
    rows += [(UNKNOWN, i, text) for i, text in enumerate(NO_NOTICES)]
    return spark.createDataFrame(rows, "family string, number int, text string")


def paragraphs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> row_id, doc_id, n_paragraphs, n_worded, paragraph, words, before. Paragraphs are lines; a
    document without text has one empty one. n_worded of them have words; before is the last word of the line before, null if that has none."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), words_of)
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", lines.alias("lines"))
    # the generator stands in a step of its own, or ids would number its rows
    befores = F.expr("transform(lines, (x, i) -> struct(x AS words, if(i > 0, try_element_at(lines[i - 1], -1), null) AS before))")
    worded = F.size(F.filter("lines", lambda x: F.size(x) > 0)).cast("long")
    exploded = numbered.select("row_id", "doc_id", F.size("lines").cast("long").alias("n_paragraphs"), worded.alias("n_worded"), F.posexplode(befores).alias("paragraph", "line"))
    return exploded.select("row_id", "doc_id", "n_paragraphs", "n_worded", "paragraph", F.col("line.words").alias("words"), F.col("line.before").alias("before"))


def named_grams(spark: SparkSession) -> dict[tuple[str, int], list[int]]:
    """The n-grams of each notice but those of FRAME (a few hundred, of fixed values)."""
    texts = [(family, i, text) for family, texts in _every_notice().items() for i, text in enumerate(texts)]
    rows = spark.createDataFrame([*texts, (UNKNOWN, 0, FRAME)], "family string, number int, text string").withColumn("words", words_of(F.col("text")))
    grams = {(r["family"], r["number"]): set(r["grams"]) for r in rows.select("family", "number", _hashed("words").alias("grams")).collect()}  # of NOTICES
    frame = grams.pop((UNKNOWN, 0))
    return {notice: sorted(own - frame) for notice, own in grams.items()}


def marked(docs: DataFrame, grams: list[int]) -> DataFrame:
    """docs(doc_id, text, ...) -> row_id, doc_id, n_paragraphs, n_worded, paragraph, grams (those of ``grams`` that the paragraph has), bridge
    (the pair of the word before and its first one, if that is one of them); of paragraphs with one, and of the first of each document."""
    pair = F.xxhash64("before", F.col("words")[0])
    bridge = F.when(F.col("before").isNotNull() & (F.size("words") > 0) & pair.isin(grams), pair)
    lines = paragraphs(docs).select("row_id", "doc_id", "n_paragraphs", "n_worded", "paragraph", _among(_hashed("words"), grams).alias("grams"), bridge.alias("bridge"))
    return lines.where((F.size("grams") > 0) | F.col("bridge").isNotNull() | (F.col("paragraph") == 0))


class Scanner:
    """Features by n-gram (a weight for each class), intercepts and temperature; by notice the features that it holds."""

    def __init__(self, features: dict[int, list[float]], classes: list[str], intercepts: list[float], temperature: float, notices: dict[tuple[str, int], list[int]]):
        self.features, self.classes, self.intercepts, self.temperature, self.notices = features, classes, intercepts, temperature, notices


def _least(size: int) -> int:
    """How many of a notice's n-grams are its least share."""
    return next(n for n in range(size + 1) if n >= LEAST_SHARE * size)


def _holds_notice(found: DataFrame, named: dict[tuple[str, int], list[int]]) -> Column:
    """Whether a row of marked() has the least share of a notice's n-grams."""
    often = {r["gram"]: r["n"] for r in found.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # the n-grams of NOTICES
    # a paragraph without any of the size - least + 1 rarest n-grams of a notice has too few of it; only the others are compared
    rare, notices = set(), []
    for own in filter(None, named.values()):
        rare |= set(sorted(own, key=lambda g: (often.get(g, 0), g))[: len(own) - _least(len(own)) + 1])
        notices.append(F.struct(F.lit(_least(len(own))).alias("least"), F.array(*[F.lit(g).cast("long") for g in own]).alias("own")))
    return F.exists("grams", lambda g: g.isin(sorted(rare))) & F.exists(F.array(*notices), lambda x: F.size(F.array_intersect("grams", x["own"])) >= x["least"])


def _training(spark: SparkSession, plain: DataFrame, without: int, features: list[int]) -> DataFrame:
    """Windows of the notices, and the paragraphs of ``plain`` that have features, with ``without`` others -> family, terms (the features in order, as text), n."""
    texts = [(family, text) for family, texts in _every_notice().items() for text in texts] + [(UNKNOWN, text) for text in NO_NOTICES]
    window = F.expr("explode(flatten(transform(array(1.0, 0.8, 0.6), s -> transform(sequence(0, cast(floor(size(words) * (1 - s)) as int)), a -> slice(words, a + 1, cast(ceil(size(words) * s) as int))))))")
    windows = spark.createDataFrame(texts, "family string, text string").withColumn("words", words_of(F.col("text"))).select("family", window.alias("words")).where("size(words) > 1")
    terms = lambda grams: F.array_sort(F.transform(grams, lambda g: g.cast("string"))).alias("terms")
    rows = windows.select("family", terms(_among(_hashed("words"), features)), F.lit(1).cast("long").alias("n"))
    rows = rows.unionByName(spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("terms"), F.lit(without).cast("long").alias("n")).where("n > 0"))
    rows = rows.unionByName(plain.select(F.lit(UNKNOWN).alias("family"), terms(F.col("grams")), F.lit(1).cast("long").alias("n")))
    data = kept(rows.groupBy("family", "terms").agg(F.sum("n").alias("n")))
    return data.coalesce(-(-data.count() // TRAINING_ROWS))


def fit(found: DataFrame, named: dict[tuple[str, int], list[int]]) -> Scanner:
    """marked() of all documents and the n-grams of notices -> the scanner. Only numbers a feature, at most a few hundred, reach the driver."""
    spark = found.sparkSession
    total = found.where("paragraph = 0").agg(F.sum("n_worded")).first()[0] or 0

    # features: n-grams of notices that are rare; paragraphs that hold a notice must not make its own n-grams common, nor count as without a licence
    noticed = _holds_notice(found, named)
    plain = found.where(~noticed)
    common = {r["gram"] for r in plain.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON * max(total, 1)).collect()}  # some of the n-grams of NOTICES
    notices = {notice: [g for g in own if g not in common] for notice, own in named.items()}
    features = sorted(set().union(*notices.values()))

    # training rows: windows of the notices, and plain paragraphs
    plain = plain.withColumn("grams", F.filter("grams", lambda g: g.isin(features))).where(F.size("grams") > 0)
    counted = found.agg(F.count_if(noticed).alias("noticed"), F.count_if(~noticed & F.exists("grams", lambda g: g.isin(features))).alias("plain")).first()
    data = _training(spark, plain, total - counted["noticed"] - counted["plain"], features)
    counts = {r[0]: r[1] for r in data.groupBy("family").agg(F.sum("n")).collect()}
    balance = F.create_map(*[x for f, c in counts.items() for x in (F.lit(f), F.lit(1.0 / c))])
    data = data.withColumn("weight", F.element_at(balance, F.col("family")) * F.col("n")).withColumn("fold", F.pmod(F.xxhash64("terms", "family"), F.lit(5)))
    vector = CountVectorizerModel.from_vocabulary([str(g) for g in features] or [""], "terms", "features", binary=True)
    classes = sorted(counts)
    index = StringIndexerModel.from_labels(classes, "family", "label")
    ready = index.transform(vector.transform(data))
    regression = LogisticRegression(weightCol="weight", family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=60)
    held_back = regression.fit(ready.where("fold <> 0"))
    tried = held_back.transform(ready.where("fold = 0")).select("label", "weight", F.col("rawPrediction"))
    logits = vector_to_array("rawPrediction")
    tried = tried.select("label", "weight", logits.alias("z")).withColumn("t", F.explode(F.array(*map(F.lit, TEMPERATURES))))
    cost = F.log(F.aggregate(F.transform("z", lambda z: F.exp((z - F.array_max("z")) / F.col("t"))), F.lit(0.0), lambda a, x: a + x)) - (F.element_at("z", F.col("label").cast("int") + 1) - F.array_max("z")) / F.col("t")
    best = tried.groupBy("t").agg(F.sum(cost * F.col("weight")).alias("cost")).orderBy("cost", "t").first()
    model = regression.fit(ready)

    matrix = model.coefficientMatrix.toArray()
    weights = {g: list(map(float, matrix[:, i])) for i, g in enumerate(features)}
    return Scanner(weights, classes, [float(x) for x in model.interceptVector], float(best["t"]) if best else 1.0, notices)


def _by_family(spark: SparkSession, scanner: Scanner) -> DataFrame:
    """A row for each feature and family whose notices hold it: gram, w (by class), of (by family), family, number, held (by notice of the family)."""
    families, most = list(NOTICES), max(map(len, _every_notice().values()))
    own = {f: [grams for (g, _), grams in scanner.notices.items() if g == f] for f in families}
    rows = []
    for gram, weights in scanner.features.items():
        of = [float(any(gram in grams for grams in own[f])) for f in families]
        for i, f in enumerate(families):
            if of[i]:
                held = [1.0 / len(grams) if gram in grams else 0.0 for grams in own[f]]
                rows.append((gram, weights, of, f, i, held + [0.0] * (most - len(held))))
    return kept(spark.createDataFrame(rows, "gram long, w array<double>, of array<double>, family string, number int, held array<double>").coalesce(1))  # the n-grams of NOTICES


def _dense(held: DataFrame, by_family: DataFrame, scanner: Scanner) -> DataFrame:
    """Found n-grams -> row_id, paragraph of the lines with one of a family of which the lines near it have enough for a notice, so that
    only these are tried in windows: a window that confirms a family lies in the WRAPPED lines around each of its lines."""
    least = {}
    for (family, _), grams in scanner.notices.items():
        if size := len(grams):
            least[family] = min(least.get(family, size), math.ceil(LEAST_SHARE * size - 1e-9))
    need = F.element_at(F.create_map(*[x for f, n in least.items() for x in (F.lit(f), F.lit(n))]), F.col("family")) if least else F.lit(1)
    lines = held.join(F.broadcast(by_family.select("gram", "family")), "gram").groupBy("row_id", "family", "paragraph").agg(F.count(F.lit(1)).alias("n"))  # the n-grams of NOTICES
    around = Window.partitionBy("row_id", "family").orderBy("paragraph").rangeBetween(1 - WRAPPED, WRAPPED - 1)
    return lines.withColumn("around", F.sum("n").over(around)).where(F.col("around") >= need).select("row_id", "paragraph").distinct()


def scan(docs: DataFrame, scanner: Scanner | None = None) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> documents (row_id, doc_id, n_paragraphs), and notices (row_id, family, first, last, probability, share).

    A window of lines is scored for each family on the n-grams of that family's notices only, so that one
    text can name several. A family counts where it is likeliest of all classes and the window holds most of a
    notice; not where all that it has belongs to another confirmed family that has more (CC BY in CC BY-SA).
    Of nested windows the smallest counts, and windows that overlap are one notice.
    """
    spark = docs.sparkSession
    named = scanner.notices if scanner else named_grams(spark)
    found = kept(marked(docs, sorted(set().union(*named.values()))))
    scanner = scanner or fit(found, named)
    documents = found.where("paragraph = 0").select("row_id", "doc_id", "n_paragraphs")
    each = F.concat(*[F.transform(a, lambda g: F.struct(g.alias("gram"), F.lit(b).alias("bridge"))) for a, b in ((F.col("grams"), 0), (F.array_compact(F.array("bridge")), 1))])  # noqa: B023
    features = F.filter(each, lambda x: x["gram"].isin(list(scanner.features)))
    held = found.select("row_id", "n_paragraphs", "paragraph", F.explode(features).alias("g")).select("row_id", "n_paragraphs", "paragraph", "g.*")

    spans = F.expr(f"explode(flatten(transform(sequence(0, {WRAPPED - 1}), more -> transform(sequence(0, more), back -> struct(paragraph - back AS first, paragraph - back + more AS last)))))")
    by_family = _by_family(spark, scanner)
    near = kept(_dense(held, by_family, scanner))
    at = held.join(near, ["row_id", "paragraph"], "left_semi").select("row_id", "n_paragraphs", "paragraph", "gram", "bridge", spans.alias("at")).select("*", "at.first", "at.last")
    inside = at.where("first >= 0 and last < n_paragraphs and (bridge = 0 or first < paragraph)").groupBy("row_id", "first", "last", "gram").agg(F.max("bridge").alias("bridge"))
    most, families = max(map(len, _every_notice().values())), list(NOTICES)
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(scanner.classes))] + [F.sum(F.col("held")[k]).alias(f"h{k}") for k in range(most)]
    sums += [F.sum(F.col("of")[i]).alias(f"o{i}") for i in range(len(families))] + [F.count(F.lit(1)).alias("n"), F.max("bridge").alias("bridge")]
    summed = inside.join(F.broadcast(by_family), "gram").groupBy("row_id", "first", "last", "family", "number").agg(*sums)  # the n-grams of NOTICES
    # lines that nothing joins are no wrapped text
    summed = summed.withColumn("share", F.greatest(*[F.col(f"h{k}") for k in range(most)])).where((F.col("share") >= LEAST_SHARE - 1e-9) & ((F.col("first") == F.col("last")) | (F.col("bridge") > 0)))
    z = F.array(*[(F.col(f"z{i}") + b) / scanner.temperature for i, b in enumerate(scanner.intercepts)])
    own = F.element_at("z", F.element_at(F.create_map(*[x for i, c in enumerate(scanner.classes) for x in (F.lit(c), F.lit(i + 1))]), F.col("family")))
    probability = F.exp(own - F.array_max("z")) / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))
    scored = summed.withColumn("z", z).withColumn("probability", probability).where(F.col("probability") >= LEAST_PROBABILITY)
    passed = kept(scored.select("row_id", "first", "last", "family", "number", "n", "probability", "share", F.array(*[F.col(f"o{i}") for i in range(len(families))]).alias("of")))

    a, same = passed.alias("a"), (F.col("a.row_id") == F.col("b.row_id"))
    more = (F.col("a.number") != F.col("b.number")) & (F.col("b.n") > F.col("a.n")) & (F.element_at("a.of", F.col("b.number") + 1) >= F.col("a.n"))
    within = (F.col("a.first") >= F.col("b.first")) & (F.col("a.last") <= F.col("b.last"))
    alone = kept(a.join(passed.alias("b"), same & within & more, "left_anti").drop("of", "n", "number"))
    smaller = (F.col("a.family") == F.col("b.family")) & (F.col("b.first") >= F.col("a.first")) & (F.col("b.last") <= F.col("a.last")) & (F.col("b.last") - F.col("b.first") < F.col("a.last") - F.col("a.first"))
    least = alone.alias("a").join(alone.alias("b"), same & smaller, "left_anti")
    before = F.lag("last").over(Window.partitionBy("row_id", "family").orderBy("first"))
    return documents, least.withColumn("starts", (F.col("first") > F.coalesce(before, F.lit(-1))).cast("long"))


def licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, families, n_notices, n_paragraphs, probability; one row a document.

    families are the confirmed ones in order, joined by a comma, empty if there is none; n_notices counts each
    family's notices; probability is that of the surest one, null without one. Words are runs of letters and
    digits. A null text has one empty paragraph. Repeated rows are rows of their own; an empty table gives an
    empty one.
    """
    documents, notices = scan(docs, scanner)
    named = notices.groupBy(F.col("row_id").alias("of_row")).agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.sum("starts").alias("n_notices"), F.max("probability").alias("probability")
    )
    return documents.join(named, F.col("row_id") == F.col("of_row"), "left").select(
        "doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "n_paragraphs", "probability"
    )


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))
