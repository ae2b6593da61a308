"""Operator 12: how far the sources of a language diverge in their terms, by sort-based streaming.

1. Map tasks count the terms of whole texts and write pieces (lang, term, source, document, documents, occurrences): a
   piece sums the documents that a task has held since it last wrote, and stands at the first of them. So a term that
   stands everywhere is a piece a task and source, however many documents have it.
2. Pieces are dealt by (lang, term) and sorted by lang, term, source and document. A scan of run lengths sums the runs,
   holding one of them, and keeps the terms that stand in enough documents of their language: one row a term.
3. The totals of each group follow, then a second scan turns each term's run into partial sums for pairs of sources and
   the first terms of each group. Only these move again: at most a row a task for each pair, and TOP rows for each group.

All arithmetic is in integers. What the driver and each task hold besides is a row for each (lang, source), of whose
square the result has a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import kept, steps, table
from docloom.llm.terms import terms

#: Documents of its language that a kept term stands in at least, and the ranks of terms that are told.
LEAST_DOCS, TOP = 10, 10
#: A term's share of a group, with two pseudo-occurrences of each kept term, is an integer in this unit.
UNIT = 10**9
#: Pieces that a map task holds before it sums them up, and cells of a matrix that one step works on.
HELD_PIECES, STEP_CELLS = 400_000, 1 << 20
#: Sums of pairs that a task holds before it writes them.
HELD_CELLS = 1 << 22
#: Bytes of texts whose terms are counted at once.
TEXT_BYTES = 4 << 20

PIECES = pa.schema([("lang", pa.large_string()), ("term", pa.large_string()), ("source", pa.large_string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
RUNS = pa.schema([("lang", pa.large_string()), ("term", pa.large_string()), ("docs", pa.int64()), ("sources", pa.list_(pa.large_string())), ("counts", pa.list_(pa.int64()))])
PARTS = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("part", pa.string()), ("item", pa.large_string()), ("value", pa.int64())])


def _bounds(*same: np.ndarray) -> np.ndarray:
    """Where runs start: at 0 and where any of the arrays is false; ``same[i]`` tells whether row i + 1 goes on."""
    return np.flatnonzero(np.r_[True, ~np.logical_and.reduce(same)])


def _goes_on(column: pa.Array) -> np.ndarray:
    return pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)


def _counted(part: pa.RecordBatch, first: int) -> pa.Table:
    """Texts -> their pieces; ``first`` is the number of the first row."""
    found, code, doc = terms(part.column("text"))
    groups = [part.column(c).cast(pa.large_string()).fill_null("").dictionary_encode() for c in ("lang", "source")]
    of_doc = [g.indices.to_numpy().astype(np.int64) for g in groups]
    n_docs, n_terms, n_sources = part.num_rows, max(len(found), 1), len(groups[1].dictionary)
    group = of_doc[0] * n_sources + of_doc[1]
    key = np.sort((group[doc] * n_terms + code) * n_docs + doc)
    if not len(key):
        return PIECES.empty_table()
    at = _bounds(key[1:] == key[:-1])  # a run for each group, term and document
    runs = key[at] // n_docs
    piece = _bounds(runs[1:] == runs[:-1])
    docs = np.diff(np.r_[piece, len(runs)])
    n = np.diff(np.r_[at[piece], len(key)])
    group, code = np.divmod(runs[piece], n_terms)
    lang, source = np.divmod(group, n_sources)
    return pa.Table.from_arrays([groups[0].dictionary.take(pa.array(lang)), found.take(pa.array(code)), groups[1].dictionary.take(pa.array(source)), pa.array(first + key[at[piece]] % n_docs), pa.array(docs), pa.array(n)], schema=PIECES)


def _summed(held: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(held).group_by(["lang", "term", "source"], use_threads=False).aggregate([("document", "min"), ("docs", "sum"), ("n", "sum")])
    return summed.rename_columns([x.removesuffix("_min").removesuffix("_sum") for x in summed.column_names]).select(PIECES.names).cast(PIECES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    held: list[pa.Table] = []
    for batch in batches:
        for part in steps(batch, step_bytes=TEXT_BYTES):
            held.append(_counted(part, row))
            row += part.num_rows
            if sum(t.num_rows for t in held) > HELD_PIECES:
                held = [_summed(held)]
                if held[0].num_rows > HELD_PIECES // 2:
                    yield from held.pop().to_batches(10_000)
    if held:
        yield from _summed(held).to_batches(10_000)


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pieces in their order -> a row for each term that stands in ``least`` documents of its language. The last run of a
    batch is open, and goes before the next batch, summed up by source."""
    open_run: pa.Table | None = None

    def closed(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        columns = {c: rows.column(c).combine_chunks() for c in PIECES.names}
        same_term = _goes_on(columns["term"]) & _goes_on(columns["lang"])
        at = _bounds(same_term, _goes_on(columns["source"]))
        docs, n = (np.add.reduceat(columns[c].to_numpy(), at) for c in ("docs", "n"))
        term_at = np.searchsorted(at, _bounds(same_term))  # among the runs of sources
        rest = None
        if not last:
            cut = term_at[-1]
            tail = pa.array(at[cut:])
            rest = pa.Table.from_arrays([*(columns[c].take(tail) for c in PIECES.names[:4]), pa.array(docs[cut:]), pa.array(n[cut:])], schema=PIECES)
            at, docs, n, term_at = at[:cut], docs[:cut], n[:cut], term_at[:-1]
        if not len(term_at):
            return None, rest
        of_term = np.add.reduceat(docs, term_at)
        stays = of_term >= least
        sizes = np.diff(np.r_[term_at, len(at)])
        inner = np.repeat(stays, sizes)
        lists = pa.array(np.r_[0, np.cumsum(sizes[stays])], pa.int32())
        where = pa.array(at[term_at[stays]])
        source = columns["source"].take(pa.array(at[inner]))
        found = [columns["lang"].take(where), columns["term"].take(where), pa.array(of_term[stays]), pa.ListArray.from_arrays(lists, source), pa.ListArray.from_arrays(lists, pa.array(n[inner]))]
        return pa.RecordBatch.from_arrays(found, schema=RUNS), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).select(PIECES.names).cast(PIECES)
        out, open_run = closed(pa.concat_tables([open_run, rows]) if open_run is not None else rows, False)
        if out is not None and out.num_rows:
            yield out
    if open_run is not None:
        yield closed(open_run, True)[0]


def share(count: np.ndarray, size: np.ndarray | int, unit: int = UNIT) -> np.ndarray:
    """1 + floor(unit * count / size), by three digits at a time, so that nothing overflows below sizes of 9e15."""
    digits, rest = np.zeros_like(count), count
    for _ in range(len(str(unit)) // 3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // size, rest % size
    return 1 + digits


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pairs(sums: dict[tuple[str, int], np.ndarray], groups: dict[str, tuple[int, list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Empty ``sums`` into rows: what each source has seen of each other one, and what the other one cannot see."""
    for lang, a in list(sums):
        sources, own = pa.array(groups[lang][1], pa.large_string()), sums.pop((lang, a))
        for values, turned in zip(own, (False, True), strict=True):
            of = np.flatnonzero(values)
            of = of[of != a]
            there = [pa.array([groups[lang][1][a]] * len(of), pa.large_string()), sources.take(pa.array(of))]
            source, item = there[::-1] if turned else there
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.large_string()), source, pa.array(["pair"] * len(of)), item, pa.array(values[of])], schema=PARTS)


def _parts(batches: Iterator[pa.RecordBatch], groups: dict[str, tuple[int, list[str], list[int]]], top: int, most: int = HELD_CELLS) -> Iterator[pa.RecordBatch]:
    """Runs -> partial sums of pairs, less what they would be without the term in either source, and first terms.
    groups: by language the number of its terms, its sources and their sizes."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    cells = 0
    first: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            n_terms, sources, sizes = groups[lang]
            of_lang = batch.filter(pc.equal(batch.column("lang"), pa.scalar(lang, batch.schema.field("lang").type)))
            names, size = pa.array(sources, pa.large_string()), np.array(sizes, np.int64) + 2 * n_terms
            whole = sum(sizes) + 2 * n_terms
            none = share(np.full(len(sources), 2, np.int64), size)
            base = distance(none[:, None], none[None]) if len(sources) ** 2 <= STEP_CELLS else None
            for start in range(0, of_lang.num_rows, step := max(1, STEP_CELLS // len(sources))):
                rows = of_lang.slice(start, step)
                lists = rows.column("sources")
                row = pc.list_parent_indices(lists).to_numpy()
                at = pc.index_in(lists.flatten().cast(pa.large_string()), value_set=names).to_numpy().astype(np.int64)
                counts = np.zeros((rows.num_rows, len(sources)), np.int64)
                counts[row, at] = rows.column("counts").flatten().to_numpy()
                p = share(counts + 2, size)
                q = share(counts.sum(axis=1) + 2, whole)
                words = rows.column("term").cast(pa.large_binary())
                for a in np.unique(at).tolist():
                    has = np.flatnonzero(counts[:, a])
                    rest = base[a] if base is not None else distance(none[a], none)
                    if (lang, a) not in sums:
                        sums[lang, a] = np.zeros((2, len(sources)), np.int64)
                        cells += 2 * len(sources)
                    for i in range(0, len(has), step):
                        own = has[i : i + step]
                        more = distance(p[own, a][:, None], p[own]) - rest
                        sums[lang, a][0] += more.sum(axis=0)
                        more[counts[own] > 0] = 0  # there the other source counts the pair the other way round
                        sums[lang, a][1] += more.sum(axis=0)
                    high = has[p[has, a] > q[has]]
                    value = distance(p[high, a], q[high])
                    if len(value) > top:
                        stays = value >= np.partition(value, -top)[-top]
                        high, value = high[stays], value[stays]
                    best = first.setdefault((lang, a), [])
                    best += zip((-value).tolist(), words.take(pa.array(high)).to_pylist(), strict=True)
                    best.sort()
                    del best[top:]
                    if cells > most:
                        yield from _pairs(sums, groups)
                        cells = 0
    yield from _pairs(sums, groups)
    rows = [(lang, groups[lang][1][a], "term", term.decode(), -value) for (lang, a), best in first.items() for value, term in best]
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), PARTS, strict=True)], schema=PARTS)


def term_runs(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, term, docs, sources, counts: a row for each term that stands in ``least``
    documents of its language, with its occurrences in each source that has it."""
    pieces = docs.select("text", "lang", "source").mapInArrow(_pieces, "lang string, term string, source string, document long, docs long, n long")
    # sorted by term before lang: the same runs, and the prefix that Spark sorts by tells most of them apart
    ordered = pieces.repartition("lang", "term").sortWithinPartitions("term", "lang", "source", "document")
    return ordered.mapInArrow(partial(_runs, least=least), "lang string, term string, docs long, sources array<string>, counts array<long>")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, source, part, item, value, rank.

    Part ``pair``: for each source of each language, every other one and the sum over the language's kept terms of their
    distance; part ``term``: the ``top`` terms that stand out in the source against its language. Null text, lang and
    source count as empty ones, and sources that are then equal are one. Every row is a document, repeated ones and equal
    doc_ids too; texts are read whole. A source without a term is compared like others; a language without a kept term
    gives distances of 0. Ties go by the bytes of the item. An empty table gives an empty one.
    """
    named = docs.select("text", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
    runs = kept(term_runs(named, least))
    counted = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("size"))
    n_terms = runs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    groups = kept(
        named.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(n_terms, "lang", "left")
        .select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    )
    of_lang: dict[str, tuple[int, list[str], list[int]]] = {}
    for r in groups.sort("lang", "source").collect():  # a row a group; the result has their square
        known = of_lang.setdefault(r.lang, (r.n_terms, [], []))
        known[1].append(r.source)
        known[2].append(r["size"])
    parts = kept(runs.mapInArrow(partial(_parts, groups=of_lang, top=top), "lang string, source string, part string, item string, value long"))
    none = F.when(F.col("n_terms") > 0, F.expr(f"1 + {2 * UNIT} div (size + 2 * n_terms)")).otherwise(F.lit(0)).cast("long")
    one = groups.withColumn("p", none)
    other = one.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    without = F.when(F.col("n_terms") > 0, F.expr("((p - q) * (p - q)) div (p + q) * n_terms")).otherwise(F.lit(0)).cast("long")
    every = one.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", without.alias("value"))
    pairs = every.unionByName(parts.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    terms_ = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms_)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH named AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (
  SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM named),
stays AS (SELECT lang, term, count(*)::HUGEINT AS n FROM found GROUP BY lang, term HAVING count(DISTINCT row_id) >= {LEAST_DOCS}),
counts AS (SELECT f.lang, f.source, f.term, count(*)::HUGEINT AS n FROM found f JOIN stays USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM named),
sized AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(c.n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS size,
    (SELECT count(*) FROM stays s WHERE s.lang = g.lang)::HUGEINT AS v FROM groups g),
langs AS (SELECT lang, sum(size)::HUGEINT AS size, max(v) AS v FROM sized GROUP BY lang),
shares AS (
  SELECT z.lang, z.source, s.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 2)) // (z.size + 2 * z.v) AS p
  FROM sized z JOIN stays s USING (lang) LEFT JOIN counts c ON c.lang = z.lang AND c.source = z.source AND c.term = s.term),
whole AS (SELECT l.lang, s.term, 1 + ({UNIT}::HUGEINT * (s.n + 2)) // (l.size + 2 * l.v) AS q FROM langs l JOIN stays s USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
firsts AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, ((a.p - w.q) * (a.p - w.q) // (a.p + w.q))::BIGINT AS value
  FROM shares a JOIN whole w ON a.lang = w.lang AND a.term = w.term WHERE a.n > 0 AND a.p > w.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM firsts))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
