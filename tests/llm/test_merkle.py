import hashlib
import random
import zlib

from pyspark.sql import types as T

from docloom.llm import merkle

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("leaf", T.LongType())])


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def fields(values):
    return [f"{len(str(v).encode())}:{v}" if v is not None else "-" for v in values]


def levels(nodes):
    """All levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    leaves = []
    for doc_id, source, lang, n, text in rows:
        leaf = h(*fields((doc_id, source, lang, n, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaves.append((source is not None, (source or "").encode(), doc_id is not None, doc_id or 0, leaf, h(*fields((doc_id, source, lang, n, text and text.translate(lower)))) if hit else leaf, doc_id))
    leaves.sort(key=lambda x: x[:5])
    names = sorted({x[:2] for x in leaves})
    trees = [levels([x[4] for x in leaves if x[:2] == name]) for name in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for i, (*_, leaf, tampered, doc_id) in enumerate(x for x in leaves if x[:2] == name):
            proof, folded = [], tampered
            for levels_, at in ((tree, i), (top, k)):
                for level in levels_[:-1]:
                    left, right = level[at // 16 * 16 : at], level[at + 1 : at // 16 * 16 + 16]
                    proof += left + right
                    folded = h(*left, folded, *right)
                    at //= 16
            out.append((doc_id, leaf, tree[-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows, parts=3):
    df = merkle.manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts))
    return sorted(map(tuple, df.collect()), key=str)


def corpus(rng, n):
    sources = [None, "", "Z", "a", "é", "日", *(f"s{i}" for i in range(20))]
    return [(rng.randrange(n), rng.choice(sources) if rng.random() < 0.4 else "hot", rng.choice([None, "en", "de"]), rng.choice([None, 3, -12]), rng.choice([None, "", "Abc É", "x" * 50, str(rng.random())])) for _ in range(n)]


def test_equals_a_plain_version(spark):
    rng = random.Random(1)
    rows = corpus(rng, 900)
    rows += rows[:60] + [(None, "hot", None, None, None)] * 3 + [(5, "hot", "en", 1, "LONG " * 200_000)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, 1) == got(spark, rows, 9)


def test_few_rows_and_one_source(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    for rows in ([(1, None, None, None, None)], [(i, "a", "en", 2, "T") for i in range(17)], [(i, f"s{i}", "en", 2, "T") for i in range(33)], [(i, "ab"[i == 40], "en", 2, "T") for i in range(41)]):
        assert got(spark, rows) == plain(rows)


def test_many_fragments(spark):
    """Partitions of a few rows each, so that the reduction takes rounds."""
    rng = random.Random(2)
    rows = corpus(rng, 700)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fragments_merge_in_any_grouping():
    rng = random.Random(4)
    sizes = [1, 2, 16, 17, 300, 4097]
    nodes = [(t, n, 0, i, bytes([t, i % 256, i // 256])) for t, n in enumerate(sizes) for i in range(n)]
    roots, made = set(), set()
    for _ in range(4):
        rng.shuffle(nodes)
        parts = [merkle.Forest(len(sizes)) for _ in range(7)]
        for i, node in enumerate(nodes):
            parts[i % 7].put(*node)
        while len(parts) > 1:
            rng.shuffle(parts)
            one, other = parts.pop(), parts[-1]
            for (tree, size, level, run), held in one.open.items():
                for at, digest in held.items():
                    other.put(tree, size, level, 16 * run + at, digest)
            other.done += one.done
        roots.add(parts[0].root)
        made.add(tuple(sorted(parts[0].done)))
        assert not parts[0].open
    assert len(roots) == len(made) == 1 and None not in roots
