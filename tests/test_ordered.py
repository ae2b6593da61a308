"""Ordered operators against sequential versions of their rules, on random inputs."""

import random

from pyspark.sql import functions as F

from docloom.operators import ordered


def anomalies_in_order(numbers):
    seen, last, out = set(), {}, []
    for pos, n in enumerate(numbers):
        n = tuple(n)
        if not n:
            continue
        parent = n[:-1]
        expected = last[parent] + 1 if parent in last else 1
        if n in seen:
            out.append((pos, "duplicate_number", None))
        if len(n) > 1 and parent not in seen:
            out.append((pos, "missing_parent", None))
        if len(n) > 1 and n[-1] != expected:
            out.append((pos, "sequence_gap", expected))
        seen.add(n)
        last[parent] = n[-1]
    return out


def test_numbering(spark):
    rng = random.Random(1)
    docs = {d: [[rng.randint(1, 3) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 15))] for d in range(120)}
    rows = [(d, i, n) for d, numbers in docs.items() for i, n in enumerate(numbers)]
    got = {}
    for r in ordered.numbering_anomalies(spark.createDataFrame(rows, "doc_id int, pos int, number array<int>")).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.kind, r.expected_last))
    for d, numbers in docs.items():
        assert sorted(got.get(d, []), key=str) == sorted(anomalies_in_order(numbers), key=str)


def read_in_order(tokens):
    text, stack, fields, out = [], [], [], []
    for kind, t in tokens:
        if kind == "begin":
            stack.append(False)
            fields.append(["", False])
        elif kind == "separate":
            if stack:
                stack[-1] = True
            if fields and not fields[-1][1]:
                if fields[-1][0].strip():
                    out.append(fields[-1][0].strip())
                fields[-1][1] = True
        elif kind == "end":
            if stack:
                stack.pop()
                parts, done = fields.pop()
                if not done and parts.strip():
                    out.append(parts.strip())
        elif kind == "instr":
            if fields and not fields[-1][1]:
                fields[-1][0] += t
        elif kind == "text" and not any(stack):
            text.append(t)
        elif kind in ("tab", "break"):
            text.append({"tab": "\t", "break": "\n"}[kind])
    return "".join(text), out


def test_field_stack(spark):
    rng = random.Random(2)
    kinds = ["begin", "separate", "end", "instr", "text", "tab", "break", "simple_text"]
    lists = [[(rng.choice(kinds), rng.choice([" a", "b ", " ", "REF x"])) for _ in range(rng.randint(0, 14))] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, tokens array<struct<kind:string,text:string>>")
    for r in df.select("i", ordered.text_outside_results(F.col("tokens")).alias("text"), ordered.field_instructions(F.col("tokens")).alias("found")).collect():
        assert (r.text, r.found) == read_in_order(lists[r.i]), lists[r.i]


def test_field_stacks_as_rows_in_chunks(spark):
    rng = random.Random(3)
    kinds = ["begin", "separate", "end", "instr", "text", "tab", "break"]
    lists = [[(rng.choice(kinds), rng.choice([" a", "b ", " ", "REF x"])) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    rows = [(i, at, kind, text) for i, tokens in enumerate(lists) for at, (kind, text) in enumerate(tokens)]
    for chunk in (3, 4096):
        opened = ordered.open_fields(spark.createDataFrame(rows, "i int, at long, kind string, text string"), ["i"], chunk)
        texts, found = {}, {}
        for r in opened.withColumn("shown", ordered.shown(opened)).orderBy("i", "at").collect():
            texts[r.i] = texts.get(r.i, "") + (r.shown or "")
        for r in ordered.completed_fields(opened, ["i"]).orderBy("i", "at").collect():
            found.setdefault(r.i, []).append(r.instruction)
        for i, tokens in enumerate(lists):
            assert (texts.get(i, ""), found.get(i, [])) == read_in_order(tokens), tokens


def test_trailing_sections_and_prefixes(spark):
    s = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, False), (2, 0, False), (2, 1, False)], "doc_id int, idx int, payload boolean")
    assert sorted((r.doc_id, r.idx) for r in ordered.trailing_empty(s).collect()) == [(1, 2), (1, 3), (2, 1)]
    runs = spark.createDataFrame([(1, 0, "1.2"), (1, 1, " Ti"), (1, 2, "tle")], "doc_id int, run int, text string")
    got = ordered.without_prefix(ordered.run_offsets(runs, ["doc_id"], "run"), F.lit(4)).orderBy("run").collect()
    assert [r.text for r in got] == ["", "Ti", "tle"]
