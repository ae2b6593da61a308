import random

import pytest
from pyspark.sql import types as T

from docloom.llm import licences

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("family", T.StringType()), T.StructField("gram", T.LongType())])
LINES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "This library is licensed under the GNU Lesser General Public License, version 3",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "licensed under cc by-sa 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "proprietary": "All rights reserved.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
}


def corpus():
    rng = random.Random(1)
    words = "the of and is this work under all mit software thand erhe ingre tion nter ofthe public version license by no part 2 3 0 4".split()
    words = words + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(700)]
    prose = lambda: " ".join(rng.choices(words, k=rng.randint(3, 60))) + "."
    rows, want = [], {}
    for i in range(600):
        lines = [prose() for _ in range(rng.randint(1, 5))]
        if i % 6 == 0:
            family = rng.choice(list(LINES))
            lines.insert(rng.randint(0, len(lines)), LINES[family])
            want[i] = family
        rows.append((i, "\n".join(lines), "clash", 1))
    return rows, want


@pytest.fixture(scope="module")
def scanned(spark):
    rows, want = corpus()
    rows += [(900, None, "", 1), (901, "", "", 1), (902, "\n".join([LINES["mit"], LINES["gpl"], "x"]), "", 1), (902, "\n".join([LINES["mit"], LINES["gpl"], "x"]), "", 1), (None, LINES["mit"] + " " + "thand erhe " * 20_000, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, want, licences.licences(docs)


def test_notices_are_found_and_prose_is_left_alone(scanned):
    rows, want, result = scanned
    got = result.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.families == want.get(r.doc_id, ""), r
            assert (r.probability is None) == (r.families == "") and r.n_notices == int(r.doc_id in want)
    lines = {i: t for i, t, *_ in rows}
    assert all(r.n_paragraphs == len((lines[r.doc_id] or "").split("\n")) for r in got)


def test_defined_cases(scanned):
    got = [r for r in scanned[2].collect() if r.doc_id is None or r.doc_id >= 900]
    assert sorted((r.doc_id or 0, r.families, r.n_notices, r.n_paragraphs) for r in got) == [(0, "mit", 1, 1), (900, "", 0, 1), (901, "", 0, 1), (902, "gpl,mit", 2, 3), (902, "gpl,mit", 2, 3)]


def test_no_python_in_the_plan_and_empty_table(spark, scanned):
    plan = scanned[2]._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert licences.licences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapped_notices_and_several_in_one_line(spark):
    rows, _ = corpus()
    odd = {
        1000: ("Copyright. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:", "bsd,proprietary"),
        1001: ("# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and\n# associated documentation files", "mit"),
        1002: ("you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation", "gpl"),
        1003: ("Licensed under the Apache License, Version 2.0, or released under the MIT License", "apache-2.0,mit"),
        1004: ("Licensed under CC BY\n-SA 4.0", "cc-by-sa"),
    }
    docs = spark.createDataFrame(rows + [(i, text, "", 1) for i, (text, _) in odd.items()], SCHEMA).repartition(3)
    got = {r.doc_id: r.families for r in licences.licences(docs).collect()}
    assert {i: got[i] for i in odd} == {i: want for i, (_, want) in odd.items()}


def test_identifiers_name_their_own_family_or_none(spark):
    rows, _ = corpus()
    odd = {
        "MIT": "mit", "BSD-3-Clause": "bsd", "BSD-2-Clause": "bsd", "ISC": "", "MPL-2.0": "mpl", "GPL-2.0-only": "gpl", "GPL-3.0-or-later": "gpl", "LGPL-2.1-or-later": "lgpl", "BSL-1.0": "", "EPL-2.0": "",
        "AGPL-3.0-only": "agpl", "Apache-2.0": "apache-2.0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC0-1.0": "cc0", "Unlicense": "unlicense", "EUPL-1.2": "", "Zlib": "",
    }
    docs = spark.createDataFrame(rows + [(1000 + i, f"# SPDX-License-Identifier: {x}\nimport os", "", 1) for i, x in enumerate(odd)], SCHEMA).repartition(3)
    got = {r.doc_id: r.families for r in licences.licences(docs).collect()}
    assert {x: got[1000 + i] for i, x in enumerate(odd)} == odd


def test_a_notice_over_ten_lines(spark):
    rows, _ = corpus()
    words = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files".split()
    text = "\n".join("// " + " ".join(words[i : i + 2]) for i in range(0, len(words), 2))
    docs = spark.createDataFrame(rows + [(1000, "x\n" + text + "\ny", "", 1)], SCHEMA).repartition(3)
    (r,) = licences.licences(docs).where("doc_id = 1000").collect()
    assert r.families == "mit" and r.n_notices == 1 and text.count("\n") >= 9


def test_what_is_common_is_counted_in_all_documents(spark):
    """Pairs in one line of seven hundred, but in one of a hundred and seventy of the documents that a sample by a hash of doc_id took."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(700)]
    prose = lambda: " ".join(rng.choices(words, k=12))
    some = [r[0] for r in spark.range(8_000).where(f"pmod(xxhash64(id, 11), {1 << 20}) < {1 << 17}").collect()][:48]
    text = {i: f"{['released under', 'under the', 'the mit', 'mit license'][k % 4]} {prose()}" for k, i in enumerate(some)}
    rows = [(i, text.get(i) or prose(), "", 1) for i in range(8_000)] + [(9_000, LINES["mit"], "", 1), (9_001, "All rights reserved.", "", 1)]
    got = {r.doc_id: r.families for r in licences.licences(spark.createDataFrame(rows, SCHEMA).repartition(3)).where("doc_id >= 9000").collect()}
    assert got == {9_000: "mit", 9_001: "proprietary"}
