"""Queries that must meet every row of their tables, on rows that the small driver's tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom import catalogue, catalogue_packages, catalogue_updates  # noqa: F401

DOCS = "doc_id long, text string"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables with documents of lines that are short, blank and longer than 21,000 characters."""
    texts = [(i, "\n".join(f"{'  ' if n % 2 else ''}line {n} of {i}" for n in range(i % 40))) for i in range(60)] + [(77, "ab" * 12_000 + "\nshort"), (78, "é" * 25_000)]
    spark.createDataFrame(texts, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def duck(folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_heading_update_has_every_paragraph(spark, folder):
    every = catalogue.lines(spark, folder)
    got = catalogue.QUERIES["heading_update"](spark, folder)
    assert got.count() == every.count()
    assert got.select("doc_id", "pos").exceptAll(every.select("doc_id", "pos")).isEmpty()
    assert {r.style for r in got.where("pos % 3 = 0").collect()} == {"Normal"}
    assert sorted(map(tuple, got.collect())) == duck(folder, catalogue.SQL["heading_update"])


def test_run_edits_keep_every_run_of_long_lines(spark, folder):
    """What the runs hold is the whole line with its span replaced, however long it is."""
    got = catalogue.QUERIES["run_edits"](spark, folder).where("doc_id in (77, 78)").collect()
    lines = {(r.doc_id, r.pos): r.text for r in catalogue.lines(spark, folder).where(F.col("doc_id").isin(77, 78)).collect()}
    for (doc, pos), text in lines.items():
        runs = sorted((r.run, r.text, r.fault) for r in got if (r.doc_id, r.pos) == (doc, pos))
        assert len(runs) == -(-len(text) // 7)
        k = pos % 5
        want = text if runs[0][2] else text[: k + 3] + "<new>" + text[k + 12 :]
        assert "".join(t for _, t, _ in runs) == want


@pytest.mark.parametrize("name", ["trailing_section_candidates", "trailing_section_removal", "section_relations"])
def test_texts_of_sections_neither_move_nor_stay_on_disk(spark, folder, monkeypatch, name):
    """A document is one row until its nodes are written, and these hold no text; results are those of the SQL."""
    plans = []

    def seen(df, write=catalogue_packages.stored):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return write(df)

    monkeypatch.setattr(catalogue_packages, "stored", seen)
    got = catalogue.QUERIES[name](spark, folder)
    columns, plan = plans[0]
    assert "Exchange" not in plan and "text" not in columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck(folder, catalogue.SQL[name]), key=str)
