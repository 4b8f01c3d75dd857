"""Queries over generated lines and programs against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from shardloom.plans import chunks, lines
from shardloom.sources.shared import written

SF = "/root/testdata/sf0.001"
CASES = {**{k: (q, lines.SQL[k]) for k, q in lines.QUERIES.items()}, **{k: (chunks.QUERIES[k], chunks.SQL[k]) for k in ("hard_splits", "nested_chunks")}}


@pytest.mark.parametrize("name", list(CASES))
def test_query_equals_sql(spark, name):
    query, sql = CASES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(sql)
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    got = query(spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == rows and rows


def test_embedded_files_read_documents_once(spark, monkeypatch):
    """However many levels there are; their lines lie in many files, though the documents are one."""
    of_documents = []

    def noted(df):
        out = written(df)
        if any(f.endswith("/documents.parquet") for f in df.inputFiles()):
            of_documents.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(lines, "written", noted)
    assert lines.embedded_files(spark, SF).count()
    assert len(of_documents) == 1 and of_documents[0] > 4
