"""Empty tables, repeated rows, ties, very long texts and clashing names of the queries that other tests leave out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shardloom.llm import bpe, decontaminate, html, topk, urls

TABLES = {
    "documents": "doc_id long, text string, lang string, source string", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<double>",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
}
QUERIES = {"op2": topk.op2_exact_topk, "op5": urls.op5_url_filters, "op9": html.op9_html_extraction, "op10": bpe.op10_byte_bpe}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.collect() == [] and df.columns[0] in ("query_id", "page_id", "doc_id")


def test_repeated_rows_stay(spark, tmp_path):
    page = (1, "http://x/1", "<article><p>" + "word " * 40 + "</p></article>")
    spark.createDataFrame([page, page, (None, None, None), (None, None, None)], TABLES["pages"]).withColumn("text", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, None, None, None)], TABLES["documents"]).withColumn("n_tokens", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    pages = html.op9_html_extraction(spark, str(tmp_path)).collect()
    assert sorted(r.n_chars for r in pages) == [0, 0, 199, 199] and sum(r.page_id is None for r in pages) == 2
    rows = bpe.op10_byte_bpe(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 2), (False, 2), (True, 0)]


def test_very_long_pages():
    words = " ".join(f"w{i}" for i in range(60_000))
    page = "<nav>" + "<a href=x>menu</a>" * 20_000 + f"</nav><article><p>{words}</p>" + "".join(f"<p>{'p ' * 30}</p>" for _ in range(5000)) + "</article><div class=comments>" + "<p>c c c</p>" * 20_000
    text = html.main_text(page, html.default_tree())
    assert text.startswith(words) and text.count("\n\n") == 5000 and "menu" not in text and "c c" not in text


def test_equal_items_and_equal_lines_of_alignment(spark):
    """Items with one text are found each; a text that holds an item twice counts it once."""
    item = "the quick brown fox jumps over the lazy dog while the old cat sleeps near a warm fire"
    items = spark.createDataFrame([(1, item), (2, item), (2, item)], TABLES["benchmark"])
    docs = spark.createDataFrame([(5, f"{item} and again {item}"), (6, item), (6, item)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tokens) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(d, i, 18) for d in (5, 6) for i in (1, 2)]


def test_topk_with_clashing_names(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0]) for i in range(41)]
    df = spark.createDataFrame(rows, TABLES["embeddings"]).withColumns({c: F.lit("clash") for c in ("id", "cells", "score", "rank", "query_id", "shard")})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk.op2_exact_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for q in (0, 20, 40):
        near = sorted((-((q % 3) * (i % 3) + 1) * 64 * 64, i) for i, _ in rows if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)
