from __future__ import annotations

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "chunk_index", "strategy", "content", "start_line", "end_line"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_gives_the_same_chunks(spark, tmp_path):
    from shardloom.streaming.chunks import chunk_stream

    q = chunk_stream(spark, f"{SF}/documents.parquet", "chunk_test")
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from chunk_test").first()[0] == entry.entry(spark).count()
