"""The row-local chunking operator on a stream: the same expressions, no state."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import Sizes, chunk_files, chunk_rows


def chunk_stream(spark: SparkSession, path: str, name: str, sizes: Sizes = Sizes()) -> StreamingQuery:
    """Chunks of documents (doc_id, text) that arrive as Parquet, in a table in memory."""
    folder, file = os.path.split(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    return chunk_rows(chunk_files(stream, content="text", sizes=sizes, language="text"), "doc_id").writeStream.format("memory").queryName(name).start()
