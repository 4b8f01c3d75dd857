"""Exact top-k search by inner product: tiles of queries against shards, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD_ROWS = 32768
TILE = 256
FAN_IN = 8


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    inf = float("inf")
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))


def shards(rows: DataFrame, count: int) -> DataFrame:
    """(shard, dim, ids, cells): rows (id, cells as array of long) dealt by a hash of the whole row.

    Identical rows would meet in one shard, so each id is expected once (see `nearest`).
    """
    return rows.groupBy(F.pmod(F.xxhash64("id", "cells"), F.lit(count)).cast("int").alias("shard"), F.size("cells").alias("dim")).agg(F.collect_list(F.struct("id", "cells")).alias("members"))


def _matrix(members: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = members.flatten()
    ids = flat.field("id").to_numpy(zero_copy_only=False)
    return ids, flat.field("cells").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, cells = _matrix(batch.column("members").slice(i, 1))
                asked, vectors = _matrix(batch.column("asked").slice(i, 1))
                order = np.argsort(ids, kind="stable")
                ids, cells = ids[order], cells[order]
                top = float(np.abs(cells.astype(float)).max()) * float(np.abs(vectors.astype(float)).max()) * cells.shape[1]
                if top < 2**53:  # all partial sums are exact
                    cells, vectors = cells.astype(np.float64), vectors.astype(np.float64)
                got: tuple[list, list, list] = ([], [], [])
                for q in range(0, len(asked), TILE):
                    scores = (vectors[q : q + TILE] @ cells.T).astype(np.int64)
                    for query, row in zip(asked[q : q + TILE], scores):
                        near = _largest(row, ids, query, k)
                        got[0].append(np.full(len(near), query))
                        got[1].append(ids[near])
                        got[2].append(row[near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in got], ["query_id", "vec_id", "score"])

    return run


def _largest(row: np.ndarray, ids: np.ndarray, query: int, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id; ids ascend; the query's own id is left out."""
    if len(row) > k + 1:
        floor = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
        place = np.flatnonzero(row >= floor)
    else:
        place = np.arange(len(row))
    place = place[ids[place] != query]
    return place[np.lexsort((ids[place], -row[place]))][:k]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest integer inner product.

    rows, queries: (id long, cells array<long>). Ties go to the smaller id; a query's own id is left
    out. Rows with a null id take no part; an id that is repeated counts once, with its largest
    cells. Vectors of another length than the query's are no candidates. Empty tables give no rows.
    Work is dealt by shard: every shard meets all queries in tiles of `TILE`, keeps k a query, and
    the short lists are merged as a tree of fan-in `FAN_IN`.
    """
    spark = rows.sparkSession
    once = lambda df: df.where("id is not null").groupBy("id").agg(F.max("cells").alias("cells"))
    rows, queries = once(rows), once(queries)
    count = max(1, -(-rows.count() // SHARD_ROWS), 2 * spark.sparkContext.defaultParallelism)
    asked = queries.groupBy(F.floor(F.pmod(F.xxhash64("id"), F.lit(max(1, count // 8))) / 1).alias("tile"), F.size("cells").alias("dim")).agg(F.collect_list(F.struct("id", "cells")).alias("asked"))
    tiles = asked.select("dim", "asked", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"))
    pairs = shards(rows, count).join(tiles, ["shard", "dim"]).select("shard", "members", "asked")
    lists = pairs.mapInArrow(_best(k), "query_id long, vec_id long, score long").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    best = lambda w: F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        lists = lists.withColumn("shard", F.pmod("shard", F.lit(count)))
        lists = lists.withColumn("rank", best(Window.partitionBy("query_id", "shard"))).where(F.col("rank") <= k)
    return lists.withColumn("rank", best(Window.partitionBy("query_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of `embeddings` for every vec_id divisible by 20; see `nearest` for edge cases."""
    vectors = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("cells"))
    return nearest(rows, rows.where("id % 20 = 0"), 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT vec_id, unnest(cells) AS c, generate_subscripts(cells, 1) AS i FROM v),
dot AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.c * r.c) AS BIGINT) AS score
        FROM cell q JOIN cell r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dot) WHERE rank <= 20
"""
