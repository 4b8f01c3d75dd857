"""Documents in compressed blocks, and exchanges of 64-bit keys between blocks and hash buckets.

An exact-repeat search asks one question of very many keys: does this key occur elsewhere? A block of
documents sends every distinct key once, in sorted arrays, to the bucket of its hash; a bucket answers
in the order it was asked. A key that a third of all documents hold costs a bucket one entry a block,
never one a document, so no bucket is hot. Answers go back to the blocks by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts, tidied

BLOCK_BYTES = 2 << 20
KEYS_A_BUCKET = 3_000_000  # keys that a bucket takes in, about; bounds its memory


def squeeze(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def expand_sorted(data: bytes) -> np.ndarray:
    planes = expand(data, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


@dataclass
class Block:
    """ids (and which of them are null), bytes of all texts behind one another, n + 1 offsets, hashes of texts if asked for."""

    ids: np.ndarray
    null: np.ndarray
    body: np.ndarray
    at: np.ndarray
    marks: np.ndarray | None = None

    @staticmethod
    def of(row: dict) -> Block:
        ids, null = expand(row["ids"], np.int64), expand(row["null"], bool)
        sizes = expand(row["sizes"], np.int64)
        marks = expand(row["marks"], np.int64) if row.get("marks") else None
        return Block(ids, null, expand(row["body"], np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), marks)


PACKED = "block long, n int, ids binary, `null` binary, sizes binary, body binary, marks binary"


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """Rows of PACKED, about BLOCK_BYTES of text each; a longer text is a block of its own. marks: xxhash64 of each text, if `marked`.

    Block numbers follow from the task, so write the result before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", BLOCK_BYTES):
            body, at = texts(part.column("text"))
            ids = part.column("id")
            row = {"block": number, "n": part.num_rows, "ids": squeeze(ids.fill_null(0).to_numpy(zero_copy_only=False)), "null": squeeze(ids.is_null().to_numpy(zero_copy_only=False)),
                   "sizes": squeeze(np.diff(at)), "body": squeeze(body, 3), "marks": squeeze(part.column("mark").to_numpy()) if marked else None}
            number += 1
            yield pa.RecordBatch.from_pylist([row], _PACKED_ARROW)

    mark = [F.xxhash64(text).alias("mark")] if marked else []
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), *mark).mapInArrow(tidied(run), PACKED)


_PACKED_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), *[(x, pa.binary()) for x in ("ids", "null", "sizes", "body", "marks")]])
ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("payload", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])


def ask(rows: DataFrame, keys_of: Callable[[Block, dict], tuple[np.ndarray, list[np.ndarray]]], buckets: int) -> DataFrame:
    """(block, bucket, keys, payload): what keys_of gives for each block, dealt out by hash.

    keys_of returns sorted distinct keys and arrays of facts in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            keys, facts = keys_of(Block.of(row), row)
            cuts = bounds(keys, buckets)
            for b in range(buckets):
                part = slice(cuts[b], cuts[b + 1])
                if part.start == part.stop:
                    continue
                payload = b"".join(len(x := squeeze(f[part])).to_bytes(4, "little") + x for f in facts)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bucket": b, "keys": squeeze_sorted(keys[part]), "payload": payload}], ASKED)

    return rows.mapInArrow(tidied(run), "block long, bucket int, keys binary, payload binary")


def bounds(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket's part of sorted keys begins, and their number: buckets are ranges of the hash."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def facts_of(payload: bytes, types: list) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = int.from_bytes(payload[at : at + 4], "little")
        out.append(expand(payload[at + 4 : at + 4 + size], t))
        at += 4 + size
    return out


def answer(asked: DataFrame, types: list, reply: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], buckets: int) -> DataFrame:
    """(block, answers array<struct<bucket, answer>>): reply's bytes for each key, in the order asked.

    reply gets, for one bucket, the keys of all blocks and the facts sent with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for row in each(batches):
            held.setdefault(row["bucket"], []).append(row)
        for bucket, rows in held.items():
            parts = [expand_sorted(r["keys"]) for r in rows]
            facts = [facts_of(r["payload"], types) for r in rows]
            for r in rows:
                r["keys"] = r["payload"] = None
            said = reply(np.concatenate(parts), [np.concatenate(x) for x in zip(*facts)])
            for r, own in zip(rows, np.split(said, np.cumsum([len(p) for p in parts])[:-1])):
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "bucket": bucket, "answer": squeeze(own)}], ANSWERED)

    dealt = asked.repartition(buckets, "bucket")
    said = dealt.mapInArrow(tidied(run), "block long, bucket int, answer binary")
    return said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def answers_of(value: list | None, dtype=np.uint8) -> np.ndarray:
    """The answers of all buckets in the order of the block's sorted keys."""
    parts = [expand(x["answer"], dtype) for x in value or []]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def buckets_for(keys: float) -> int:
    """How many buckets hold about KEYS_A_BUCKET keys each."""
    return max(2, -(-int(keys) // KEYS_A_BUCKET))


def counts(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each key the sum of `own` over all its entries."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(own[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff(np.append(new, len(keys))))
    return out


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places windows of `length` from these starts cover."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(starts + length, minlength=n + 1)[:n]) > 0


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)
