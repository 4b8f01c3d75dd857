"""Substring dedup by fixed-block anchors: later copies of runs of SPAN words go, the first stays.

1. The index: non-overlapping blocks of BLOCK words, at every BLOCK-th word of each text. A run of SPAN
   words holds a whole one wherever it starts, as SPAN >= 2 * BLOCK - 1. The probes: every rolling
   window of BLOCK words. Both go to hash buckets once for each block of documents; a bucket says which
   occur twice and which of them are indexed.
2. Hits extend: a run of SPAN words can repeat only if all windows in it occur twice and one is an
   indexed block. Such runs are compared whole, by hash, and the earliest place of each is found.
   Runs side by side make up the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, answer, answers_of, ask, buckets_for, counts, covered, distinct, each, pack
from .common import pair, rolling, shared_dir, stored, table, tidied, words

SPAN = 20
BLOCK = 10
PROBE_MASK = np.uint64((1 << 64) - (1 << 20))  # probes carry 44 bits: a false hit only compares one more run
TWICE, INDEXED = 1, 2


class Words:
    """Words of a block of documents, and their rolling windows of `size` words."""

    def __init__(self, block: Block, span: int, size: int):
        self.block, self.span, self.size = block, span, size
        self.doc, _, _, value = words(block.body, block.at)
        n = len(value)
        self.first = np.searchsorted(self.doc, np.arange(len(block.at)))  # first word of each text
        self.index = np.arange(n) - self.first[self.doc] if n else np.zeros(0, np.int64)
        self.grams = rolling(value, size)
        self.inside = self.doc[: len(self.grams)] == self.doc[size - 1 :] if len(self.grams) else np.zeros(0, bool)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all rolling windows inside a text, and which of them are index blocks."""
        at = np.flatnonzero(self.inside)
        return self.grams[at] & PROBE_MASK, self.index[at] % self.size == 0

    def runs(self, said: np.ndarray) -> np.ndarray:
        """First words of runs of `span` words that may repeat. said: a bucket's answers for probes(), in order."""
        flags = np.zeros(len(self.grams), np.uint8)
        flags[self.inside] = said
        width = self.span - self.size + 1  # windows in a run
        if len(flags) < width:
            return np.zeros(0, np.int64)
        twice = np.concatenate([[0], np.cumsum(flags & TWICE)])
        hit = np.concatenate([[0], np.cumsum(flags == (TWICE | INDEXED))])
        n = len(flags) - width + 1
        reach = min(self.size, width)
        return np.flatnonzero((twice[width:] - twice[:-width] == width) & (hit[reach : reach + n] - hit[:n] > 0) & (self.doc[:n] == self.doc[self.span - 1 : self.span - 1 + n]))

    def run_keys(self, starts: np.ndarray) -> np.ndarray:
        return pair(self.grams[starts], self.grams[starts + self.span - self.size])

    def order(self, starts: np.ndarray) -> np.ndarray:
        """Order of runs by document id (null last), then place, then row."""
        doc = self.doc[starts]
        return np.lexsort((doc, self.index[starts], self.block.ids[doc], self.block.null[doc]))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def first_of_each(runs: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of runs, the earliest run of each, and the place of each run's key."""
    ordered = runs.order(starts)
    keys, at, place = np.unique(runs.run_keys(starts[ordered]), return_index=True, return_inverse=True)
    back = np.empty(len(starts), np.int64)
    back[ordered] = place
    return keys, ordered[at], back


def drop_repeats(docs: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per row of docs, RESULT: without the words of each run of `span` words that also starts earlier.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged; null has none.
    Earlier: a smaller id, or in one text an earlier word. Runs don't cross rows and are judged on the
    input. Rows that repeat an id are texts of their own, of which one counts as the earlier; null ids
    come last. `kept` (words left, one space between) is null unless asked for. Columns other than the
    two named don't matter.
    """
    spark, size, folder = docs.sparkSession, max(1, span // 2), shared_dir(docs.sparkSession)
    packed = stored(pack(docs, doc_id, text), folder, "packed")
    total = 3 * (packed.agg(F.sum(F.octet_length("body"))).first()[0] or 0)

    def probe(block: Block, row: dict):
        keys, indexed = Words(block, span, size).probes()
        keys, place, times = distinct(keys)
        marks = np.zeros(len(keys), np.uint8)
        marks[place[indexed]] = 1
        return keys, [times.clip(0, 2).astype(np.uint8), marks]

    def hits(keys: np.ndarray, facts: list[np.ndarray]) -> np.ndarray:
        return (TWICE * (counts(keys, facts[0]) > 1) + INDEXED * (counts(keys, facts[1]) > 0)).astype(np.uint8)

    def found(block: Block, row: dict) -> tuple[Words, np.ndarray]:
        own = Words(block, span, size)
        _, place, _ = distinct(own.probes()[0])
        return own, own.runs(answers_of(row["answers"])[place] if len(place) else np.zeros(0, np.uint8))

    def extend(block: Block, row: dict):
        own, starts = found(block, row)
        keys, at, _ = first_of_each(own, starts)
        doc = own.doc[starts[at]]
        return keys, [block.null[doc], block.ids[doc], own.index[starts[at]].astype(np.int32), np.full(len(keys), row["block"], np.int64)]

    def earliest(keys: np.ndarray, facts: list[np.ndarray]) -> np.ndarray:
        order = np.lexsort((*facts[::-1], keys))
        ordered, out = keys[order], np.zeros(len(keys), np.uint8)
        out[order] = np.concatenate([[1], ordered[1:] != ordered[:-1]]) if len(keys) else 0
        return out

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            block = Block.of(row)
            own, starts = found(block, row)
            _, at, place = first_of_each(own, starts)
            stays = np.zeros(len(starts), bool)
            stays[at] = answers_of(row["more"])[: len(at)] == 1
            yield _result(own, covered(len(own.doc), starts[~stays], span), with_kept)

    n = buckets_for(total / 6)
    probed = stored(answer(ask(packed, probe, n), [np.uint8, np.uint8], hits, n), folder, "probed")
    both = packed.join(probed, "block", "left")
    n = buckets_for(total / 15)
    kinds = [bool, np.int64, np.int32, np.int64]
    more = stored(answer(ask(both, extend, n), kinds, earliest, n).withColumnRenamed("answers", "more"), folder, "extended")
    return both.join(more, "block", "left").mapInArrow(tidied(last), RESULT)


def _result(own: Words, gone: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    block, out = own.block, {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
    for i, (a, b) in enumerate(zip(block.at[:-1], block.at[1:])):
        mine, parts = gone[own.first[i] : own.first[i + 1]], block.body[a:b].tobytes().split()
        lost = int(mine.sum())
        kept = b" ".join(compress(parts, (~mine).tolist()) if lost else parts)
        out["doc_id"].append(None if block.null[i] else int(block.ids[i]))
        out["n_words"].append(len(parts))
        out["n_removed"].append(lost)
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept.decode() if with_kept else None)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `documents`: without the words of runs of 20 that also start earlier.

    A null text has no words; its row has the digest of the empty text. Null ids come last; see `drop_repeats`.
    """
    return drop_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 19)) AS s, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1 : i + 20], ' '))) AS run FROM w WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE r > 1),
lost AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""
