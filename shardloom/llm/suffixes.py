"""Suffix-array dedup by bucket-pointer refinement: q-gram buckets, refined by the bucket numbers of later offsets.

A suffix's bucket at depth 2q follows from two bucket numbers at depth q: its own, and that of the suffix
q bytes on. Each level asks only for the suffixes that still share their bucket: their refined numbers
are sorted together (`counts`, on the machine that holds the range of the number), which says how large
each new bucket is. A suffix alone in its bucket leaves; the numbers of the others are used again, by
themselves and by the suffixes that point to them, at the next level. Bucket numbers are 64-bit hashes
of what the bucket's suffixes begin with, so equal beginnings get equal numbers on every machine.

Not every suffix is sorted from the start. Anchors are suffixes whose q-gram has its smallest s-gram at
its start or end: being one depends on the q-gram alone, and LENGTH bytes always hold some. Levels:

1. Anchors at depth q.
2. Anchors that share their bucket, at depth 2q, by the bucket q bytes on.
3. Anchors that still do, by the bucket of the next anchor, if that one is shared too: it names all bytes
   from one anchor to the end of the next. A bucket as large as before has not been split.
4. Windows of LENGTH bytes. With an anchor alone in its bucket a window is unique. If no bucket was split
   at its anchors, all that share the anchor share the window. Only the others, at the ends of repeats,
   get a number of their own: the bucket at their start refined by that LENGTH - 2q bytes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, answer, answers_of, ask, buckets_for, counts, covered, distinct, each, pack
from .common import BYTE, pair, rolling, shared_dir, stored, table, tidied

LENGTH = 200
LEAST = 16  # shorter lengths hold no anchor for sure
S = 16  # bytes of an s-gram; anchors are at most q - S bytes apart
TWIST = np.uint64(0x5851F42D4C957F2D)  # keeps buckets of pairs apart from those of anchors


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of k values, by doubling."""
    width = 1
    while width * 2 <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if width < k else x


class Suffixes:
    """Suffixes of a block: bucket numbers at depth q (everywhere) and 2q (where asked for), and the anchors among them."""

    def __init__(self, block: Block, length: int = LENGTH):
        self.length, self.block = length, block
        self.q = q = -(-length // 4)  # two buckets at depth 2q cover a window
        s = min(S, q // 3)
        value = BYTE[block.body]
        n = len(block.body)
        self.grams = rolling(value, q)
        doc = np.repeat(np.arange(len(block.at) - 1), np.diff(block.at))
        m = max(0, n - 2 * q + 1)
        if m:
            small = rolling(value, s)
            least = sliding_min(small, q - s + 1)[:m]
            picked = (doc[:m] == doc[2 * q - 1 :]) & ((least == small[:m]) | (least == small[q - s :][:m]))
        else:
            picked = np.zeros(0, bool)
        self.at = np.flatnonzero(picked)
        self.near = doc[self.at[:-1]] == doc[self.at[1:]] if len(self.at) > 1 else np.zeros(0, bool)  # anchor i + 1 is in the text of i
        starts = max(0, n - length + 1)
        self.windows = doc[:starts] == doc[length - 1 :] if starts else np.zeros(0, bool)
        self.own = np.full(len(self.at), 2, np.int64)  # sizes of the anchors' buckets, as far as known
        self.link = np.zeros(len(self.at) + 1, np.int64)  # link[i + 1]: of anchor i and the next
        self.sure = self.unsure = np.zeros(0, np.int64)  # windows repeated for sure, windows to be asked about: known once links are

    def refined(self, places: np.ndarray) -> np.ndarray:
        """Bucket numbers at depth 2q: that at depth q, and that of the suffix q bytes on."""
        return pair(self.grams[places], self.grams[places + self.q])

    def shared(self) -> np.ndarray:
        """Anchors that aren't alone in their bucket."""
        return np.flatnonzero(self.own > 1)

    def linked(self) -> np.ndarray:
        """Anchors that aren't alone, nor is the next one."""
        return np.flatnonzero(self.near & (self.own[:-1] > 1) & (self.own[1:] > 1)) if len(self.at) > 1 else np.zeros(0, np.int64)

    def keys(self, level: int) -> np.ndarray:
        """Bucket numbers that this level asks about; those before must be told."""
        if level == 0:
            return self.grams[self.at]
        if level == 1:
            return self.refined(self.at[self.shared()])
        if level == 2:
            i = self.linked()
            gap = (self.at[i + 1] - self.at[i]).astype(np.uint64)
            return pair(pair(self.refined(self.at[i]), self.refined(self.at[i + 1])), gap ^ TWIST)
        return pair(self.refined(self.unsure), self.refined(self.unsure + self.length - 2 * self.q))

    def tell(self, level: int, sizes: np.ndarray) -> None:
        """sizes: of the buckets of keys(level), in their order."""
        if level == 0:
            self.own = sizes
        elif level == 1:
            self.own[self.shared()] = sizes
        elif level == 2:
            self.link[1:-1][self.near] = 1  # an end that is alone leaves the pair alone
            self.link[self.linked() + 1] = sizes
            self.sure, self.unsure = self._open_windows()

    def _open_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(start of each window that is repeated for sure, start of each that needs a bucket of its own)."""
        own, link = self.own, self.link
        if not len(self.windows) or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = link[:-1] == own, link[1:] == own  # all in the bucket go on alike
        alone = np.concatenate([[0], np.cumsum(own == 1)])
        cut = np.concatenate([[0], np.cumsum(link == 1)])  # link[i] joins anchors i - 1 and i
        uneven = np.concatenate([[0], np.cumsum(~(left & right))])
        starts = np.flatnonzero(self.windows)
        j = np.searchsorted(self.at, starts)  # first anchor in the window
        k = np.searchsorted(self.at, starts + self.length - 2 * self.q, "right")  # behind the last
        shared = (k > j) & (alone[k] == alone[j]) & (cut[np.maximum(k, j + 1)] == cut[j + 1])
        starts, j, k = starts[shared], j[shared], k[shared]
        # even: every anchor inside agrees on both sides, so the first anchor's bucket is the window's
        even = uneven[k] == uneven[j]
        return starts[even], starts[~even]


def removed(block: Block, starts: np.ndarray, length: int) -> np.ndarray:
    """Which bytes windows of `length` from these starts cover."""
    return covered(len(block.body), starts, length)


SHARES = (0.06, 0.06, 0.06, 0.4)  # keys of each level for a byte of text, at most about
WINDOWS = len(SHARES) - 1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """One row per row of docs, RESULT: without the bytes of every `length`-byte string that starts at two places.

    Texts are UTF-8; null is empty. Strings don't cross rows, may overlap, and are judged on the input.
    Rows that repeat an id are texts of their own. `kept` (the bytes left) is null unless asked for.
    Columns other than the two named don't matter. length: LEAST or more.
    """
    if length < LEAST:
        raise ValueError(f"length {length} is under {LEAST}")
    folder = shared_dir(docs.sparkSession)
    packed = stored(pack(docs, doc_id, text), folder, "packed")
    total = packed.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    reply = lambda keys, facts: counts(keys, facts[0]).clip(0, 2**31 - 1).astype(np.uint32)

    def told(block: Block, row: dict, levels: int) -> Suffixes:
        own = Suffixes(block, length)
        for level in range(levels):
            own.tell(level, _sizes(own, row, level))
        return own

    def asking(level: int):
        def keys_of(block: Block, row: dict):
            keys, _, times = distinct(told(block, row, level).keys(level))
            return keys, [times.astype(np.uint32)]

        return keys_of

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            block = Block.of(row)
            own = told(block, row, WINDOWS)
            twice = _sizes(own, row, WINDOWS) > 1
            yield _result(block, removed(block, np.concatenate([own.sure, own.unsure[twice]]), length), with_kept)

    rows = packed
    for level, share in enumerate(SHARES):
        n = buckets_for(3 * total * share)  # text is about three times as long as its packed form
        sizes = answer(ask(rows, asking(level), n), [np.uint32], reply, n)
        rows = rows.join(stored(sizes.withColumnRenamed("answers", f"level{level}"), folder, f"level{level}"), "block", "left")
    return rows.mapInArrow(tidied(last), RESULT)


def _sizes(own: Suffixes, row: dict, level: int) -> np.ndarray:
    """What the buckets answered to keys(level), in its order."""
    _, place = np.unique(own.keys(level), return_inverse=True)
    return answers_of(row[f"level{level}"], np.uint32)[place].astype(np.int64) if len(place) else np.zeros(0, np.int64)


def _result(block: Block, gone: np.ndarray, with_kept: bool) -> pa.RecordBatch:
    at, out = block.at, {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        mine = gone[a:b]
        kept = block.body[a:b][~mine].tobytes()
        out["doc_id"].append(None if block.null[i] else int(block.ids[i]))
        out["n_bytes"].append(int(b - a))
        out["n_removed"].append(int(mine.sum()))
        out["n_spans"].append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept if with_kept else None)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_substrings of documents, without the bytes left: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup_substrings(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")
