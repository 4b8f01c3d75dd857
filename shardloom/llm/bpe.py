"""Byte-level BPE encoding and decoding: whole pre-tokens by minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spare, table, tidied

CACHE = 1 << 19  # pre-tokens whose ids a task remembers; only speed depends on it


class PerfectHash:
    """Minimal perfect hash of fixed keys: buckets, largest first, each get a seed that puts their keys in free places."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        self.seeds, taken = np.zeros(self.buckets, np.int64), np.zeros(self.n, bool)
        first = np.array([hash_bytes(k) for k in keys], np.uint64)
        own = (first % np.uint64(self.buckets)).astype(np.int64)
        members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=self.buckets))[:-1])
        self.place = np.zeros(self.n, np.int64)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not len(members[b]):
                break
            if len(members[b]) == 1:  # the rest: one key each, straight to the free places
                free = iter(np.flatnonzero(~taken)) if free is None else free
                at = int(next(free))
                self.seeds[b], self.place[members[b][0]] = -at - 1, at
                continue
            h, seed = first[members[b]][:, None], 1
            while True:  # 64 seeds at a time
                at = self._at(h, np.arange(seed, seed + 64, dtype=np.uint64))
                fits = np.flatnonzero(~taken[at].any(axis=0) & (np.diff(np.sort(at, axis=0), axis=0) > 0).all(axis=0))
                if len(fits):
                    break
                seed += 64
            at = at[:, fits[0]]
            taken[at], self.seeds[b], self.place[members[b]] = True, seed + int(fits[0]), at
        self._seeds = self.seeds.tolist()

    def _at(self, h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        x = (h ^ seeds * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def __getitem__(self, key: bytes) -> int:
        """The place of a key; for any other bytes some place or other."""
        h = hash_bytes(key)
        seed = self._seeds[h % self.buckets]
        if seed < 0:
            return -seed - 1
        x = (h ^ (seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        return (x >> 32) % self.n


hash_bytes = xxhash.xxh3_64_intdigest


class Codec:
    """Encodes and decodes by a table of token bytes and ranks (base64 and rank in each line)."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.tokens: list[tuple[bytes, int]] = [(b"", -1)] * len(keys)
        for key, at in zip(keys, self.hash.place.tolist()):
            self.tokens[at] = (key, self.ranks[key])
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, str] = {}

    def whole(self, part: bytes) -> int:
        """First tier: the id of a pre-token that is a token, or -1."""
        key, rank = self.tokens[self.hash[part]]
        return rank if key == part else -1

    def merge(self, part: bytes) -> list[int]:
        """Second tier: the pair of least rank, leftmost first, merges until none is left.

        A heap entry holds rank, start and end of a pair as one number.
        """
        n, rank, push, pop = len(part), self.ranks.get, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits
        end, left = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at i; end 0: gone
        heap = [r << both | i << bits | i + 2 for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, stop = entry >> bits & low, entry & low
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two has changed since
            end[i], end[mid] = stop, 0
            left[stop] = i
            if stop < n and (r := rank(part[i : end[stop]])) is not None:
                push(heap, r << both | i << bits | end[stop])
            if (j := left[i]) >= 0 and (r := rank(part[j:stop])) is not None:
                push(heap, r << both | j << bits | stop)
        return [rank(part[i : end[i]]) for i in range(n) if end[i]]

    def ids(self, part: str) -> list[int]:
        raw = part.encode("utf-8", "surrogatepass")
        return [rank] if (rank := self.whole(raw)) >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.ids(part)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def ids_text(self, text: str) -> str:
        """The ids of a text as decimal numbers with spaces between."""
        cache, out = self.cache, []
        for part in self.split(text):
            got = cache.get(part)
            if got is None:
                got = " ".join(map(str, self.ids(part)))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(part) <= 64:
                    cache[part] = got
            out.append(got)
        return " ".join(out)


@functools.lru_cache(2)
def codec(lines: bytes, pattern: str) -> Codec:
    return Codec(lines, pattern)


def digests(lines: bytes, pattern: str):
    """An Arrow UDF: text to (n_tokens, ids_sha256, decoded_sha256); null is the empty text."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    @tidied
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(lines, pattern)
        try:
            for batch in values:
                out: tuple[list, list, list] = ([], [], [])
                for value in batch:
                    ids = own.ids_text(value.as_py() or "")
                    decoded = own.decode(map(int, ids.split()))
                    out[0].append(ids.count(" ") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # the worker is used again, by other stages too
            own.cache.clear()

    return run


def encode(docs: DataFrame, lines: bytes, pattern: str, text: str = "text", column: str = "ids") -> DataFrame:
    """docs with the token ids of text, array<int>; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    @tidied
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(lines, pattern)
        for batch in values:
            yield pa.array([own.encode(v.as_py() or "") for v in batch], pa.list_(pa.int32()))

    return small_batches(docs).withColumn(column, run(F.col(text)))


def decode(docs: DataFrame, lines: bytes, pattern: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """docs with the text of token ids; bytes that are not UTF-8 become U+FFFD, null ids give null.

    An id outside the vocabulary is an error.
    """

    @F.arrow_udf("string")
    @tidied
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(lines, pattern)
        for batch in values:
            yield pa.array([None if v is None else own.decode(v).decode("utf-8", "replace") for v in batch.to_pylist()], pa.string())

    return small_batches(docs).withColumn(column, run(F.col(ids)))


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The lines of a rank file (under 1 MB, so sent with the tasks) and the pattern of pre-tokens."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def token_digests(docs: DataFrame) -> DataFrame:
    """docs (all columns but text) with n_tokens, ids_sha256, decoded_sha256; a null text is the empty one.

    Columns of docs named like a result are replaced.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept, own = [c for c in docs.columns if c not in (*new, "text")], spare(docs, "_bpe")
    return small_batches(docs).select(*kept, digests(*vocabulary())(F.col("text")).alias(own)).select(*kept, *[F.col(own)[c].alias(c) for c in new])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `documents`; see `token_digests`."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
