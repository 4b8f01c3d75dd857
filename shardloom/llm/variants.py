"""Spelling variants of a corpus: words within one edit of each other, found by the halves of every word.

One edit leaves a half of a word as it is. Shards of an Aho-Corasick automaton hold both halves of their words; every word is scanned by
the shards that its own beginnings and ends belong to, and a hit counts if its offset and the length of the word behind it fit.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, slices, small_batches, stored, table, tidied

LENGTH, LEAST, RATIO, DELETED = 7, 2, 10, 31
HELD = 400_000  # distinct words that a task counts before it hands them on
SHARD_ROWS, SHARD_BYTES = 50_000, 8 << 20
HOT = 50_000  # words with one half; beyond it that half's words are halved again
LEAF = 12  # words that are compared one by one
BROADCAST_KEYS = 10_000

# Latin-1: A-Z to a-z, letters stay, all else parts words.
LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def word_counts(docs: DataFrame, length: int = LENGTH, least: int = LEAST, deleted: int = DELETED) -> DataFrame:
    """word, n: words of `length` code points or more with `least` occurrences or more.

    A word of a document loses one letter where `deleted` divides the crc32 of "<doc_id>:<word>"; see `op11_spelling_variants`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in slices(batches, "text"):
            for doc, text in zip(part.column("doc"), part.column("text")):
                begun = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in Counter(text.as_py().encode("latin-1", "replace").translate(LETTER).split()).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if h % deleted == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= length:
                        total[word] += n
            if len(total) > HELD:
                yield from out(total)
                total.clear()
        yield from out(total)

    def out(total: Counter) -> Iterator[pa.RecordBatch]:
        found = list(total.items())
        for i in range(0, len(found), 100_000):
            part = found[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = small_batches(docs.select(text("doc_id").alias("doc"), text("text").alias("text"))).mapInArrow(tidied(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- halves ------------------------------------------------------------------------------------


def cut(path: str, length: int) -> tuple[int, int]:
    """What is left open of a word: from lo to hi, once the halves that path names (p the first, s the second) are taken as known."""
    lo, hi = 0, length
    for step in path:
        middle = lo + (hi - lo) // 2
        lo, hi = (middle, hi) if step == "p" else (lo, middle)
    return lo, hi


def halves(word: str, path: str = "", known: tuple[int, int] | None = None) -> Iterator[tuple[str, str, str, bool]]:
    """(path, beginning, end, own): the halves of the words that this one may be near to, and which of them are its own.

    They are those of words of its length and one more or less. For a path, only those whose known parts have the lengths `known`.
    """
    size, found = len(word), {}
    for length in (size - 1, size, size + 1):
        lo, hi = cut(path, length)
        if known is not None and known != (lo, length - hi):
            continue
        for step in "ps":
            lo, hi = cut(path + step, length)
            key = (path + step, word[:lo], word[size - (length - hi) :])
            found[key] = found.get(key, False) or length == size
    return ((*key, own) for key, own in found.items())


ROUTED = "path string, beginning string, ending string, own boolean, word string, n long"


def _routed(rows: DataFrame) -> DataFrame:
    """A row for each half of each word; rows that have halves already get those of what is left open."""
    deeper = "path" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                out = []
                for row in batch.slice(i, 10_000).to_pylist():
                    known = (row["path"], (len(row["beginning"]), len(row["ending"]))) if deeper else ("", None)
                    out += [(*key, row["word"], row["n"]) for key in halves(row["word"], *known)]
                columns = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ROUTED)], ["path", "beginning", "ending", "own", "word", "n"])

    found = rows.mapInArrow(tidied(run), ROUTED)
    return found.groupBy("path", "beginning", "ending", "word", "n").agg(F.max("own").alias("own")) if deeper else found


_ROUTED = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
KEY = ["path", "beginning", "ending"]


def routes(words: DataFrame, folder: str, hot: int = HOT) -> DataFrame:
    """The halves of all words; a half of more than `hot` words gives way to the halves of what it leaves open, again and again.

    What leaves open one letter can't be halved: so many words are no more than there are letters.
    """
    rows, done, level = _routed(words), [], 0
    if words.count() <= hot:
        return rows
    while True:
        left = F.length("word") - F.length("beginning") - F.length("ending")
        many = rows.where("own").groupBy(*KEY).agg(F.count("*").alias("_n"), F.min(left).alias("_left")).where((F.col("_n") > hot) & (F.col("_left") > 1)).select(*KEY)
        many = stored(many, folder, f"hot-{level}")
        n = many.count()
        if not n:
            done.append(rows)
            break
        small = F.broadcast(many) if n <= BROADCAST_KEYS else many
        done.append(rows.join(small, KEY, "left_anti"))
        rows = stored(_routed(rows.join(small, KEY, "left_semi")), folder, f"halved-{level}")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + 1 - (len(a) - len(b)) :]


class Halved:
    """Words of one length that are equal outside lo to hi; more than LEAF are held by the halves of what is between."""

    def __init__(self, words: list[str], lo: int, hi: int):
        self.words, self.lo, self.hi, self.middle = words, lo, hi, lo + (hi - lo) // 2
        self.firsts = self.seconds = None

    def _split(self) -> None:
        firsts, seconds = defaultdict(list), defaultdict(list)
        for w in self.words:
            firsts[w[self.lo : self.middle]].append(w)
            seconds[w[self.middle : self.hi]].append(w)
        self.firsts = {k: Halved(v, self.middle, self.hi) for k, v in firsts.items()}
        self.seconds = {k: Halved(v, self.lo, self.middle) for k, v in seconds.items()}

    def near(self, word: str, longer: int) -> Iterator[str]:
        """The words within one edit of a word that is equal outside, and longer by -1, 0 or 1."""
        lo, hi, middle = self.lo, self.hi, self.middle
        if len(self.words) <= LEAF or hi - lo < 2:
            own = word[lo : hi + longer]
            yield from (w for w in self.words if one_edit(w[lo:hi], own))
            return
        if self.firsts is None:
            self._split()
        first = word[lo:middle]
        if first in self.firsts:
            yield from self.firsts[first].near(word, longer)
        if (found := self.seconds.get(word[middle + longer : hi + longer])) is not None:
            yield from (w for w in found.near(word, longer) if w[lo:middle] != first)


def _fits_path(path: str, a: str, word: str) -> bool:
    """Whether no earlier path leads to this pair: where the second half was taken, the first ones differ."""
    for i, step in enumerate(path):
        if step == "s":
            lo, hi = cut(path[:i], len(a))
            middle = lo + (hi - lo) // 2
            if a[lo:middle] == word[lo:middle]:
                return False
    return True


def scan(shard: pa.Table) -> pa.Table:
    """word, near, best_n, best: for the words of a shard how many near words its halves lead to, and the most frequent of them."""
    groups: defaultdict[tuple[str, str, str], defaultdict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    n: dict[str, int] = {}
    for path, beginning, ending, own, word, count in zip(*(shard.column(c).to_pylist() for c in ("path", "beginning", "ending", "own", "word", "n"))):
        n[word] = count
        if own:
            groups[path, beginning, ending][len(word)].append(word)
    segments: defaultdict[str, list[tuple]] = defaultdict(list)
    for (path, beginning, ending), by_length in groups.items():
        held = {length: Halved(ws, len(beginning), length - len(ending)) for length, ws in by_length.items()}
        segments[beginning if path[-1] == "p" else ending].append((path, beginning, ending, held))
    automaton = ahocorasick.Automaton()
    for segment, held in segments.items():
        if segment:
            automaton.add_word(segment, held)
    automaton.make_automaton()
    out = []
    for word in n if len(automaton) else ():
        size, near, best = len(word), 0, None
        for end, held in automaton.iter(word):
            for path, beginning, ending, by_length in held:
                if path[-1] == "p":
                    if end != len(beginning) - 1 or not word.endswith(ending):
                        continue
                elif end != size - 1 or not word.startswith(beginning):
                    continue
                for length in (size - 1, size, size + 1):
                    if length not in by_length:
                        continue
                    for w in by_length[length].near(word, size - length):
                        if "s" not in path or _fits_path(path, w, word):
                            near += 1
                            best = min(best, (-n[w], w)) if best else (-n[w], w)
        if near:
            out.append((word, near, -best[0], best[1]))
    columns = zip(*out) if out else [[]] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])


def nearest(words: DataFrame, folder: str, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, n, n_near, best_n, best of distinct words (word, n): number of near words, and the most frequent one (the smallest of equals)."""
    rows = routes(words, folder, hot)
    about = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("beginning") + F.octet_length("ending")), F.lit(0))).first()
    shards = max(1, -(-about[0] // shard_rows), -(-about[1] // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(*KEY), F.lit(shards)).cast("int"))
    found = dealt.groupBy("shard").applyInArrow(scan, "word string, near long, best_n long, best string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    both = none.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("_b")).select("word", "n", "n_near", (-F.col("_b.less")).alias("best_n"), F.col("_b.best").alias("best"))


def roots(links: DataFrame, folder: str) -> DataFrame:
    """word, root of links (word, form): where following forms ends. Every round doubles the steps; forms grow in number, so rounds are few."""
    now, level = links.select("word", F.col("form").alias("root"), F.lit(True).alias("_moved")), 0
    while True:
        behind = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = now.select("word", "root").join(behind, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        now = stored(now, folder, f"roots-{level}")
        discard(links.sparkSession, folder, f"roots-{level - 1}")
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        level += 1


def variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, deleted: int = DELETED, hot: int = HOT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of documents (doc_id, text); see `op11_spelling_variants`.

    A null text has no words, a null doc_id counts as the empty one. Repeated rows count each. An empty table gives no rows; other
    columns, whatever their names, are not read. Words may be of any length: a shard is bounded by bytes too.
    """
    folder = shared_dir(docs.sparkSession)
    words = stored(word_counts(docs, length, least, deleted), folder, "words")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = nearest(words, folder, hot, shard_rows).select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    found = stored(found, folder, "found")
    discard(docs.sparkSession, folder, "words")
    ends = roots(found.where("form is not null").select("word", "form"), folder)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n over all `documents`.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, of seven code points and two occurrences or more; one in
    31 pairs of document and word loses a letter first, by the crc32 of both. Near words differ by one inserted, deleted or replaced code
    point. form is the most frequent near word (the smallest in code-point order of equals) if it occurs ten times as often, root the
    last of the forms from here.
    """
    return variants(table(spark, sf_dir, "documents"))
