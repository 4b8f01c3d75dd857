"""N-gram Jaccard join: near-duplicate documents by word shingles, with T-occurrence search.

1. Each shingle's number of documents, over all documents, from one exchange between blocks and buckets.
2. Shingles of one document only can't be shared: a document with fewer than 75 % shared ones has no
   partner. Equal sets are one class from here on.
3. A pair must share a shingle of both prefixes (shingles by rising frequency, all but 75 % of them and
   one). In each prefix list a few classes are hubs: the list is searched for them, and they leave it.
   Classes that are linked already need no search. In the last round every class left in a list is a hub;
   its hubs are dealt into indexes of bounded size, and the list's classes are sent to each index once,
   so pairs are never rows. A list of n near copies is done after n searches for its first hub.
4. A search (DivideSkip): the hubs of a group are an inverted index. A query merges its short lists on a
   heap, looks the candidates up in its long lists by binary search, and keeps those that reach the
   overlap their sizes require. Groups with many queries are split; their hubs are copied.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import Block, answer, answers_of, ask, buckets_for, counts, distinct, each, pack, squeeze
from .blocks import expand
from .common import LOWER, discard, mix, rolling, shared_dir, shuffled, spare, stored, table, tidied, words

SHINGLE = 5
MASK = np.uint64((1 << 64) - (1 << 20))  # frequencies are those of the upper 44 bits of a shingle; they only order
HUBS = (1, 16, None)  # hubs a list, by round; None: all that are left
GROUP_HUBS = 128  # hubs of an index, about
LEAD_HUBS = 512  # hubs of one list in an index, about
GROUP_QUERIES = 512


class Sets:
    """Distinct shingles of a block: by document, ascending."""

    def __init__(self, block: Block, size: int = SHINGLE):
        doc, _, _, value = words(block.body, block.at, LOWER)
        docs = len(block.at) - 1
        first = np.searchsorted(doc, np.arange(docs + 1))
        length = np.diff(first)
        grams = rolling(value, size)
        inside = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
        short = np.flatnonzero((length > 0) & (length < size))
        whole = [mix(rolling(value[first[i] : first[i + 1]], int(length[i])) + np.uint64(length[i])) for i in short]
        keys = np.concatenate([grams[inside], *whole]) if len(inside) or whole else np.zeros(0, np.uint64)
        owner = np.concatenate([doc[inside], short])
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        self.keys, self.doc, self.docs = keys[new], owner[new], docs
        self.at = np.searchsorted(self.doc, np.arange(docs + 1))
        self.size = np.diff(self.at)


def required(a: int, b: int, num: int = 75, den: int = 100) -> int:
    """The least overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def divide_skip(lists: list, least: int, ids: int = 1 << 30) -> list[tuple[int, int]]:
    """(id, occurrences) of the ids in at least `least` of the ascending lists, ascending; ids: how many there are at most.

    The longest lists are left out of the merge: with l of them, an id must stand in least - l of the
    others; only such ids are looked up in the long ones, all of them at once in each.
    """
    if least < 1 or len(lists) < least:
        return []
    lists = sorted(lists, key=len)
    skip = _left_out(np.array([len(x) for x in lists]), least, ids)
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    short = [x.tolist() if isinstance(x, np.ndarray) else x for x in short]
    out = _merge(short, least - skip)
    if not skip or not out:
        return out
    found, times = (np.array(x, np.int64) for x in zip(*out))
    for i, more in enumerate(long):
        if i % 8 == 0:
            able = times + (skip - i) >= least
            if not able.all():
                found, times = found[able], times[able]
                if not len(found):
                    return []
        more = np.asarray(more)
        times += more.take(np.searchsorted(more, found), mode="clip") == found
    able = times >= least
    return list(zip(found[able].tolist(), times[able].tolist()))


def _left_out(sizes: np.ndarray, least: int, ids: int) -> int:
    """How many of the longest lists to look up instead of merging: what should cost least.

    A merged entry costs about as much as a hundred lookups; a list that is looked in, three entries.
    """
    skip = np.arange(least)
    merged = np.cumsum(sizes)[len(sizes) - 1 - skip]
    asked = np.minimum(merged // (least - skip), ids)
    return int(np.argmin(merged + skip * (3 + asked / 100)))


def _merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(id, occurrences) of the ids in at least `need` of the ascending lists, by a heap of their heads."""
    at = [0] * len(lists)
    heads = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heads)
    out = []
    while len(heads) >= need:
        now, popped = heads[0][0], []
        while heads and heads[0][0] == now:
            popped.append(heapq.heappop(heads)[1])
        if len(popped) >= need:
            out.append((now, len(popped)))
            ahead = now + 1
        else:  # ids before the need-th head stand in too few lists
            while len(popped) < need - 1 and heads:
                popped.append(heapq.heappop(heads)[1])
            if not heads:
                break
            ahead = heads[0][0]
        for k in popped:
            at[k] = bisect_left(lists[k], ahead, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heads, (lists[k][at[k]], k))
    return out


INFO = "doc_id long, mark long, n_shingles long, node long, most long, prefix array<bigint>, shared binary"


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z as a-z; a set holds the
    distinct runs of `size` words, or the whole sequence of a shorter text. Rows are linked when den *
    overlap >= num * union. component_id is the smallest doc_id that links reach. Null, empty and
    white texts have no shingles and no links. Null ids are linked like others but are never the
    smallest. Rows that repeat an id are documents of their own. Other columns don't matter.
    """
    rooted = labelled(docs, num, den, size, doc_id, text)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(shuffled(least), "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def labelled(docs: DataFrame, num: int = 75, den: int = 100, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, root: rows with one root are one component; no shingles: null."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    packed = stored(pack(docs, doc_id, text, marked=True), folder, "packed")
    total = 3 * (packed.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    n = buckets_for(total / 6)

    def frequency(block: Block, row: dict):
        keys, _, times = distinct(Sets(block, size).keys & MASK)
        return keys, [times.astype(np.uint32)]

    reply = lambda keys, facts: np.minimum(counts(keys, facts[0]), 2**31 - 1).astype(np.uint32)
    frequencies = stored(answer(ask(packed, frequency, n), [np.uint32], reply, n), folder, "frequencies")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            block = Block.of(row)
            yield _describe(block, Sets(block, size), answers_of(row["answers"], np.uint32), num, den)

    info = stored(packed.join(shuffled(frequencies), "block", "left").mapInArrow(tidied(describe), INFO), folder, "info")
    discard(spark, folder, "packed", "frequencies")
    classes = info.where("prefix is not null").select("node", "n_shingles", "most", "prefix", "shared").dropDuplicates(["node"])
    classes = stored(classes, folder, "classes")
    links = _links(classes, folder, num, den)
    discard(spark, folder, "classes")
    if links is None:
        labels = spark.createDataFrame([], "node long, root long")
    else:
        labels = components(links, folder, "labels")
    return info.select("doc_id", "mark", "n_shingles", "node").join(shuffled(labels), "node", "left").select("doc_id", "mark", "n_shingles", F.coalesce("root", "node").alias("root"))


def _describe(block: Block, sets: Sets, said: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """INFO of each text; prefix and shared (shingles that others have) only where a partner is possible.

    most: with m shared shingles, a partner's size is (num + den) * m / num less the own size, at most.
    """
    _, place, _ = distinct(sets.keys & MASK)
    often = said[place].astype(np.int64) if len(place) else np.zeros(0, np.int64)
    order = np.lexsort((sets.keys, often, sets.doc))
    keys, often = sets.keys[order], often[order]
    shared = often > 1
    known = np.concatenate([[0], np.cumsum(shared)])
    spread = mix(sets.keys ^ np.uint64(0x1D8E4E27C47D124F))
    sums = np.concatenate([[0], np.cumsum(spread, dtype=np.uint64)]).astype(np.uint64)
    node = mix(sums[sets.at[1:]] - sums[sets.at[:-1]] + sets.size.astype(np.uint64)).view(np.int64)
    out: dict[str, list] = {k: [] for k in ("doc_id", "mark", "n_shingles", "node", "most", "prefix", "shared")}
    for i in range(sets.docs):
        a, b = sets.at[i], sets.at[i + 1]
        size = int(b - a)
        least = -(-num * size // den)  # of a partner's shingles, at the least
        open_ = size > 0 and known[b] - known[a] >= least
        head = keys[a : a + size - least + 1][shared[a : a + size - least + 1]] if open_ else None
        out["doc_id"].append(None if block.null[i] else int(block.ids[i]))
        out["mark"].append(int(block.marks[i]))
        out["n_shingles"].append(size)
        out["node"].append(int(node[i]) if size else None)
        out["most"].append((num + den) * int(known[b] - known[a]) // num - size)
        out["prefix"].append(head.view(np.int64) if open_ else None)
        out["shared"].append(squeeze(np.sort(keys[a:b][shared[a:b]])) if open_ else None)
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _links(classes: DataFrame, folder: str, num: int, den: int) -> DataFrame | None:
    """(node, other): enough links to join all classes that links reach from one another."""
    spark = classes.sparkSession
    lists = classes.select("node", F.col("n_shingles").alias("n"), "most", F.explode("prefix").alias("key"))
    lists = stored(_possible(lists), folder, "lists").withColumn("root", F.col("node"))
    links = None
    for r, hubs in enumerate(HUBS):
        if not lists.take(1):
            break
        if hubs == 1:  # the smallest set of a list can be linked with most others; lists with one such lead become one
            lead = lists.groupBy("key").agg(F.min(F.struct("n", "node"))["node"].alias("lead"))
            lists = stored(lists.join(shuffled(lead), "key").select(F.col("lead").alias("key"), "node", "n", "most", "root").distinct(), folder, "led")
            chosen, asking = lists.where("node = key"), lists.where("node <> key")
        else:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "node"))
            chosen, asking = lists.withColumn("_r", rank).where(F.col("_r") <= hubs).drop("_r") if hubs else lists, lists
        chosen = stored(chosen, folder, f"chosen{r}") if hubs else chosen
        found = stored(_search(chosen, asking, classes.select("node", "shared"), num, den, whole=hubs is None), folder, f"found{r}")
        links = found if links is None else links.unionByName(found)
        if hubs is None:
            break
        # A hub has met its whole list, and leaves it.
        lists = lists.join(shuffled(chosen.select("key", "node")), ["key", "node"], "left_anti").drop("root")
        labels = components(links, folder, f"labels{r}")
        lists = stored(_possible(lists.join(shuffled(labels), "node", "left").withColumn("root", F.coalesce("root", "node"))), folder, f"lists{r}")
        discard(spark, folder, "led", "lists", f"chosen{r}", f"lists{r - 1}")
    return links


def _possible(lists: DataFrame) -> DataFrame:
    """Entries of lists (key, node, n, most, maybe root) that can still have a partner in their list.

    A list needs classes that aren't joined yet, and sizes that fit: one is too small or too large for
    every other where it is beyond what the best of the list can have.
    """
    for _ in range(2):
        joined = F.min("root") != F.max("root") if "root" in lists.columns else F.count("*") > 1
        bounds = lists.groupBy("key").agg(F.min("n").alias("_n"), F.max("most").alias("_most"), joined.alias("_open")).where("_open")
        lists = lists.join(shuffled(bounds), "key").where("most >= _n and n <= _most").drop("_n", "_most", "_open")
    return lists


def _search(chosen: DataFrame, lists: DataFrame, sets: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """(node, other): links that join each entry (key, node, n, most, root) of lists with all chosen entries of its key that it is linked to.

    Keys share an index, so that a query is sent once an index. `whole`: a key can have any number of
    chosen entries; they are dealt into parts of about LEAD_HUBS, and queries go to every part.
    """
    if whole:
        parts = chosen.groupBy("key").agg(F.ceil(F.count("*") / LEAD_HUBS).cast("int").alias("_parts"))
        chosen = chosen.join(shuffled(parts), "key").withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
        lists = lists.join(shuffled(parts), "key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    else:
        chosen, lists = chosen.withColumn("_part", F.lit(0)), lists.withColumn("_part", F.lit(0))
    groups = max(1, -(-chosen.count() // GROUP_HUBS))
    entry = [F.pmod(F.xxhash64("key", "_part"), F.lit(groups)).alias("group"), "node", "n", "most", "root"]
    hubs, queries = chosen.select(*entry).distinct(), lists.select(*entry).distinct()
    subs = queries.groupBy("group").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("subs"))
    hubs = hubs.join(shuffled(subs), "group").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("query", F.lit(0))
    queries = queries.join(shuffled(subs), "group").withColumn("sub", F.pmod(F.xxhash64("node", F.lit(1)), F.col("subs")).cast("int")).withColumn("query", F.lit(1))
    place = ["group", "sub", "query", "n", "node"]
    tasks = max(4 * chosen.sparkSession.sparkContext.defaultParallelism, groups)  # a number that isn't made smaller: the work isn't in the bytes
    rows = hubs.unionByName(queries).drop("subs").join(shuffled(sets), "node").repartition(tasks, "group", "sub").sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in each([batch]):
                if (own := (row["group"], row["sub"])) != now:
                    now, index = own, Index(num, den)
                if row["query"]:
                    out += index.links(row)
                else:
                    index.add(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["node", "other"])

    return rows.select(*place, "most", "root", "shared").mapInArrow(tidied(run), "node long, other long")


class Index:
    """An inverted index of hubs, added by size and node before the first query, and what is joined so far."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.keys: list[np.ndarray] = []  # shingles of each hub
        self.order: list[tuple[int, int]] = []
        self.owner: dict[int, int] = {}  # a hub of each root's region
        self.first: list[int] = []  # the region of each hub
        self.frozen: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None  # shingles, where their lists begin, lists, regions

    def add(self, row: dict) -> None:
        own = len(self.order)
        self.keys.append(expand(row["shared"], np.uint64))
        self.order.append((row["n"], row["node"]))
        self.first.append(self.owner.setdefault(row["root"], own))

    def _freeze(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lists behind one another, in the order of their shingles; hubs ascend in each."""
        keys, hub = np.concatenate(self.keys), np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        self.keys = []
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        return keys, np.append(first, len(order)), hub[order], np.array(self.first)

    def links(self, row: dict) -> list[tuple[int, int]]:
        """Links of a query with the regions of all smaller hubs that it is linked to and not joined with yet.

        Each pair of a list is looked at once; hubs that are joined with the query leave the lists before the search.
        """
        if not self.order:
            return []
        if self.frozen is None:
            self.frozen = self._freeze()
        keys, begins, postings, region = self.frozen
        n, node = row["n"], row["node"]
        lo = bisect_left(self.order, (-(-self.num * n // self.den),))
        hi = min(bisect_left(self.order, (n, node)), bisect_right(self.order, (row["most"], math.inf)))
        if lo >= hi:
            return []
        mine = self.owner.get(row["root"])
        mine = None if mine is None else int(region[mine])
        fit = np.zeros(len(region), bool)
        fit[lo:hi] = True if mine is None else region[lo:hi] != mine
        if not fit.any():
            return []
        own = expand(row["shared"], np.uint64)
        place = np.searchsorted(keys, own)
        place = place[(place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == own)]
        lists = [postings[a:b] for a, b in zip(begins[place].tolist(), begins[place + 1].tolist())]
        least = required(n, self.order[lo][0], self.num, self.den)
        if len(lists) < least:
            return []
        if not fit.all():
            lists = _only(lists, fit)
        got = [i for i, times in divide_skip(lists, least, int(fit.sum())) if times >= required(n, self.order[i][0], self.num, self.den)]
        tops = np.unique(region[got])
        if not len(tops):
            return []
        first = int(tops[0]) if mine is None else mine
        region[np.isin(region, tops)] = first
        self.owner[row["root"]] = first
        return [(node, self.order[i][1]) for i in tops.tolist()]


def _only(lists: list[np.ndarray], fit: np.ndarray) -> list[np.ndarray]:
    """What of each list fits; lists that are empty then are left out."""
    flat = np.concatenate(lists)
    kept = fit[flat]
    ends = np.searchsorted(np.flatnonzero(kept), np.cumsum([len(x) for x in lists])).tolist()
    flat = flat[kept]
    return [flat[a:b] for a, b in zip([0, *ends], ends) if a < b]


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) of all nodes in links: root is the smallest node that links reach.

    Each round a node takes the least label next to it and that label's label, and offers the least
    label next to it to its own label's node, so that whole regions are hooked and rounds grow with
    the logarithm of a chain. It ends when no label changes.
    """
    both = stored(links.select("node", "other").union(links.select("other", "node")).distinct(), folder, f"{name}-both")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    labels = stored(labels, folder, f"{name}-0")
    for i in itertools.count(1):
        near = both.join(shuffled(labels.select(F.col("node").alias("other"), "root")), "other").groupBy("node").agg(F.min("root").alias("_near"))
        step = labels.join(shuffled(near), "node").select("node", F.col("root").alias("_old"), "_near", F.least("root", "_near").alias("_mid"))
        jump = labels.select(F.col("node").alias("_mid"), F.col("root").alias("_far"))
        offer = lambda node, root, old: F.struct(node.alias("node"), root.alias("root"), old.alias("_old"))
        own = offer(F.col("node"), F.least("_mid", "_far"), F.col("_old"))
        hook = offer(F.col("_old"), F.col("_near"), F.lit(None).cast("long"))
        offers = step.join(shuffled(jump), "_mid").select(F.inline(F.when(F.col("_near") < F.col("_old"), F.array(own, hook)).otherwise(F.array(own))))
        step = stored(offers.groupBy("node").agg(F.max("_old").alias("_old"), F.min("root").alias("root")), folder, f"{name}-{i}")
        labels = step.select("node", "root")
        discard(links.sparkSession, folder, f"{name}-{i - 1}")
        if not step.where("_old <> root").take(1):
            discard(links.sparkSession, folder, f"{name}-both")
            return labels


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents`; see `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id (null last), then text hash.

    Texts without shingles all stay. Of rows that repeat both id and text one stays. Rows are told
    apart by id and text, so a row of another group with the same id is not touched.
    """
    rows = labelled(docs).where("root is not null").groupBy("root", "doc_id", "mark").count()
    rows = stored(rows, shared_dir(docs.sparkSession), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("_best"))
    beaten = ~(F.col("_best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_best.mark") == F.col("mark")))
    gone = rows.join(shuffled(best), "root").where(beaten).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"))
    mark = spare(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    same = lambda keys: marked["doc_id"].eqNullSafe(keys["_id"]) & (marked[mark] == keys["_of"])
    repeated = rows.where("count > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"))
    if not repeated.take(1):
        return marked.join(gone, same(gone), "left_anti").drop(mark)
    either = gone.unionByName(repeated)
    one = marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", mark])
    one = one.join(gone, one["doc_id"].eqNullSafe(gone["_id"]) & (one[mark] == gone["_of"]), "left_anti")
    return marked.join(either, same(either), "left_anti").unionByName(one).drop(mark)


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS common FROM one a JOIN one b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM overlap WHERE 100 * common >= 75 * (m + n - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT e.x, reach.r FROM reach JOIN edges e ON e.y = reach.d)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.d = s.doc_id) AS component_id FROM sets s
"""
