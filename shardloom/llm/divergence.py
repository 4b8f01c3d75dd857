"""Source divergence audit: how the sources of a language differ in their words, from two passes over all texts.

The first pass counts exact document frequencies and so finds the kept terms. The second recounts occurrences
with an Aho-Corasick automaton over the kept terms, each between two delimiters. Counts are sparse postings
(source, term, count); pairs of sources meet in tiles of postings, never as rows of a join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, slices, small_batches, stored, table, tidied

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
AUTOMATON_TERMS, TERM_BYTES = 200_000, 64  # bounds what every task holds: the most frequent terms; all others are counted by a shuffle
HELD = 500_000  # distinct terms that a task counts before it hands them on
HELD_TOKENS = 4_000_000
POSTINGS = 100_000  # of a tile
BLOCK = 512  # sources on each side of a tile

# A-Z to a-z; letters and bytes of non-ASCII characters stay; all else is a delimiter.
TERM_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _plain(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return small_batches(docs.select(text("text").alias("text"), text("lang").alias("lang"), text("source").alias("source")))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str, str]]:
    for part in slices(batches, "text"):
        for text, lang, source in zip(part.column("text").cast(pa.binary()), part.column("lang"), part.column("source")):
            yield text.as_py(), lang.as_py(), source.as_py()


def document_frequencies(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, df: terms of at least `least` documents of their language. Counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)
        for n, (text, lang, _) in enumerate(_rows(batches)):
            seen[lang].update(set(text.translate(TERM_BYTE).split()))
            if n % 256 == 255 and sum(map(len, seen.values())) > HELD:
                yield from _counted(seen)
                seen.clear()
        yield from _counted(seen)

    found = _plain(docs).mapInArrow(tidied(run), "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def _counted(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in seen.items():
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        for i in range(0, len(terms), 100_000):
            part = terms[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(list(counts.values())[i : i + 100_000], pa.int64())], ["lang", "term", "n"])


def occurrences(docs: DataFrame, terms: list[tuple[str, str, int]]) -> DataFrame:
    """source, term_id, n: how often documents hold each of `terms` (lang, term, id); a row for each task that met one.

    One automaton a language; the delimiter behind a term is also the one in front of the next.
    """
    by_lang: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for lang, term, number in terms:
        by_lang[lang].append((term, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[str, ahocorasick.Automaton] = {}
        met: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        held = 0
        texts: defaultdict[tuple[str, str], list[bytes]] = defaultdict(list)

        def scan() -> int:
            n = 0
            for (lang, source), parts in texts.items():
                if lang not in by_lang:
                    continue
                if lang not in automata:
                    automata[lang] = _automaton(by_lang[lang])
                padded = b" " + b" ".join(parts).translate(TERM_BYTE) + b" "
                ids = np.fromiter((i for _, i in automata[lang].iter(padded.decode())), np.int64)
                met[source].append(ids)
                n += len(ids)
            texts.clear()
            return n

        size = 0
        for text, lang, source in _rows(batches):
            texts[lang, source].append(text)
            size += len(text)
            if size > 2 << 20:
                held, size = held + scan(), 0
            if held > HELD_TOKENS:
                yield from _met(met)
                held = 0
        scan()
        yield from _met(met)

    return _plain(docs).mapInArrow(tidied(run), "source string, term_id long, n long")


def _automaton(terms: list[tuple[str, int]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, number in terms:
        out.add_word(f" {term} ", number)
    out.make_automaton()
    return out


def _met(met: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for source, parts in met.items():
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(ids), pa.string()), pa.array(ids), pa.array(n.astype(np.int64))], ["source", "term_id", "n"])
    met.clear()


def rare_occurrences(docs: DataFrame, known: list[tuple[str, str, int]], kept: DataFrame) -> DataFrame:
    """source, term_id, n of the kept terms that the automaton doesn't hold: all other words are counted in tasks and joined with them."""
    common = defaultdict(set)
    for lang, term, _ in known:
        common[lang].add(term.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
        for n, (text, lang, source) in enumerate(_rows(batches)):
            seen[lang, source].update(w for w in text.translate(TERM_BYTE).split() if w not in common[lang])
            if n % 256 == 255 and sum(map(len, seen.values())) > HELD:
                yield from out(seen)
                seen.clear()
        yield from out(seen)

    def out(seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in seen.items():
            for batch in _counted({lang: counts}):
                yield batch.append_column("source", pa.array([source] * batch.num_rows, pa.string()))

    found = _plain(docs).mapInArrow(tidied(run), "lang string, term string, n long, source string")
    return found.join(kept.select("lang", "term", "term_id"), ["lang", "term"]).select("source", "term_id", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), in decimals that hold any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total + PRIOR * terms)))


def postings_of(docs: DataFrame, folder: str, least: int = LEAST_DOCS, held_terms: int = AUTOMATON_TERMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, groups, postings), written tables.

    kept: lang, term, term_id; groups: lang, source, number (in its language), terms (V), total (N), none (the share of a term that the
    group doesn't hold, null if V is 0); postings: lang, source, number, none, term_id, n, p, q, for counts over 0.
    """
    numbered = document_frequencies(docs, least).withColumn("term_id", F.monotonically_increasing_id())
    kept = stored(numbered, folder, "kept")
    top = kept.where(F.octet_length("term") <= TERM_BYTES).orderBy(F.desc("df"), "lang", "term").limit(held_terms)
    known = [(r.lang, r.term, r.term_id) for r in top.select("lang", "term", "term_id").collect()]  # held_terms at most
    met = occurrences(docs, known)
    if kept.count() > len(known):
        met = met.unionByName(rare_occurrences(docs, known, kept))
    counts = stored(met.groupBy("source", "term_id").agg(F.sum("n").alias("n")).join(kept.select("term_id", "lang"), "term_id"), folder, "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    all_groups = _plain(docs).select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = all_groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    groups = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("none", share(F.lit(0), F.col("total"), F.col("terms")))
    groups = stored(groups, folder, "groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("_all"))
    shares = counts.join(groups, ["lang", "source"]).join(F.broadcast(whole) if whole.count() <= 10_000 else whole, "lang")
    shares = shares.withColumn("_of_lang", F.sum("n").over(Window.partitionBy("term_id")))
    postings = shares.select("lang", "source", "number", "none", "term_id", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("_of_lang"), F.col("_all"), F.col("terms")).alias("q"))
    postings = stored(postings, folder, "postings")
    discard(docs.sparkSession, folder, "counts")
    return kept, groups, postings


def pair_sums(postings: DataFrame, groups: DataFrame, tile_postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """lang, a, b, value for all a < b: numbers of two sources, and their absolute differences of shares, summed over all kept terms.

    A tile holds some of a language's terms and two blocks of its sources. A term that neither source holds adds |none_a - none_b|; so a
    tile adds what its postings change in that: terms of one source from sorted shares and their sums, terms of both by small products.
    """
    count, most = postings.count(), groups.agg(F.max("number")).first()[0] or 0
    shards, blocks = max(1, -(-count // tile_postings)), most // block + 1

    def tiled(df: DataFrame) -> DataFrame:
        df = df.withColumn("_own", F.floor(F.col("number") / block).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return df.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_own", "_other")

    def tile(key: tuple, held: pa.Table, about: pa.Table) -> pa.Table:
        lang, shard, lo, hi = (k.as_py() for k in key)
        about = about.sort_by("number")
        number, none = about.column("number").to_numpy(), about.column("none").to_numpy()
        sums = _changes(np.searchsorted(number, held.column("number").to_numpy()), held.column("term_id").to_numpy(), held.column("p").to_numpy(), none)
        if shard == 0:
            sums += about.column("terms").to_numpy() * np.abs(none[:, None] - none[None, :])
        in_lo, in_hi = number // block == lo, number // block == hi
        a, b = np.nonzero(in_lo[:, None] & in_hi[None, :] & (number[:, None] < number[None, :]))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(number[a], pa.int32()), "b": pa.array(number[b], pa.int32()), "value": pa.array(sums[a, b], pa.int64())})

    left = tiled(postings.select("lang", "number", "term_id", "p").withColumn("shard", F.pmod(F.xxhash64("term_id"), F.lit(shards)).cast("int")))
    spread = F.explode(F.when(F.col("terms") > 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.lit(0))))
    right = tiled(groups.select("lang", "number", F.coalesce("none", F.lit(0)).alias("none"), "terms").withColumn("shard", spread))
    keys = ["lang", "shard", "lo", "hi"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "lang string, a int, b int, value long")
    return out.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _changes(who: np.ndarray, term: np.ndarray, p: np.ndarray, none: np.ndarray) -> np.ndarray:
    """What postings (source, term, share) add to |none_a - none_b| for each term that a or b holds, for all pairs of sources."""
    gap = np.abs(none[:, None] - none[None, :])
    sums = np.zeros(gap.shape, np.int64)
    by_source = np.lexsort((p, who))
    for part in _runs(who, by_source):
        g, own = who[part[0]], p[part]
        upto = np.concatenate([[0], np.cumsum(own)])
        below = np.searchsorted(own, none)
        apart = none * (2 * below - len(own)) + upto[-1] - 2 * upto[below] - len(own) * gap[g]
        sums[g] += apart
        sums[:, g] += apart
    for part in _runs(term, np.argsort(term, kind="stable")):
        g, own = who[part], p[part]
        alone = np.abs(own[:, None] - none[g][None, :])
        sums[np.ix_(g, g)] += np.abs(own[:, None] - own[None, :]) - alone - alone.T + gap[np.ix_(g, g)]
    return sums


def _runs(values: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """`order` cut where the ordered values change."""
    return [x for x in np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(x)]


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, held_terms: int = AUTOMATON_TERMS, tile_postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Null text, lang and source are the empty text. Every row is a document, repeated ones too. Part `pair`: all other sources of the
    language by their distance; part `term`: the `top` terms that a source has more of than its language. A language without kept terms
    has pairs of value 0 and no terms; one with a single source has no pairs. Ties go to the smaller item in UTF-8 order. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    folder = shared_dir(docs.sparkSession)
    kept, groups, postings = postings_of(docs, folder, least, held_terms)
    sums = pair_sums(postings, groups, tile_postings, block)
    both = F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("_of")), F.struct(F.col("b").alias("number"), F.col("a").alias("_of"))))
    pairs = sums.select("lang", "value", both.alias("_p")).select("lang", "value", "_p.*")
    names = groups.select("lang", "number", "source")
    pairs = pairs.join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("_of"), F.col("source").alias("item")), ["lang", "_of"])
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    more = postings.where("p > q").join(kept.select("term_id", F.col("term").alias("item")), "term_id")
    terms = more.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value")).withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all `documents`; see `audit`."""
    return audit(table(spark, sf_dir, "documents"))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN sizes USING (lang)),
l AS (SELECT lang, term, sum(n) AS n, (SELECT sum(total) FROM g WHERE g.lang = c.lang) AS total FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    CAST(1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (g.total + {PRIOR} * g.v) AS BIGINT) AS p,
    CAST(1 + ({SCALE}::HUGEINT * (l.n + {PRIOR})) // (l.total + {PRIOR} * g.v) AS BIGINT) AS q
    FROM g JOIN kept USING (lang) JOIN l USING (lang, term) LEFT JOIN c USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
