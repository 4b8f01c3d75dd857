"""Benchmark decontamination by template windows. DataFrame functions only.

A text becomes tokens; numbers, names and units turn into typed placeholders, so that a question
with other values keeps its template. Windows of the template are hash-joined with those of the
benchmark. Where a window holds placeholders, the names behind them must map one to one; numbers and units may coincide or part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spare, stored, table

PROBE, STEP = 5, 4
WINDOW = PROBE + STEP - 1  # template tokens in a window
SHORT = 4  # items with fewer tokens are found only as whole documents; others below WINDOW at any place, whole
BAND = 8  # lines of alignment that differ by up to half of it count together: words put in or left out
BROADCAST_ROWS = 1_000_000  # rows of benchmark windows or ids (16 to 40 bytes each) up to which they are broadcast

# Units of measure; words of closed classes, which are no names where a sentence begins.
UNITS = ("kg g mg lb lbs oz km m cm mm mi ft in yd l ml h hr hrs hours hour min mins minutes minute s sec secs seconds second "
         "days day weeks week months month years year % percent usd eur dollars dollar euros euro cents cent degrees degree mph kmh kph gb mb tb")  # fmt: skip
NO_NAMES = ("The An If How What When Where Who Whose Why Which While In On At For From To Of By With And Or But So As He She They It We You His Her Their Its "
            "Our Your This That These Those There Here Then Now Is Are Was Were Do Does Did Has Have Had Can Could Will Would Should Let Suppose Find Each Every After "
            "Before Given During All Some Both No Not One Two Three")  # fmt: skip
NUMBER = r"(?<![^\s(\[{\"'$€£+\-])[$€£+\-]?[0-9]+(?:[.,:/][0-9]+)*"
NAME = rf"""\p{{Lu}}(?<![^\s(\[{{"'“‘]\p{{Lu}})[\p{{Ll}}'’-]++(?=[\s.,;:!?)\]}}"”’]|$)(?<!(?<![\p{{L}}])(?:{'|'.join(NO_NAMES.split())}))"""
SPLIT = r"[\x20\x09-\x0D]+"


def _dark(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def value_tokens(text: Column, names: bool = True) -> Column:
    """What stands behind template_tokens, in lower case: one token for each; names side by side are one token."""
    t = F.coalesce(text, F.lit(""))
    if names:
        t = F.regexp_replace(t, NAME, "\u0002$0")
        t = F.regexp_replace(t, "(?<=\u0002[\\p{L}'’-]{1,60}) (?=\u0002)", "\u0003")
    return F.transform(_dark(t), lambda w: F.lower(_bare(F.translate(w, "\u0002\u0003", ""))))


def template_tokens(text: Column, names: bool = True) -> Column:
    """Tokens in lower case without marks at their ends; <n>, <u>, <N> for numbers, units, names.

    A name is a capitalised word but for those of NO_NAMES; names side by side are one. Without
    `names`, they stay words.
    """
    units = rf"(?i)(?<=<n> |<n>)(?:{'|'.join(UNITS.split())})(?![\p{{L}}0-9])"
    numbers = lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(t, NUMBER, "<n>"), units, "<u>")).otherwise(t)
    one = lambda t: F.when(t.contains("<N> <N>"), F.regexp_replace(t, "<N>(?: <N>)+", "<N>")).otherwise(t)
    low = lambda t: F.when(t.contains("<N>"), F.replace(F.lower(F.replace(t, F.lit("<N>"), F.lit("<\u0001>"))), F.lit("<\u0001>"), F.lit("<N>"))).otherwise(F.lower(t))
    t = F.coalesce(text, F.lit(""))
    steps = [lambda t: F.regexp_replace(t, NAME, "<N>"), one] if names else []
    for step in (*steps, numbers, low, _dark):
        t = _let(t, step)
    return F.transform(t, _bare)


def _bare(word: Column) -> Column:
    """Without marks at the ends; the whole word if nothing else is left."""
    return _let(F.trim(word, F.lit(_MARKS)), lambda core: F.when(core == "", word).otherwise(core))


_MARKS = ".,;:!?\"'()[]{}*#$%&|~`_-–—“”‘’…"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once a row, however often body's own functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(tokens: Column, size: int = WINDOW, step: int = 1) -> Column:
    """64-bit hashes of windows at every step-th token, in order; a shorter text is one window, an empty one none."""
    hashes = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - size + 1, F.lit(1)), F.lit(step)), lambda i: F.xxhash64(F.slice(h, i, size)))
    none = F.array().cast("array<bigint>")
    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(h) == 0, none).otherwise(hashes(h)))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = 0.6, least: int = 24) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_windows): the items that a document holds, by template.

    n_tokens counts the item's tokens under windows shared on neighbouring lines of alignment
    (document place less item place; at the best band of lines), n_windows those windows. An item
    counts from `share` of its tokens, or `least` tokens if that is less. A window of placeholders
    alone counts for nothing. Null and empty texts hold nothing and are in nothing; null ids count as
    one id. Rows that repeat an id are one document with all their texts. Columns other than id and
    text don't matter.
    """
    items = benchmark.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).distinct()
    forms = F.array(*[F.struct(F.lit(k).alias("form"), template_tokens(F.col("_text"), k == 0).alias("t"), value_tokens(F.col("_text"), k == 0).alias("values")) for k in (0, 1)])
    forms = F.filter(forms, lambda f: (f["form"] == 0) | (f["t"] != F.get(forms, F.lit(0))["t"]))  # as it is, and without names, as in a text all in lower case
    items = items.select("_item", F.explode(forms).alias("_f")).select("_item", F.col("_f.t").alias("_t"), "_f.values").where(F.size("_t") > 0).withColumn("_template", F.xxhash64("_t", F.size("_t")))
    templates = items.select("_template", "_t").dropDuplicates(["_template"])  # items that differ in their values alone share one
    index = templates.select("_template", F.size("_t").alias("_size"), F.posexplode(windows(F.col("_t"))).alias("_place", "_h"), "_t")
    mine = F.slice("_t", F.col("_place") + 1, WINDOW)
    index = index.withColumn("_slots", F.exists(mine, _is_slot)).where(F.exists(mine, lambda w: ~_is_slot(w))).drop("_t")
    short = sorted(r[0] for r in templates.select(F.size("_t")).where(F.size("_t").between(SHORT, WINDOW - 1)).distinct().collect())  # WINDOW - SHORT sizes at most
    keys = templates.select(F.explode(F.concat(windows(F.col("_t"), PROBE), F.when(F.size("_t") < WINDOW, windows(F.col("_t"))).otherwise(F.array().cast("array<bigint>")))).alias("_h")).distinct()
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    # Every run of WINDOW tokens holds a run of PROBE that starts at a STEP-th token. Short items are looked for whole at every token.
    own, folder = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")), shared_dir(docs.sparkSession)
    probes = _let(template_tokens(F.col("_text")), lambda t: F.concat(windows(t, PROBE, STEP), *[windows(t, n) for n in short]))
    maybe = stored(own.select("_doc", F.explode(probes).alias("_h")).join(small(keys), "_h", "left_semi").select("_doc").distinct(), folder, "maybe")
    near = _only(own, maybe)
    at = lambda n: near.select("_doc", F.posexplode(windows(template_tokens(F.col("_text")), n)).alias("_at", "_h"))
    places = at(WINDOW)
    for n in short:
        places = places.unionByName(at(n))
    hits = places.join(small(index), "_h").select("_doc", "_template", "_size", "_place", "_slots", (F.col("_at") - F.col("_place")).alias("_line"))
    lines = hits.groupBy("_doc", "_template", "_size", "_line").agg(F.array_sort(F.collect_set("_place")).alias("_places"), F.max("_slots").alias("_slots"))
    half = F.floor(F.col("_line") / (BAND // 2))
    bands = lines.withColumn("_band", F.explode(F.array(half, half - 1))).groupBy("_doc", "_template", "_size", "_band").agg(F.collect_list(F.struct("_line", "_places")).alias("_lines"), F.max("_slots").alias("_slots"))
    bands = bands.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(F.transform("_lines", lambda x: x["_places"])))))
    shared = F.aggregate(  # tokens under the windows; each adds what the one before has not covered
        "_places", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(p + WINDOW, F.col("_size")) - F.greatest(p, a["end"])).alias("n"), F.least(p + WINDOW, F.col("_size")).alias("end")),
        lambda a: a["n"],
    )
    bands = bands.withColumn("n_tokens", shared.cast("int")).withColumn("n_windows", F.size("_places"))
    bands = bands.where(F.col("n_tokens") >= F.least(F.ceil(F.col("_size") * share), F.lit(least))).drop("_places")
    bands = stored(bands, folder, "bands")
    sure = bands.where(~F.col("_slots")).join(items, "_template").select("_doc", "_item", "n_tokens", "n_windows")
    found = sure.unionByName(_consistent(bands.where("_slots"), own, items))
    best = found.groupBy("_doc", "_item").agg(F.max(F.struct("n_tokens", "n_windows")).alias("_best"))
    return best.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), F.col("_best.n_tokens").cast("long").alias("n_tokens"), F.col("_best.n_windows").cast("long").alias("n_windows"))


def _is_slot(word: Column) -> Column:
    return word.isin("<n>", "<u>", "<N>", "<n><u>")


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs with a wanted id. The ids are broadcast if they are few, else documents are dealt out by id."""
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("_doc", "_id")
    return docs.join(F.broadcast(wanted) if few else wanted, docs["_doc"].eqNullSafe(F.col("_id")), "left_semi")


def _consistent(bands: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Bands of lines whose names map one to one between item and document, under the windows that they share, for each item of the template.

    Numbers and units don't contradict: other values may be equal where the item's differ, and the other way round. Only documents
    with such bands are read again.
    """
    texts = _only(docs, bands.select("_doc").distinct()).select(F.col("_doc").alias("_own"), value_tokens(F.col("_text")).alias("_ours"))
    both = bands.join(items, "_template").where(F.size("_t") == F.col("_size")).join(texts, F.col("_doc").eqNullSafe(F.col("_own")))
    both = both.select("_doc", "_item", "n_tokens", "n_windows", F.struct("_t", "values", "_ours", "_lines", "_size").alias("_p"))
    slot = lambda p, i, line: F.struct(F.get(p["_t"], i).alias("kind"), F.get(p["values"], i).alias("item"), F.get(p["_ours"], i + line).alias("doc"))
    under = lambda p, x: F.array_distinct(F.flatten(F.transform(x["_places"], lambda a: F.sequence(a, F.least(a + WINDOW, p["_size"]) - 1))))
    slots = lambda p: F.array_distinct(F.flatten(F.transform(p["_lines"], lambda x: F.filter(F.transform(under(p, x), lambda i: slot(p, i, x["_line"])), lambda s: s["kind"] == "<N>"))))
    one = lambda s, side: F.size(F.array_distinct(F.transform(s, lambda x: x[side]))) == F.size(s)
    agrees = _let(F.col("_p"), lambda p: _let(slots(p), lambda s: one(s, "item") & one(s, "doc")))
    return both.where(agrees).select("_doc", "_item", "n_tokens", "n_windows")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_tokens, n_windows: which `documents` hold which item of `benchmark`; see `contaminated`."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Null ids are kept only if no such row holds one."""
    own = spare(docs, "_bad")
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[own]), "left_anti")


SQL = """
WITH RECURSIVE
norm AS (SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS t FROM documents
         UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark),
tok AS (SELECT side, id, list_transform(t, lambda w: CASE WHEN trim(w, '.,;:!?"''()[]{}*#$%&|~`_-–—“”‘’…') = '' THEN w ELSE trim(w, '.,;:!?"''()[]{}*#$%&|~`_-–—“”‘’…') END) AS t FROM norm WHERE len(t) > 0),
places AS (SELECT side, id, t, len(t) AS n, unnest(range(greatest(len(t) - 7, 1))) AS i FROM tok),
win AS (SELECT side, id, n, i, array_to_string(t[i + 1 : i + 8], ' ') AS w FROM places),
hit AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, b.n, b.i AS place, d.i - b.i AS line FROM win d JOIN win b USING (w) WHERE d.side = 'd' AND b.side = 'b'),
cov AS (SELECT doc_id, item_id, n, line, place, least(place + 8, n) - greatest(place, coalesce(lag(least(place + 8, n)) OVER (PARTITION BY doc_id, item_id, line ORDER BY place), -1)) AS more FROM hit),
lines AS (SELECT doc_id, item_id, n, line, sum(more) AS n_tokens, count(*) AS n_windows FROM cov GROUP BY ALL HAVING sum(more) >= least(ceil(n * 0.6), 24)),
best AS (SELECT doc_id, item_id, n_tokens, n_windows, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_tokens DESC, n_windows DESC) AS r FROM lines)
SELECT doc_id, item_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_windows AS BIGINT) AS n_windows FROM best WHERE r = 1
"""
