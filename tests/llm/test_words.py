"""Word operators (spelling variants, source divergence) against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom.llm import divergence, variants

CLASH = ("term", "term_id", "n", "number", "lang_", "value", "rank", "part", "item", "_of", "word", "shard")


def clashing(df):
    return df.repartition(3).withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def divergence_by_hand(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        df = Counter(t for one, _, ts in words if one == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        sources = {s for one, s, _ in words if one == lang}
        count = {s: Counter(t for one, x, ts in words if (one, x) == (lang, s) for t in ts if df[t] >= least) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(h, sum(abs(p[s][t] - p[h][t]) for t in kept)) for h in sources if h != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def documents(seed=1, n=220, sources=7):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("wort", "Été", "ça", "Γειά", "x") for b in ("", "en", "ing", "ü", "日本", "Q")]
    rows = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "de", None]), rnd.choice([None, *[f"s{i}" for i in range(sources)]])
        ws = rnd.choices(vocabulary, weights=[1 + i * (len(source or "") + i) % 7 for i in range(len(vocabulary))], k=rnd.randrange(0, 40))
        rows.append((rnd.choice([" ", ", ", "\n\t", " 12 "]).join(ws), lang, source))
    return rows + [(None, "en", "s1"), ("", "fr", "only"), ("eins", "fr", "only"), (None, None, None), rows[0], rows[0], ("viel " * 20_000, "de", "long"), ("a\x00b", "en", "nul")]


@pytest.mark.parametrize(("held", "tile", "block"), [(1000, 100_000, 512), (5, 40, 2)])
def test_divergence(spark, held, tile, block):
    rows = documents()
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string"))
    got = divergence.audit(df, 8, 10, held, tile, block)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in got.collect()) == divergence_by_hand(rows, 8, 10)


def test_divergence_without_rows_or_terms(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).collect() == []
    few = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y"), (None, None, "x")], empty.schema)
    assert sorted(tuple(r) for r in divergence.audit(few).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 7_000_000_000_000_123, 9_000_000_000_000_001, 4_000_000_007
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 1_000_000_000 * (n + 5) // (total + 5 * terms)


def near_by_hand(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, length=7, least=2, ratio=10, deleted=31):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    near = {w: [x for x in n if near_by_hand(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled(seed):
    rnd, rows = random.Random(seed), []
    bases = ["".join(rnd.choices("abcé", k=rnd.randrange(6, 13))) for _ in range(60)] + ["commune", "Straßenbahn", "ÀÉÎÕÜßÿ", "aaaaaaaa", "abababab", "abcdefghij" * 12]
    for i in range(260):
        words = []
        for _ in range(rnd.randrange(5, 60)):
            w = rnd.choice(bases[: rnd.choice([3, 20, len(bases)])])
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w) + 1)
                w = w[:at] + rnd.choice(["", "a", "b", "é", "X"]) + w[at + rnd.randrange(2) :]
            words.append(w)
        rows.append((i, rnd.choice([" ", "-", "1", "Ā", "日", " "]).join(words)))
    return rows + [(None, "commune commune"), (900, None), (901, ""), (902, "commune " * 9000), (902, "communes " * 300), rows[0], rows[0], (903, "z" * 50_000 + " " + "z" * 50_000), (904, "z" * 50_001 + "\n" + "z" * 50_001)]


@pytest.mark.parametrize(("hot", "shard_rows"), [(50_000, 50_000), (20, 300), (2, 4000)])
def test_variants(spark, hot, shard_rows):
    rows = spelled(hot)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = variants.variants(df, hot=hot, shard_rows=shard_rows)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    got = sorted(tuple(r) for r in got.collect())
    assert got == variants_by_hand(rows)
    assert sum(r[4] for r in got) > 500 and any(r[1] for r in got)


def test_chains_of_forms_end(spark):
    rows = [(1, " ".join(["commune"] * 100_000 + ["communes"] * 8000 + ["communest"] * 700 + ["communesto"] * 60 + ["communestor"] * 5))]
    got = {r.word: r.root for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), deleted=1 << 40).collect()}
    assert set(got.values()) == {"commune"} and len(got) == 5


def test_variants_without_rows(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_variants_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in variants.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()) == variants_by_hand(rows)
