"""Searches and repeats against brute force, with nulls, empties, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import blocks, decontaminate, jaccard, substrings, suffixes, topk, urls

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").collect()][:90]
    rnd, rows = random.Random(3), list(base)
    for i in range(300, 360):
        a, b = rnd.choice(base)[1], rnd.choice(base)[1]
        x, y = rnd.randrange(len(a)), rnd.randrange(len(b))
        rows.append((i, a[x : x + rnd.randrange(100, 900)] + rnd.choice(["", "Q", "é"]) + b[y : y + rnd.randrange(150, 260)]))
    for i in range(400, 430):  # near copies of one text
        w = base[7][1].split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(["x", "Y"])
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "ab " * 700), (503, "x" * 450), (504, " \t\n"), (505, base[0][1][:200]), (None, base[1][1]), (507, base[1][1]), (507, base[1][1][:300]),
             (508, "one two"), (509, "One  TWO"), (510, "Long " * 30000), (None, None)]
    return rows


def frame(spark, rows):
    """With columns that have the names of results and of inner columns."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.repartition(3).withColumns({c: F.lit("clash") for c in ("block", "n_removed", "key", "kept", "component_id", "node", "id", "_doc")})


def test_suffixes(spark, docs):
    rows = [r for r in docs if len(r[1] or "") < 100_000]
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in suffixes.dedup_substrings(frame(spark, rows), with_kept=False).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("length", [16, 17, 40, 333])
def test_suffix_levels(length):
    """Levels of refinement over small alphabets, as a bucket would answer them, against a brute count of all strings."""
    rnd = random.Random(length)
    for letters in (b"ab", b"abcdefgh", bytes(range(97, 123))):
        base = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(0, 6 * length))) for _ in range(4)]
        raw = [*base, b"", b"x" * (3 * length), base[0], b"ab" * length]
        raw += [x[rnd.randrange(len(x) + 1) :] + y[: rnd.randrange(len(y) + 1)] for x, y in (rnd.sample(base, 2) for _ in range(6))]
        parts = []
        for texts in (raw[:5], raw[5:9], raw[9:]):
            at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            block = blocks.Block(np.arange(len(texts)), np.zeros(len(texts), bool), np.frombuffer(b"".join(texts), np.uint8), at)
            parts.append(suffixes.Suffixes(block, length))
        for level in range(suffixes.WINDOWS + 1):
            keys = [p.keys(level) for p in parts]
            n = Counter(np.concatenate(keys).tolist())
            sizes = [np.array([n[k] for k in own.tolist()], np.int64) for own in keys]
            for p, size in zip(parts, sizes):
                p.tell(level, size)
        seen = Counter(t[s : s + length] for t in raw for s in range(len(t) - length + 1))
        got = []
        for p, size in zip(parts, sizes):
            gone = suffixes.removed(p.block, np.concatenate([p.sure, p.unsure[size > 1]]), length)
            got += [gone[a:b].tolist() for a, b in zip(p.block.at[:-1], p.block.at[1:])]
        for t, gone in zip(raw, got):
            want = [False] * len(t)
            for s in range(len(t) - length + 1):
                if seen[t[s : s + length]] > 1:
                    want[s : s + length] = [True] * length
            assert gone == want


def test_substrings(spark, docs):
    rows = [r for r in docs if r[0] is not None and r[0] != 507]  # ids of their own: which of equals is first is then settled
    words = {i: (t or "").split() for i, t in rows}
    seen, want = set(), []
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - 19):
            if (run := tuple(w[s : s + 20])) in seen:
                gone |= set(range(s, s + 20))
            seen.add(run)
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in substrings.drop_repeats(frame(spark, rows), with_kept=False).drop("kept").collect()]
    assert sorted(got) == want


def test_substrings_with_repeated_and_null_ids_keep_one(spark, docs):
    text = next(t for _, t in docs if t and 100 < len(t.split()) < 300)
    got = substrings.drop_repeats(frame(spark, [(7, text), (7, text), (None, text)])).collect()
    assert sorted(r.n_removed for r in got)[0] == 0 and sum(r.n_removed for r in got) == 2 * len(text.split())
    assert next(r for r in got if r.doc_id is None).n_removed == len(text.split())


def component_model(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and (least[find(k)] is None or i < least[find(k)]):
            least[find(k)] = i
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard(spark, docs):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(frame(spark, docs)).collect()), key=str)
    assert got == component_model(docs)


def test_jaccard_of_a_large_drifting_group(spark, monkeypatch):
    """Copies too far apart to be linked directly, searched in several parts and indexes."""
    rnd, base = random.Random(11), [f"w{k}" for k in range(60)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "LEAD_HUBS", 7)
    monkeypatch.setattr(jaccard, "GROUP_HUBS", 5)
    monkeypatch.setattr(jaccard, "GROUP_QUERIES", 9)
    for rounds in ((1, 16, None), (1, None)):
        monkeypatch.setattr(jaccard, "HUBS", rounds)
        assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows)).collect()), key=str) == component_model(rows)


def test_jaccard_broadcasts_nothing(spark, docs):
    """What would be broadcast grows with the input and is unpacked in the driver."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    before = max((ran.apply(i).executionId() for i in range(ran.size())), default=-1)
    jaccard.near_duplicates(frame(spark, docs)).collect()
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [x.physicalPlanDescription() for x in map(ran.apply, range(ran.size())) if x.executionId() > before]
    assert sum("SortMergeJoin" in x for x in plans) > 3
    assert not [x for x in plans if "Broadcast" in x]


def test_one_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (3, f"{a} x"), (3, b), (9, f"{b} y"), (9, f"{b} y"), (None, a), (None, f"{a} z"), (7, a), (3, f"{a} x"), (1, ""), (1, ""), (None, None), (2, "only this")]
    df = frame(spark, rows).withColumns({"_mark": F.lit("clash"), "_gone": F.lit(1)})
    out = jaccard.keep_one_of_each(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, f"{a} x"), (3, b), (1, ""), (1, ""), (None, None), (2, "only this")], key=str)


def test_components_of_a_shuffled_chain(spark, tmp_path):
    rnd = random.Random(5)
    ids = rnd.sample(range(1 << 60), 1010)
    links = list(zip(ids[:999], ids[1:1000])) + [(ids[1000], x) for x in ids[1001:]]
    rnd.shuffle(links)
    got = jaccard.components(spark.createDataFrame(links, "node long, other long"), f"file://{tmp_path}", "links").collect()
    assert sorted(map(tuple, got)) == sorted([(x, min(ids[:1000])) for x in ids[:1000]] + [(x, min(ids[1000:])) for x in ids[1000:]])


def test_divide_skip():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 12))]
        least = rnd.randrange(1, len(lists) + 1)
        want = sorted((x, c) for x, c in Counter(x for l in lists for x in l).items() if c >= least)
        assert sorted(jaccard.divide_skip(lists, least)) == want


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    rows = [(1, "a b c")][:n]
    df = frame(spark, rows)
    assert suffixes.dedup_substrings(df).count() == substrings.drop_repeats(df).count() == jaccard.near_duplicates(df).count() == n
    assert decontaminate.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_topk(spark):
    rnd = random.Random(2)
    vectors = [(i, [rnd.choice([-0.5, 0.25, 0.1, 1.0, 0.015]) for _ in range(8)]) for i in range(130)]
    vectors += [(200, None), (220, [None] + [1.0] * 7), (240, [float("nan")] * 8), (260, [float("inf")] * 8), (280, []), (300, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").where(topk.usable(F.col("embedding")))
    rows = df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x * 64)).alias("cells"))
    got = sorted(tuple(r) for r in topk.nearest(rows, rows.where("id % 20 = 0")).collect())
    good = {i: [math.floor(64 * x) for x in v] for i, v in vectors[:130]} | {300: [64] * 3}
    want = []
    for q in (i for i in good if i % 20 == 0):
        near = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)


def test_large_integers_stay_exact(spark):
    big = [(20, [2**33, 1]), (1, [2**28, 3]), (2, [2**28, 2]), (3, [2**28, 3])]
    rows = spark.createDataFrame(big, "id long, cells array<long>")
    got = [(r.vec_id, r.score) for r in topk.nearest(rows, rows.where("id = 20")).orderBy("rank").collect()]
    assert got == [(1, 2**61 + 3), (3, 2**61 + 3), (2, 2**61 + 2)]


def test_urls(spark):
    cases = [
        ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("http://x.net", "x.net", "", None, "allow"), ("http://x.net/", "x.net", "/", "net/", "block"),
        ("https://b.example.com/de/x?q=1", "b.example.com", "/de/x", "example.com/de/", "block"), ("http://q.org/fr/#t", "q.org", "/fr/", "org/fr/", "allow"),
        ("http://www.cheap-pills.example.com/a/b", "www.cheap-pills.example.com", "/a/b", None, "block"), ("http://xcheap-pills.example.com/a", "xcheap-pills.example.com", "/a", None, "allow"),
        (None, "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"), ("http://h?x/y", "h", "", None, "allow"), ("http://x.org/a/sub/p", "x.org", "/a/sub/p", None, "block"),
        ("http://x.org/a/subp", "x.org", "/a/subp", None, "allow"), ("http://x.org/one", "x.org", "/one", None, "block"), ("a\nb://h/p", "h", "/p", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases * 2)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([(x,) for x in (*urls.LISTED, "x.org/a/sub/", "x.org/one", None)], "name string")
    got = sorted((tuple(r) for r in urls.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [(i, *c[1:]) for i, c in enumerate(cases * 2)]
    assert urls.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_listed_urls_equal_brute_force(spark):
    """Thousands of names in a filter of many blocks, a full filter with false positives, and URLs far longer than any name."""
    rnd = random.Random(21)
    label, host = lambda: rnd.choice("abcd") + str(rnd.randrange(40)), lambda n: ".".join(label() for _ in range(n))
    listed = {f"{host(rnd.randrange(2, 4))}/" + "".join(f"{label()}/" for _ in range(rnd.randrange(3))) + rnd.choice(["", "", label()]) for _ in range(3000)}
    pages = [(i, f"http://{host(rnd.randrange(1, 5))}" + "".join(f"/{label()}" for _ in range(rnd.randrange(5))) + rnd.choice(["", "/", "?q"])) for i in range(3000)]
    pages += [(4000 + i, f"http://{rnd.choice(['', 'm.', 'm'])}{x}{rnd.choice(['', label(), '/' + label(), 'x/y?z'])}") for i, x in enumerate(sorted(listed)[::3])]
    pages += [(9000, "http://a1.b2/" + "/" * 60_000), (9001, "http://" + "a." * 30_000 + "b1/x"), (9002, None), (9003, pages[0][1]), (9003, pages[0][1])]

    def bad(url):
        rest = (url or "").partition("://")[2]
        h, path = (rest.split("?")[0].split("/", 1) + [""])[:2]
        path = f"/{path}"
        cut = 40  # longer than any listed name
        hosts = {".".join(h.split(".")[-k:]) for k in range(1, min(8, h.count(".") + 1) + 1)}
        return any(f"{x}{path[:k]}" in listed for x in hosts for k in range(1, cut) if path[:k] == path or path[k - 1 : k] == "/")

    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"_fit": F.lit("clash"), "_listed": F.lit(0)})
    names = spark.createDataFrame([(x,) for x in listed], "name string")
    want = sorted((i, "block" if bad(u) else "allow") for i, u in pages)
    assert 300 < sum(v == "block" for _, v in want) < 3700
    for most in (1 << 17, 2):
        urls_most, urls.MAX_BLOCKS = urls.MAX_BLOCKS, most
        try:
            got = sorted((r.page_id, r.verdict) for r in urls.judge(df, names, rules=()).collect())
        finally:
            urls.MAX_BLOCKS = urls_most
        assert got == want


def test_templates(spark):
    items = [(1, "If Anna buys 12 apples for 3 dollars each and pays with 50 dollars then how many dollars does she get back from the shop"), (2, "a wholly different text about rivers and the sea that runs on for a while without numbers"), (3, None), (4, "")]
    texts = [
        (1, "Intro words. If Anna buys 7 apples for 4 euros each and pays with 90 euros then how many euros does she get back from the shop. End"),  # other values, one to one
        (2, "If Anna buys 7 apples for 7 euros each and pays with 8 dollars then how many euros does she get back from the shop"),  # 12 and 3 both became 7: values may coincide
        (3, "Something else entirely, with 12 apples and 3 dollars each."),
        (4, "X! A WHOLLY different text, about rivers and the sea that runs on for a while; without numbers. Y"),
        (5, None), (6, ""), (None, items[1][1]), (8, "w " * 50000),
    ]
    df, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (None, 2)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {3, 5, 6, 8}


STORIES = [
    "{A} has {n} apples and eats {m}. {A} then buys {k} more at the market. How many apples does {A} have now?",
    "A train leaves {B} at {n} km per hour while {A} drives a car at {m} km per hour. After {k} hours how far apart are the train and {A}?",
    "{A} and {B} share {n} dollars. {A} gets {m} dollars more than {B}, who spends {k} dollars on a book. How much money does {B} have left?",
    "In a class of {n} pupils, {m} play chess and {k} play no game at all. {A} wants to know how many pupils play another game.",
]


def told(story, rnd, names):
    a, b = rnd.sample(names, 2)
    n, m, k = rnd.sample(range(2, 5000), 3)
    return story.format(A=a, B=b, n=n, m=m, k=k)


def test_reparameterised_questions_are_found(spark):
    """Recall over rewritten questions, with words put in and names of two words; no clean text, and no inconsistent one, is found."""
    rnd, names = random.Random(12), ["Tom", "Anna", "Mary Ann", "Omar", "Li", "Zoé", "Jean-Paul", "New York"]
    items = [(i, told(s, rnd, names)) for i, s in enumerate(STORIES)] + [(50, "What is the capital of Peru?"), (51, "Name it.")]
    texts, want = [], set()
    for i in range(200):
        k = rnd.randrange(len(STORIES))
        text = told(STORIES[k], rnd, names)
        if i % 4 == 1:  # one word put in
            w = text.split(" ")
            w.insert(rnd.randrange(5, len(w) - 5), "really")
            text = " ".join(w)
        if i % 4 == 2:
            text = items[k][1].lower()
        texts.append((i, f"{rnd.choice(['So it goes.', 'Consider this:', ''])} {text} {rnd.choice(['The end.', '', 'Think!'])}"))
        want.add((i, k))
    clean = [" ".join(rnd.choice("river stone light under green walks sings the of a and Tom 12 km".split()) for _ in range(80)) for _ in range(60)]
    texts += [(1000 + i, t) for i, t in enumerate(clean)]
    texts += [(2000, "He asked: what is the capital of Peru? Nobody knew."), (2001, "What is the capital of Chile?"), (2002, "Name it."), (2003, "name it. or not, at a longer length than that"), (2004, " ".join(map(str, range(4000))))]
    want |= {(2000, 50), (2001, 50), (2002, 51)}
    texts.append((3000, "Tom has 12 apples and eats 4. Anna then buys 7 more at the market. How many apples does Omar have now?"))  # one name of the item became three
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame([*items, (60, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")).collect()}
    assert got <= want, sorted(got - want)
    assert len(got & want) >= 0.95 * len(want), [(t, items[k][1]) for i, t in texts for j, k in want - got if i == j and k < 50]


@pytest.mark.parametrize("values", [range(2, 5000), range(1, 5), range(3, 4)])
def test_recall_with_values_that_coincide(spark, values):
    """Numbers may be equal in the document where the item's differ, and differ where the item's are equal."""
    rnd, names = random.Random(len(values)), ["Tom", "Anna", "Omar", "Li", "Zoé"]
    tell = lambda s, v: s.format(**dict(zip("AB", rnd.sample(names, 2))), **{k: rnd.choice(v) for k in "nmk"})
    items = [(i, tell(s, values)) for i, s in enumerate(STORIES)]
    texts = [(i, "Consider this: " + tell(STORIES[i % len(STORIES)], rnd.choice([range(2, 5000), range(1, 5), range(7, 8)]))) for i in range(80)]
    texts.append((None, texts[0][1]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, (i or 0) % len(STORIES)) for i, _ in texts}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_many_items_of_few_templates(spark):
    """A template is looked up once, however many items have it."""
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit("Tom has "), F.col("id").cast("string"), F.lit(" apples and eats 3 of them every day until none are left in box "), (F.col("id") % 2).cast("string"), F.lit(" or any other")).alias("text"))
    docs = [(1, "Ann has 7 apples and eats 9 of them every day until none are left in box 4 or any other"), (2, "nothing of that kind is to be seen in this text, not a bit of it")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert [tuple(r) for r in got.groupBy("doc_id").count().collect()] == [(1, 20_000)]


def test_tokens_of_templates_and_values_agree(spark):
    rows = [("Mary Ann Lee bought 3.5 kg, (Tom's) 7kg at New York. If Anna went: “Bob” left",), ("",), (None,), ("Tom Anna, Li Tom",), ("a  b\tC Dd\nEe",)]
    out = spark.createDataFrame(rows, "text string").select(decontaminate.template_tokens(F.col("text")).alias("t"), decontaminate.value_tokens(F.col("text")).alias("v")).collect()
    assert all(len(r.t) == len(r.v) for r in out)
    assert out[0].t == ["<N>", "bought", "<n>", "<u>", "<N>", "<n><u>", "at", "<N>", "if", "<N>", "went", "<N>", "left"] and out[0].v[0] == "mary ann lee".replace(" ", "")


def test_words_that_polynomials_take_for_equal(spark):
    """The doubling sequence and its complement, as letters of a word: one polynomial modulo 2**64, and two words."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    lead = " ".join(f"x{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{lead} {one}"), (2, f"{lead} {two}"), (3, f"{one} w"), (4, f"{two} w"), (5, f"{two} w")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.drop_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
