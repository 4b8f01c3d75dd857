"""Facts of the chunking operators, and an independent straight-line model of the recursive splitter."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shardloom.functions import nesting as N
from shardloom.functions import text as T
from shardloom.functions.languages import command_kind, grammar_supported, language_for_path
from shardloom.functions.separators import CHAINS, chain_for
from shardloom.operators.chunk import Sizes, chunk_files, chunk_rows


def size(x: str) -> int:
    return len(x.encode())


def model(text: str, chain: list[str], limit: int) -> list[str]:
    """Cut at the first separator that the text holds, go on with the later ones, merge."""
    if size(text) <= limit:
        return [text] if text else []
    for i, sep in enumerate(chain):
        if sep in text:
            break
    else:
        return [text]
    parts = list(text) if sep == "" else [p if k == 0 else sep + p for k, p in enumerate(text.split(sep))]
    out: list[str] = []
    for p in parts:
        for q in model(p, chain[i + 1 :], limit) if size(p) > limit else [p]:
            if q and out and size(out[-1] + q) <= limit:
                out[-1] += q
            elif q:
                out.append(q)
    return out


def chunks(spark, content, path="a.unknown", kind=None, **sizes):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    rows = chunk_rows(chunk_files(df, kind=F.lit(kind) if kind else None, sizes=Sizes(**sizes)), "path")
    return [(r.strategy, r.content, r.start_line, r.end_line) for r in rows.orderBy("chunk_index").collect()]


def test_lookups(spark):
    df = spark.createDataFrame([("a.go",), ("b.py",), ("c.sh",), ("d.swift",), ("e.unknown",), ("x.GO",), ("dir.go/file",), (None,)], "p string")
    got = [r[0] for r in df.select(language_for_path(F.col("p"))).collect()]
    assert got == ["go", "python", "bash", "swift", "text", "text", "text", "text"]
    assert [r[0] for r in spark.createDataFrame([("GO",), ("php_only",), ("solidity",), (None,)], "l string").select(grammar_supported(F.col("l"))).collect()] == [True, True, False, False]
    assert [r[0] for r in spark.createDataFrame([("grep",), ("cd",), ("nope",)], "c string").select(command_kind(F.col("c"))).collect()] == ["search", "nav", "unknown"]


def test_alignment(spark):
    df = spark.createDataFrame([("a😀b", o) for o in (0, 1, 2, 4, 5, 100)], "s string, o int")
    rows = df.select(T.align_up(F.col("s"), F.col("o")), T.align_down(F.col("s"), F.col("o"))).collect()
    assert [r[0] for r in rows] == [0, 1, 5, 5, 5, 6]
    assert [r[1] for r in rows] == [0, 1, 1, 1, 5, 6]


def test_overlap_starts_with_a_whole_character(spark):
    got = spark.range(1).select(T.suffix(F.lit("😀" * 50), 17)).first()[0]
    assert got == "😀" * 4


@pytest.mark.parametrize("key", list(CHAINS))
def test_every_chain_matches_the_model(spark, key):
    rnd = random.Random(key)
    chain = CHAINS[key]
    words = [s for s in chain if s] + ["alpha", "é", "😀", " ", "\n", "x" * 12]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", T.recursive_split(F.col("t"), F.lit(chain), 40).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == model(t, chain, 40), (key, t)
        assert "".join(got[i]) == t and all(size(p) <= 40 for p in got[i])


def test_words_around_large_ones_match_the_model(spark):
    """Words as large as a chunk or larger, of characters of one to four bytes, short ones and runs of separators beside them."""
    rnd = random.Random(3)
    for limit in (8, 11, 40):
        word = lambda: rnd.choice(["a", "é", "", "€", "ab", "x" * rnd.randrange(limit - 4, limit * 3)] + ["".join(rnd.choice("aé€😀") for _ in range(rnd.randrange(limit // 4, limit)))] * 3)  # noqa: E731, B023
        texts = ["".join(word() + rnd.choice([" ", " ", "  ", "\n", "\n\n", ""]) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
        for chain in (CHAINS[""], [" ", ""], ["\n", " ", ""], [" ", "\n"], [""], ["$$", "$", " ", ""]):
            df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
            got = {r.i: r.p for r in df.select("i", T.recursive_split(F.col("t"), F.lit(chain), limit).alias("p")).collect()}
            for i, t in enumerate(texts):
                assert got[i] == model(t, chain, limit), (limit, chain, t)


def test_large_line_is_split_in_its_own_time(spark):
    """Chunks grow with a text's bytes; folds over its words that copy what they have took minutes."""
    import time

    began = time.perf_counter()
    text = spark.range(1).select(F.repeat(F.lit("aé bcd "), 500_000).alias("t"))
    n, largest = text.select(F.explode(T.recursive_split(F.col("t"), F.lit(CHAINS[""]), 1000)).alias("p")).agg(F.count("*"), F.max(F.octet_length("p"))).first()
    assert n >= 4000 and 990 < largest <= 1000 and time.perf_counter() - began < 30


def test_markdown_sections(spark):
    doc = "# T\n\nintro words here\n\n" + "".join(f"\n## S{i}\n\n" + "word " * 14 for i in range(3))
    got = chunks(spark, doc, "r.md", size=100, overlap=0)
    assert {s for s, *_ in got} == {"fallback"} and sum(c.lstrip().startswith("## ") for _, c, *_ in got) == 3


def test_kinds_of_splitter(spark):
    js = "function a() {}\n\nfunction b() {}\n\nfunction c() {}\n"
    got = chunks(spark, js, "x.js", kind=" LangChain ", size=40, overlap=0)
    assert {s for s, *_ in got} == {"langchain"} and len(got) >= 2 and all(c.strip().startswith("function") for _, c, *_ in got[1:])
    assert [s for s, *_ in chunks(spark, "package a\n", "a.go")] == ["ast"]
    assert chunks(spark, "", "a.go") == [] and chunks(spark, None) == []


def test_large_syntax_file_is_cut_at_declarations(spark):
    go = "package p\n" + "".join(f"\nfunc F{i}() int {{ return {i} }}\n" for i in range(8))
    got = chunks(spark, go, "a.go", syntax_size=100, syntax_overlap=0)
    assert 2 <= len(got) < 9 and all(any(f"F{i}()" in c for _, c, *_ in got) for i in range(8))


def test_lines(spark):
    got = chunks(spark, "alpha\nbravo\ncharlie\n", size=8, overlap=0)
    assert [(c, a, b) for _, c, a, b in got] == [("alpha", 1, 1), ("\nbravo", 2, 2), ("\ncharlie", 3, 3), ("\n", 4, 4)]


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("a.go", "x")], "path string, content string")
    plan = chunk_rows(chunk_files(df), "path")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_unknown_language_has_the_default_chain():
    assert chain_for("nope") == chain_for(None) == ["\n\n", "\n", " ", ""]


def test_hard_split(spark):
    for text, size in (("aé😀b" * 7, 5), ("😀😀", 3), ("", 4), ("abc", 1)):
        raw, want, at = text.encode(), [], 0
        while at < len(raw):
            end = min(at + size, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
            end = end if end > at else at + len(raw[at:].decode()[0].encode())
            want.append(raw[at:end].decode())
            at = end
        assert spark.range(1).select(T.hard_split(F.lit(text), size)).first()[0] == want


def test_hard_split_of_a_large_text(spark):
    """As many steps as pieces, not as characters: a fold over these took minutes."""
    import time

    text = spark.range(1).select(F.repeat(F.lit("aé😀b\n"), 1_000_000).alias("t"))
    text.select(F.size(T.hard_split(F.lit("a"), 500))).collect()
    began = time.perf_counter()
    rows = text.select("t", F.explode(T.hard_split(F.col("t"), 500)).alias("p")).agg(F.count("*"), F.max(F.octet_length("p")), F.sum(F.octet_length("p")), F.min(F.octet_length("p"))).first()
    assert tuple(rows)[1:3] == (500, 9_000_000) and rows[0] <= 9_000_000 / 497 + 1 and time.perf_counter() - began < 30


def test_levels_of_lines(spark):
    go = "package p\n\nfunc a() {\n\tif x { // }\n\t\ts := \"}{\"\n\t}\n}\n/* {\n{ */\nvar b = []int{\n1,\n}"
    python = "import a\n\n@x\ndef f(\n    a,\n):\n    '''doc\n{\n    '''\n    return [\n1]\nclass C:\n  x = 1 # (\n"
    bash = "f() {\n  echo '{' # {\n}\nf"
    far = N.FAR
    for lang, text, want in (("go", go, [0, far, 0, 1, 2, 2, 1, 0, far, 0, 1, 1]), ("python", python, [0, far, 0, 0, far, far, 4, far, far, 4, far, 0, 2, far]), ("bash", bash, [0, 1, 1, 0])):
        assert spark.range(1).select(N.line_levels(F.lit(text), F.lit(lang))).first()[0] == want, lang


def generated(rnd, lang):
    """A source file and its functions, as they stand in it; nesting and strings with brackets in them at random."""
    parts, functions = [], []
    for i in range(rnd.randrange(3, 14)):
        name, body = f"f{i}", []
        for _ in range(rnd.randrange(1, 30)):
            indent = "    " * rnd.randrange(1, 3)
            body.append(indent + rnd.choice(["x = 1", 's = "}{)("', "call(a, b)", "y = g(h([1, 2]))"]) + rnd.choice(["", "  " + {"python": "# ({", "go": "// ({"}[lang]]))
        if lang == "go":
            text = f"func {name}() {{\n" + "\n".join(body) + rnd.choice(["\n", "\n    if x {\n        z(1)\n    }\n", "\n\n"]) + "}"
        else:
            text = f"def {name}(a,\n  b):\n    pass\n" + "\n".join(body) + "\n    return 1"
        functions.append(text)
        parts += [rnd.choice(["", "\n", {"python": "# note\n", "go": "// note\n"}[lang]]), text, "\n"]
    return "".join(parts), functions


@pytest.mark.parametrize("lang", ["go", "python"])
def test_no_block_that_fits_is_cut(spark, lang):
    rnd = random.Random(lang)
    files = [generated(rnd, lang) for _ in range(25)] + [("x" * 900 + "\n" + "(" * 50 + "\n" + ")" * 60, []), ("", []), ("\n\n", []), ("}" * 10, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(files)], "i int, t string")
    dark = lambda x: len("".join(x.split()).encode())
    for limit in (120, 300, 700):
        rows = df.select("i", N.nested_split(F.col("t"), F.lit(lang), F.lit(chain_for(lang)), limit, T.nonwhite_bytes).alias("p")).collect()
        for r in rows:
            text, functions = files[r.i]
            assert "".join(r.p) == text and all(dark(p) <= limit for p in r.p)
            for f in functions:
                if dark(f) <= limit:
                    assert any(f in p for p in r.p), (limit, f)
            assert len(r.p) <= 2 + 2.2 * dark(text) / limit + sum(dark(f) > limit for f in functions)  # blocks are joined again


def test_large_files_are_cut_between_blocks(spark):
    text = "package p\n" + "".join(f"\nfunc F{i}() int {{\n\tif a {{\n\t\treturn {i}\n\t}}\n\treturn 0\n}}\n" for i in range(60))
    got = chunks(spark, text, "a.go", syntax_size=200, syntax_overlap=0)
    assert all(c.count("{") == c.count("}") for _, c, *_ in got) and len(got) > 5
    lines = text.split("\n")
    assert all("\n".join(lines[a - 1 : b]).strip() == c for _, c, a, b in got)
