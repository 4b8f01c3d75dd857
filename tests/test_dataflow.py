"""Python programs whose paths go through names, arguments and walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import dataflow
from shardloom.operators.dataflow import with_facts
from shardloom.operators.programs import child_lines, program_files
from shardloom.sources.shared import written

# Program, arguments, what it reads, what it writes; the directory is /repo.
PROGRAMS = [
    ("p = 'v.txt'; open(p)", None, {"/repo/v.txt"}, set()),
    ("x = 'a.go'; x = compute(); open(x)", None, set(), set()),
    ("x = 'a.go'\nx = 'b.go'\nopen(x).read()", None, {"/repo/b.go"}, set()),
    ("import pathlib; p = pathlib.Path('x.go'); p.open()", None, {"/repo/x.go"}, set()),
    ("import sys\nopen(sys.argv[1]); open(sys.argv[3]); open(sys.argv[0])", ["/r/x.go", "b"], {"/r/x.go"}, set()),
    ("from sys import argv\nfor a in argv[1:]: open(a)\nn = argv[1:]\nopen(argv[2], 'w')", ["a", "b"], set(), {"/repo/b"}),
    ("import fileinput\nfileinput.input()", ["a", "/b"], {"/repo/a", "/b"}, set()),
    ("import fileinput\nfileinput.input(['c', x])", ["a"], {"/repo/c"}, set()),
    ("from pathlib import Path\nroot = Path('.')\nfor p in root.rglob('*.go'):\n    if 'x' in p.read_text(): print(p)", None, {"/repo"}, set()),
    ("import os\nfor d, ds, fs in os.walk('/abs'):\n  for f in fs:\n    q = os.path.join(d, f)\n    open(q).read()", None, {"/abs"}, set()),
    ("import glob\ndef files():\n    return 1\nnames = sorted(glob.glob('src/**/*.py'))\nmore = list(names)\nfor n in more: open(n)", None, {"/repo/src"}, set()),
    ("import pathlib; [p.read_text() for p in pathlib.Path('.').rglob('*')]", None, {"/repo"}, set()),
    ("import pathlib\nfor p in pathlib.Path('.').iterdir(): print(p.name)", None, set(), set()),
    ("import os\nfor f in os.listdir('d'): pass\nopen('one.txt')", None, {"/repo/one.txt"}, set()),
    ("import os\nd = 'deep/er'\nfor f in os.listdir(d):\n    open(d + '/' + f)", None, {"/repo/deep/er"}, set()),
    ("open(f'src/{name}.go'); open(f'{a}/b'); open(f'plain.go'); open(f'/{x}')", None, {"/repo/src", "/repo/plain.go", "/"}, set()),
    ("e = d\nd = c\nc = b\nb = a\na = glob.glob('t/*')\nopen(e)", None, {"/repo/t"}, set()),
    ("a = b\nb = a\nopen(a)", None, set(), set()),
    ("a = b = 'x.txt'\nopen(b); open(a)", None, {"/repo/x.txt"}, set()),
    ("p: str = 'y.txt'\nio.open(p)\nopen(mode='w', file='z')\nopen('z', mode='a')", None, {"/repo/y.txt"}, {"/repo/z"}),
    ("Path('o').write_text('x'); Path('i').read_bytes(); Path('m').open('r+'); q.write_text('x')", None, {"/repo/i"}, {"/repo/o", "/repo/m"}),
    ("for x in glob.glob('s/*'):\n  open(x, 'w')", None, set(), set()),
    ("for i, x in enumerate(sorted(Path('/q').glob('*'))):\n  (x / 'y').read_text()", None, {"/q"}, set()),
    ("# open('c.txt')\n'''open('d.txt')'''\ns = \"open('e.txt')\"", None, set(), set()),
    (r"open('a\tb'); open('a' 'b'); open(r'c\d'); open(b'e')", None, {"/repo/a\\tb", "/repo/c\\d", "/repo/e"}, set()),
    ("open(1); open(); open(*a); open(x()); obj.open('w')", None, set(), set()),
    ("print 'python two'; open('x')", None, set(), set()),
    ("open('~/h'); open('../up')", None, {"/home/u/h", "/up"}, set()),
    ("é = 'ü/ß'; open(é); open('日/本')", None, {"/repo/ü/ß", "/repo/日/本"}, set()),
    ("obj.x = glob.glob('g/*')\nopen(obj)", None, {"/repo/g"}, set()),
    ("", None, set(), set()), (None, None, set(), set()), ("\x00", None, set(), set()), ("(" * 400 + "open('x')" + ")" * 400, None, set(), set()),
]
COLUMNS = "k int, lang string, text string, argv array<string>, cwd string, home string"


def found(spark, rows, cwd="/repo"):
    df = spark.createDataFrame([(i, "python", p, a, cwd, "/home/u") for i, (p, a, *_) in enumerate(rows)], COLUMNS)
    got = {i: (set(), set()) for i in range(len(rows))}
    for r in dataflow.python_files(df, "k").collect():
        got[r.k][r.access == "write"].add(r.path)
    return got


def test_programs(spark):
    got = found(spark, PROGRAMS)
    for i, (program, _, reads, writes) in enumerate(PROGRAMS):
        if program and program.startswith("(((("):  # as deep as the interpreter takes it
            assert got[i] in (({"/repo/x"}, set()), (set(), set()))
        else:
            assert got[i] == (reads, writes), program


def test_no_directory_no_relative_path(spark):
    assert found(spark, [("open('a'); open('/b')", None)], None)[0] == ({"/b"}, set())


def by_hand(names, edges):
    """Directories of each name: what a walk along the edges backwards comes to."""
    out = {}
    for name in names:
        seen, todo, dirs = set(), [name], set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                for target, kind, value in edges:
                    if target == n:
                        dirs.add(value) if kind == "dir" else todo.append(value)
        out[name] = dirs
    return out


@pytest.mark.parametrize("seed", range(3))
def test_flows_of_random_programs(spark, seed):
    rnd, programs = random.Random(seed), []
    for _ in range(40):
        names = [f"n{i}" for i in range(rnd.randrange(2, 12))]
        edges, lines = [], []
        for _ in range(rnd.randrange(1, 25)):
            target, value = rnd.choice(names), rnd.choice(names)
            form = rnd.randrange(6)
            if form == 0:
                folder = f"/d{rnd.randrange(5)}"
                edges.append((target, "dir", folder))
                lines.append(rnd.choice([f"{target} = glob.glob('{folder}/*')", f"for {target} in os.listdir('{folder}'): pass", f"{target} = sorted(Path('{folder}').rglob('*'))"]))
            else:
                edges.append((target, "taint", value))
                lines.append([f"{target} = {value}", f"for {target} in {value}: pass", f"z = [{target} for {target} in list({value})]", f"{target} = os.path.join({value}, 'x')", f"{target} = {value}.parent / 'x'"][form - 1])
        asked = rnd.choice(names)
        programs.append(("\n".join([*lines, f"open({asked})"]), None, by_hand(names, edges)[asked], set()))
    got = found(spark, programs)
    for i, (program, _, reads, writes) in enumerate(programs):
        assert got[i] == (reads, writes), program


def test_programs_are_read_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "python", f"open('{i % 2}')", "/w", "/h") for i in range(6)], "i int, lang string, text string, cwd string, home string")
    plan = dataflow.python_files(rows, "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    texts, seen = ["open('a')", None, "open('b')", "open('a')", "(", None], []
    real = dataflow.read
    monkeypatch.setattr(dataflow, "read", lambda text: seen.append(text) or real(text))
    (got,) = dataflow._facts(iter([dataflow.pa.array(texts)]))
    assert got.to_pylist() == [real(t) for t in texts] and len(seen) == len(set(seen)) == 4


def test_facts_that_are_there_are_not_read_again(spark):
    rows = [(0, "python", "import os\nos.system('cat a')\nopen('b')"), (1, "ruby", "File.read('c')"), (2, "python", None), (3, "python", "open(")]
    df = spark.createDataFrame([(i, lang, t, None, "/w", "/h") for i, lang, t in rows], "k int, lang string, text string, argv array<string>, cwd string, home string")
    once = written(with_facts(df))
    for made, want in ((program_files, {(0, "/w/b"), (1, "/w/c")}), (child_lines, {(0, "cat a")})):
        out = made(once, "k")
        assert "_facts(" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.k, r.path if made is program_files else r.command) for r in out.collect()} == want
        assert sorted(map(str, out.collect())) == sorted(map(str, made(df, "k").collect()))
