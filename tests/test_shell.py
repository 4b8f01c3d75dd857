"""Facts of the command operators on lines beyond those of the registered queries."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from shardloom.functions import paths as P
from shardloom.operators import shell
from shardloom.operators.scan import read
from shardloom.operators.programs import FORMS, child_lines, program_files
from shardloom.sources.shared import written
from pyspark.sql import functions as F

LINES = [
    ("/repo", "jq -e '.x' /repo/a.json", {("R", "/repo/a.json")}),
    ("/repo", "jq --from-file /repo/prog.jq /repo/a.json", {("R", "/repo/a.json")}),
    ("/repo", "jq --slurpfile s /repo/side.json '.x' /repo/a.json", {("R", "/repo/side.json"), ("R", "/repo/a.json")}),
    ("/repo", "grep -e pattern /repo/a.go", {("R", "/repo/a.go")}),
    ("/repo", "grep --regexp=pattern /repo/a.go", {("R", "/repo/a.go")}),
    ("/w", "awk -F: '{print $1}' data.txt", {("R", "/w/data.txt")}),
    ("/w", "sed 's/a/b/' data.txt", {("R", "/w/data.txt")}),
    ("/w", "grep -F -f <(cat patterns) target.txt", {("R", "/w/target.txt")}),
    ("/w", "/usr/bin/grep -rn pat /tmp/log", {("R", "/tmp/log")}),
    ("/w", "cat <<EOF >> /tmp/log\nx\nEOF", {("W", "/tmp/log")}),
    ("/w", "echo hi > >(tee log)", set()),
    ("/w", "grep x file.txt > out.txt", {("R", "/w/file.txt"), ("W", "/w/out.txt")}),
    ("/w", "head -n 5 f", {("R", "/w/5"), ("R", "/w/f")}),
    ("/w", "awk -i inplace '{print}' f", {("R", "/w/f"), ("W", "/w/f")}),
    ("/w", "dd if=a of=b", {("W", "/w/b")}),
    ("/w", "git apply x.patch", {("W", "/w/x.patch")}),
    ("/w", "cat a 2>&1", {("R", "/w/a")}),
    ("/w", "rg TODO", {("R", "/w")}),
    ("/w", "cat ../b ~/c", {("R", "/b"), ("R", "/home/u/c")}),
    ("/repo", "perl -ne 'print' a.pl b.pl", {("R", "/repo/a.pl"), ("R", "/repo/b.pl")}),
    ("/repo", "perl -e 'print' a.pl", set()),
    (None, "cat rel /abs", {("R", "/abs")}),
    ("/w", None, set()),
    ("/w", "   ", set()),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c, d, "/home/u") for i, (d, c, _) in enumerate(LINES)], "cmd_id int, command string, base_cwd string, home string")
    return shell.decompose(df).cache()


def test_reads_and_writes(parsed):
    got = {i: set() for i in range(len(LINES))}
    for mark, rows in (("R", shell.reads(parsed)), ("W", shell.writes(parsed))):
        for r in rows.where("resolvable").collect():
            got[r.cmd_id].add((mark, r.path))
    for i, (d, c, want) in enumerate(LINES):
        assert got[i] == want, c


def test_no_path_is_made_up(parsed):
    for rows in (shell.reads(parsed), shell.writes(parsed)):
        assert not rows.where("resolvable and path rlike '[$`(\\t\\n]'").count()


def test_clean_path(spark):
    cases = {"/a/../../b//c/.": "/b/c", "": ".", "a/./b/..": "a", "../x": "../x", "/": "/", "//x": "/x"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert not df.where(P.clean_path(F.col("p")) != F.col("want")).count()


def test_small_functions(spark):
    row = spark.range(1).select(
        P.strip_quotes(F.lit("'a b'")), P.contains_expansion(F.lit("a$b")), P.is_assignment(F.lit("A+=1")), P.safe_unquoted(F.lit("a b")), P.is_recursive_flag(F.lit("-nR")),
        P.write_mode(F.lit("r+")), P.glob_prefix_dir(F.lit("/a/b*/c")), P.glob_prefix_dir(F.lit("*.x")), P.sql_unquote(F.lit("'it''s'")), P.sql_unquote(F.lit(r"'a\b'")), P.hfs_path(F.lit("A:b")),
    ).first()
    assert tuple(row) == ("a b", True, True, False, True, True, "/a", None, "it's", None, True)


def test_scripts_and_their_arguments(spark):
    lines = [(1, "python s.py /repo/x.go"), (2, "python3 -W ignore none.py a"), (3, "python -c 'x' s.py"), (4, "python -m mod")]
    df = spark.createDataFrame([(i, c, "/repo", "/home/u") for i, c in lines], "cmd_id int, command string, base_cwd string, home string")
    scripts = spark.createDataFrame([("/repo/s.py", "import sys\nopen(sys.argv[1])")], "path string, content string")
    found = shell.script_regions(shell.decompose(df), scripts)
    assert {(r.cmd_id, r.text) for r in found.collect()} == {(1, "import sys\nopen(sys.argv[1])"), (2, "")}
    assert [(r.cmd_id, r.access, r.path) for r in program_files(found, "cmd_id").collect()] == [(1, "read", "/repo/x.go")]


def test_child_commands(spark):
    text = "import os\nos.system('rg P /repo')\nsubprocess.run(['grep', 'TODO', \"/repo/x.go\"])\nos.system(cmd)"
    programs = spark.createDataFrame([(1, "python", text, "/w", "/home/u")], "cmd_id int, lang string, text string, cwd string, home string")
    lines = child_lines(programs, "cmd_id")
    assert {r.command for r in lines.collect()} == {"rg P /repo", "grep TODO /repo/x.go"}
    keyed = lines.withColumn("cmd_id", F.monotonically_increasing_id())
    assert {(r.argv0, r.path) for r in shell.reads(shell.decompose(keyed)).collect()} == {("rg", "/repo"), ("grep", "/repo/x.go")}


REGIONS = [
    ("docker run -it --rm -v /a:/b -e X=1 img grep -rn X .", ("shell", "grep -rn X .", True)), ("docker run -v a:b img ls", ("shell", "ls", True)), ("docker exec box sh -c ls", ("shell", "sh -c ls", True)),
    ('docker run img cat "$F"', None), ("docker run img", None), ("docker build .", None), ("docker run -w", None),
    ("xargs -0 grep -l TODO", ("shell", "grep -l TODO", False)), ('xargs grep x "$F" y', ("shell", "grep x", False)), ('xargs "$CMD" x', None),
    ("find . -name x -exec grep -n TODO {} +", ("shell", "grep -n TODO", False)), (r"find . -exec cat {} \;", ("shell", "cat", False)), ('find . -exec "$CMD" {} +', None),
    ("sqlite3 -csv a.db 'select 1'", ("sql", "select 1", True)), ("sqlite3 a.db", None), ("awk -i inplace '{print}' f", ("awk", "{print}", True)), ("awk -f p.awk f", None), ("awk '{x}' -f", ("awk", "{x}", True)),
    ("sed -n 's/a/b/p' f", ("sed", "s/a/b/p", True)), ("sed -e 's/a/b/' f", None), ("jq -r '.a' f", ("jq", ".a", True)), ('jq "$Q" f', None),
    ("node -p 1 -e 2", ("javascript", "2", True)), ("python -c 'print(1)'", ("python", "print(1)", True)), ('bash -c "$X"', None), ("perl -e 'print'", ("perl", "print", True)),
]


def test_regions(spark):
    df = spark.createDataFrame([(i, c, "/w", "/home/u") for i, (c, _) in enumerate(REGIONS)], "cmd_id int, command string, base_cwd string, home string")
    got = {r.cmd_id: (r.lang, r.text, r.new_scope) for r in shell.regions(df, shell.decompose(df)).collect()}
    for i, (c, want) in enumerate(REGIONS):
        assert got.get(i) == want, c


def test_stages_and_pipelines(spark):
    lines = ["cat f | grep x |& wc -l", "a; b | c && d", "if a; then b | c; fi", "x | (p; q | r) | y", "one"]
    want = {
        0: [("cat", 0, 0, 23), ("grep", 1, 0, 23), ("wc", 2, 0, 23)], 1: [("a", 0, 0, 0), ("b", 0, 3, 8), ("c", 1, 3, 8), ("d", 0, 0, 0)],
        2: [("a", 0, 0, 0), ("b", 0, 11, 16), ("c", 1, 11, 16)], 3: [("x", 0, 0, 18), ("p", 0, 0, 0), ("q", 0, 8, 13), ("r", 1, 8, 13), ("y", 2, 0, 18)], 4: [("one", 0, 0, 0)],
    }
    df = spark.createDataFrame([(i, c, "/w", "/home/u") for i, c in enumerate(lines)], "cmd_id int, command string, base_cwd string, home string")
    got = {i: [] for i in want}
    for r in shell.decompose(df).orderBy("cmd_id", "command_index").collect():
        if r.argv0:
            got[r.cmd_id].append((r.argv0, r.stage, r.pipeline_start_byte, r.pipeline_end_byte))
    assert got == want


def test_resolve_word(spark):
    df = spark.createDataFrame([(1, "A=/x; A=/y; ( A=/z; ls ); B=$(pwd); ls", "/w", "/home/u"), (2, None, "/w", "/home/u"), (3, " ", "/w", "/home/u")], "cmd_id int, command string, base_cwd string, home string")
    words = [(1, "$A", 0, 4, "/x"), (1, '"${A}"', 0, 3, None), (1, "$A", 0, 30, "/y"), (1, "$A", 1, 30, "/z"), (1, "$B", 0, 99, None), (1, "plain", 0, 99, None), (1, "$A/q", 0, 99, None), (2, "$A", 0, 9, None)]
    asked = spark.createDataFrame(words, "cmd_id int, text string, scope_id int, byte int, want string")
    assert [r.text for r in shell.resolve_word(shell.decompose(df), asked).collect() if r.value != r.want] == []
    assert {r.cmd_id: r.opaque for r in shell.opaque(df).collect()} == {1: False, 2: True, 3: True}


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "duck 'select 1'", "/w", "/home/u"), (2, "jq -r .a f", "/w", "/home/u")], "cmd_id int, command string, base_cwd string, home string")
    first = lambda args: shell.region("sql", F.get(args, F.lit(0))["value"])
    own = {"duck": first, "jq": first}
    assert {(r.cmd_id, r.lang, r.text) for r in shell.regions(df, shell.decompose(df), own).collect()} == {(1, "sql", "select 1"), (2, "sql", "-r")}
    programs = spark.createDataFrame([(1, "lua", "io.lines('a')", "/w", "/h"), (2, "python", "open('b')", "/w", "/h")], "cmd_id int, lang string, text string, cwd string, home string")
    forms = [*FORMS, ("lua", "read", False, r"io\.lines\(('[^']*')\)")]
    assert {(r.cmd_id, r.path) for r in program_files(programs, "cmd_id", forms=forms).collect()} == {(1, "/w/a"), (2, "/w/b")}


def test_names_taken_out_of_fs(spark):
    texts = [
        ("const { readFileSync: rd, writeFileSync } = require('fs'); rd('a'); writeFileSync('b', 1); x.rd('c')", {"/w/a", "/w/b"}),
        ('import { readFile as get } from "fs/promises"; get("d"); readFile("e")', {"/w/d"}), ("const { readFileSync } = require('other'); readFileSync('f')", set()), ("fs.readFileSync('g')", {"/w/g"}),
    ]
    df = spark.createDataFrame([(i, "javascript", t, "/w", "/h") for i, (t, _) in enumerate(texts)], "cmd_id int, lang string, text string, cwd string, home string")
    got = {i: set() for i in range(len(texts))}
    for r in program_files(df, "cmd_id").collect():
        got[r.cmd_id].add(r.path)
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_no_path_from_comments_and_strings(spark):
    texts = [
        ("javascript", "// fs.readFileSync('c.js')\n/* fs.readFileSync('d.js') */ var s = \"fs.readFileSync('e.js')\"; fs.readFileSync('yes'); t = `fs.readFileSync('f.js')`"),
        ("ruby", "# File.read('c')\n=begin\nFile.read('d')\n=end\nputs \"File.read('e')\"; File.read('yes')"),
        ("php", "// readfile('c');\n# readfile('d');\n/* readfile('e'); */ echo \"readfile('f')\"; readfile('yes');"),
        ("perl", "# open(F, \"<\", \"c\");\n=pod\nopen(F, \"<\", \"d\");\n=cut\nprint 'open(F, \"<\", \"e\")'; $n = $#x; open(F, \"<\", \"yes\");"),
        ("awk", "# print > \"c\"\n{ x = \"getline < \\\"d\\\"\"; getline < \"yes\" }"), ("sed", "# r c\n/a/r yes"),
        ("sql", "-- readfile('c')\n/* readfile('d') */ select 'readfile(''e'')', readfile('yes')"), ("applescript", "-- read file \"c\"\n(* read file \"d\" *)\nset x to \"read file y\"\nread file \"yes\""),
        ("python", "# open('c')\nx = \"open('d')\"\n'''open('e')'''\nopen('yes')"), ("javascript", "/* fs.readFileSync('c')"), ("javascript", "x = '" + "a" * 200_000 + "'; fs.readFileSync('yes')"),
    ]
    df = spark.createDataFrame([(i, lang, t, "/w", "/h") for i, (lang, t) in enumerate(texts)], "k int, lang string, text string, cwd string, home string")
    got = {i: set() for i in range(len(texts))}
    for r in program_files(df, "k").collect():
        got[r.k].add(r.path)
    assert got == {i: {"/w/yes"} if "yes" in t else set() for i, (_, t) in enumerate(texts)}


CONTROL = [
    ("cat <<'EOF'\nabc def\nEOF\ncat x", [("cat", 0, 0, ["abc def"]), ("cat", 24, 0, [])]), ("cat <<A; tee <<B\n1\nA\n2\nB\nls", [("cat", 0, 0, ["1"]), ("tee", 9, 0, ["2"]), ("ls", 25, 0, [])]),
    ("cat <<A\nprint A\nA \nA", [("cat", 0, 0, ["print A\nA "])]), ("cat <<-A\n\tx\n\tA\nls", [("cat", 0, 0, ["\tx"]), ("ls", 15, 0, [])]), ("cat <<A\nnever ended", [("cat", 0, 0, ["never ended"])]), ("cat <<A\nA\nls", [("cat", 0, 0, [""]), ("ls", 10, 0, [])]),
    ("cat <<A | tee b\nq'\"\nA\nls é; pwd", [("cat", 0, 0, ["q'\""]), ("tee", 10, 0, []), ("ls", 22, 0, []), ("pwd", 29, 0, [])]), ("echo $(cat <<A\n) x", [("echo", 0, 0, [])]),
    ("for f in a b; do cat $f; done", [("cat", 17, 0, [])]), ("for f\ndo ls\ndone", [("ls", 9, 0, [])]), ("for ((i=0; i<3; i++)); do ls; done", [("ls", 26, 0, [])]), ("select x in a; do ls; done", [("ls", 18, 0, [])]),
    ("f() { ls; }", [("ls", 6, 0, [])]), ("function f { ls; }; f", [("ls", 13, 0, []), ("f", 20, 0, [])]), ("f () ( ls )", [("ls", 7, 1, [])]), ("case x in (a|b) ls;; *) pwd; esac", [("ls", 16, 0, []), ("pwd", 24, 0, [])]), ("case x in esac; ls", [("ls", 16, 0, [])]),
    ("while ! a; do b; done", [("a", 8, 0, []), ("b", 14, 0, [])]), ("until a\ndo b\ndone", [("a", 6, 0, []), ("b", 11, 0, [])]), ("if a; then b; elif c; then d; else e; fi", [("a", 3, 0, []), ("b", 11, 0, []), ("c", 19, 0, []), ("d", 27, 0, []), ("e", 35, 0, [])]),
    ("(a; (b); c) && (d)", [("a", 1, 1, []), ("b", 5, 2, []), ("c", 9, 1, []), ("d", 16, 3, [])]), ("((a = 1)); [ -f x ] && [[ -f y || b ]]; ls", [("ls", 40, 0, [])]), ("time ls # cat b\n# cat c\npwd", [("ls", 5, 0, []), ("pwd", 24, 0, [])]),
    ("echo a#b 'c # d' #e", [("echo", 0, 0, [])]), ("echo if for done } {", [("echo", 0, 0, [])]), ("a=1 b=2; c=3 d", [("d", 9, 0, [])]), ("echo $'it\\'s' `ls` ${x:-y} $((1+2))", [("echo", 0, 0, [])]), ("a; b & c", [("a", 0, 0, []), ("b", 3, 0, []), ("c", 7, 0, [])]),
    ("> only", []), ("{ a; } > o", [("a", 2, 0, [])]), ("if a; then b; fi > o | c", [("a", 3, 0, []), ("b", 11, 0, []), ("c", 23, 0, [])]), ("ls " + "x" * 60_000, [("ls", 0, 0, [])]), ("echo '" + "é" * 30_000 + "'; ls", [("echo", 0, 0, []), ("ls", 60_009, 0, [])]),
    ("cat <<A\n" + "x 'y\n" * 20_000 + "A\nls", [("cat", 0, 0, [("x 'y\n" * 20_000)[:-1]]), ("ls", 100_010, 0, [])]),
]
BROKEN = ["echo 'a", 'echo "a', "echo `a", "(a", "a)", "{ a; ", "a; }", "if a; then b", "done", "for x in a; do b", "case x in a) b", "a ;; b", "if a; fi; fi", "do a; done", "echo $(a", "f() { a", "[[ -f a", "then a", "", None, " \n\t"]


def test_control_words_and_heredocs(spark):
    lines = [c for c, _ in CONTROL] + BROKEN
    df = spark.createDataFrame(list(enumerate(lines)), "cmd_id int, command string").withColumns({"base_cwd": F.lit("/w"), "home": F.lit("/home/u")})
    got = {i: [] for i in range(len(lines))}
    for r in shell.decompose(df).where("named").orderBy("cmd_id", "command_index").collect():
        got[r.cmd_id].append((r.argv0, r.start_byte, r.scope_id, r.bodies))
    for i, line in enumerate(lines):
        assert got[i] == (CONTROL[i][1] if i < len(CONTROL) else []), line
    assert [r.opaque for r in shell.opaque(df).orderBy("cmd_id").collect()] == [i >= len(CONTROL) for i in range(len(lines))]
    assert {r.token for r in shell.tokens(df.where("cmd_id = 0")).collect()} == {"cat", "<<", "'EOF'", "x"}


def test_redirections_of_groups(spark):
    lines = [("{ cd /z; cat a; } > o", {"/w/o"}, {"/z/a"}), ("(cd /z; cat a > b) > o", {"/w/o", "/z/b"}, {"/z/a"}), ("cd /y; { cd /z; } > o; cat a > p", {"/y/o", "/z/p"}, {"/z/a"}), ("for x in 1; do cat b; done < c >> 7", {"/w/7"}, {"/w/b", "/w/c"}), ("ls >& 2; ls 2>&1; ls >&-", set(), set())]
    df = spark.createDataFrame([(i, c, "/w", "/home/u") for i, (c, *_) in enumerate(lines)], "cmd_id int, command string, base_cwd string, home string")
    parsed = shell.decompose(df)
    for rows, k in ((shell.writes(parsed), 1), (shell.reads(parsed), 2)):
        got = {i: set() for i in range(len(lines))}
        for r in rows.where("resolvable").collect():
            got[r.cmd_id].add(r.path)
        assert got == {i: x[k] for i, x in enumerate(lines)}
    assert {r.argv0 for r in shell.commands(parsed).collect()} == {"cd", "cat", "ls"}


def test_closure(spark):
    lines = ["bash <<A\nbash <<B\nbash <<C\nbash <<D\nbash <<E\ncat deep\nE\ncat five\nD\nC\nB\nA", "python /s/a.py", "python3 -m pkg.mod x", "python -m http.server", "cd \"$V\"; bash -c 'cat rel /abs'", "python -c \"import os; os.system('cat inner')\"", "python /s/none.py"]
    scripts = [("/s/a.py", "import subprocess\nsubprocess.run(['python', '/s/b.py'])\nopen('a')"), ("/s/b.py", "import os\nos.system('python /s/a.py')\nopen('b')"), ("/w/pkg/mod/__main__.py", "import sys\nopen(sys.argv[1])")]
    df = spark.createDataFrame([(i, c, "/w", "/home/u") for i, c in enumerate(lines)], "cmd_id int, command string, base_cwd string, home string")
    files = spark.createDataFrame(scripts, "path string, content string")
    parsed, programs = shell.closure(df, files, cut=written)
    got = {(r.root, r.level, r.path) for r in shell.reads(parsed.where("level > 0"), "root", "level").where("resolvable").collect()}
    got |= {(r.root, r.level, r.path) for r in program_files(programs, "root", "level").collect()}
    assert got == {("0", 4, "/w/five"), ("1", 1, "/w/a"), ("1", 3, "/w/b"), ("2", 1, "/w/x"), ("4", 1, "/abs"), ("5", 2, "/w/inner")}
    assert shell.closure(df, None, 1)[0].select("level").distinct().count() == 1
    levels = shell.nested(df.where("cmd_id = 0"), 5, written)
    assert [shell.reads(p).where("resolvable and path = '/w/five'").count() for _, p in levels] == [0, 0, 0, 0, 1]


def test_closure_parses_each_level_once(spark):
    """What is given back reads what was written, and works out no line again; a level's lines are not written apart."""
    df = spark.createDataFrame([(0, "bash -c 'bash -c \"cat a\"'", "/w", "/home/u")], "cmd_id int, command string, base_cwd string, home string")
    wrote = []
    cut = lambda d: wrote.append(d) or written(d)
    parsed, programs = shell.closure(df, None, 3, cut)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (parsed, programs, *wrote)]
    assert [p.count("_scanned(") for p in plans] == [0, 0, 1, 0, 1, 0, 1]
    assert [(r.level, r.path) for r in shell.reads(parsed, "level").collect()] == [(2, "/w/a")]


def test_broken_lines_are_those_of_the_shell(tmp_path):
    """Random lines against the shell's own check of its grammar: none that it accepts is broken, and hardly any other way round."""
    bash = shutil.which("bash")
    if not bash:
        pytest.skip("no shell here")
    rnd = random.Random(11)
    tokens = ["a", "b c", "x=1", "if", "then", "else", "fi", "while", "do", "done", "for i in 1 2", "case x in", "a)", "esac", ";;", ";", "\n", "&&", "||", "|", "&", "(", ")", "{", "}", "!", "> f", "2>&1", "'q'", '"d $(e)"', "[[ -f a ]]", "f()", "# c\n", "((1))"]
    groups = ["if {} ; then {} ; fi", "while {} ; do {} ; done", "{{ {} ; }} && {}", "( {} ) | {}", "for i in 1 ; do {} ; done ; {}", "case x in a) {} ;; b) {} ;; esac", "f() {{ {} ; }} ; {}"]
    lines = [" ".join(rnd.choices(tokens, k=rnd.randrange(1, 7))) for _ in range(150)]
    lines += [" ".join([rnd.choice(groups).format(*(" ; ".join(rnd.choices(["a", "b c", "(d)", "[[ f ]]", "x=1"], k=2)) for _ in range(2))), *rnd.choices(tokens, k=rnd.randrange(2))]) for _ in range(150)]
    said = [subprocess.run([bash, "-n", "-c", x], capture_output=True, check=False).returncode == 0 for x in lines]
    mine = [not read(x)["broken"] for x in lines]
    assert not [x for x, s, m in zip(lines, said, mine) if s and not m and x.split("#")[0].strip()]
    assert sum(m and not s for s, m in zip(said, mine)) <= 3 and 50 < sum(said) < 250
