"""Queries over command lines and programs that are made of every document's words, and what they mean, in SQL.

{w} is a word of the document's text, {s} its source, {n} its doc_id; the directory is /w/{s}, the home /home/u. Documents take the cases
in turn by the order of their ids' remainders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shell
from ..operators.dataflow import python_files
from ..operators.programs import program_files
from ..sources.shared import written
from ..sources.tables import table

# Command line; commands (program, directory or - for the line's, scope, stage); paths read; paths written; regions (language, text);
# what embedded programs read or write (level, access, path). A relative path is one of the line's directory.
CASES = [
    ("cat <<A > {w}.txt; cat {n}.log\nbody of {w}\nA\ncat z", [("cat", "-", 0, 0)] * 3, ["{n}.log", "z"], ["{w}.txt"], [("opaque", "body of {w}")], []),
    ("bash <<A; python3 <<B\ncat {w}\nprint A\nA\nopen('{n}.txt')\nB\nls", [("bash", "-", 0, 0), ("python3", "-", 0, 0), ("ls", "-", 0, 0)], [], [],
     [("shell", "cat {w}\nprint A"), ("python", "open('{n}.txt')")], [(1, "read", "{w}"), (1, "read", "{n}.txt")]),
    ("for f in {w} b; do grep -n x {n}.txt; done > out.{w}", [("grep", "-", 0, 0)], ["{n}.txt"], ["out.{w}"], [], []),
    ("f() { cat {w}; }; f", [("cat", "-", 0, 0), ("f", "-", 0, 0)], ["{w}"], [], [], []),
    ("case {w} in a|{w}) cat {n};; (*) cat {s}.log;; esac", [("cat", "-", 0, 0)] * 2, ["{n}", "{s}.log"], [], [], []),
    ("{ cd /z/{w}; cat a; } > o.{n}", [("cd", "-", 0, 0), ("cat", "/z/{w}", 0, 0)], ["/z/{w}/a"], ["o.{n}"], [], []),
    ("( cd /q/{n} && cat a ) > o; cat {w}", [("cd", "-", 1, 0), ("cat", "/q/{n}", 1, 0), ("cat", "-", 0, 0)], ["/q/{n}/a", "{w}"], ["o"], [], []),
    ("if [ -f {w} ]; then cat {w} | sort; else cat no; fi", [("cat", "-", 0, 0), ("sort", "-", 0, 1), ("cat", "-", 0, 0)], ["{w}", "no"], [], [], []),
    ("while read l; do echo $l; done < in.{w} | grep {n}", [("read", "-", 0, 0), ("echo", "-", 0, 0), ("grep", "-", 0, 1)], ["in.{w}"], [], [], []),
    ("[[ -f {w} && a < b ]] && cat {n} # don't", [("cat", "-", 0, 0)], ["{n}"], [], [], []),
    ("echo '{w}", None, [], [], [], []),
    ("cat {w}; done", None, [], [], [], []),
    ("D=/d/{w}; cat $D", [("cat", "-", 0, 0)], ["/d/{w}"], [], [], []),
    ("docker run -v /a:/b img cat /etc/{w}", [("docker", "-", 0, 0)], [], [], [("shell", "cat /etc/{w}")], [(1, "read", "/etc/{w}")]),
    ("find src -name '*.go' -exec grep -n {w} /f/{n} \\;", [("find", "-", 0, 0)], ["src", "*.go", "grep", "{w}", "/f/{n}", "\\;"], [], [("shell", "grep -n {w} /f/{n}")], [(1, "read", "/f/{n}")]),
    ("xargs -0 grep -l {w} /x/{n}", [("xargs", "-", 0, 0)], [], [], [("shell", "grep -l {w} /x/{n}")], [(1, "read", "/x/{n}")]),
    ("sqlite3 {w}.db \"select readfile('/r/{n}')\"", [("sqlite3", "-", 0, 0)], [], [], [("sql", "select readfile('/r/{n}')")], [(1, "read", "/r/{n}")]),
    ("bash <<A\nbash <<B\nbash <<C\ncd /deep\nbash <<D\ncat {w}\nD\nC\nB\nA", [("bash", "-", 0, 0)], [], [], [("shell", "bash <<B\nbash <<C\ncd /deep\nbash <<D\ncat {w}\nD\nC\nB")], [(4, "read", "/deep/{w}")]),
    ("python3 - <<P\nimport os\nos.system('bash -c \"cat {w} > {n}\"')\nP", [("python3", "-", 0, 0)], [], [], [("python", "import os\nos.system('bash -c \"cat {w} > {n}\"')")], [(3, "read", "{w}"), (3, "write", "{n}")]),
    ("python /s/{n}.py a.{w}", [("python", "-", 0, 0)], [], [], [], [(1, "read", "a.{w}"), (2, "read", "/c/{w}")]),
    ("python -m pkg.m{n}", [("python", "-", 0, 0)], [], [], [], [(1, "read", "m.{n}"), (1, "write", "/o/{w}")]),
    ("perl -ne 'print' {w}.pl {n}.pl", [("perl", "-", 0, 0)], ["{w}.pl", "{n}.pl"], [], [], []),
    ("cat {w} | (cd /k; head {n}) | wc -l", [("cat", "-", 0, 0), ("cd", "-", 1, 0), ("head", "/k", 1, 0), ("wc", "-", 0, 2)], ["{w}", "/k/{n}"], [], [], []),
]
# Scripts that the lines above run, by path.
SCRIPTS = [
    ("/s/{n}.py", "import sys, subprocess\nopen(sys.argv[1])\nsubprocess.run(['cat', '/c/{w}'])\nsubprocess.run(['python', '/s/{n}.py', 'b'])"),
    ("/w/{s}/pkg/m{n}.py", "names = 'm.{n}'\nopen(names)\nopen('/o/{w}', 'w')"),
]
# Python program, run with the arguments {w} and /a/{n}; what it reads; what it writes.
PROGRAMS = [
    ("p = '{w}.txt'; open(p)", ["{w}.txt"], []),
    ("p = '{w}.txt'\np = f()\nopen(p)", [], []),
    ("import sys\nopen(sys.argv[1]); open(sys.argv[2], 'w')", ["{w}"], ["/a/{n}"]),
    ("from pathlib import Path\nroot = Path('{w}')\nfor p in sorted(root.rglob('*.go')):\n    print(p.read_text())", ["{w}"], []),
    ("import os\nfor d, ds, fs in os.walk('/v/{n}'):\n    for f in fs:\n        q = os.path.join(d, f)\n        open(q).read()", ["/v/{n}"], []),
    ("import os\nprint(os.listdir('{w}'))", [], []),
    ("import glob\na = glob.glob('{w}/*/*.py')\nb = a\nc = [x for x in b]\nfor y in b: open(y)", ["{w}"], []),
    ("open(f'/log/{w}/{name}')\nopen(f'{name}/{w}')", ["/log/{w}"], []),
    ("e = d\nd = c\nc = b\nb = glob.iglob('/g/{n}/*')\nopen(e)", ["/g/{n}"], []),
    ("# open('{w}')\ns = \"open('{w}')\"\nPath('{n}.out').write_text(s)", [], ["{n}.out"]),
    ("import fileinput\nfor l in fileinput.input(): print(l)", ["{w}", "/a/{n}"], []),
    ("open('{w}'", [], []),
]
HOME = "/home/u"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, w, s, n of every document."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{3,12}", 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(word == "", F.lit("none")).otherwise(word).alias("w"), F.coalesce("source", F.lit("")).alias("s"), F.col("doc_id").cast("string").alias("n"))


def _put(template: Column) -> Column:
    for slot in "wsn":
        template = F.replace(template, F.lit(f"{{{slot}}}"), F.col(slot))
    return template


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines_of(_facts(spark, sf_dir))


def _lines_of(facts: DataFrame) -> DataFrame:
    pick = F.get(F.lit([c[0] for c in CASES]), F.pmod("doc_id", F.lit(len(CASES))).cast("int"))
    return facts.select(F.col("doc_id").alias("cmd_id"), _put(pick).alias("command"), F.concat(F.lit("/w/"), F.col("s")).alias("base_cwd"), F.lit(HOME).alias("home"))


def line_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs, where, in which subshell and at which place of a pipeline."""
    return shell.commands(shell.decompose(_lines(spark, sf_dir))).select(F.col("cmd_id").alias("doc_id"), "argv0", "cwd", "scope_id", "stage")


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the lines themselves read and write."""
    parsed = shell.decompose(_lines(spark, sf_dir))
    both = shell.reads(parsed).withColumn("access", F.lit("read")).unionByName(shell.writes(parsed).withColumn("access", F.lit("write")))
    return both.where("resolvable").select(F.col("cmd_id").alias("doc_id"), "access", "path")


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs inside the lines, heredocs among them."""
    rows = _lines(spark, sf_dir)
    return shell.regions(rows, shell.decompose(rows)).select(F.col("cmd_id").alias("doc_id"), "lang", "text")


def line_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.opaque(_lines(spark, sf_dir)).withColumnRenamed("cmd_id", "doc_id")


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a variable stands for behind the end of each line, outside subshells."""
    rows = _lines(spark, sf_dir)
    asked = rows.select("cmd_id", F.explode(F.array(F.lit("$D"), F.lit('"${D}"'), F.lit("$f"))).alias("text"), F.lit(0).alias("scope_id"), F.octet_length("command").alias("byte"))
    return shell.resolve_word(shell.decompose(rows), asked).select(F.col("cmd_id").alias("doc_id"), "text", "value")


def embedded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that programs below the lines read and write, at all levels: shells in shells, scripts, commands of programs."""
    tasks = 4 * spark.sparkContext.defaultParallelism  # a number that isn't made smaller: the work isn't in the bytes, nor in how documents are stored
    facts = written(_facts(spark, sf_dir).repartition(tasks, "doc_id"))
    scripts = facts.select(F.explode(F.array(*[F.struct(_put(F.lit(p)).alias("path"), _put(F.lit(c)).alias("content")) for p, c in SCRIPTS])).alias("_s")).select("_s.*").dropDuplicates(["path"])
    parsed, programs = shell.closure(_lines_of(facts), scripts, cut=written)
    below = parsed.where("level > 0")
    of_shells = shell.reads(below, "root", "level").withColumn("access", F.lit("read")).unionByName(shell.writes(below, "root", "level").withColumn("access", F.lit("write"))).where("resolvable").select("root", "level", "access", "path")
    of_programs = program_files(programs, "cmd_id", "root", "level").where("resolvable").select("root", "level", "access", "path")
    return of_shells.unionByName(of_programs).distinct().select(F.col("root").cast("long").alias("doc_id"), "level", "access", "path")


def python_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of python programs that go through names, arguments, loops and walked directories."""
    pick = F.get(F.lit([p[0] for p in PROGRAMS]), F.pmod("doc_id", F.lit(len(PROGRAMS))).cast("int"))
    rows = _facts(spark, sf_dir).select("doc_id", F.lit("python").alias("lang"), _put(pick).alias("text"), F.array("w", F.concat(F.lit("/a/"), "n")).alias("argv"), F.concat(F.lit("/w/"), "s").alias("cwd"), F.lit(HOME).alias("home"))
    return python_files(rows, "doc_id").select("doc_id", "access", "path")


QUERIES = {f.__name__: f for f in (line_commands, line_files, line_regions, line_opaque, line_words, embedded_files, python_dataflow)}

# -- expected rows, by case --------------------------------------------------------------------

_FACTS = "f AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(text, ''), '[a-z]{3,12}') = '' THEN 'none' ELSE regexp_extract(coalesce(text, ''), '[a-z]{3,12}') END AS w, coalesce(source, '') AS s, CAST(doc_id AS VARCHAR) AS n FROM documents)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _filled(column: str) -> str:
    return f"replace(replace(replace({column}, '{{w}}', w), '{{s}}', s), '{{n}}', n)"


def _sql(n: int, columns: str, rows: list[tuple], select: str) -> str:
    values = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"WITH {_FACTS}, x(k, {columns}) AS (VALUES {values}) SELECT doc_id, {select} FROM f JOIN x ON doc_id % {n} = k"


def _path(path: str) -> str:
    return path if path.startswith("/") else f"/w/{{s}}/{path}"


_ALL = list(enumerate(CASES))
SQL = {
    "line_commands": _sql(len(CASES), "argv0, cwd, scope, stage", [(k, a, "/w/{s}" if d == "-" else d, sc, st) for k, c in _ALL for a, d, sc, st in c[1] or ()], f"argv0, {_filled('cwd')} AS cwd, CAST(scope AS INTEGER) AS scope_id, CAST(stage AS INTEGER) AS stage"),
    "line_files": _sql(len(CASES), "access, path", [(k, a, _path(p)) for k, c in _ALL for a, ps in (("read", c[2]), ("write", c[3])) for p in ps], f"access, {_filled('path')} AS path"),
    "line_regions": _sql(len(CASES), "lang, text", [(k, lang, t) for k, c in _ALL for lang, t in c[4]], f"lang, {_filled('text')} AS text"),
    "line_opaque": f"SELECT doc_id, doc_id % {len(CASES)} IN ({', '.join(str(k) for k, c in _ALL if c[1] is None)}) AS opaque FROM documents",
    "line_words": f"WITH {_FACTS}, x(text) AS (VALUES ('$D'), ('\"${{D}}\"'), ('$f')) SELECT doc_id, text, CASE WHEN doc_id % {len(CASES)} = {next(k for k, c in _ALL if c[0].startswith('D='))} AND text <> '$f' THEN '/d/' || w END AS value FROM f CROSS JOIN x",
    "embedded_files": _sql(len(CASES), "level, access, path", [(k, n, a, _path(p)) for k, c in _ALL for n, a, p in c[5]], f"CAST(level AS INTEGER) AS level, access, {_filled('path')} AS path"),
    "python_dataflow": _sql(len(PROGRAMS), "access, path", [(k, a, _path(p)) for k, c in enumerate(PROGRAMS) for a, ps in (("read", c[1]), ("write", c[2])) for p in ps], f"access, {_filled('path')} AS path"),
}
