"""Files that embedded programs read and write: a table of literal call forms, matched by Spark's own pattern functions.

Only calls whose path is one literal string count: an escape, interpolation, variable or named argument
drops the call, and so does a comment or a string around it. Python has its data flow instead (`dataflow`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_prefix_dir, resolve_path
from ..functions.text import let
from .dataflow import facts_of, python_files

Q = r"""('[^'\\\n]*'|"[^"\\$#{\n]*")"""  # one literal string
PQ = r"""("[^"\\$@\n]*")"""  # one literal string of Perl

# (language, read or write, whether the path is a glob, pattern). Group 1 is the quoted path, group 2 a bare one.
FORMS = [
    ("javascript", "read", False, rf"(?<![\w.])fs\.(?:readFileSync|readFile|readdirSync|readdir|createReadStream|promises\.readFile)\(\s*{Q}\s*[,)]"),
    ("javascript", "write", False, rf"(?<![\w.])fs\.(?:writeFileSync|writeFile|appendFileSync|createWriteStream)\(\s*{Q}\s*[,)]"),
    ("javascript", "write", False, rf"(?<![\w.])fs\.openSync\(\s*{Q}\s*,\s*['\"][wa]"),
    ("ruby", "read", False, rf"(?<!\w)(?:File\.(?:read|readlines|foreach)|IO\.read|Dir\.(?:entries|each_child))\(?\s*{Q}\s*[,)\n;]?"),
    ("ruby", "read", False, rf"(?<!\w)File\.open\(\s*{Q}\s*(?:,\s*['\"]r[bt]?['\"]\s*)?\)"),
    ("ruby", "read", True, rf"(?<!\w)Dir(?:\.glob\(|\[)\s*{Q}\s*[,)\]]"),
    ("ruby", "write", False, rf"(?<!\w)File\.write\(\s*{Q}\s*,"),
    ("ruby", "write", False, rf"(?<!\w)File\.open\(\s*{Q}\s*,\s*['\"][wa]"),
    ("php", "read", False, rf"(?<![\w>:$])(?:file_get_contents|file|readfile|scandir)\(\s*{Q}\s*[,)]"),
    ("php", "read", False, rf"(?<![\w>:$])fopen\(\s*{Q}\s*,\s*['\"](?![wa])[a-z+]+['\"]"),
    ("php", "read", True, rf"(?<![\w>:$])glob\(\s*{Q}\s*[,)]"),
    ("php", "write", False, rf"(?<![\w>:$])file_put_contents\(\s*{Q}\s*,"),
    ("php", "write", False, rf"(?<![\w>:$])fopen\(\s*{Q}\s*,\s*['\"][wa]"),
    ("perl", "read", False, rf"(?<!\w)open\s*\(?[^,;]+,\s*[\"']\+?<(?:\s*:[^\"']*)?[\"']\s*,\s*{PQ}"),
    ("perl", "write", False, rf"(?<!\w)open\s*\(?[^,;]+,\s*[\"'](?:>>|\+>|>)(?:\s*:[^\"']*)?[\"']\s*,\s*{PQ}"),
    ("perl", "read", False, r"(?<!\w)open\s*\(?[^,;]+,\s*\"\s*\+?<\s*()([^\"\\$@&<>|\s][^\"\\$@]*)\"\s*\)?"),
    ("perl", "write", False, r"(?<!\w)open\s*\(?[^,;]+,\s*\"\s*>>?\s*()([^\"\\$@&<>|\s][^\"\\$@]*)\"\s*\)?"),
    ("awk", "read", False, r"getline(?:\s+\w+)?\s*<\s*(\"[^\"\\]*\")"),
    ("awk", "write", False, r"(?:print|printf)\b[^\n;}>]*>>?\s*(\"[^\"\\]*\")"),
    ("sed", "read", False, r"(?m)(?:^|[;{\n])\s*(?:[0-9$]+(?:,[0-9$]+)?|/[^/\n]*/)?\s*[rR]\s+()([^\n]+)"),
    ("sed", "write", False, r"(?m)(?:^|[;{\n])\s*(?:[0-9$]+(?:,[0-9$]+)?|/[^/\n]*/)?\s*(?:[wW]\s+|s/[^/\n]*/[^/\n]*/[gpiI0-9]*w\s+)()([^\n]+)"),
    ("sql", "read", False, r"(?i)(?<!\w)ATTACH\s+(?:DATABASE\s+)?('[^'\\]*')\s+AS\b"),
    ("sql", "read", False, r"(?i)(?<!\w)readfile\s*\(\s*('[^'\\]*')\s*\)"),
    ("sql", "read", False, r"(?m)^\s*\.import\s+()([^\s'\"\\-][^\s\\]*)\s+\S+"),
    ("sql", "write", False, r"(?i)(?<!\w)writefile\s*\(\s*('[^'\\]*')\s*,"),
    ("sql", "write", False, r"(?m)^\s*\.output\s+()((?!stdout\b)[^\s'\"\\-][^\s\\]*)"),
    ("applescript", "read", False, r"(?m)(?<!\w)read\s+(?:POSIX\s+)?(?:file|alias)\s+(\"[^\"\\:\n]*\")(?!\s*&)"),
    ("applescript", "write", False, r"(?m)(?<!\w)write\s+[^\n]*?\bto\s+(?:POSIX\s+)?file\s+(\"[^\"\\:\n]*\")(?!\s*&)"),
]
LANGUAGES = ("python", *dict.fromkeys(f[0] for f in FORMS))

# What is passed over where it begins outside a call form: strings and comments.
SINGLE, DOUBLE = r"""'(?:[^'\\]|\\.)*+'""", r'"(?:[^"\\]|\\.)*+"'
SLASHES, STARS, HASH, DASHES = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", r"(?<![$\w{])#[^\n]*", r"--[^\n]*"
PASSED_OVER = {
    "javascript": (SINGLE, DOUBLE, r"`(?:[^`\\]|\\.)*+`", SLASHES, STARS),
    "ruby": (SINGLE, DOUBLE, HASH, r"(?m:^=begin\b)(?s:.*?)(?:(?m:^=end\b)|\z)"),
    "php": (SINGLE, DOUBLE, SLASHES, HASH, STARS),
    "perl": (SINGLE, DOUBLE, HASH, r"(?m:^=[a-z]\w*)(?s:.*?)(?:(?m:^=cut\b)|\z)"),
    "awk": (DOUBLE, HASH),
    "sed": (r"(?m:^)[ \t]*#[^\n]*",),
    "sql": (r"'(?:[^']|'')*+'", r'"(?:[^"]|"")*+"', DASHES, STARS),
    "applescript": (DOUBLE, DASHES, HASH, r"\(\*(?s:.*?)(?:\*\)|\z)"),
}


# Names that are taken out of fs: "read", "read: alias", "read as alias", between braces. Group 1 is what stands there.
FS_NAMES = (
    r"(?:const|let|var)\s*\{([^{}]*)\}\s*=\s*require\(\s*['\"]fs(?:/promises)?['\"]\s*\)",
    r"import\s*\{([^{}]*)\}\s*from\s*['\"]fs(?:/promises)?['\"]",
)


def with_receivers(text: Column) -> Column:
    """A javascript program whose calls of names taken out of fs are written as calls of fs."""
    taken = F.flatten(F.transform(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in FS_NAMES])), lambda x: F.split(x, ",")))
    part = lambda x, i: F.regexp_extract(x, r"^\s*(\w+)\s*(?:(?::|\bas\b)\s*(\w+)\s*)?$", i)
    names = F.transform(taken, lambda x: F.struct(part(x, 1).alias("name"), F.when(part(x, 2) != "", part(x, 2)).otherwise(part(x, 1)).alias("alias")))
    put = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w.$])"), n["alias"], F.lit(r"\(")), F.concat(F.lit("fs."), n["name"], F.lit("(")))
    return F.aggregate(F.filter(names, lambda n: n["name"] != ""), text, put)


def _matches(text: Column, lang: str, access: str, glob: bool, pattern: str) -> Column:
    """Paths of one form: array of (access, raw, path). Where no form begins, a string or comment is passed over as a whole."""
    bare = "()(" in pattern

    def one(found: Column) -> Column:
        path = F.trim(found) if bare else F.substr(found, F.lit(2), F.length(found) - 2)
        return F.struct(F.lit(access).alias("access"), found.alias("raw"), (glob_prefix_dir(path) if glob else path).alias("path"))

    either = "|".join(f"(?:{p})" for p in (pattern, *PASSED_OVER.get(lang, ())))
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(either), F.lit(2 if bare else 1)), lambda x: x != ""), one)


def child_lines(programs: DataFrame, *keys: str) -> DataFrame:
    """keys, command, base_cwd, home: command lines that python programs (keys, lang, text, cwd, home) run, to decompose in turn.

    os.system with one literal; subprocess calls with a list of literals, joined by spaces.
    """
    rows = programs.where("lang = 'python'").select(*keys, F.col("cwd").alias("base_cwd"), "home", F.explode(facts_of(programs)["commands"]).alias("command"))
    return rows.select(*keys, "command", "base_cwd", "home")


def program_files(programs: DataFrame, *keys: str, forms: Sequence[tuple[str, str, bool, str]] = FORMS) -> DataFrame:
    """keys, lang, access (read or write), path, resolvable, raw for programs (keys, lang, text, cwd, home, and argv for python).

    Python's paths are those of `python_files`, all resolvable. Every other language has its own forms; programs in other languages, null and empty ones have no rows.
    `.output off` in SQL writes to /dev/null. The same path is reported once a program and access. forms:
    what counts as a call, for these languages or further ones; give [*FORMS, ...] to add some.
    """
    flows = python_files(programs, *keys).select(*keys, F.lit("python").alias("lang"), "access", "path", F.lit(True).alias("resolvable"), "raw")
    found = None
    for lang in dict.fromkeys(f[0] for f in forms):
        text = with_receivers(F.col("text")) if lang == "javascript" else F.col("text")
        arrays = let(text, lambda t: F.array_distinct(F.flatten(F.array(*[_matches(t, *form) for form in forms if form[0] == lang]))))  # noqa: B023
        found = F.when(F.col("lang") == lang, arrays) if found is None else found.when(F.col("lang") == lang, arrays)
    rows = programs.select(*keys, "lang", "cwd", "home", F.explode(found).alias("_m")).where("_m.raw <> ''")
    path = F.when((F.col("lang") == "sql") & (F.col("_m.path") == "off"), F.lit("/dev/null")).otherwise(resolve_path(F.col("_m.path"), F.col("cwd"), F.col("home")))
    rows = rows.withColumn("path", path)
    rows = rows.select(*keys, "lang", F.col("_m.access").alias("access"), "path", F.col("path").isNotNull().alias("resolvable"), F.col("_m.raw").alias("raw"))
    return rows.distinct().unionByName(flows)
