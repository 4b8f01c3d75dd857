"""Queries of the command operators, over a fixture of command lines that `events` repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages, paths
from ..operators import shell
from ..sources.tables import table

HOME = "/home/u"
# Fixed values: (directory, command line); what they mean is stated below, in SQL.
CASES = [
    ("/start", 'cd "$VAR" && grep -rn X .'),
    ("/start", "cd /indexed/repo && grep -rn X ."),
    ("/w", "cat <<'EOF'\ngrep secret file\nEOF"),
    ("/repo", 'git grep "x"'),
    ("/w", 'grep -nE "x" /tmp/log'),
    ("/w", "find Tests | grep -iE x"),
    ("/work", '( cd "$1" && grep x . )'),
    ("/start", "cd ~/proj && cat f"),
    ("/w", 'bash -c "cd /x && grep y ."'),
    ("/w", "sed -i 's/a/b/' file.txt"),
    ("/w", "echo hi >> /tmp/log"),
    ("/w", "env FOO=1 sudo grep x /etc/shadow"),
    ("/w", ""),
    ("/start", "cd /a && cat one && cd /b && cat two"),
    ("/work", "E='/repo/src'\ngrep -rn X \"$E\""),
    ("/work", '( E=/repo/src; grep -rn X "$E" )\ngrep -rn X "$E"'),
    ("/work", 'E=$(pwd)\ngrep -rn X "$E"'),
    ("/repo", "jq --arg a 1 --arg b 2 '.a' /repo/a.json /repo/b.json"),
    ("/base", "cd /repo/wt && git diff > out.txt"),
    ("/w", "tee out.txt < in.txt"),
    ("/w", "patch f.txt < diff.patch"),
    ("/w", "ssh host 'grep TOKEN ~/.config/x'"),
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command line for each event: the cases take turns."""
    pick = F.get(F.array(*[F.struct(F.lit(c).alias("command"), F.lit(d).alias("base_cwd")) for d, c in CASES]), F.pmod("event_id", F.lit(len(CASES))).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("cmd_id"), pick.alias("_c")).select("cmd_id", "_c.command", "_c.base_cwd", F.lit(HOME).alias("home"))


def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.commands(shell.decompose(lines(spark, sf_dir))).select("cmd_id", "command_index", "argv0", "kind", "cwd", "scope_id")


def shell_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.reads(shell.decompose(lines(spark, sf_dir))).select("cmd_id", "argv0", "path", "resolvable", "origin")


def shell_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.writes(shell.decompose(lines(spark, sf_dir))).select("cmd_id", "argv0", "path", "resolvable", "origin")


def shell_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shell.assignments(shell.decompose(lines(spark, sf_dir))).select("cmd_id", "name", "value", "resolvable", "scope_id")


def shell_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return shell.regions(rows, shell.decompose(rows)).select("cmd_id", "lang", "text", "new_scope")


def shell_nested_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that embedded shell programs read, by line: one level below the line."""
    level = shell.nested(lines(spark, sf_dir), 2)[1][1]
    return shell.reads(level).where("resolvable").select(F.element_at(F.split("cmd_id", "/"), 1).cast("long").alias("cmd_id"), "path")


def effective_cwd_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of the command at or before byte 12 of each line."""
    rows = lines(spark, sf_dir)
    return shell.effective_cwd(shell.decompose(rows), rows.select("cmd_id", F.lit(12).cast("long").alias("byte"))).select("cmd_id", "cwd")


def command_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit([*languages.KIND_OF, "nope"])
    rows = table(spark, sf_dir, "events").select("event_id", F.get(names, F.pmod("event_id", F.lit(len(languages.KIND_OF) + 1)).cast("int")).alias("program"))
    return rows.withColumn("kind", languages.command_kind(F.col("program")))


def read_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each directory is read from."""
    found = shell.reads(shell.decompose(lines(spark, sf_dir))).where("resolvable")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return found.groupBy(F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder")).agg(F.count("*").alias("n_reads"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path functions over the URLs of pages, taken as paths."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("p"))
    return rows.select("page_id", paths.base_name(F.col("p")).alias("base"), paths.clean_path(F.concat(F.lit("/"), F.col("p"), F.lit("/../x//."))).alias("cleaned"), paths.hfs_path(F.col("p")).alias("hfs"), paths.is_name(paths.base_name(F.col("p"))).alias("is_name"))


QUERIES = {f.__name__: f for f in (shell_commands, shell_reads, shell_writes, shell_assignments, shell_regions, shell_nested_reads, effective_cwd_at, command_kind, read_hotspots, path_functions)}

# -- expected rows, by case --------------------------------------------------------------------

_N = len(CASES)


def _expected(columns: str, values: str, select: str) -> str:
    return f"WITH x(k, {columns}) AS (VALUES {values}) SELECT event_id AS cmd_id, {select} FROM events JOIN x ON event_id % {_N} = k"


_READS = """(0, 'grep', NULL, ''), (1, 'grep', '/indexed/repo', ''), (3, 'git grep', '/repo', ''), (4, 'grep', '/tmp/log', ''), (5, 'find', '/w/Tests', ''),
(6, 'grep', NULL, ''), (7, 'cat', '/home/u/proj/f', ''), (9, 'sed', '/w/file.txt', ''), (11, 'grep', '/etc/shadow', ''), (13, 'cat', '/a/one', ''), (13, 'cat', '/b/two', ''),
(14, 'grep', '/repo/src', ''), (15, 'grep', '/repo/src', ''), (15, 'grep', NULL, ''), (16, 'grep', NULL, ''), (17, 'jq', '/repo/a.json', ''), (17, 'jq', '/repo/b.json', ''),
(19, 'tee', '/w/in.txt', 'redirect'), (20, 'patch', '/w/diff.patch', 'redirect')"""
SQL = {
    "shell_commands": _expected("i, argv0, kind, cwd, scope", """(0, 0, 'cd', 'nav', '/start', 0), (0, 1, 'grep', 'search', NULL, 0), (1, 0, 'cd', 'nav', '/start', 0), (1, 1, 'grep', 'search', '/indexed/repo', 0),
(2, 0, 'cat', 'read', '/w', 0), (3, 0, 'git', 'vcs', '/repo', 0), (4, 0, 'grep', 'search', '/w', 0), (5, 0, 'find', 'read', '/w', 0), (5, 1, 'grep', 'search', '/w', 0), (6, 0, 'cd', 'nav', '/work', 1),
(6, 1, 'grep', 'search', NULL, 1), (7, 0, 'cd', 'nav', '/start', 0), (7, 1, 'cat', 'read', '/home/u/proj', 0), (8, 0, 'bash', 'interpreter', '/w', 0), (9, 0, 'sed', 'read', '/w', 0),
(10, 0, 'echo', 'unknown', '/w', 0), (11, 0, 'grep', 'search', '/w', 0), (13, 0, 'cd', 'nav', '/start', 0), (13, 1, 'cat', 'read', '/a', 0), (13, 2, 'cd', 'nav', '/a', 0), (13, 3, 'cat', 'read', '/b', 0),
(14, 1, 'grep', 'search', '/work', 0), (15, 1, 'grep', 'search', '/work', 1), (15, 2, 'grep', 'search', '/work', 0), (16, 1, 'grep', 'search', '/work', 0), (17, 0, 'jq', 'read', '/repo', 0),
(18, 0, 'cd', 'nav', '/base', 0), (18, 1, 'git', 'vcs', '/repo/wt', 0), (19, 0, 'tee', 'write', '/w', 0), (20, 0, 'patch', 'write', '/w', 0), (21, 0, 'ssh', 'network', '/w', 0)""",
                                "CAST(i AS INTEGER) AS command_index, argv0, kind, cwd, CAST(scope AS INTEGER) AS scope_id"),
    "shell_reads": _expected("argv0, path, origin", _READS, "argv0, path, path IS NOT NULL AS resolvable, origin"),
    "shell_writes": _expected("argv0, path, origin", "(9, 'sed', '/w/file.txt', 'argument'), (10, 'echo', '/tmp/log', 'redirect'), (18, 'git', '/repo/wt/out.txt', 'redirect'), (19, 'tee', '/w/out.txt', 'argument'), (20, 'patch', '/w/f.txt', 'argument')",
                              "argv0, path, true AS resolvable, origin"),
    "shell_assignments": _expected("name, value, scope", "(14, 'E', '/repo/src', 0), (15, 'E', '/repo/src', 1), (16, 'E', NULL, 0)", "name, x.value, x.value IS NOT NULL AS resolvable, CAST(scope AS INTEGER) AS scope_id"),
    "shell_regions": _expected("lang, text, scope", "(2, 'opaque', 'grep secret file', false), (8, 'shell', 'cd /x && grep y .', true), (9, 'sed', 's/a/b/', true), (21, 'shell', 'grep TOKEN ~/.config/x', true), (17, 'jq', 'a', true)", "lang, text, scope AS new_scope"),
    "shell_nested_reads": _expected("path", "(8, '/x'), (21, '/home/u/.config/x')", "path"),
    "effective_cwd_at": f"WITH x(k, cwd) AS (VALUES (0, '/start'), (1, '/start'), (2, '/w'), (3, '/repo'), (4, '/w'), (5, '/w'), (6, '/work'), (7, '/start'), (8, '/w'), (9, '/w'), (10, '/w'), (11, '/w'), (12, NULL), (13, '/a'), (14, '/work'), (15, '/work'), (16, '/work'), (17, '/repo'), (18, '/base'), (19, '/w'), (20, '/w'), (21, '/w')) SELECT event_id AS cmd_id, cwd FROM events JOIN x ON event_id % {_N} = k",
    "command_kind": "WITH k(i, program, kind) AS (VALUES " + ", ".join(f"({i}, '{p}', '{k}')" for i, (p, k) in enumerate([*languages.KIND_OF.items(), ("nope", "unknown")])) + f") SELECT event_id, program, kind FROM events JOIN k ON event_id % {len(languages.KIND_OF) + 1} = i",
    "read_hotspots": f"WITH x(k, argv0, path, origin) AS (VALUES {_READS}) SELECT CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder, count(*) AS n_reads FROM events JOIN x ON event_id % {_N} = k WHERE path IS NOT NULL GROUP BY 1",
    "path_functions": "SELECT page_id, split_part(url, '/', -1) AS base, '/' || array_to_string(list_filter(string_split(regexp_replace(url, '/[^/]*/?$', ''), '/'), lambda e: e NOT IN ('', '.')), '/') || CASE WHEN url LIKE '%/' THEN '' ELSE '' END || '/x' AS cleaned, contains(url, ':') AS hfs, regexp_matches(split_part(url, '/', -1), '^[A-Za-z_][A-Za-z0-9_]*$') AS is_name FROM pages",
}
