"""Shell words and paths as Catalyst expressions. What can't be pinned to a literal is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NAME = "[A-Za-z_][A-Za-z0-9_]*"


def strip_quotes(word: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.coalesce(F.nullif(F.regexp_extract(word, r"""(?s)^(['"])(.*)\1$""", 2), F.lit("")), F.when(word.isin("''", '""'), F.lit("")).otherwise(word))


def contains_expansion(word: Column) -> Column:
    return word.contains("$") | word.contains("`")


def is_name(word: Column) -> Column:
    return word.rlike(f"^{NAME}$")


def is_assignment(word: Column) -> Column:
    return word.rlike(rf"(?s)^{NAME}\+?=.*$")


def safe_unquoted(value: Column) -> Column:
    """Whether a value stands for one word without quotes around its expansion."""
    return ~value.rlike(r"[ \t\n*?\[]")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def is_recursive_flag(word: Column) -> Column:
    """-r, -R or --recursive, alone or in a cluster of short flags."""
    return word.isin("--recursive", "--dereference-recursive") | word.rlike("^-[A-Za-z]*[rR]")


def literal_value(word: Column) -> Column:
    """The value of a word that is one literal, else null: '...' as it is; "..." and bare words without $ and backtick."""
    quoted, bare = r"""(?s)^(?:'[^']*'|"(?:[^"\\$`]|\\.)*")$""", r"""(?s)^(?![<>]\()[^'"$`]+$"""
    return let(word, lambda w: F.when(w.rlike(bare), w).when(w.rlike(quoted), F.substr(w, F.lit(2), F.length(w) - 2)))


def clean_path(path: Column) -> Column:
    """The shortest equal path: no empty, . or inner .. elements; the empty path is "."."""
    return let(path, _clean)


def _clean(path: Column) -> Column:
    rooted = path.startswith("/")
    step = lambda a, e: F.when(e.isin("", "."), a).when(
        (e == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)
    ).when((e == "..") & rooted, a).otherwise(F.array_append(a, e))
    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return let(joined, lambda j: F.when(rooted, F.concat(F.lit("/"), j)).when(j == "", F.lit(".")).otherwise(j))


def resolve_path(path: Column, cwd: Column, home: Column) -> Column:
    """Absolute path of a literal, or null: ~ and ~/x need a home, a relative path a known absolute cwd."""
    def resolved(v: Column) -> Column:
        p, c, h = v["p"], v["c"], v["h"]
        whole = F.when(p.startswith("/"), p).when(p == "~", h).when(p.startswith("~/"), F.concat(h, F.substr(p, F.lit(2)))).when(c.startswith("/"), F.concat(c, F.lit("/"), p))
        return let(whole, lambda w: F.when(w.startswith("/"), _clean(w)))

    return let(F.struct(path.alias("p"), cwd.alias("c"), home.alias("h")), resolved)


def write_mode(mode: Column) -> Column:
    """Whether a file mode writes: any of w, a, x, +."""
    return mode.rlike("[wax+]")


def glob_prefix_dir(pattern: Column, wild: str = r"*?[{") -> Column:
    """The directory in front of the first element that holds a wildcard; null if none is certain."""
    marks = "".join(f"\\{c}" for c in wild)
    head = F.regexp_extract(pattern, f"^([^{marks}]*)", 1)
    folder = F.regexp_extract(head, "^(.*)/[^/]*$", 1)
    return F.when(head == pattern, pattern).when(head.contains("/"), F.when(folder == "", F.lit("/")).otherwise(folder))


def hfs_path(path: Column) -> Column:
    return path.contains(":")


def sql_unquote(literal: Column) -> Column:
    """A SQL string literal's value; null where a backslash makes it unsure."""
    return F.when(~literal.contains("\\"), F.replace(strip_quotes(literal), F.lit("''"), F.lit("'")))
