"""Lookups: language of a path, languages with a syntax tree, kind of a command."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension (the extension's case counts).
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".cpp": "cpp", ".c": "c",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".m": "objective-c", ".mm": "objective-c", ".dart": "dart", ".sol": "solidity", ".ipynb": "jupyter", ".md": "markdown",
    ".markdown": "markdown", ".tex": "latex", ".sh": "bash", ".bash": "bash", ".json": "json", ".awk": "awk", ".pl": "perl", ".pm": "perl",
    ".css": "css", ".html": "html", ".htm": "html", ".kts": "kotlin",
}

# Languages and aliases that have a grammar.
GRAMMARS = ("javascript", "js", "typescript", "ts", "python", "py", "java", "cpp", "c++", "c", "go", "rust", "rs", "scala", "csharp", "cs", "php",
            "php_only", "ruby", "bash", "json", "html", "css", "kotlin", "objective-c", "dart", "swift", "awk", "perl")

# Programs by kind.
KINDS = {
    "nav": "cd pushd popd",
    "search": "grep egrep fgrep rg ag ack",
    "read": "cat less more head tail cut sort uniq wc nl find awk gawk sed jq",
    "write": "tee dd cp mv rm touch mkdir patch",
    "vcs": "git",
    "network": "ssh scp rsync curl wget",
    "interpreter": "python python3 perl node ruby osascript sqlite3 bash sh zsh",
    "build": "make cargo go",
    "pkg": "apt apt-get brew npm pip pip3",
    "wrapper": "env sudo nice timeout xargs nohup parallel",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def language_for_path(path: Column) -> Column:
    """Language of the last extension of the last path element; text where it is unknown, null or missing."""
    return F.coalesce(F.try_element_at(literal_map(EXTENSIONS), F.regexp_extract(path, r"(\.[^./]*)$", 1)), F.lit("text"))


def grammar_supported(language: Column) -> Column:
    """Whether a language id, in any case, has a grammar; null counts as none."""
    return F.coalesce(F.lower(language).isin(*GRAMMARS), F.lit(False))


def command_kind(program: Column) -> Column:
    """Kind of a program by its base name; unknown if it is not listed."""
    return F.coalesce(F.try_element_at(literal_map(KIND_OF), program), F.lit("unknown"))
