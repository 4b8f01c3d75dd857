"""Files to chunks: size-bounded, line-numbered pieces along language-aware separators. Row-local, no Python, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import grammar_supported, language_for_path
from ..functions.nesting import nested_split
from ..functions.separators import CHAINS, KEY_OF, chain_for
from ..functions.text import let, line_count, newlines, nonwhite_bytes, recursive_split, suffix


@dataclass(frozen=True)
class Sizes:
    """Bytes a chunk: for files with a grammar (white space not counted), and for the others."""

    syntax_size: int = 2500
    syntax_overlap: int = 300
    size: int = 1000
    overlap: int = 200


def separators_of(language: Column) -> Column:
    """The chain of a language id in any case; the default chain if it is unknown or null."""
    out = F.lit(CHAINS[""])
    for key, chain in CHAINS.items():
        names = [a for a, k in KEY_OF.items() if k == key]
        if names:
            out = F.when(F.lower(language).isin(*names), F.lit(chain)).otherwise(out)
    return out


def _chain(language: Column | str | None) -> Column:
    return separators_of(language) if isinstance(language, Column) else F.lit(chain_for(language))


def numbered(pieces: Column) -> Column:
    """Pieces that make up a text, with the lines on which they start and end.

    A line break at the very start of a piece counts as passed, one at its end opens the next line.
    """
    start = F.struct(F.array().cast("array<struct<content:string,start_line:int,end_line:int>>").alias("out"), F.lit(1).alias("line"))
    step = lambda a, p: F.struct(
        F.array_append(a["out"], F.struct(p.alias("content"), (a["line"] + p.startswith("\n").cast("int")).alias("start_line"), (a["line"] + newlines(p)).alias("end_line"))).alias("out"),
        (a["line"] + newlines(p)).alias("line"),
    )
    return F.aggregate(pieces, start, step, lambda a: a["out"])


def add_overlap(chunks: Column, overlap: int) -> Column:
    """Each chunk but the first begins with the end of the one before as it was, and a line break."""
    if overlap <= 0:
        return chunks

    def one(c: Column, i: Column, whole: Column) -> Column:
        before = suffix(F.get(whole, i - 1)["content"], overlap)
        return F.when(i == 0, c).otherwise(
            let(before, lambda b: F.struct(F.concat(b, F.lit("\n"), c["content"]).alias("content"), F.greatest(F.lit(1), c["start_line"] - line_count(b)).alias("start_line"), c["end_line"].alias("end_line")))
        )

    return let(chunks, lambda whole: F.transform(whole, lambda c, i: one(c, i, whole)))


def split_text(text: Column, language: Column | str | None = None, size: int = 1000, overlap: int = 200) -> Column:
    """array<struct<content, start_line, end_line>> by the recursive splitter; empty for null and empty texts."""
    pieces = let(_chain(language), lambda s: recursive_split(text, s, size))
    return add_overlap(numbered(pieces), overlap)


SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))  # the same, listed


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def syntax_chunks(text: Column, language: Column | str, sizes: Sizes, nesting: bool = True) -> Column:
    """Chunks of a file that has a grammar.

    A file within the budget is one trimmed chunk: no tree is needed. A larger one is cut between its blocks, by the depth of
    brackets or indentation, and merged up to the budget, by bytes other than white space (`nested_split`); without `nesting` at the
    declarations that its language's chain names. A syntax tree would cut at nodes, so these boundaries are approximate.
    """
    body = trimmed(F.coalesce(text, F.lit("")))
    lead = newlines(F.regexp_extract(F.coalesce(text, F.lit("")), f"^[{SPACE}]*", 0))
    whole = F.array(F.struct(body.alias("content"), (lead + 1).alias("start_line"), (lead + 1 + newlines(body)).alias("end_line")))
    named = language if isinstance(language, Column) else F.lit(language)
    if nesting:
        pieces = numbered(let(_chain(language), lambda s: nested_split(F.coalesce(text, F.lit("")), named, s, sizes.syntax_size, nonwhite_bytes)))
    else:
        pieces = numbered(let(_chain(language), lambda s: recursive_split(text, s, sizes.syntax_size, nonwhite_bytes)))
    lead_of = lambda c: newlines(F.regexp_extract(c["content"], f"^[{SPACE}]*", 0)) - c["content"].startswith("\n").cast("int")
    one = lambda c: let(F.struct(trimmed(c["content"]).alias("t"), (c["start_line"] + lead_of(c)).alias("line")), lambda x: F.struct(x["t"].alias("content"), x["line"].alias("start_line"), (x["line"] + newlines(x["t"])).alias("end_line")))
    cut = F.filter(F.transform(pieces, one), lambda c: c["content"] != "")
    return F.when(body == "", F.array().cast("array<struct<content:string,start_line:int,end_line:int>>")).when(nonwhite_bytes(text) <= sizes.syntax_size, whole).otherwise(add_overlap(cut, sizes.syntax_overlap))


def chunk_files(files: DataFrame, path: str = "path", content: str = "content", kind: Column | None = None, sizes: Sizes = Sizes(), language: str | None = None, nesting: bool = True) -> DataFrame:
    """files with language, strategy and chunks (array of content, start_line, end_line).

    kind "langchain" (any case, blanks around it ignored) asks for the recursive splitter; else files
    with a grammar have strategy ast, all others fallback. Null and empty contents have no chunks.
    `language` fixes the language of all rows and keeps the plan small; `nesting` as in `syntax_chunks`.
    Columns named like a result are replaced.
    """
    kept = [c for c in files.columns if c not in ("language", "strategy", "chunks")]
    rows = files.select(*kept, (F.lit(language) if language else language_for_path(F.col(path))).alias("language"))
    asked = F.coalesce(F.lower(F.trim(kind)) == "langchain", F.lit(False)) if kind is not None else F.lit(False)
    rows = rows.withColumn("strategy", F.when(asked, F.lit("langchain")).when(grammar_supported(F.col("language")), F.lit("ast")).otherwise(F.lit("fallback")))
    lang = language or F.col("language")
    plain = split_text(F.col(content), lang, sizes.size, sizes.overlap)
    return rows.withColumn("chunks", F.when(F.col("strategy") == "ast", syntax_chunks(F.col(content), lang, sizes, nesting)).otherwise(plain))


def chunk_rows(chunked: DataFrame, *keys: str) -> DataFrame:
    """A row for each chunk: keys, language, strategy, chunk_index, content, start_line, end_line."""
    # An inner explode would have Spark work the chunks out twice, for a filter on their number first.
    rows = chunked.select(*keys, "language", "strategy", F.posexplode_outer("chunks").alias("chunk_index", "_c")).where("_c is not null")
    return rows.select(*keys, "language", "strategy", "chunk_index", "_c.content", "_c.start_line", "_c.end_line")
