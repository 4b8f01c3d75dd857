"""Source text cut where its nesting allows: lines with the depth at which they begin, whole blocks kept together.

Depth is a running sum of brackets, with strings and comments passed over, or the indentation where a language nests by it. A block is a
line and the deeper ones behind it. All of it is row-local: folds over the tokens and lines of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, newlines, recursive_split

FAR = 1 << 20  # the level of lines that belong to the one before: blank ones, and such inside a string or comment
LIST = 64  # blocks of a list that is appended to
DEEPEST = 12  # deeper lines count as of this level
BLOCKS = "array<struct<t:string,b:int,m:int,u:boolean>>"  # text, level, measure, whether it is a whole block of the level at hand

_SINGLE, _DOUBLE, _BACK = r"'(?:[^'\\\n]|\\.)*+'", r'"(?:[^"\\\n]|\\.)*+"', r"`[^`]*+`"
_SLASHES, _STARS, _HASH = r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)", r"(?<![$\w])#[^\n]*+"
_TRIPLE = r"\"\"\"(?s:.*?)(?:\"\"\"|\z)|'''(?s:.*?)(?:'''|\z)"
# Languages that nest by indentation or by words at its levels, those with # comments, and those where ' opens no string.
INDENTED = ("python", "ruby", "yaml", "lua", "elixir")
HASHED = ("python", "ruby", "bash", "perl", "php", "r", "yaml", "elixir")
NO_SINGLE = ("rust", "haskell", "ocaml", "lisp")
TRIPLED = ("python", "swift", "kotlin", "scala", "dart", "java")


def _tokens(text: Column, language: Column) -> Column:
    """Strings, comments, line breaks and brackets, in order."""
    plain = (_DOUBLE, r"\n", r"[({\[]", r"[)}\]]")

    def pattern(hashed: bool, single: bool, tripled: bool) -> str:
        comments = (_HASH,) if hashed else (_SLASHES, _STARS)
        return "|".join([*([_TRIPLE] if tripled else []), *comments, *([_SINGLE] if single else []), _BACK, *plain])

    lang = F.lower(F.coalesce(language, F.lit("")))
    out = F.regexp_extract_all(text, F.lit(pattern(False, True, False)), F.lit(0))
    for names, given in ((HASHED, (True, True, False)), (TRIPLED, (False, True, True)), (("python",), (True, True, True)), (NO_SINGLE, (False, False, False))):
        out = F.when(lang.isin(*names), F.regexp_extract_all(text, F.lit(pattern(*given)), F.lit(0))).otherwise(out)
    return out


def line_levels(text: Column, language: Column) -> Column:
    """array<int>: the level at which each line begins; FAR where it belongs to the line before."""
    state = lambda depth, full, levels: F.struct(depth.alias("depth"), full.alias("full"), levels.alias("levels"))
    put = lambda a, more: F.when(F.size(a["levels"]) < LIST, state(a["depth"], a["full"], F.concat(a["levels"], more))).otherwise(state(a["depth"], F.array_append(a["full"], a["levels"]), more))

    def step(a: Column, token: Column) -> Column:
        return (
            F.when(token == "\n", put(a, F.array(a["depth"])))
            .when(token.isin("(", "[", "{"), state(a["depth"] + 1, a["full"], a["levels"]))
            .when(token.isin(")", "]", "}"), state(F.greatest(a["depth"] - 1, F.lit(0)), a["full"], a["levels"]))
            .when(newlines(token) > 0, put(a, F.array_repeat(F.lit(FAR), newlines(token))))
            .otherwise(a)
        )

    begun = state(F.lit(0), F.array().cast("array<array<int>>"), F.array(F.lit(0)))
    depths = F.aggregate(_tokens(text, language), begun, step, lambda a: F.flatten(F.array_append(a["full"], a["levels"])))
    indented = F.lower(F.coalesce(language, F.lit(""))).isin(*INDENTED)
    indent = lambda line: F.length(F.regexp_extract(line, r"^\n?([ \t]*)", 1))

    def level(line: Column, depth: Column) -> Column:
        own = F.when(indented, F.when(depth == 0, F.least(indent(line), F.lit(DEEPEST))).otherwise(F.lit(FAR))).otherwise(F.when(depth == FAR, F.lit(FAR)).otherwise(F.least(depth, F.lit(DEEPEST))))
        return F.when(line.rlike(r"^\s*$"), F.lit(FAR)).otherwise(own).cast("int")

    return F.zip_with(_lines(text), depths, level)


def _lines(text: Column) -> Column:
    """Lines of a text, each but the first beginning with its line break; empty ones too."""
    return F.transform(F.split(text, "\n", -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\n"), p)))


def _grouped(pieces: Column, joins: Callable[[Column, Column, Column], Column], close: Callable[[Column, Column], Column], alone: Callable[[Column], Column]) -> Column:
    """BLOCKS of runs of pieces: joins(first of the run, its measure so far, piece) tells what goes on a run, close(run, its measure) what it becomes, alone(piece) what a run of one does.

    What is done is kept in lists of lists, as appending copies a list.
    """

    def fold(all_: Column) -> Column:
        state = lambda full, out, first, next_, m: F.struct(full.alias("full"), out.alias("out"), first.alias("first"), next_.alias("next"), m.alias("m"))
        none = F.array().cast(BLOCKS)
        one = lambda a: F.array_append(a["out"], alone(F.get(all_, a["first"])))
        run = lambda a: F.concat(a["out"], close(F.slice(all_, a["first"] + 1, a["next"] - a["first"]), a["m"]))
        done = lambda a: F.when(a["next"] - a["first"] == 1, one(a)).otherwise(run(a))
        begun = state(F.array().cast(f"array<{BLOCKS}>"), none, F.lit(0), F.lit(1), F.get(all_, F.lit(0))["m"])
        closed = lambda a, p: F.when(F.size(a["out"]) < LIST, state(a["full"], done(a), a["next"], a["next"] + 1, p["m"])).otherwise(state(F.array_append(a["full"], done(a)), none, a["next"], a["next"] + 1, p["m"]))
        step = lambda a, p: F.when(joins(F.get(all_, a["first"]), a["m"], p), state(a["full"], a["out"], a["first"], a["next"] + 1, a["m"] + p["m"])).otherwise(closed(a, p))
        return F.aggregate(F.slice(all_, F.lit(2), F.size(all_)), begun, step, lambda a: F.flatten(F.array_append(a["full"], done(a))))

    return let(pieces, lambda x: F.when(F.size(x) < 1, F.array().cast(BLOCKS)).otherwise(fold(x)))


def _block(run: Column, level: Column, m: Column, whole: Column) -> Column:
    return F.struct(F.array_join(F.transform(run, lambda p: p["t"]), "").alias("t"), level.cast("int").alias("b"), m.cast("int").alias("m"), whole.alias("u"))


def nested_split(text: Column, language: Column, separators: Column, size: int, measure: Callable[[Column], Column]) -> Column:
    """Pieces of text that measure at most `size`, cut between blocks: a block that fits is in one piece.

    Blocks of the least level that fit are made first. From the deepest level up, a line and the deeper ones behind it become one block if they fit, and neighbouring blocks are joined from
    the left as long as they do; what leads a block that doesn't fit goes with what follows it. A line that doesn't fit is cut along
    `separators`. Pieces put together are text.
    """
    no = F.lit(False)
    lines = F.zip_with(_lines(text), line_levels(text, language), lambda t, b: F.struct(t.alias("t"), b.alias("b"), measure(t).cast("int").alias("m"), no.alias("u")))
    one = lambda level, whole: lambda run, m: F.array(_block(run, level(run), m, whole)).cast(BLOCKS)
    own = lambda run: F.get(run, F.lit(0))["b"]
    same = lambda p: p

    def outer(x: Column) -> Column:
        """Blocks of the least level that fit are one at once: whatever is joined inside them, they would be in the end."""
        fits = lambda run, m: F.when(m <= size, F.array(_block(run, own(run), m, no))).otherwise(run).cast(BLOCKS)
        return let(F.array_min(F.transform(x, lambda p: p["b"])), lambda least: _grouped(x, lambda first, m, p: (first["b"] == least) & (p["b"] > least), fits, same))

    begun = _grouped(let(lines, outer), lambda first, m, p: (p["b"] == FAR) & (m + p["m"] <= size), one(own, no), same)

    def up(pieces: Column, level: Column) -> Column:
        apart = lambda run: F.transform(run, lambda p: F.struct(p["t"].alias("t"), p["b"].alias("b"), p["m"].alias("m"), no.alias("u")))
        close = lambda run, m: F.when((own(run) == level) & (m <= size), F.array(_block(run, level, m, F.lit(True)))).otherwise(apart(run)).cast(BLOCKS)
        alone = lambda p: F.struct(p["t"].alias("t"), p["b"].alias("b"), p["m"].alias("m"), ((p["b"] == level) & (p["m"] <= size)).alias("u"))
        deeper = lambda x: _grouped(x, lambda first, m, p: (first["b"] == level) & (p["b"] > level), close, alone)
        blocks = F.when(F.exists(pieces, lambda p: p["b"] > level), deeper(pieces)).otherwise(F.transform(pieces, alone).cast(BLOCKS))
        return _grouped(blocks, lambda first, m, p: p["u"] & (first["u"] | (first["b"] < level)) & (m + p["m"] <= size), lambda run, m: F.array(_block(run, own(run), m, F.get(run, F.lit(0))["u"])).cast(BLOCKS), same)

    def whole(pieces: Column) -> Column:
        levels = F.reverse(F.array_sort(F.array_distinct(F.transform(F.filter(pieces, lambda p: p["b"] < FAR), lambda p: p["b"]))))
        return F.aggregate(levels, pieces, up)

    cut = lambda p: F.when(p["m"] <= size, F.array(p["t"])).otherwise(recursive_split(p["t"], separators, size, measure))
    return F.filter(F.flatten(F.transform(let(begun, whole), cut)), lambda t: t != "")
