"""Scalar and array functions of the splitter, all as Catalyst expressions. Sizes are UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\v"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row, however often body's own functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def line_count(text: Column) -> Column:
    """0 for the empty text, else newlines and one."""
    return F.when(text == "", F.lit(0)).otherwise(newlines(text) + 1)


def nonwhite_bytes(text: Column) -> Column:
    """Bytes other than space, tab, newline, carriage return, form feed and vertical tab."""
    return F.octet_length(F.translate(text, WHITE, "")).cast("int")


def align_up(text: Column, offset: Column) -> Column:
    """The least start of a character at or behind a byte offset; the size in bytes beyond the end."""
    at = _inside(text, offset)
    ahead = F.hex(F.substring(text.cast("binary"), at + 1, F.lit(3)))
    return (at + F.length(F.regexp_extract(ahead, "^((?:[89AB][0-9A-F])*)", 1)) / 2).cast("int")


def align_down(text: Column, offset: Column) -> Column:
    """The largest start of a character at or before a byte offset; the size in bytes beyond the end."""
    at = _inside(text, offset)
    back = F.hex(F.substring(text.cast("binary"), F.greatest(at - 2, F.lit(1)), F.least(at + 1, F.lit(4))))
    return F.when(at == F.octet_length(text), at).otherwise(at - F.length(F.regexp_extract(back, "((?:[89AB][0-9A-F])*)$", 1)) / 2).cast("int")


def _inside(text: Column, offset: Column) -> Column:
    return F.least(F.greatest(offset, F.lit(0)), F.octet_length(text))


def suffix(text: Column, limit: int) -> Column:
    """The longest end of text of at most `limit` bytes that starts with a whole character."""
    tail = F.hex(F.substring(text.cast("binary"), F.octet_length(text) - limit + 1, F.lit(limit)))
    whole = F.decode(F.unhex(F.regexp_replace(tail, "^(?:[89AB][0-9A-F])+", "")), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).when(F.lit(limit <= 0), F.lit("")).otherwise(whole)


def split_keep(text: Column, separator: Column) -> Column:
    """Pieces of text, each but the first beginning with its separator; characters for the empty separator. No empty pieces."""
    parts = F.when(separator == "", F.split(text, "")).otherwise(
        F.transform(F.split(text, F.concat(F.lit(r"\Q"), separator, F.lit(r"\E")), -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(separator, p)))
    )
    return F.filter(parts, lambda p: p != "")


def merge_adjacent(pieces: Column, size: int, measure: Callable[[Column], Column] = F.octet_length) -> Column:
    """Neighbours joined from the left as long as they measure at most `size`. Measures add up."""
    measured = F.transform(pieces, lambda t: F.struct(t.alias("t"), F.lit(0).alias("b"), measure(t).cast("int").alias("m")))
    return F.transform(_joined(measured, F.lit(0), size), lambda p: p["t"])


def _bytes(text: Column) -> Column:
    """A text of one character for each byte of text, as patterns count characters."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def _of_bytes(text: Column) -> Column:
    """The text that `_bytes` was given."""
    return F.encode(text, "ISO-8859-1").cast("string")


def hard_split(text: Column, size: int) -> Column:
    """Pieces of at most `size` bytes, as long as whole characters allow; a longer character is a piece of its own."""
    pattern = rf"(?s).{{1,{max(size, 1)}}}(?![\x80-\xBF])|.[\x80-\xBF]+"
    return F.transform(F.regexp_extract_all(_bytes(text), F.lit(pattern), F.lit(0)), _of_bytes)


PIECES = "array<struct<t:string,b:int,m:int>>"  # text, level of the separator that it begins with, measure


def _joined(pieces: Column, level: Column, size: int) -> Column:
    """PIECES, where neighbours of this level or a later one are joined as long as they measure at most `size`.

    The fold carries places and sums; a text is put together once, when it is complete.
    """

    def fold(all_: Column) -> Column:
        state = lambda out, first, next_, m, b: F.struct(out.alias("out"), first.alias("first"), next_.alias("next"), m.alias("m"), b.alias("b"))
        text = lambda a: F.array_join(F.transform(F.slice(all_, a["first"] + 1, a["next"] - a["first"]), lambda p: p["t"]), "")
        done = lambda a: F.array_append(a["out"], F.struct(text(a).alias("t"), a["b"].alias("b"), a["m"].alias("m")))
        step = lambda a, p: F.when((a["next"] > 0) & ((p["b"] < level) | (a["m"] + p["m"] > size)), state(done(a), a["next"], a["next"] + 1, p["m"], p["b"])).otherwise(
            state(a["out"], a["first"], a["next"] + 1, a["m"] + p["m"], F.when(a["next"] > 0, a["b"]).otherwise(p["b"]))
        )
        zero = F.lit(0)
        return F.aggregate(all_, state(F.array().cast(PIECES), zero, zero, zero, F.lit(-1)), step, done)

    return let(pieces, lambda x: F.when((F.size(x) < 2) | ~F.exists(x, lambda p: p["b"] >= level), x).otherwise(fold(x)))


SHORTEST = 8  # sizes below it are cut piece by piece


def _packed(text: Column, separator: Column, next_: Column, size: int) -> Column:
    """Pieces of a text of more than `size` bytes as `split_keep` and `_joined` would give them, cut and joined by one pattern; not joined where it can't be told.

    Pieces begin at a separator of one byte, so a joined one is the longest run of at most `size` bytes in front of a separator or the
    end. A piece that is too large for that is cut between characters, if those are next in the chain: its first part is joined to up to
    three bytes before it (a character's) if it leaves room for them, its last one to what follows. Other large pieces, and longer
    separators, are left to the fold.
    """
    quoted = F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))
    filled = lambda form: F.replace(F.lit(form), F.lit("<sep>"), quoted)
    characters = rf".{{1,{size}}}(?![\x80-\xBF])"
    whole = rf".{{1,{size}}}(?=<sep>|\z)"
    room = "|".join(rf".{{{j}}}(?=<sep>[^<sep>]{{{size - j}}}[\x80-\xBF]{{{j}}}).{{1,{size - j}}}(?![\x80-\xBF])" for j in (1, 2, 3))
    large = filled(rf"(?s)(?:\A[^<sep>]|<sep>)[^<sep>]{{{size}}}")

    def found(t: Column) -> Column:
        cut = lambda form: F.transform(F.regexp_extract_all(t, form, F.lit(0)), _of_bytes)
        return (
            F.when(separator == "", cut(F.lit(f"(?s){characters}")))
            .when((F.octet_length(separator) == 1) & (next_ == ""), cut(filled(f"(?s){room}|{whole}|{characters}")))
            .when((F.octet_length(separator) == 1) & ~F.regexp_like(t, large), cut(filled(f"(?s){whole}")))
            .otherwise(split_keep(text, separator))
        )

    return let(_bytes(text), found)


def recursive_split(text: Column, separators: Column, size: int, measure: Callable[[Column], Column] = F.octet_length) -> Column:
    """Pieces of text of at most `size`, cut at the earliest separator of the chain that does, and merged again.

    Down the chain, pieces that are too large are cut; a piece remembers the place in the chain of the
    separator that it begins with, and its measure. Up again, neighbours are merged that no earlier
    separator parts. Both are folds over the chain, so the plan has the same size for any chain. Pieces
    put together are text.
    """
    piece = lambda t, b: F.struct(t.alias("t"), b.alias("b"), measure(t).cast("int").alias("m"))
    native = measure is F.octet_length and size >= SHORTEST

    def cut(pieces: Column, i: Column) -> Column:
        split = lambda t: _packed(t, F.get(separators, i), F.get(separators, i + 1), size) if native else split_keep(t, F.get(separators, i))
        parts = lambda p: F.transform(split(p["t"]), lambda x, j: piece(x, F.when(j == 0, p["b"]).otherwise(i)))
        large = F.flatten(F.transform(pieces, lambda p: F.when(p["m"] <= size, F.array(p)).otherwise(parts(p)))).cast(PIECES)
        return F.when(F.exists(pieces, lambda p: p["m"] > size), large).otherwise(pieces)

    whole = F.array(piece(F.coalesce(text, F.lit("")), F.lit(-1))).cast(PIECES)
    down = F.aggregate(F.sequence(F.lit(0), F.size(separators) - 1), whole, cut)
    up = F.aggregate(F.sequence(F.size(separators) - 1, F.lit(0), F.lit(-1)), down, lambda x, i: _joined(x, i, size))
    return F.filter(F.transform(up, lambda p: p["t"]), lambda t: t != "")
