"""One pass over a command line: its simple commands with their words, redirections, heredoc bodies, subshells and pipelines.

A fold over the line's tokens with a stack of open groups and a queue of heredocs that wait for the end of their line. Compound
commands leave only what they run; a line that a shell would not accept is broken and has no commands. Places are bytes of the line as it
is written, heredoc bodies included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 1 << 30


def _balanced(depth: int = 6) -> str:
    """What may stand between two parentheses."""
    quoted = r"""\\.|'[^']*+'|"(?:[^"\\]|\\.)*+\""""
    inside = rf"(?:[^()'\"\\]|{quoted})*+"
    for _ in range(depth):
        inside = rf"(?:[^()'\"\\]|{quoted}|\({inside}\))*+"
    return inside


_IN = _balanced()
TOKEN = re.compile("|".join((
    r"(?P<blank>[ \t\r]++|\\\r?\n)",
    rf"(?P<process>[<>]\({_IN}\))",
    r"(?P<redirect>[0-9]*+&>>|[0-9]*+(?:<<<|<<-?|>>|>&|<&|&>|>\||<>|<|>)(?:(?<=&)[0-9]++(?=[\s;|&)]|$)|(?<=&)-(?=[\s;|&)]|$))?)",
    r"(?P<operator>&&|\|\||;;&|;;|;&|\|&|[;|&\n()])",
    rf"""(?P<word>(?:\$'(?:[^'\\]|\\.)*+'|'[^']*+'|"(?:\\.|\$\({_IN}\)|[^"\\])*+"|\$\({_IN}\)|`(?:\\.|[^`\\])*+`|\$\{{[^}}]*+\}}|\\[^\n]|[^\s;|&<>()'"`\\])++)""",
    r"(?P<other>.)",
)), re.S)
ARITHMETIC = re.compile(rf"\(\({_IN}\)\)", re.S)
PARENTHESES = re.compile(r"[ \t]*\([ \t]*\)")

# The words that open and close compound commands, and those in between.
OPENS = {"if": "fi", "while": "done", "until": "done", "for": "done", "select": "done", "case": "esac", "{": "}"}
WITHIN = {"then": "fi", "elif": "fi", "else": "fi", "do": "done"}
PREFIXES = frozenset(("!", "time"))
CLOSES = frozenset(OPENS.values())


@dataclass
class Frame:
    """An open group: the word that closes it, where it began, its scope, and the pipeline that is being read in it."""

    closer: str
    pos: int = 0
    scope: int = 0
    pipes: int = 0
    begin: int | None = None
    members: list = field(default_factory=list)
    filled: bool = False  # whether something runs in it, since its last control word
    ready: bool = False  # whether its then or do has come
    header: bool = False  # whether names stand in front of its do, and no commands


class Line:
    """The state of the fold. `expects` is what the next word may be: a command, a header up to `until`, or the patterns of a case."""

    def __init__(self, text: str):
        self.text, self.commands, self.broken = text, [], False
        self.frames, self.scopes, self.closes = [Frame("")], 0, {0: FAR}
        self.now: dict | None = None  # the command being read
        self.first, self.until, self.patterns = True, None, False
        self.waiting: list[tuple[dict, str, bool]] = []
        self.target = False  # whether a redirection waits for its word
        self.group = False  # whether a group has just ended: only redirections and control words follow it
        self.joint = ""  # the operator that a command must follow yet, or () for a function's body
        self.last = 0  # end byte of the last token of the pipeline
        self.run()

    def run(self) -> None:
        text, at, byte = self.text, 0, 0
        while at < len(text) and not self.broken:
            m = TOKEN.match(text, at)
            end, kind = m.end(), m.lastgroup
            if kind == "word" and text[at] == "#" and not self.target:
                end, kind = (found if (found := text.find("\n", at)) >= 0 else len(text)), "blank"
            elif kind == "operator" and text[at] == "(" and self.first and not self.patterns and (skipped := ARITHMETIC.match(text, at)):
                end, kind, self.first = skipped.end(), "blank", self.until is not None
                self.group = self.until is None
                self.fill()
            size = len(text[at:end].encode("utf-8", "surrogatepass"))
            if kind == "operator":
                self.operator(m[0], byte, byte + size)
                if m[0] == "\n" and self.waiting:
                    end = self.bodies(end)
                    size = len(text[at:end].encode("utf-8", "surrogatepass"))
            elif kind == "word":
                end = self.word(m[0], end, byte, byte + size)
                size = len(text[at:end].encode("utf-8", "surrogatepass"))
            elif kind == "redirect":
                self.redirect(m[0], byte, byte + size)
            elif kind == "process":
                self.broken |= self.group and not self.target
                self.put(m[0], "target" if self.target else "word", byte, byte + size)
                self.target = self.first = False
            elif kind == "other":
                self.broken = True
            at, byte = end, byte + size
        self.finish()
        self.broken |= len(self.frames) > 1 or self.until is not None or bool(self.joint)
        for c in self.commands:
            c["closes"] = self.closes.get(c["scope_id"], FAR)

    # -- commands ------------------------------------------------------------------------------

    def put(self, token: str, role: str, start: int, end: int) -> None:
        """Adds a token to the command being read, or begins one; tokens of headers and patterns belong to none."""
        if self.until or self.patterns:
            return
        frame = self.frames[-1]
        self.broken |= self.joint == "()"  # a function's body is a group
        self.fill()
        if self.now is None:
            self.now = self.command(start, start, end, frame.scope, frame.pipes)
            frame.members.append(self.now)
            if frame.begin is None:
                frame.begin = start
        self.now["tokens"].append({"pos": start, "token": token, "role": role, "start_byte": start, "end_byte": end})
        self.now["end_byte"] = max(self.now["end_byte"], end)
        self.last = end

    def fill(self) -> None:
        self.frames[-1].filled, self.joint = True, ""

    def command(self, pos: int, start: int, end: int, scope: int, stage: int) -> dict:
        made = {"command": len(self.commands), "pos": pos, "start_byte": start, "end_byte": end, "scope_id": scope, "closes": FAR, "stage": stage, "pipeline_start": 0, "pipeline_end": 0, "tokens": [], "bodies": []}
        self.commands.append(made)
        return made

    def finish(self) -> None:
        """Ends a pipeline: its commands get its bytes."""
        frame = self.frames[-1]
        for c in frame.members if frame.pipes else ():
            c["pipeline_start"], c["pipeline_end"] = frame.begin or 0, self.last
        frame.pipes, frame.begin, frame.members = 0, None, []
        self.now = None

    def redirect(self, token: str, start: int, end: int) -> None:
        self.put(token, "redirect", start, end)
        self.first, self.target = False, not token[-1].isdigit() and not token.endswith("&-")

    def operator(self, token: str, start: int, end: int) -> None:
        self.target = False
        if self.until == "]]":
            return
        if self.patterns:
            if token == ")":
                self.patterns, self.first = False, True
            return
        if self.until in ("in", "fi", "esac"):
            self.broken = token not in ("\n",)
            return
        if token in (";", "&", "&&", "||", "|", "|&"):
            self.broken = self.until is None and self.first
            self.joint = token if token not in (";", "&") else ""
        self.until, self.group = None, False
        if token == "(":
            if not self.first:
                self.broken = True
                return
            self.scopes += 1
            self.open(Frame(")", start, self.scopes))
        elif token == ")":
            self.close(")", start, end)
        elif token in (";;", ";&", ";;&"):
            self.finish()
            self.patterns = self.frames[-1].closer == "esac"
            self.broken = not self.patterns
        elif token in ("|", "|&"):
            self.now, self.first = None, True
            self.frames[-1].pipes += 1
        else:
            self.finish()
            self.first = True

    # -- groups --------------------------------------------------------------------------------

    def open(self, frame: Frame) -> None:
        outer = self.frames[-1]
        if outer.begin is None:
            outer.begin = frame.pos
        if frame.closer != ")":
            frame.scope = outer.scope
        self.now, self.first, self.joint = None, True, ""
        self.frames.append(frame)

    def close(self, closer: str, start: int, end: int) -> None:
        """Ends a group; redirections behind it are read where the group began, outside it."""
        self.finish()
        frame = self.frames[-1]
        if frame.closer != closer or self.joint or not (frame.filled or closer == "esac") or not (frame.ready or closer not in ("fi", "done")):
            self.broken = True
            return
        self.frames.pop()
        self.group = True
        self.fill()
        if closer == ")":
            self.closes[frame.scope] = start
        outer = self.frames[-1]
        self.now, self.first, self.last = self.command(frame.pos, start, end, outer.scope, outer.pipes), False, end
        outer.members.append(self.now)

    def word(self, token: str, end: int, start: int, stop: int) -> int:
        """Takes a word; returns where to read on."""
        if self.target:
            self.put(token, "target", start, stop)
            self.target = False
            if self.now and len(self.now["tokens"]) > 1 and (op := self.now["tokens"][-2]["token"].lstrip("0123456789")) in ("<<", "<<-"):
                self.waiting.append((self.now, re.sub(r"['\"\\]", "", token), op == "<<-"))
            return end
        if self.patterns:
            if token == "esac":
                self.patterns = False
                self.close("esac", start, stop)
            return end
        if self.until:
            if token == self.until and token != "do":
                self.patterns, self.group, self.until = token == "in", token == "]]", None
                self.first = False
                self.fill()
            elif self.until == "do" and token == "do":
                self.until, self.first = None, True
                self.frames[-1].ready, self.frames[-1].filled = True, False
            return end
        if self.first or (self.group and (token in CLOSES or token in WITHIN)):
            self.group = False
            return self.leading(token, end, start, stop)
        self.broken |= self.group
        self.put(token, "word", start, stop)
        return end

    def leading(self, token: str, end: int, start: int, stop: int) -> int:
        """Takes the first word of a command: a control word, a function's name, a test, or the command itself."""
        if token in OPENS:
            self.open(Frame(OPENS[token], start, header=token in ("for", "select")))
            self.until = {"for": "do", "select": "do", "case": "in"}.get(token)
        elif token in WITHIN:
            self.finish()
            frame, self.first = self.frames[-1], True
            self.broken = frame.closer != WITHIN[token] or bool(self.joint) or not (frame.filled or token == "do" and not frame.ready and frame.header)
            frame.ready, frame.filled = token != "elif", False
        elif token in CLOSES:
            self.close(token, start, stop)
        elif token in PREFIXES:
            self.broken = token == "!" and self.joint in ("|", "|&") or self.joint == "()"
            self.joint = self.joint if token == "!" else ""
            self.frames[-1].begin = start if self.frames[-1].begin is None else self.frames[-1].begin
        elif token in ("[[", "["):
            self.until, self.first = "]]" if token == "[[" else "]", False
        elif token == "function" and (m := re.compile(r"[ \t]+[^\s(){};|&<>]+(?:[ \t]*\([ \t]*\))?").match(self.text, end)):
            self.joint = "()"
            return m.end()
        elif m := PARENTHESES.match(self.text, end):
            self.joint = "()"
            return m.end()
        else:
            self.first = False
            self.put(token, "word", start, stop)
        return end

    def bodies(self, at: int) -> int:
        """Reads the bodies of the heredocs that wait; returns where the line behind the last one's end begins."""
        for command, delimiter, tabs in self.waiting:
            begin = at
            while at < len(self.text):
                stop = found if (found := self.text.find("\n", at)) >= 0 else len(self.text)
                line = self.text[at:stop]
                if (line.lstrip("\t") if tabs else line) == delimiter:
                    command["bodies"].append(self.text[begin : max(begin, at - 1)])
                    at = min(stop + 1, len(self.text))
                    break
                at = min(stop + 1, len(self.text))
            else:
                command["bodies"].append(self.text[begin:at])
        self.waiting = []
        return at


INT, TEXT = pa.int32(), pa.string()
_TOKENS = pa.list_(pa.struct([("pos", INT), ("token", TEXT), ("role", TEXT), ("start_byte", INT), ("end_byte", INT)]))
_PLACES = ("command", "pos", "start_byte", "end_byte", "scope_id", "closes", "stage", "pipeline_start", "pipeline_end")
_SCANNED = pa.struct([("broken", pa.bool_()), ("commands", pa.list_(pa.struct([*[(x, INT) for x in _PLACES], ("tokens", _TOKENS), ("bodies", pa.list_(TEXT))])))])
SCANNED = (
    "struct<broken boolean, commands array<struct<" + ", ".join(f"{x} int" for x in _PLACES) + ", tokens array<struct<pos int, token string, role string, start_byte int, end_byte int>>, bodies array<string>>>>"
)


def read(text: str | None) -> dict:
    """broken, commands of a line; commands without any token are left out. Null and blank lines are broken: nothing can be said of them."""
    if text is None or not text.strip():
        return {"broken": True, "commands": []}
    line = Line(text)
    return {"broken": line.broken, "commands": [] if line.broken else [c for c in line.commands if c["tokens"]]}


def _scanned(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in lines:
        yield pa.array([read(x.as_py()) for x in batch], _SCANNED)


def scan(line: Column) -> Column:
    """`read` of each line: SCANNED."""
    return F.arrow_udf(_scanned, SCANNED)(line)
