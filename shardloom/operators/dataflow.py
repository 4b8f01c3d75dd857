"""Files that python programs read and write through names: bindings, arguments, and directories that a program walks.

Each program gives facts once, in its own row: what names are bound to, which names a value comes from, and what is opened. What they
amount to is worked out by row-local expressions: the last binding of a name, and a fixpoint that carries walked directories along
assignments, loops and comprehensions until nothing is added. What can't be told is not reported.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import resolve_path
from ..functions.text import let

# Names of the standard library that open, walk, pass on or run something.
READS = frozenset(("read_text", "read_bytes", "read", "readline", "readlines"))
WRITES = frozenset(("write_text", "write_bytes"))
WALKS = frozenset(("rglob", "glob", "iterdir", "walk"))
OS_WALKS = frozenset(("walk", "fwalk", "scandir", "listdir"))
GLOBS = frozenset(("glob", "iglob"))
PASSES_ON = frozenset(("sorted", "list", "reversed", "set", "frozenset", "tuple", "iter", "enumerate"))
RUNS = frozenset(("run", "call", "check_call", "check_output", "Popen"))

STRING = re.compile(r"""[rbuRBUfF]{0,2}('{3}|"{3}|'|")(.*)\1\Z""", re.S)


class Facts:
    """What one program says. An origin is (kind, value): literal, dir (a directory as it is), argv (its number), argvs, var or taint (a name)."""

    def __init__(self, text: str):
        self.lines = text.encode().splitlines(keepends=True)
        self.binds, self.edges, self.sinks, self.commands = [], [], [], []
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.Assign):
                for target in node.targets[:-1]:
                    self.bind(target, None, node)
                self.bind(node.targets[-1], node.value, node)
            elif isinstance(node, ast.AnnAssign) and node.value:
                self.bind(node.target, node.value, node)
            elif isinstance(node, ast.For | ast.AsyncFor):
                self.flow(node.target, node.iter)
            elif isinstance(node, ast.comprehension):
                self.flow(node.target, node.iter)
            elif isinstance(node, ast.Call):
                self.call(node)
        self.binds.sort(key=lambda b: b[0])

    def source(self, node: ast.expr) -> str:
        rows = self.lines[node.lineno - 1 : node.end_lineno]
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return b"".join(rows).decode()

    def literal(self, node: ast.expr | None) -> str | None:
        """What stands between the quotes of one string without replacements, as it is written."""
        plain = isinstance(node, ast.Constant) and isinstance(node.value, str | bytes)
        if not plain and not (isinstance(node, ast.JoinedStr) and all(isinstance(v, ast.Constant) for v in node.values)):
            return None
        m = STRING.match(self.source(node))
        return m[2] if m and not re.search(rf"(?<!\\)(?:\\\\)*{m[1]}", m[2]) else None

    def path(self, node: ast.expr | None) -> list[tuple[str, str]]:
        """A literal, or arguments of the program."""
        if (text := self.literal(node)) is not None:
            return [("literal", text)]
        if isinstance(node, ast.Subscript) and _dotted(node.value) in ("argv", "sys.argv"):
            if isinstance(node.slice, ast.Slice):
                return [("argvs", "")]
            if isinstance(node.slice, ast.Constant) and type(node.slice.value) is int:
                return [("argv", str(node.slice.value))]
        return []

    def bind(self, target: ast.expr, value: ast.expr | None, at: ast.stmt) -> None:
        if isinstance(target, ast.Name):
            inside = _path_argument(value)
            self.binds.append(((at.lineno, at.col_offset), target.id, next(iter(self.path(inside or value)), None)))
        if value is not None:
            self.flow(target, value)

    def flow(self, target: ast.expr, value: ast.expr) -> None:
        if origins := self.taint(value):
            names = [n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(target) if isinstance(n, ast.Name | ast.Attribute)]
            self.edges += [(name, *origin) for name in names for origin in origins]

    def taint(self, node: ast.expr | None) -> list[tuple[str, str]]:
        """Where the directories come from that an expression's value was found in."""
        if isinstance(node, ast.Name):
            return [("taint", node.id)]
        if isinstance(node, ast.Attribute | ast.Subscript):
            return self.taint(node.value)
        if isinstance(node, ast.List | ast.Set | ast.Tuple):
            return [o for e in node.elts for o in self.taint(e)]
        if isinstance(node, ast.BinOp):
            return self.taint(node.left) + self.taint(node.right)
        if not isinstance(node, ast.Call):
            return []
        first = node.args[0] if node.args else None
        if isinstance(node.func, ast.Name):
            return self.taint(first) if node.func.id in PASSES_ON else []
        if not isinstance(node.func, ast.Attribute):
            return []
        owner, method = _dotted(node.func.value), node.func.attr
        if owner == "os.path" and method == "join":
            return [o for a in node.args for o in self.taint(a)]
        if owner == "glob" and method in GLOBS:
            pattern = self.literal(first)
            return [] if pattern is None else [("dir", _folder(re.split(r"[*?\[]", pattern)[0]) or ".")]
        if owner == "os" and method in OS_WALKS:
            return self.path(first) or ([("var", first.id)] if isinstance(first, ast.Name) else [])
        if method in WALKS:
            receiver = node.func.value
            return [("var", receiver.id)] if isinstance(receiver, ast.Name) else self.path(_path_argument(receiver))
        return []

    # -- what is opened ------------------------------------------------------------------------

    def sink(self, access: str, node: ast.expr | None) -> None:
        """Tries in order, the first that amounts to something counts; a write only counts for a literal or an argument."""
        tries = [self.path(node)]
        if access == "read":
            tries.append([("var", node.id)] if isinstance(node, ast.Name) else [])
            head = node.values[0] if isinstance(node, ast.JoinedStr) and node.values else None
            folder = _folder(head.value) if isinstance(head, ast.Constant) and not self.path(node) else None
            tries += [[("dir", folder)] if folder else [], self.taint(node)]
        if any(tries):
            self.sinks.append((access, self.source(node), [t for t in tries if t]))

    def call(self, node: ast.Call) -> None:
        args = [a for a in node.args if not isinstance(a, ast.Starred)]
        first = args[0] if args else None
        if isinstance(node.func, ast.Name):
            if node.func.id == "open":
                self.opened(first, args, node)
            return
        if not isinstance(node.func, ast.Attribute):
            return
        owner, method, receiver = _dotted(node.func.value), node.func.attr, node.func.value
        inside = _path_argument(receiver)
        if owner == "io" and method == "open":
            self.opened(first, args, node)
        elif owner == "fileinput" and method == "input":
            for entry in first.elts if isinstance(first, ast.List) else [None]:
                if entry is None:
                    self.sinks.append(("read", "", [[("argvs", "")]]))
                else:
                    self.sink("read", entry)
        elif owner == "os" and method == "system":
            self.commands += [c for c in [self.literal(first)] if c]
        elif owner == "subprocess" and method in RUNS:
            words = [self.literal(e) for e in first.elts] if isinstance(first, ast.List) else []
            self.commands += [" ".join(words)] if words and None not in words else []
        elif method in READS:
            self.sink("read", inside or receiver)
        elif method in WRITES and inside is not None:
            self.sink("write", inside)
        elif method == "open":
            writes = bool(re.search("[wax+]", self.literal(first) or ""))
            if inside is not None or not writes:
                self.sink("write" if writes else "read", inside or receiver)

    def opened(self, first: ast.expr | None, args: list, node: ast.Call) -> None:
        named = next((k.value for k in node.keywords if k.arg == "mode"), None)
        mode = self.literal(args[1] if len(args) > 1 else None) or self.literal(named) or ""
        if first is not None:
            self.sink("write" if re.search("[wax+]", mode) else "read", first)


def _dotted(node: ast.expr) -> str:
    """a or a.b, else the empty text."""
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
        return f"{node.value.id}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def _path_argument(node: ast.expr | None) -> ast.expr | None:
    """The first argument of Path(...) or x.Path(...)."""
    if isinstance(node, ast.Call) and "Path" == (node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", "")):
        return node.args[0] if node.args else None
    return None


def _folder(text: str) -> str | None:
    """What is in front of the last slash of a text; None if it has none."""
    head, slash, _ = text.rpartition("/")
    return (head or "/") if slash else None


_ORIGIN = pa.struct([("kind", pa.string()), ("value", pa.string())])
_FACTS = pa.struct([
    ("binds", pa.list_(pa.struct([("name", pa.string()), ("origin", _ORIGIN)]))),
    ("edges", pa.list_(pa.struct([("name", pa.string()), ("origin", _ORIGIN)]))),
    ("sinks", pa.list_(pa.struct([("access", pa.string()), ("raw", pa.string()), ("tries", pa.list_(pa.list_(_ORIGIN)))]))),
    ("commands", pa.list_(pa.string())),
])
_TEXT_ORIGIN = "struct<kind string, value string>"
FACTS = f"struct<binds array<struct<name string, origin {_TEXT_ORIGIN}>>, edges array<struct<name string, origin {_TEXT_ORIGIN}>>, sinks array<struct<access string, raw string, tries array<array<{_TEXT_ORIGIN}>>>>, commands array<string>>"


def read(text: str | None) -> dict:
    """The facts of a program; none of a null one, or one that isn't python."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            facts = Facts(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"binds": [], "edges": [], "sinks": [], "commands": []}
    origin = lambda o: o and {"kind": o[0], "value": o[1]}
    return {
        "binds": [{"name": n, "origin": origin(o)} for _, n, o in facts.binds],
        "edges": [{"name": n, "origin": {"kind": k, "value": v}} for n, k, v in dict.fromkeys(facts.edges)],
        "sinks": [{"access": a, "raw": r, "tries": [[origin(o) for o in t] for t in ts]} for a, r, ts in facts.sinks],
        "commands": facts.commands,
    }


def _facts(programs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Equal programs of a batch are read once."""
    for batch in programs:
        equal = batch.dictionary_encode("encode")
        yield pa.array([read(x) for x in equal.dictionary.to_pylist()], _FACTS).take(equal.indices)


def facts(program: Column) -> Column:
    """`read` of each python program: FACTS."""
    return F.arrow_udf(_facts, FACTS)(program)


def with_facts(programs: DataFrame) -> DataFrame:
    """programs (lang, text) with python_facts: to be written with them, where they are asked for more than once. Other programs have none."""
    return programs.withColumn("python_facts", facts(F.when(F.col("lang") == "python", F.col("text"))))


def facts_of(programs: DataFrame) -> Column:
    """Facts of python programs (text): those that `with_facts` has put there, or read now."""
    return F.col("python_facts") if "python_facts" in programs.columns else facts(F.col("text"))


# -- what the facts amount to ------------------------------------------------------------------

NAMED = "array<struct<name:string,path:string>>"


def _amounts_to(origin: Column, binds: Column, argv: Column, cwd: Column, home: Column, names: Column | None = None) -> Column:
    """Paths of an origin: array<string>, empty if there are none. names: what the fixpoint knows of tainted names, if it is asked."""
    none = F.array().cast("array<string>")
    absolute = lambda p: F.filter(F.array(resolve_path(p, cwd, home)), lambda x: x.isNotNull())

    def plain(o: Column) -> Column:
        number = F.try_to_number(o["value"], F.lit("999999")).cast("int")
        given = F.when((o["kind"] == "argv") & (number >= 1), F.array(F.get(argv, number - 1))).when(o["kind"] == "argvs", argv).otherwise(none)
        found = F.when(o["kind"].isin("literal", "dir"), F.array(o["value"])).otherwise(F.coalesce(given, none))
        return F.flatten(F.transform(F.filter(found, lambda x: x.isNotNull()), absolute))

    last = lambda n: F.try_element_at(F.transform(F.filter(binds, lambda b: b["name"] == n), lambda b: b["origin"]), F.lit(-1))
    out = F.when(origin["kind"] == "var", let(last(origin["value"]), lambda o: F.when(o.isNotNull(), plain(o)).otherwise(none))).otherwise(plain(origin))
    if names is None:
        return out
    return F.when(origin["kind"] == "taint", F.transform(F.filter(names, lambda x: x["name"] == origin["value"]), lambda x: x["path"])).otherwise(out)


def tainted(edges: Column, paths_of) -> Column:
    """Names and the directories that their values were found in: array of (name, path).

    Starts from the edges that walk a directory and carries what is known along all others, at most once for each edge; a pass that
    adds nothing is the last one that works.
    """
    start = F.array_distinct(F.flatten(F.transform(F.filter(edges, lambda e: e["origin"]["kind"] != "taint"), lambda e: F.transform(paths_of(e["origin"]), lambda p: F.struct(e["name"].alias("name"), p.alias("path"))))))
    along = F.filter(edges, lambda e: e["origin"]["kind"] == "taint")

    def once(known: Column) -> Column:
        new = F.transform(along, lambda e: F.transform(F.filter(known, lambda k: k["name"] == e["origin"]["value"]), lambda k: F.struct(e["name"].alias("name"), k["path"].alias("path"))))
        return F.array_distinct(F.concat(known, F.flatten(new)))

    state = lambda known, more: F.struct(known.alias("known"), more.alias("more"))
    step = lambda s, _: F.when(s["more"], let(once(s["known"]), lambda n: state(n, F.size(n) > F.size(s["known"])))).otherwise(s)
    begun = state(F.coalesce(start, F.array().cast(NAMED)).cast(NAMED), F.lit(True))
    return F.aggregate(F.sequence(F.lit(0), F.size(along)), begun, step, lambda s: s["known"])


def python_files(programs: DataFrame, *keys: str) -> DataFrame:
    """keys, access (read or write), path, raw (what stands for it) of python programs (keys, lang, text, cwd, home, and argv: an array of literals, null ones unknown).

    open and io.open by mode, Path's read_ and write_ methods and open, read methods of what was opened, fileinput. A path is a literal,
    an argument, a name bound to one (its last binding), the fixed directory of an f-string, or the directory that a value was found in
    by walking it: then the directory is read. Each path once a program and access. Programs that aren't python, null, empty or broken
    ones have no rows; relative paths need a cwd. Programs `with_facts` are not read again.
    """
    argv = F.col("argv") if "argv" in programs.columns else F.lit(None).cast("array<string>")
    # Programs that open nothing go when sinks are exploded: a filter on their number would have Spark read each program twice.
    rows = programs.where("lang = 'python'").select(*keys, "cwd", "home", F.coalesce(argv, F.array().cast("array<string>")).alias("_argv"), facts_of(programs).alias("_f"))
    of = lambda names: lambda o: _amounts_to(o, F.col("_f.binds"), F.col("_argv"), F.col("cwd"), F.col("home"), names)
    rows = rows.withColumn("_names", tainted(F.col("_f.edges"), of(None)))
    sinks = F.transform("_f.sinks", lambda s: F.struct(s["access"].alias("access"), s["raw"].alias("raw"), _first(s["tries"], of(F.col("_names"))).alias("paths")))
    rows = rows.select(*keys, F.explode(sinks).alias("_s")).select(*keys, F.col("_s.access").alias("access"), F.col("_s.raw").alias("raw"), F.explode("_s.paths").alias("path"))
    return rows.groupBy(*keys, "access", "path").agg(F.min("raw").alias("raw"))


def _first(tries: Column, paths_of) -> Column:
    """The paths of the first try that has any."""
    none = F.array().cast("array<string>")
    return F.aggregate(tries, none, lambda a, t: F.when(F.size(a) > 0, a).otherwise(F.flatten(F.transform(t, paths_of))))
