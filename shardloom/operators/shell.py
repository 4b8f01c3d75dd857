"""Command lines to relations: commands, assignments, directories, reads, writes, embedded programs.

Every line is scanned once, in its own row (`scan`); directories and variables are as-of lookups among the line's own events. The only
shuffle is by cmd_id, and nothing compares one line with another. Whatever isn't a literal is null with resolvable false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import command_kind
from ..functions.paths import NAME, base_name, is_assignment, is_recursive_flag, literal_value, resolve_path, safe_unquoted
from ..functions.text import let
from .dataflow import with_facts
from .programs import child_lines
from .scan import FAR, scan

# Flags that take a value, flags that supply the pattern or program, and their joined forms, by program.
VALUE_FLAGS = {
    "grep": "-e -f -m -A -B -C -d --include --exclude --exclude-dir --color", "egrep": "-e -f -m", "rg": "-e -f -m -A -B -C -g --glob -t --type --max-count",
    "ag": "-G --file-search-regex", "sed": "-e -f", "awk": "-F -v -f -i", "gawk": "-F -v -f -i", "jq": "-f --from-file --arg --argjson --slurpfile --rawfile",
    "stat": "-f -t",
}
EXPRESSION_FLAGS = {**dict.fromkeys(("grep", "egrep", "fgrep", "rg", "ag", "ack", "git grep", "sed"), "-e -f"), "awk": "-f", "gawk": "-f", "jq": "-f --from-file"}
JOINED_FLAGS = {**dict.fromkeys(("grep", "egrep", "fgrep", "rg", "ag", "ack", "git grep"), "--regexp= --file="), "sed": "--expression= --file=",
                "awk": "--file=", "gawk": "--file=", "jq": "--from-file="}
TWO_VALUES = ("--arg", "--argjson", "--slurpfile", "--rawfile")
FILE_VALUES = ("--slurpfile", "--rawfile")
PATTERN_FIRST = ("grep", "egrep", "fgrep", "rg", "ag", "ack", "git grep", "awk", "gawk", "sed", "jq")
SEARCH_HERE = ("rg", "ag", "ack", "git grep")
HEREDOC_READERS = {"python": "python", "python3": "python", "bash": "shell", "sh": "shell", "zsh": "shell", "node": "javascript", "ruby": "ruby", "perl": "perl"}
# Language of the program behind a flag (or behind no flag: the first operand).
PROGRAM_FLAGS = (("bash", "-c", "shell"), ("sh", "-c", "shell"), ("zsh", "-c", "shell"), ("python", "-c", "python"), ("python3", "-c", "python"), ("perl", "-e", "perl"),
                 ("node", "-e", "javascript"), ("node", "-p", "javascript"), ("ruby", "-e", "ruby"), ("php", "-r", "php"), ("osascript", "-e", "applescript"))


def _lookup(table: dict[str, str], program: Column) -> Column:
    out = F.array().cast("array<string>")
    for values in sorted(set(table.values())):
        out = F.when(program.isin(*[k for k, v in table.items() if v == values]), F.array(*[F.lit(x) for x in values.split()])).otherwise(out)
    return out


def tokens(lines: DataFrame) -> DataFrame:
    """cmd_id, command, base_cwd, home to tokens: cmd_id, base_cwd, home, command, scope_id, closes, stage, pipeline_start, pipeline_end, pos, token, role, start_byte, end_byte.

    command numbers what runs; scope_id numbers subshells in order, 0 outside; closes is the place where the scope ends; role is word,
    redirect or target; stage counts the pipes before it in its pipeline, whose bytes are from pipeline_start up to pipeline_end (0 and 0
    where no pipe is; a group has pipelines of its own). Words of control (for, do, case patterns, function names, tests) belong to
    nothing that runs and have no rows; redirections behind a group are a command of their own, at the place where the group begins.
    """
    rows = lines.select("cmd_id", "base_cwd", "home", F.explode(scan(F.col("command"))["commands"]).alias("_c"))
    places = [f"_c.{c}" for c in ("command", "scope_id", "closes", "stage", "pipeline_start", "pipeline_end")]
    return rows.select("cmd_id", "base_cwd", "home", *places, F.explode("_c.tokens").alias("_t")).select("*", "_t.*").drop("_t")


def _strip(words: Column) -> Column:
    """Words without one env (and its assignments) or sudo (and its flags) in front; -u and --user take a value."""
    def env(w: Column) -> Column:
        return F.aggregate(w, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) == 0) & is_assignment(x), a).otherwise(F.array_append(a, x)))

    def sudo(w: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
        step = lambda a, x: F.when(a["skip"], F.struct(a["out"].alias("out"), F.lit(False).alias("skip"))).when(
            (F.size(a["out"]) == 0) & x.startswith("-"), F.struct(a["out"].alias("out"), x.isin("-u", "--user").alias("skip"))
        ).otherwise(F.struct(F.array_append(a["out"], x).alias("out"), F.lit(False).alias("skip")))
        return F.aggregate(w, start, step, lambda a: a["out"])

    def one(w: Column) -> Column:
        first, rest = F.regexp_extract(F.get(w, F.lit(0)), r"^['\"]?(?:.*/)?(env|sudo)['\"]?$", 1), F.slice(w, F.lit(2), F.size(w))
        return F.when((F.size(w) < 2) | (first == ""), w).when(first == "env", env(rest)).otherwise(sudo(rest))

    return let(words, one)


def _expanded(word: Column, pos: Column, assigns: Column) -> Column:
    """literal_value, or the value of a word that is just $NAME or ${NAME}: the last assignment in sight."""
    def looked_up(w: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(w, rf'^"?\$({NAME}|\{{{NAME}\}})"?$', 1), "[{}]", "")
        seen = lambda n: F.filter(assigns, lambda a: (a["name"] == n) & (a["pos"] < pos) & (a["closes"] > pos))
        value = let(name, lambda n: F.when(n != "", F.try_element_at(F.transform(seen(n), lambda a: a["value"]), F.lit(-1))))
        return let(value, lambda v: F.when(w.startswith('"') | safe_unquoted(v), v))

    return let(word, lambda w: F.when(w.startswith("$") | w.startswith('"$'), looked_up(w)).otherwise(literal_value(w)))


def decompose(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each command of each line (cmd_id, command, base_cwd, home).

    cmd_id, command_index, start_byte, scope_id, argv0, kind, args (array of text, value, resolvable,
    kind), cwd, cwd_resolvable, redirects (array of op, text, value), assigns (array of name, value,
    resolvable; only of commands that are nothing else), home, end_byte, stage, pipeline_start_byte,
    pipeline_end_byte, bodies (of heredocs), named (whether it runs something), base_cwd, and columns of lines to
    `keep`. Redirections of a group, and such without a command, are rows that aren't named; they come last in a line.
    Null, blank and broken lines have no commands. A line's whole work is bounded by its length; lines are never compared.
    """
    rows = lines.select("cmd_id", "base_cwd", "home", *keep, F.explode(scan(F.col("command"))["commands"]).alias("_c")).select("cmd_id", "base_cwd", "home", *keep, "_c.*").withColumnRenamed("tokens", "_t")
    rows = rows.withColumn("_w", F.transform(F.filter("_t", lambda t: t["role"] == "word"), lambda t: t["token"]))
    prefix = F.aggregate("_w", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & is_assignment(x)).cast("int")).alias("n"), (a["on"] & is_assignment(x)).alias("on")), lambda a: a["n"])
    rows = rows.withColumn("_n", prefix)
    target = lambda i: F.get("_t", i)
    redirects = F.filter(F.transform("_t", lambda t, i: F.struct(t["token"].alias("op"), F.when(target(i + 1)["role"] == "target", target(i + 1)["token"]).alias("text"), t["role"].alias("role"))), lambda r: r["role"] == "redirect")
    rows = rows.withColumn("_redirects", redirects)
    only = (F.col("_n") == F.size("_w")) & (F.col("_n") > 0)
    assigned = F.when(only, F.transform("_w", lambda w: F.struct(
        F.regexp_extract(w, rf"^({NAME})\+?=", 1).alias("name"),
        F.when(~w.rlike(rf"^{NAME}\+="), F.coalesce(literal_value(F.regexp_extract(w, r"(?s)^[^=]*=(.*)$", 1)), F.when(w.endswith("="), F.lit("")))).alias("value"))))
    rows = rows.withColumn("_assigns", F.coalesce(assigned, F.array().cast("array<struct<name:string,value:string>>")))
    argv = F.slice("_w", F.col("_n") + 1, F.size("_w"))
    for _ in range(3):
        argv = _strip(argv)
    rows = rows.withColumn("_argv", argv)
    line = Window.partitionBy("cmd_id")
    events = F.collect_list(F.when(F.size("_assigns") > 0, F.struct("pos", "closes", "_assigns"))).over(line)
    seen = F.flatten(F.transform(F.array_sort(events), lambda e: F.transform(e["_assigns"], lambda a: F.struct(e["pos"].alias("pos"), e["closes"].alias("closes"), a["name"].alias("name"), a["value"].alias("value")))))
    rows = rows.withColumn("_seen", seen)
    value = lambda w: _expanded(w, F.col("pos"), F.col("_seen"))
    name = F.coalesce(base_name(literal_value(F.get("_argv", F.lit(0)))), F.lit(""))
    rows = rows.withColumn("argv0", name).withColumn("_values", F.transform(F.slice("_argv", F.lit(2), F.size("_argv")), lambda w: F.struct(w.alias("text"), value(w).alias("value"))))
    operand = F.filter("_values", lambda v: ~v["text"].startswith("-"))
    moves = F.when((F.col("argv0") == "cd"), F.struct("pos", "closes", F.when(F.size(operand) == 0, F.lit("~")).otherwise(F.get(operand, F.lit(0))["value"]).alias("to")))
    rows = rows.withColumn("_moves", F.array_sort(F.collect_list(moves).over(line)))
    here = F.filter("_moves", lambda m: (m["pos"] < F.col("pos")) & (m["closes"] > F.col("pos")))
    walk = F.aggregate(here, F.struct(F.coalesce("base_cwd", F.lit("")).alias("c"), F.lit(True).alias("ok")), lambda a, m: let(resolve_path(m["to"], F.when(a["ok"], a["c"]), F.col("home")), lambda p: F.struct(F.coalesce(p, F.lit("")).alias("c"), p.isNotNull().alias("ok"))))
    rows = rows.withColumn("_cwd", walk)
    word_kind = lambda v: F.when(v["value"].isNull(), F.lit("unresolvable")).when(v["value"].startswith("-"), F.lit("flag")).otherwise(F.lit("literal"))
    args = F.transform("_values", lambda v: F.struct(v["text"].alias("text"), v["value"].alias("value"), v["value"].isNotNull().alias("resolvable"), word_kind(v).alias("kind")))
    rows = rows.withColumn("_named", F.size("_argv") > 0)
    order = F.row_number().over(Window.partitionBy("cmd_id").orderBy(F.size("_w") == 0, "pos")) - 1
    return rows.select(
        "cmd_id", order.cast("int").alias("command_index"), F.col("start_byte").cast("long").alias("start_byte"), F.col("scope_id").cast("int").alias("scope_id"), "argv0", command_kind(F.col("argv0")).alias("kind"),
        args.alias("args"), F.when(F.col("_cwd.ok"), F.nullif(F.col("_cwd.c"), F.lit(""))).alias("cwd"), F.col("_cwd.ok").alias("cwd_resolvable"),
        F.transform("_redirects", lambda r: F.struct(r["op"].alias("op"), r["text"].alias("text"), value(r["text"]).alias("value"))).alias("redirects"),
        F.transform("_assigns", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"), a["value"].isNotNull().alias("resolvable"))).alias("assigns"), "home",
        F.col("end_byte").cast("long").alias("end_byte"), F.col("stage").cast("int").alias("stage"), F.col("pipeline_start").cast("long").alias("pipeline_start_byte"), F.col("pipeline_end").cast("long").alias("pipeline_end_byte"),
        "bodies", F.col("_named").alias("named"), "base_cwd", *keep,
    )


def commands(parsed: DataFrame) -> DataFrame:
    """Rows that run something: an assignment alone is none, nor is a redirection without a command."""
    return parsed.where("named").drop("assigns", "redirects", "home", "bodies", "named", "base_cwd")


def assignments(parsed: DataFrame) -> DataFrame:
    return parsed.select("cmd_id", "command_index", "scope_id", F.posexplode("assigns").alias("assign_index", "_a")).select("cmd_id", "command_index", "scope_id", "assign_index", "_a.name", "_a.value", "_a.resolvable")


def resolve_word(parsed: DataFrame, words: DataFrame) -> DataFrame:
    """words (cmd_id, text, scope_id, byte) with value: what a word that is just a variable stands for at a byte.

    The last assignment of that name in the same scope that ends at or before the byte; null where there
    is none, where it is no literal, or where the word is something else.
    """
    events = parsed.where(F.size("assigns") > 0).groupBy("cmd_id").agg(F.array_sort(F.collect_list(F.struct("end_byte", "scope_id", "assigns"))).alias("_e"))
    past = lambda e: (e["scope_id"] == F.col("scope_id")) & (e["end_byte"] <= F.col("byte"))
    plain = lambda a: F.struct(F.lit(0).alias("pos"), F.lit(FAR).alias("closes"), a["name"].alias("name"), a["value"].alias("value"))
    seen = F.flatten(F.transform(F.filter("_e", past), lambda e: F.transform(e["assigns"], plain)))
    value = F.when(F.col("text").rlike(r'^"?\$'), _expanded(F.col("text"), F.lit(1), F.col("_seen")))
    return words.join(events, "cmd_id", "left").withColumn("_seen", seen).select(*words.columns, value.alias("value"))


def opaque(lines: DataFrame) -> DataFrame:
    """cmd_id, opaque: whether a line is null, blank or broken (an open quote or group, a closing word of no group), so that nothing can be said of it."""
    return lines.select("cmd_id", scan(F.col("command"))["broken"].alias("opaque"))


def _scan(program: Column, args: Column) -> Column:
    """Operands that a reading program takes as paths: array of (text, value), by its flags' arity."""
    values, supply, joined = _lookup(VALUE_FLAGS, program), _lookup(EXPRESSION_FLAGS, program), _lookup(JOINED_FLAGS, program)
    given = F.exists(args, lambda a: F.array_contains(supply, F.coalesce(a["value"], F.lit(""))) | F.exists(joined, lambda j: F.coalesce(a["value"], F.lit("")).startswith(j)))
    start = F.struct(F.lit(0).alias("skip"), F.lit(False).alias("file"), (given | ~program.isin(*PATTERN_FIRST)).alias("taken"), F.array().cast("array<struct<text:string,value:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        v, pick = F.coalesce(x["value"], F.lit("")), F.struct(x["text"].alias("text"), x["value"].alias("value"))
        two = (program == "jq") & v.isin(*TWO_VALUES)
        flag = v.startswith("-") & (F.length(v) > 1)
        state = lambda skip, file, taken, out: F.struct(skip.alias("skip"), file.alias("file"), taken.alias("taken"), out.alias("out"))
        no = F.lit(False)
        return (
            F.when(a["skip"] > 0, state(a["skip"] - 1, a["file"], a["taken"], F.when(a["file"] & (a["skip"] == 1), F.array_append(a["out"], pick)).otherwise(a["out"])))
            .when(flag & two, state(F.lit(2), v.isin(*FILE_VALUES), a["taken"], a["out"]))
            .when(flag, state(F.array_contains(values, v).cast("int"), no, a["taken"], a["out"]))
            .when(~a["taken"], state(F.lit(0), no, F.lit(True), a["out"]))
            .otherwise(state(F.lit(0), no, a["taken"], F.array_append(a["out"], pick)))
        )

    return F.aggregate(args, start, step, lambda a: a["out"])


def _perl_operands(args: Column) -> Column:
    """Operands that perl reads: only in a loop (-n or -p in a cluster) over a program given by a cluster that ends in e or E."""
    value = lambda a: F.coalesce(a["value"], F.lit(""))
    loops, given = F.exists(args, lambda a: value(a).rlike("^-[A-Za-z0-9]*[np][A-Za-z0-9]*$")), F.exists(args, lambda a: value(a).rlike("^-[A-Za-z0-9]*[eE]$"))
    none = F.array().cast(PATHS)
    state = lambda skip, out: F.struct(skip.alias("skip"), out.alias("out"))
    step = lambda a, x: F.when(a["skip"], state(F.lit(False), a["out"])).when(value(x).startswith("-"), state(value(x).rlike("^-[A-Za-z0-9]*[eE]$"), a["out"])).otherwise(
        state(F.lit(False), F.array_append(a["out"], F.struct(x["text"].alias("text"), x["value"].alias("value")))))
    return F.when(loops & given, F.aggregate(args, state(F.lit(False), none), step, lambda a: a["out"])).otherwise(none)


def reads(parsed: DataFrame, *keep: str) -> DataFrame:
    """cmd_id, command_index, origin, argv0, path, resolvable, raw, and columns to `keep`: files and folders that commands read."""
    git = (F.col("argv0") == "git") & (F.get("args", F.lit(0))["value"] == "grep")
    rows = parsed.withColumns({"_name": F.when(git, F.lit("git grep")).otherwise(F.col("argv0")), "_args": F.when(git, F.slice("args", F.lit(2), F.size("args"))).otherwise(F.col("args"))})
    around = F.col("_name").isin(*SEARCH_HERE) | F.exists("_args", lambda a: is_recursive_flag(F.coalesce(a["value"], F.lit(""))))
    none = F.array().cast(PATHS)
    here = F.when(around, F.array(F.struct(F.lit(".").alias("text"), F.lit(".").alias("value")))).otherwise(none)
    scanned = let(_scan(F.col("_name"), F.col("_args")), lambda p: F.when(F.size(p) > 0, p).otherwise(here))
    operands = F.when(F.col("kind").isin("read", "search") | (F.col("_name") == "git grep"), scanned).when(F.col("argv0") == "perl", _perl_operands(F.col("args"))).otherwise(none)
    given = F.filter("redirects", lambda r: r["op"].rlike("^[0-9]*<$") & ~r["text"].rlike(r"^[<>]\("))
    return _resolved(rows, F.concat(_named(operands, "", F.col("_name")), _named(given, "redirect", F.col("argv0"))), *keep)


PATHS = "array<struct<text:string,value:string>>"


def _named(paths: Column, origin: str, argv0: Column) -> Column:
    return F.transform(paths, lambda p: F.struct(F.lit(origin).alias("origin"), argv0.alias("argv0"), p["text"].alias("text"), p["value"].alias("value")))


def _resolved(rows: DataFrame, found: Column, *keep: str) -> DataFrame:
    """A row for each of `found` (origin, argv0, text, value), its path taken from the command's directory."""
    rows = rows.select("cmd_id", "command_index", "cwd", "cwd_resolvable", "home", *keep, F.explode(found).alias("_p"))
    path = F.when(F.col("_p.value").isNotNull(), resolve_path(F.col("_p.value"), F.when(F.col("cwd_resolvable"), F.col("cwd")), F.col("home")))
    rows = rows.withColumn("path", path)
    return rows.select("cmd_id", "command_index", "_p.origin", "_p.argv0", "path", F.col("path").isNotNull().alias("resolvable"), F.col("_p.text").alias("raw"), *keep)


def writes(parsed: DataFrame, *keep: str) -> DataFrame:
    """cmd_id, command_index, origin, argv0, path, resolvable, raw, and columns to `keep`: files that commands write."""
    out = F.filter("redirects", lambda r: r["op"].rlike("^[0-9]*(?:>>?|>&|&>>?)$") & r["text"].isNotNull() & ~r["text"].rlike(r"^[<>]\(") & ~(r["op"].endswith("&") & r["text"].rlike(r"^(?:[0-9]+|-)$")))
    pick = lambda x: F.struct(x["text"].alias("text"), x["value"].alias("value"))
    plain = F.transform(F.filter("args", lambda a: ~F.coalesce(a["value"], F.lit("")).startswith("-")), pick)
    first, last = F.get("args", F.lit(0))["value"], F.slice(plain, F.greatest(F.size(plain), F.lit(1)), F.lit(1))
    inline = F.exists("args", lambda a: F.coalesce(a["value"], F.lit("")).rlike(r"^(?:-i|-i\..*|--in-place.*)$"))
    gawk = F.aggregate("args", F.struct(F.lit("").alias("before"), F.lit(False).alias("yes")), lambda a, x: F.struct(F.coalesce(x["value"], F.lit("")).alias("before"), (a["yes"] | ((a["before"] == "-i") & (x["value"] == "inplace"))).alias("yes")), lambda a: a["yes"])
    none = F.array().cast(PATHS)
    target = (
        F.when(F.col("argv0") == "tee", plain)
        .when(F.col("argv0") == "dd", F.transform(F.filter("args", lambda a: F.coalesce(a["value"], F.lit("")).startswith("of=")), lambda a: F.struct(F.substr(a["text"], F.lit(4)).alias("text"), F.substr(a["value"], F.lit(4)).alias("value"))))
        .when((F.col("argv0") == "sed") & inline, _scan(F.lit("sed"), F.col("args")))
        .when(F.col("argv0").isin("awk", "gawk") & gawk, _scan(F.col("argv0"), F.col("args")))
        .when(F.col("argv0") == "patch", last)
        .when((F.col("argv0") == "git") & (first == "apply"), F.when(F.size(plain) > 1, last).otherwise(none))
        .otherwise(none)
    )
    return _resolved(parsed, F.concat(_named(out, "redirect", F.col("argv0")), _named(target, "argument", F.col("argv0"))), *keep)


# docker's flags that take a value of their own.
DOCKER_VALUES = ("-e", "-v", "-w", "-u", "-p", "--env", "--volume", "--workdir", "--user", "--name")


def _operand(args: Column, program: Column) -> Column:
    """(index, given): place of the first operand behind leading flags, or -1; whether one of those flags supplies the program.

    -i inplace is a pair for awk; docker's value flags and its subcommand are passed over with their values.
    """
    state = lambda i, skip, at, given: F.struct(i.alias("i"), skip.alias("skip"), at.alias("at"), given.alias("given"))
    docker, inplace = program == "docker", F.lit(False)

    def step(a: Column, x: Column) -> Column:
        t, here = x["text"], F.get(args, a["i"] + 1)["text"]
        pair = (docker & t.isin(*DOCKER_VALUES) & here.isNotNull()) | (program.isin("awk", "gawk") & (t == "-i") & (F.coalesce(here, F.lit("")) == "inplace"))
        supplied = (program.isin("awk", "gawk", "sed") & (t == "-f")) | ((program == "sed") & (t == "-e"))
        return (
            F.when(a["at"] >= 0, state(a["i"] + 1, inplace, a["at"], a["given"]))
            .when(a["skip"] | (docker & (a["i"] == 0)), state(a["i"] + 1, inplace, a["at"], a["given"]))
            .when(t.startswith("-"), state(a["i"] + 1, pair, a["at"], a["given"] | supplied))
            .otherwise(state(a["i"] + 1, inplace, a["i"], a["given"]))
        )

    return F.aggregate(args, state(F.lit(0), F.lit(False), F.lit(-1), F.lit(False)), step, lambda a: F.struct(a["at"].alias("index"), a["given"].alias("given")))


def region(lang: str, text: Column, new_scope: bool = True) -> Column:
    return F.struct(F.lit(lang).alias("lang"), text.alias("text"), F.lit(new_scope).alias("new_scope"))


def regions(lines: DataFrame, parsed: DataFrame, own: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """cmd_id, command_index, lang, text, new_scope: programs embedded in commands, and the heredocs that they are given.

    Flags are told by their text. A program or a command word that isn't a literal gives no region;
    what xargs and parallel run ends before the first word that isn't one. `own` holds rules for further
    programs, or in place of those here: from the array of arguments to a `region` (or null).
    """
    return _embedded(parsed, own).select("cmd_id", "command_index", "_r.lang", "_r.text", "_r.new_scope")


def _embedded(parsed: DataFrame, own: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """parsed with _r (lang, text, new_scope), a row for each embedded program or heredoc."""
    plain = F.filter("args", lambda a: ~a["text"].startswith("-"))
    words = lambda found: F.when((F.size(found) > 0) & F.forall(found, lambda a: a["resolvable"]), F.array_join(F.transform(found, lambda a: a["value"]), " "))
    made = F.lit(None).cast("struct<lang:string,text:string,new_scope:boolean>")
    for program, flag, lang in reversed(PROGRAM_FLAGS):  # the first flag that fits is tried last, and wins
        at = F.array_position(F.transform("args", lambda a: a["text"]), F.lit(flag)).cast("int")
        code = F.when(at > 0, F.get("args", at)["value"])
        made = F.when((F.col("argv0") == program) & code.isNotNull(), region(lang, code)).otherwise(made)
    made = F.when((F.col("argv0") == "ssh") & (F.size(plain) > 0), region("shell", F.element_at(F.concat(plain, plain), -1)["value"])).otherwise(made)
    begin = F.array_position(F.transform("args", lambda a: a["text"].startswith("-")), F.lit(False)).cast("int")
    rest = F.slice("args", F.greatest(begin, F.lit(1)), F.size("args"))
    stop = F.array_position(F.transform(rest, lambda a: a["resolvable"]), F.lit(False)).cast("int")
    made = F.when(F.col("argv0").isin("xargs", "parallel") & (begin > 0), region("shell", words(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)), False)).otherwise(made)
    exec_at = F.array_position(F.transform("args", lambda a: a["text"].isin("-exec", "-execdir")), F.lit(True)).cast("int")
    behind = F.slice("args", F.greatest(exec_at, F.lit(1)) + 1, F.size("args"))
    end = F.array_position(F.transform(behind, lambda a: a["text"].isin(";", r"\;", "+")), F.lit(True)).cast("int")
    body = F.filter(F.when(end > 0, F.slice(behind, F.lit(1), end - 1)).otherwise(behind), lambda a: a["text"] != "{}")
    made = F.when((F.col("argv0") == "find") & (exec_at > 0), region("shell", words(body), False)).otherwise(made)
    found = _operand(F.col("args"), F.col("argv0"))
    inside = let(found, lambda f: F.when(f["index"] > 0, words(F.slice("args", f["index"] + 2, F.size("args")))))
    made = F.when((F.col("argv0") == "docker") & F.get("args", F.lit(0))["value"].isin("run", "exec"), region("shell", inside)).otherwise(made)
    made = F.when((F.col("argv0") == "sqlite3") & (F.size(plain) > 1), region("sql", F.get(plain, F.lit(1))["value"])).otherwise(made)
    made = F.when((F.col("argv0") == "jq") & (F.size(plain) > 0), region("jq", F.get(plain, F.lit(0))["value"])).otherwise(made)
    for program, lang in (("awk", "awk"), ("gawk", "awk"), ("sed", "sed")):
        code = let(found, lambda f: F.when((f["index"] >= 0) & ~f["given"], F.get("args", f["index"])["value"]))
        made = F.when(F.col("argv0") == program, region(lang, code)).otherwise(made)
    for program, rule in (own or {}).items():
        made = F.when(F.col("argv0") == program, rule(F.col("args"))).otherwise(made)
    lang = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in HEREDOC_READERS.items() for x in kv]), F.col("argv0")), F.lit("opaque"))
    heredocs = F.transform("bodies", lambda b: F.struct(lang.alias("lang"), b.alias("text"), (lang == "shell").alias("new_scope")))
    code = let(made, lambda m: F.when(m["text"].isNotNull(), F.array(m)).otherwise(F.array().cast("array<struct<lang:string,text:string,new_scope:boolean>>")))
    return parsed.withColumn("_r", F.explode(F.concat(code, heredocs)))


def script_regions(parsed: DataFrame, scripts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """cmd_id, command_index, lang, text, argv, cwd, home, path, and columns to `keep`: python scripts that commands run, from scripts (path, content).

    A script that isn't in the table has an empty text. -c runs no script; -m runs a module that is a file of the directory (a.b is
    a/b.py or a/b/__main__.py), and nothing if there is none; -W and -X take a value. argv holds the operands behind the script; null
    where one is no literal.
    """
    value = lambda a: F.coalesce(a["value"], F.lit(""))
    rows = parsed.where(F.col("argv0").isin("python", "python3"))
    state = lambda skip, module, out: F.struct(skip.alias("skip"), module.alias("module"), out.alias("out"))
    no, none = F.lit(False), F.size
    step = lambda a, x: F.when(a["skip"], state(no, a["module"], a["out"])).when(
        (none(a["out"]) == 0) & ~a["module"] & value(x).startswith("-"), state(value(x).isin("-W", "-X"), value(x) == "-m", F.when(value(x) == "-c", F.array(F.lit(None).cast("string"))).otherwise(a["out"]))
    ).otherwise(state(no, a["module"], F.array_append(a["out"], x["value"])))
    rows = rows.withColumn("_o", F.aggregate("args", state(no, no, F.array().cast("array<string>")), step))
    first = F.get(F.col("_o.out"), F.lit(0))
    module = F.replace(first, F.lit("."), F.lit("/"))
    named = F.when(~F.col("_o.module"), F.array(first)).when(first.rlike(rf"^{NAME}(?:\.{NAME})*$"), F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__main__.py"))))
    rows = rows.select("*", F.posexplode(named).alias("_turn", "_name"))
    rows = rows.withColumn("_path", resolve_path(F.col("_name"), F.when(F.col("cwd_resolvable"), F.col("cwd")), F.col("home"))).where("_path is not null")
    files = scripts.select(F.col("path").alias("_path"), F.col("content").alias("text"), F.lit(True).alias("_there"))
    argv = F.slice("_o.out", F.lit(2), F.size("_o.out"))
    found = rows.join(files, "_path", "left").where(~F.col("_o.module") | F.col("_there"))
    turn = F.row_number().over(Window.partitionBy("cmd_id", "command_index").orderBy("_turn"))
    found = found.withColumn("_turn", turn).where("_turn = 1")
    return found.select("cmd_id", "command_index", F.lit("python").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), argv.alias("argv"), "cwd", "home", F.col("_path").alias("path"), *keep)


def effective_cwd(parsed: DataFrame, places: DataFrame) -> DataFrame:
    """places (cmd_id, byte) with the directory of the last command that starts at or before the byte: an as-of join."""
    spans = parsed.groupBy("cmd_id").agg(F.array_sort(F.collect_list(F.struct("start_byte", "cwd"))).alias("_s"))
    found = F.try_element_at(F.filter("_s", lambda s: s["start_byte"] <= F.col("byte")), F.lit(-1))
    return places.join(spans, "cmd_id", "left").select(*places.columns, F.when(F.col("_s").isNotNull(), found["cwd"]).alias("cwd"))


def nested(lines: DataFrame, depth: int = 5, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[tuple[DataFrame, DataFrame]]:
    """(lines, parsed) of each level: level 0 is lines, each next one the shell regions of the one before.

    Regions get the id of their line, "/" and their number; their directory is that of their command. `cut` is applied to the lines of
    each level below: give one that writes them (DataFrame.checkpoint), as a level is worked out again for each one below.
    """
    out, level = [], lines
    for i in range(depth):
        parsed = decompose(level)
        out.append((level, parsed))
        if i < depth - 1:
            level = cut(_inner(_embedded(parsed).where("_r.lang = 'shell'"), F.col("_r.text")))
    return out


def _inner(found: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Lines (cmd_id, command, base_cwd, home) out of rows of `_embedded` or programs, by number below their line."""
    number = F.row_number().over(Window.partitionBy("cmd_id").orderBy(F.col("command_index").asc_nulls_last(), text))
    return found.select(F.concat_ws("/", F.col("cmd_id").cast("string"), number.cast("string")).alias("cmd_id"), text.alias("command"), F.col("cwd").alias("base_cwd"), "home", *keep)


def closure(lines: DataFrame, scripts: DataFrame | None = None, depth: int = 5, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(parsed, programs) of lines and all that they run, down to `depth`, each row with root (the id of its line) and level.

    A frontier of lines a level: shell regions make lines of the next level; programs, scripts (path, content) among them, stand a level
    below their command, and the commands that python programs run a level below those. A script that a branch has been in is not
    entered again. programs: cmd_id, root, level, lang, text, argv, cwd, home, path (of scripts), python_facts. `cut` is applied to what is parsed and to
    the programs of each level: give one that writes them, as each is read several times, by the next levels and by whoever asks for paths.
    """
    keep = ["root", "been"]
    none = F.array().cast("array<string>")
    waiting = {0: [lines.select("cmd_id", "command", "base_cwd", "home", F.col("cmd_id").cast("string").alias("root"), none.alias("been")).withColumn("cmd_id", F.col("root"))]}
    parsed_all, programs_all = [], []
    for level in range(depth):
        if level not in waiting:
            continue
        rows = waiting[level][0]
        for more in waiting[level][1:]:
            rows = rows.unionByName(more)
        parsed = cut(decompose(rows, keep))
        parsed_all.append(parsed.withColumn("level", F.lit(level)))
        last = level + 1 >= depth
        if last and programs_all:
            break
        found = _embedded(parsed)
        waiting.setdefault(level + 1, []).append(_inner(found.where("_r.lang = 'shell'"), F.col("_r.text"), *keep))
        argv = F.transform(F.slice("args", F.greatest(F.array_position(F.transform("args", lambda a: a["text"]), F.lit("-c")).cast("int"), F.lit(0)) + 2, F.size("args")), lambda a: a["value"])
        about = ["cmd_id", "command_index", "_r.lang", "_r.text", F.when(F.col("argv0").isin("python", "python3"), argv).alias("argv"), F.when(F.col("cwd_resolvable"), F.col("cwd")).alias("cwd"), "home", F.lit(None).cast("string").alias("path"), "base_cwd", *keep]
        programs = found.where("_r.lang <> 'shell'").select(*about)
        if scripts is not None:
            read = script_regions(parsed, scripts, ["base_cwd", *keep]).where(~F.array_contains("been", F.col("path"))).withColumn("been", F.array_append("been", F.col("path")))
            programs = programs.unionByName(read.select(*programs.columns))
        programs = with_facts(programs.where(F.lit(False)) if last else programs)
        programs = programs if last else cut(programs)
        programs_all.append(programs.withColumn("level", F.lit(level + 1)))
        if level + 2 < depth:
            children = child_lines(programs, "cmd_id", "command_index", *keep).withColumn("cwd", F.col("base_cwd")).withColumn("cmd_id", F.concat("cmd_id", F.lit("/p")))
            waiting.setdefault(level + 2, []).append(_inner(children, F.col("command"), *keep))
    gathered = []
    for parts in (parsed_all, programs_all):
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        gathered.append(out.drop("been", "base_cwd", "command_index") if parts is programs_all else out.drop("been"))
    return gathered[0], gathered[1]
