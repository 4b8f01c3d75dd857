"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages, text
from ..functions.languages import EXTENSIONS
from ..operators.chunk import Sizes, chunk_files, chunk_rows, separators_of
from ..sources.tables import table

NAMES = [*EXTENSIONS, ".unknown"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a path for each: extensions take turns, the last is unknown."""
    ext = F.get(F.lit(NAMES), (F.col("doc_id") % len(NAMES)).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("src/v1.2/f"), F.col("doc_id").cast("string"), ext))


def language_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", "path", languages.language_for_path(F.col("path")).alias("language"))


def grammar_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).select("doc_id", languages.language_for_path(F.col("path")).alias("language"))
    return rows.withColumn("has_grammar", languages.grammar_supported(F.col("language")))


def nonwhite_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.nonwhite_bytes(F.col("text")).alias("n_bytes"), text.line_count(F.col("text")).alias("n_lines"))


def byte_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh byte offset of every text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.octet_length("text").cast("int"), F.lit(7))).alias("byte_offset"))
    return rows.select("doc_id", "byte_offset", text.align_up(F.col("text"), F.col("byte_offset")).alias("up"), text.align_down(F.col("text"), F.col("byte_offset")).alias("down"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces at line breaks, each keeping the break it begins with."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_keep(F.col("text"), F.lit("\n"))).alias("piece_index", "piece"))
    return rows


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = text.merge_adjacent(text.split_keep(F.col("text"), F.lit("\n")), 500)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("piece_index", "piece"))


def hard_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 bytes at most, cut between characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.hard_split(F.col("text"), 500)).alias("piece_index", "piece"))


def separator_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the chain of each document's language is, and its first separator."""
    rows = _paths(spark, sf_dir).select("doc_id", separators_of(languages.language_for_path(F.col("path"))).alias("chain"))
    return rows.select("doc_id", F.size("chain").alias("n_separators"), F.get("chain", F.lit(0)).alias("first_separator"))


def _documents(spark: SparkSession, sf_dir: str, sizes: Sizes = Sizes()) -> DataFrame:
    return chunk_files(table(spark, sf_dir, "documents").select("doc_id", "text"), content="text", sizes=sizes, language="text")


def chunk_documents_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(_documents(spark, sf_dir), "doc_id").select("doc_id", "chunk_index", "strategy", "content", "start_line", "end_line")


def chunk_documents_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without overlap: the pieces put together are the document."""
    return chunk_rows(_documents(spark, sf_dir, Sizes(overlap=0)), "doc_id").select("doc_id", "chunk_index", "content", "start_line", "end_line")


def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_files(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), content="text", language="text")
    each = rows.select("lang", F.size("chunks").alias("n"), F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["content"])).alias("b"))
    return each.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_chunks"), F.sum("b").cast("long").alias("n_bytes"))


def chunk_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_files(table(spark, sf_dir, "pages").select("page_id", "html"), content="html", kind=F.lit(" LangChain "), language="html")
    return chunk_rows(rows, "page_id").select("page_id", "chunk_index", "strategy", "content", "start_line", "end_line")


def ast_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a language with a grammar: one trimmed chunk within the budget, else cut at declarations."""
    rows = chunk_files(table(spark, sf_dir, "documents").select("doc_id", "text"), content="text", language="go", nesting=False)
    return chunk_rows(rows, "doc_id").select("doc_id", "strategy", "chunk_index", "content", "start_line", "end_line")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and a source file of every document: a function for each 25 words of its text."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    numbers = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.ceil(F.size("w") / 25).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    function = lambda i: F.concat(F.lit("\nfunc f"), i.cast("string"), F.lit('() {\n\tprint("'), F.array_join(F.slice("w", i * 25 + 1, 25), " "), F.lit('")\n}\n'))
    return rows.select("doc_id", F.concat(F.lit("package p\n"), F.array_join(F.transform(numbers, function), "")).alias("text"))


def nested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with functions of every document's words: larger ones are cut between functions, never inside one."""
    rows = chunk_files(source_files(spark, sf_dir), content="text", language="go")
    return chunk_rows(rows, "doc_id").select("doc_id", "strategy", "chunk_index", "content", "start_line", "end_line")


def split_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 5 == 0, F.lit(" LangChain ")).otherwise(F.lit("auto")))
    return chunk_files(rows.select("doc_id", "path", "text", "kind"), content="text", kind=F.col("kind")).groupBy("language", "strategy").agg(F.count("*").alias("n_files"))


QUERIES = {
    f.__name__: f
    for f in (language_for_path, grammar_supported, nonwhite_bytes, byte_alignment, split_lines, merged_lines, hard_splits, separator_chains, chunk_documents_default,
              chunk_documents_plain, chunk_stats_by_lang, chunk_pages_html, ast_files, nested_chunks, split_strategy)
}

# -- the same in DuckDB ------------------------------------------------------------------------

_EXT = ", ".join(f"'{n}'" for n in NAMES)
_LANG = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in EXTENSIONS.items()) + " ELSE 'text' END"
_FILES = f"f AS (SELECT doc_id, text, ([{_EXT}])[1 + doc_id % {len(NAMES)}] AS ext FROM documents), l AS (SELECT *, 'src/v1.2/f' || doc_id || ext AS path, {_LANG} AS language FROM f)"
_HAS = "language IN (" + ", ".join(f"'{g}'" for g in languages.GRAMMARS) + ")"


def _merge(pieces: str, size: int, measure: str = "strlen({0})") -> str:
    return (f"list_reduce(list_transform({pieces}, lambda p: {{'out': [p]}}), lambda a, b: CASE WHEN {measure.format('(a.out[-1] || b.out[1])')} <= {size} "
            f"THEN {{'out': list_append(a.out[:-2], a.out[-1] || b.out[1])}} ELSE {{'out': list_append(a.out, b.out[1])}} END).out")  # fmt: skip


def _keep(column: str, sep: str) -> str:
    """Pieces of column, each but the first beginning with sep."""
    if sep == "":
        return f"string_split({column}, '')"
    q = "'" + sep.replace("'", "''") + "'" if sep != "\n" else "chr(10)"
    if sep == "\n\n":
        q = "chr(10) || chr(10)"
    return f"list_filter(list_transform(string_split({column}, {q}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {q} || p END), lambda p: p <> '')"


def _levels(source: str, key: str, column: str, chain: list[str], size: int, measure: str = "strlen({0})") -> str:
    """CTEs l0.. with rows (id, place, c): pieces after each level of a chain, deepest first merged upwards."""
    out = [f"p0 AS (SELECT {key} AS id, [0] AS place, {column} AS c FROM {source} WHERE {column} <> '')"]
    for i, sep in enumerate(chain):  # down: pieces that are too large are cut
        out.append(f"p{i + 1} AS (SELECT id, list_append(place, j) AS place, c FROM (SELECT id, place, unnest({_keep('c', sep)}) AS c, "
                   f"generate_subscripts({_keep('c', sep)}, 1) AS j FROM p{i} WHERE {measure.format('c')} > {size}))")  # fmt: skip
    n = len(chain)
    out.append(f"m{n} AS (SELECT id, place, [c] AS cs FROM p{n})")
    for i in range(n - 1, -1, -1):  # up: neighbours below one parent are merged
        merged = _merge("pieces", size, measure)
        out.append(f"u{i} AS (SELECT id, place[:-2] AS place, flatten(list(cs ORDER BY place)) AS pieces FROM m{i + 1} GROUP BY id, place[:-2])")
        out.append(f"m{i} AS (SELECT id, place, {merged} AS cs FROM u{i} UNION ALL SELECT id, place, [c] FROM p{i} WHERE {measure.format('c')} <= {size})")
    return ",\n".join(out)


_NL = "(strlen({0}) - strlen(replace({0}, chr(10), '')))"


def _lined(overlap: int) -> str:
    """CTE `lined` from m0: id, chunk_index, content, start_line, end_line."""
    nl = _NL.format("c")
    rows = f"""piece AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM m0),
at AS (SELECT id, k, c, lag(c) OVER (PARTITION BY id ORDER BY k) AS before, 1 + coalesce(sum({nl}) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM piece),
""".replace("\nat AS", "\nplaced AS")
    if not overlap:
        return rows + f"lined AS (SELECT id, CAST(k - 1 AS INTEGER) AS chunk_index, c AS content, CAST(line + CAST(starts_with(c, chr(10)) AS INTEGER) AS INTEGER) AS start_line, CAST(line + {nl} AS INTEGER) AS end_line FROM placed)"
    tail = "CASE WHEN strlen(before) <= {n} THEN before ELSE (SELECT max(right(before, x)) FROM range(1, {n} + 1) t(x) WHERE x <= length(before) AND strlen(right(before, x)) <= {n} AND (x = length(before) OR strlen(right(before, x + 1)) > {n})) END".format(n=overlap)
    return rows + f"""tailed AS (SELECT *, {tail} AS o FROM placed),
lined AS (SELECT id, CAST(k - 1 AS INTEGER) AS chunk_index, CASE WHEN k = 1 THEN c ELSE o || chr(10) || c END AS content,
  CAST(CASE WHEN k = 1 THEN line + CAST(starts_with(c, chr(10)) AS INTEGER) ELSE greatest(1, line + CAST(starts_with(c, chr(10)) AS INTEGER) - CASE WHEN o = '' THEN 0 ELSE {_NL.format('o')} + 1 END) END AS INTEGER) AS start_line,
  CAST(line + {nl} AS INTEGER) AS end_line FROM tailed)"""


from ..functions.separators import CHAINS, chain_for  # noqa: E402

_DOCS = _levels("documents", "doc_id", "text", CHAINS[""], 1000)
_DARK = "strlen(translate({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))"
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)"
_TRIMMED = f"""piece AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM m0),
placed AS (SELECT id, k, trim(c, {_BLANK}) AS t, 1 + coalesce(sum({_NL.format('c')}) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + {_NL.format('c')} - {_NL.format(f'ltrim(c, {_BLANK})')} AS line FROM piece),
dark AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, t, lag(t) OVER (PARTITION BY id ORDER BY k) AS before, line FROM placed WHERE t <> ''),
tailed AS (SELECT *, CASE WHEN strlen(before) <= 300 THEN before ELSE (SELECT max(right(before, x)) FROM range(1, 301) r(x) WHERE x <= length(before) AND strlen(right(before, x)) <= 300 AND (x = length(before) OR strlen(right(before, x + 1)) > 300)) END AS o FROM dark),
lined AS (SELECT id, CAST(k - 1 AS INTEGER) AS chunk_index, CASE WHEN k = 1 THEN t ELSE o || chr(10) || t END AS content,
  CAST(CASE WHEN k = 1 THEN line ELSE greatest(1, line - {_NL.format('o')} - 1) END AS INTEGER) AS start_line, CAST(line + {_NL.format('t')} AS INTEGER) AS end_line FROM tailed)"""
SQL = {
    "language_for_path": f"WITH {_FILES} SELECT doc_id, path, language FROM l",
    "grammar_supported": f"WITH {_FILES} SELECT doc_id, language, {_HAS} AS has_grammar FROM l",
    "nonwhite_bytes": f"SELECT doc_id, CAST(strlen(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS INTEGER) AS n_bytes, CAST(CASE WHEN text = '' THEN 0 ELSE {_NL.format('text')} + 1 END AS INTEGER) AS n_lines FROM documents",
    "byte_alignment": """WITH d AS (SELECT doc_id, unnest(range(0, strlen(text) + 1, 7)) AS o FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS k FROM documents WHERE text <> ''),
b AS (SELECT doc_id, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM c UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NOT NULL)
SELECT d.doc_id, CAST(o AS INTEGER) AS byte_offset, CAST(u.e AS INTEGER) AS up, CAST(w.e AS INTEGER) AS down
FROM d ASOF JOIN b u ON d.doc_id = u.doc_id AND d.o <= u.e ASOF JOIN b w ON d.doc_id = w.doc_id AND d.o >= w.e""",
    "split_lines": f"SELECT doc_id, CAST(generate_subscripts({_keep('text', chr(10))}, 1) - 1 AS INTEGER) AS piece_index, unnest({_keep('text', chr(10))}) AS piece FROM documents",
    "merged_lines": f"WITH p AS (SELECT doc_id, {_merge(_keep('text', chr(10)), 500)} AS cs FROM documents WHERE text <> '') SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS piece_index, unnest(cs) AS piece FROM p",
    "hard_splits": """WITH RECURSIVE p AS (SELECT doc_id, 0 AS i, text AS rest FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, i + 1, right(rest, length(rest) - (SELECT max(k) FROM range(1, 501) t(k) WHERE k <= length(rest) AND (strlen(left(rest, k)) <= 500 OR k = 1))) FROM p WHERE strlen(rest) > 500)
SELECT doc_id, CAST(i AS INTEGER) AS piece_index, left(rest, (SELECT max(k) FROM range(1, 501) t(k) WHERE k <= length(rest) AND (strlen(left(rest, k)) <= 500 OR k = 1))) AS piece FROM p""",
    "separator_chains": f"""WITH {_FILES} SELECT doc_id, CAST(CASE language {' '.join(f"WHEN '{v}' THEN {len(chain_for(v))}" for v in sorted(set(EXTENSIONS.values())))} ELSE 4 END AS INTEGER) AS n_separators,
CASE language {' '.join("WHEN '%s' THEN '%s'" % (v, chain_for(v)[0].replace("'", "''")) for v in sorted(set(EXTENSIONS.values())))} ELSE chr(10) || chr(10) END AS first_separator FROM l""",
    "chunk_documents_default": f"WITH {_DOCS},\n{_lined(200)} SELECT id AS doc_id, chunk_index, 'fallback' AS strategy, content, start_line, end_line FROM lined",
    "chunk_documents_plain": f"WITH {_DOCS},\n{_lined(0)} SELECT id AS doc_id, chunk_index, content, start_line, end_line FROM lined",
    "chunk_stats_by_lang": f"WITH {_DOCS},\n{_lined(200)} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(id) AS n_chunks, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes FROM documents LEFT JOIN lined ON doc_id = id GROUP BY lang",
    "chunk_pages_html": f"WITH {_levels('pages', 'page_id', 'html', CHAINS['html'], 1000)},\n{_lined(200)} SELECT id AS page_id, chunk_index, 'langchain' AS strategy, content, start_line, end_line FROM lined",
    "split_strategy": f"WITH {_FILES} SELECT language, CASE WHEN doc_id % 5 = 0 THEN 'langchain' WHEN {_HAS} THEN 'ast' ELSE 'fallback' END AS strategy, count(*) AS n_files FROM l GROUP BY ALL",
    "ast_files": f"""WITH {_levels("documents", "doc_id", "text", CHAINS["go"], 2500, _DARK)},
{_TRIMMED} SELECT id AS doc_id, 'ast' AS strategy, chunk_index, content, start_line, end_line FROM lined""",
    "nested_chunks": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, list_concat(['package p' || chr(10)], list_transform(range(0, CAST(ceil(len(w) / 25.0) AS BIGINT)), lambda i: chr(10) || 'func f' || i || '() {{' || chr(10) || chr(9) || 'print("'
      || array_to_string(w[i * 25 + 1 : i * 25 + 25], ' ') || '")' || chr(10) || '}}' || chr(10))) AS units FROM w),
m0 AS (SELECT doc_id AS id, CASE WHEN {_DARK.format("array_to_string(units, '')")} <= 2500 THEN [array_to_string(units, '')] ELSE {_merge("units", 2500, _DARK)} END AS cs FROM u),
{_TRIMMED} SELECT id AS doc_id, 'ast' AS strategy, chunk_index, content, start_line, end_line FROM lined""",
}
