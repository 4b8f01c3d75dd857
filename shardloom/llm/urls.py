"""URL filters: rules by longest match, then a listed-URL set behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table

# Rules (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# The default list of canonical URLs, a parameter of op5: host names of a kind under each domain, folders, pages, and numbered hosts by rule.
BAD_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BAD_DOMAINS = ("example.com", "example.net", "example.org")
BAD_FOLDERS = ("example.com/ads/", "example.org/popup/", "mirror.example.com/en/copies/", "example.org/win.html")
NUMBERED = 5000  # hosts t0, t1, ... of tracker.example
LISTED = (*(f"{n}.{d}/" for n in BAD_NAMES for d in BAD_DOMAINS), *BAD_FOLDERS, *(f"t{i}.tracker.example/" for i in range(NUMBERED)))

BLOCK_WORDS = 4  # 64-bit words in a block
PROBES = 6
MAX_BLOCKS = 1 << 17  # bounds the broadcast filter to 4 MiB of words; a fuller filter only passes more hits on


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # a later, longer rule wins
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def canonical(host: Column, path: Column, host_most: Column, path_most: Column) -> Column:
    """All forms that can be listed: the host and its parent domains, with the whole path and every folder above it.

    host_most, path_most: characters of the longest listed host and path. Longer forms are in no list
    and are not made, so work is bounded by the list, not by the length of a URL.
    """
    labels, last = F.split(F.right(host, host_most + 1), r"\."), F.substr(path, F.lit(1), path_most)
    cut, parts = F.length(host) > host_most, F.split(F.regexp_replace(last, "^/", ""), "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.when(cut, F.slice(parents, F.lit(2), F.size(parents))).otherwise(parents)  # the first label may be a piece of one
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    whole = F.when(F.length(path) <= path_most, F.array(F.concat(F.lit("/"), F.array_join(parts, "/")))).otherwise(F.array().cast("array<string>"))
    forms = lambda x: F.flatten(F.transform(x["hosts"], lambda h: F.transform(x["paths"], lambda p: F.concat(h, p))))
    made = F.transform(F.array(F.struct(hosts.alias("hosts"), F.concat(folders, whole).alias("paths"))), forms)
    return F.array_distinct(F.get(made, F.lit(0)))


def _block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(1)), F.lit(blocks))


def _bits(name: Column, word: int) -> Column:
    """The bits of `name` in one word of its block."""
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        at = F.pmod(F.shiftrightunsigned(F.xxhash64(name, F.lit(2)), 8 * k), F.lit(64 * BLOCK_WORDS))
        out = out.bitwiseOR(F.when(F.floor(at / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return out


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..): the blocked Bloom filter of listed.name; at most MAX_BLOCKS rows."""
    return listed.groupBy(_block(F.col("name"), blocks).alias("block")).agg(*[F.bit_or(_bits(F.col("name"), i)).alias(f"w{i}") for i in range(BLOCK_WORDS)])


def listed_hits(addresses: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct (host, path) of addresses with a listed canonical form.

    The filter, bounded by MAX_BLOCKS, is broadcast and passes possible hits; an exact hash join
    with the list removes the false ones. Null names are ignored.
    """
    listed = listed.where("name is not null").select("name").distinct()
    slash = F.instr("name", "/")
    size, host_most, path_most = listed.agg(F.count("*"), F.coalesce(F.max(slash - 1), F.lit(0)), F.coalesce(F.max(F.length("name") - slash + 1), F.lit(0))).first()
    blocks = int(min(MAX_BLOCKS, max(1, size // 16)))
    all_ = canonical(F.col("host"), F.col("path"), F.lit(host_most), F.lit(path_most))
    forms = addresses.select("host", "path").distinct().select("host", "path", F.explode(all_).alias("name"))
    forms = forms.withColumn("block", _block(F.col("name"), blocks))
    possible = forms.join(F.broadcast(bloom(listed, blocks)), "block")
    for i in range(BLOCK_WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(_bits(F.col("name"), i)) == _bits(F.col("name"), i))
    return possible.select("host", "path", "name").join(listed, "name", "left_semi").select("host", "path").distinct()


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages and host, path, rule, verdict.

    A rule decides if one fits; else a page is blocked if a canonical form of its URL is listed.
    Null URLs and such without :// have empty host and path and are allowed. Rows that repeat stay.
    Columns of pages named like a result are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    fit, hit = spare(found, "_fit"), spare(found, "_listed")
    found = found.withColumn(fit, rule_of(F.col("host"), F.col("path"), rules))
    hits = listed_hits(found.where(F.col(fit).isNull() & (F.col("host") != "")), listed).withColumn(hit, F.lit(True))
    method = F.when(F.col(hit), F.lit("block")).otherwise(F.lit("allow"))
    return found.join(hits, ["host", "path"], "left").select(*kept, "host", "path", F.col(fit)["rule"].alias("rule"), F.coalesce(F.col(fit)["verdict"], method).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`, by RULES and the list LISTED; see `judge`."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "name string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


def _values(names) -> str:
    return ", ".join(f"('{x}')" for x in names)


SQL = f"""
WITH a AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
b AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM a),
listed AS (SELECT n || '.' || d || '/' AS name FROM (VALUES {_values(BAD_NAMES)}) x(n), (VALUES {_values(BAD_DOMAINS)}) y(d)
           UNION ALL SELECT * FROM (VALUES {_values(BAD_FOLDERS)}) UNION ALL SELECT 't' || i || '.tracker.example/' FROM range({NUMBERED}) r(i)),
parts AS (SELECT split_part(name, '/', 1) AS h, substr(name, instr(name, '/')) AS p FROM listed),
hosts AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[i :], '.') AS h FROM (SELECT DISTINCT host FROM b WHERE host <> ''), range(1, 20) r(i) WHERE i <= len(string_split(host, '.'))),
bad AS (SELECT DISTINCT b.page_id FROM b JOIN hosts USING (host) JOIN parts USING (h)
        WHERE b.path = p OR (p LIKE '%/' AND starts_with(CASE WHEN b.path = '' THEN '/' ELSE b.path END, p)))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN page_id IN (SELECT page_id FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM b
"""
