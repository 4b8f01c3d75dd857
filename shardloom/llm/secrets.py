"""Secret scans: fixed forms, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spare, table, tidied

# The base forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the leftmost match of AKIA[A-Z0-9]+ with 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Entropy:
    """Windows of `window` characters; bits a character from which a window of a class is a secret.

    Each class has its own alphabet: hex digits of one case; letters and digits; those and + / _ = -.
    Base spans and `parts` are cut out of a candidate; what is left of it on either side is judged
    alone, and passed over if an `allowed` pattern matches it whole. In a stretch, the runs of each
    class are judged by that class.
    """

    window: int = 20
    bits: dict = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.7, "base64": 3.9})
    allowed: tuple = (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9]+",
        r"[A-Za-z+/_=-]+",  # words, run together or joined by marks
        r"(?:[A-Za-z]+[-_/])*[A-Za-z]*[0-9]{1,4}",  # names with a number behind
    )
    parts: tuple = (
        r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",  # UUID
        r"(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2,6}Z?)?(?![0-9A-Za-z])",  # dates
        r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",  # a vendor's documented key
        r"EXAMPLE(?:KEY)?|examples?",
        r"(?:0123456789abcdef|0123456789|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)+",
    )

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """allowed, to match whole, and parts, to search."""
        return tuple(re.compile("|".join(f"(?:{x})" for x in group) or r"(?!)") for group in (self.allowed, self.parts))


CLASSES = {"hex": re.compile(r"[0-9a-f]+|[0-9A-F]+"), "alnum": re.compile(r"[0-9A-Za-z]+"), "base64": re.compile(r"[A-Za-z0-9+/_=-]+")}


def hot_windows(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Spans covered by windows with `least` bits a character or more: windows that overlap or touch are one span.

    Counts go down and up by one character a step: with S the sum of c * log2(c), H = log2(w) - S / w.
    """
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, whole, out = 0.0, math.log2(window), []
    for i, ch in enumerate(text):
        if i >= window:  # the old one first: no count exceeds the window
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += cost[c - 1] - cost[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += cost[c + 1] - cost[c]
        if i >= window - 1 and whole - total / window >= least - 1e-9:
            if out and out[-1][1] >= i - window + 1:
                out[-1][1] = i + 1
            else:
                out.append([i - window + 1, i + 1])
    return [(s, e) for s, e in out]


def entropy_spans(text: str, start: int, end: int, entropy: Entropy) -> list[tuple[str, int, int]]:
    """Hot spans of text[start:end] by class; a span inside one of a narrower class is left out."""
    out: list[tuple[str, int, int]] = []
    for kind, alphabet in CLASSES.items():
        inner, at = union([(s, e) for _, s, e in out]), 0
        for run in alphabet.finditer(text, start, end):
            if run.end() - run.start() < entropy.window:
                continue
            for s, e in hot_windows(run[0], entropy.window, entropy.bits[kind]):
                s, e = run.start() + s, run.start() + e
                while at < len(inner) and inner[at][1] <= s:
                    at += 1
                if not (at < len(inner) and inner[at][0] <= s and e <= inner[at][1]):
                    out.append((f"entropy_{kind}", s, e))
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same places."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def stretches(start: int, end: int, gone: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What disjoint spans in order leave of start to end."""
    for s, e in gone:
        if s > start:
            yield start, min(s, end)
        start = max(start, e)
    if start < end:
        yield start, end


def find_secrets(text: str, entropy: Entropy, patterns: tuple[re.Pattern, re.Pattern] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: base spans, then entropy spans beside them. Time grows with the length of the text alone."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate((*BASE_KINDS, "entropy_hex", "entropy_alnum", "entropy_base64"))}
    allowed, parts = patterns or entropy.patterns()
    base, at = union([(s, e) for _, s, e in found]), 0
    more = []
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        gone, k = [x.span() for x in parts.finditer(text, m.start(), m.end())], at
        while k < len(base) and base[k][0] < m.end():
            gone.append(base[k])
            k += 1
        gone = union(gone)
        for start, end in stretches(m.start(), m.end(), gone):
            if end - start < entropy.window:
                continue
            own = text[start:end]
            if not allowed.fullmatch(own if not gone else own.strip("+/_=-")):
                more += entropy_spans(text, start, end, entropy)
    return sorted(found + more, key=lambda x: (x[1], order[x[0]], x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, text: str = "text", entropy: Entropy = Entropy(), column: str = "secrets") -> DataFrame:
    """docs with a column of secret spans (kind, start, end; code points, end exclusive) by start.

    Null and empty texts have no spans; repeated rows are judged alike; other columns stay as they
    are, but one named like the result is replaced.
    """

    @F.arrow_udf(SPANS)
    @tidied
    def spans(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = entropy.patterns()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in values:
            yield pa.array([[dict(zip(("kind", "start", "end"), x)) for x in find_secrets(t.as_py() or "", entropy, patterns)] for t in batch], kind)

    return small_batches(docs).withColumn(column, spans(F.col(text)))


def redact(docs: DataFrame, mark: str = "[REDACTED]", entropy: Entropy = Entropy()) -> DataFrame:
    """docs with every secret span of text replaced by `mark` (spans that overlap or touch by one); n_chars, if there, follows the text.

    Null stays null, and texts without secrets stay as they are.
    """

    @F.arrow_udf("string")
    @tidied
    def clean(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = entropy.patterns()

        def one(text: str | None) -> str | None:
            spans = union([(s, e) for _, s, e in find_secrets(text, entropy, patterns)]) if text else []
            return mark.join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)])) if spans else text

        for batch in values:
            yield pa.array([one(t.as_py()) for t in batch], pa.string())

    own = spare(docs, "_clean")
    out = small_batches(docs).withColumn(own, clean(F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col(own).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length(own).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(own)).drop(own)


def base_digests(found: DataFrame, column: str = "secrets") -> DataFrame:
    """found (a result of `scan`) with the number of base spans of each kind, a digest of them, and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(column, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    return found.withColumns({**{f"n_{k}": count(k) for k in BASE_KINDS}, "base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(F.col(column))})


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digest of base spans, and all spans, of every row of `documents`; see `scan`."""
    found = base_digests(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans")
