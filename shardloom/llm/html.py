"""HTML extraction: flat text blocks, word count and link density of a block and its neighbours, a decision tree."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

# Fixed values of the markup.
SKIPPED = frozenset("script style noscript template svg head title iframe object canvas audio video textarea select button option".split())
RAW = frozenset("script style textarea title noscript iframe".split())  # no tags inside
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("svg a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow ms msqrt mspace msub msubsup msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FRAME = frozenset("nav header footer aside form menu dialog".split())  # what stands around an article
BODY = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FRAME_NAMES = re.compile(r"(?i)\b(?:nav|navbar|menu|header|masthead|footer|sidebar|side|aside|widget|related|breadcrumbs?|share|social|promo|sponsor(?:ed)?|banner|ads?|advert\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|form|comments?|replies|reply|disqus|respond|pagination|pager|tags?|toolbar|copyright|legal|disclaimer)\b")
COMMENT_NAMES = re.compile(r"(?i)\b(?:comments?|replies|reply|disqus|respond)\b")
BODY_NAMES = re.compile(r"(?i)\b(?:article|post|entry|story|content|body|main|text)\b")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str = ""
    words: int = 0
    linked: int = 0
    frame: bool = False  # inside an element, or a class or id, that frames a page
    body: bool = False  # inside an element, or a class or id, that holds an article
    heading: bool = False
    item: bool = False
    parts: list = field(default_factory=list)
    within: int = -1  # number of the innermost framing element around it


@dataclass
class Frame:
    """An element that frames a page, by the blocks in front of its begin and its end. doubtful: by a name only; holds: the name is an article's too."""

    outer: int
    begin: int
    doubtful: bool
    holds: bool
    end: int = -1


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; white space is one space, references are decoded."""
    out: list[Block] = []
    frames: list[Frame] = []
    # name, skipped, innermost framing element, whether one around holds an article, heading, item, links, number of its own frame
    stack: list[tuple[str, str, int, bool, bool, bool, int, int]] = []
    opened: dict[str, int] = {}  # how many elements of a name are open
    now = Block()
    at = 0

    def inside() -> tuple:
        return stack[-1] if stack else ("", "", -1, False, False, False, 0, -1)

    def close() -> None:
        nonlocal now
        whole = SPACE.sub(" ", html.unescape("".join(x for x, _ in now.parts))).strip()
        if whole:
            now.text, now.words = whole, len(whole.split(" "))
            now.linked = len(html.unescape("".join(x for x, l in now.parts if l)).split())
            now.parts = []
            out.append(now)
        now = Block()

    def put(raw: str) -> None:
        if not raw or inside()[1]:
            return
        if not now.parts:
            now.within, now.body, now.heading, now.item = inside()[2:6]
        now.parts.append((raw, inside()[6] > 0))

    def leave(depth: int) -> None:
        """Takes the elements from a depth on off the stack."""
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone[0]] -= 1
            if gone[7] >= 0:
                frames[gone[7]].end = len(out)

    while at <= len(page):
        m = TAG.search(page, at)
        put(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = max(m.end(), at + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name not in INLINE and not inside()[1]:
                close()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened.get(name) else None
            if depth is not None and (name not in INLINE or inside()[1] or all(x[0] in INLINE for x in stack[depth:])):
                leave(depth)
            continue
        if name == "br":
            put(" ")
        if name not in INLINE and name not in RAW and not inside()[1]:
            close()
            if name in CLOSES_P and opened.get("p"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        leave(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            while name == "li" and stack and stack[-1][0] == "li":
                leave(len(stack) - 1)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:  # nothing inside is markup
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            if name not in SKIPPED:
                put(page[at : end.start()])
            at = max(end.end(), at + 1)
            continue
        given = " ".join(next(filter(None, x), "") for x in NAMES.findall(m[3])).replace("_", "-")
        named = bool(given) and name not in ("body", "html") and bool((COMMENT_NAMES if name in BODY else FRAME_NAMES).search(given))
        framing = (name in FRAME or named) and not (name == "header" and inside()[3])  # an article's own heading
        of_article = name in BODY or bool(given and BODY_NAMES.search(given))
        _, skip, within, body, heading, item, links, _ = inside()
        if framing:
            frames.append(Frame(within, len(out), name == "form" or name not in FRAME, of_article))
        stack.append((name, skip or (name if name in SKIPPED else ""), len(frames) - 1 if framing else within, body or (of_article and not framing), heading or name in HEADINGS, item or name in ITEMS, links + (name == "a"), len(frames) - 1 if framing else -1))
        opened[name] = opened.get(name, 0) + 1
    close()
    leave(0)
    _judge_frames(out, frames)
    return out


PROSE = 20  # words outside links: a block of so many is text


def _judge_frames(blocks: list[Block], frames: list[Frame]) -> None:
    """Sets frame and body of blocks: what is framed stays so unless the frame is one by name only and no article text stands outside all frames.

    Then a name misleads if it is an article's too, or if the element holds most of the page's text in three blocks or more.
    """
    if any(b.within < 0 and not b.heading and b.words - b.linked >= PROSE for b in blocks):
        lifted = [False] * len(frames)
    else:
        free = np.concatenate([[0], np.cumsum([b.words - b.linked for b in blocks])]).astype(int)
        held = [int(free[f.end] - free[f.begin]) for f in frames]
        lifted = [f.doubtful and (h >= PROSE if f.holds else f.end - f.begin >= 3 and h >= 3 * PROSE and 2 * h > free[-1]) for f, h in zip(frames, held)]
    framed, holds = [], []
    for f, off in zip(frames, lifted):  # outer frames come first
        framed.append(not off or (f.outer >= 0 and framed[f.outer]))
        holds.append((off and f.holds) or (f.outer >= 0 and holds[f.outer]))
    for b in blocks:
        if b.within >= 0:
            b.frame, b.body = framed[b.within], b.body or holds[b.within]


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "frame", "body", "heading", "item")


def features(blocks: list[Block], page_has_body: bool) -> np.ndarray:
    """A row of FEATURES for each block; `body` is 1 inside an article, 0 beside one, 0.5 where a page marks none."""
    rows = []
    for i, b in enumerate(blocks):
        near = [blocks[j] if 0 <= j < len(blocks) else None for j in (i - 1, i + 1)]
        shape = [x for n in (b, *near) for x in ((n.words, n.linked / n.words) if n else (0, 0))]
        rows.append([*shape, b.frame, (1.0 if b.body else 0.0) if page_has_body else 0.5, b.heading, b.item])
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


# The labelled table: words, link density, the same before and after, frame, body, heading, item; 1: article text.
# Short link-dense blocks of an article are out; framed ones are out at any length; long link-free ones without a mark are in.
LABELLED = """
40 0 12 0 60 0 0 1 0 0 1|95 .02 60 0 80 .01 0 1 0 0 1|6 0 8 0 70 0 0 1 1 0 1|1 0 90 0 80 0 0 1 0 0 1|2 0 1 0 1 0 0 1 0 0 1
12 0 3 1 40 0 0 1 1 0 1|250 0 1 0 0 0 0 1 0 0 1|30 .1 40 0 6 1 0 1 0 0 1|5 0 4 0 5 0 0 1 0 1 1|18 .3 20 0 20 0 0 1 0 1 1
55 0 70 0 9 .5 0 1 0 0 1|3 0 60 0 0 0 0 1 0 0 1|14 0 0 0 50 0 0 1 0 0 1|8 .2 30 0 30 .1 0 1 0 0 1|1 0 1 0 1 0 0 1 0 0 1
20 1 30 0 40 0 0 1 0 0 1|25 .9 40 0 30 0 0 1 0 0 1|7 0 2 1 90 0 0 1 1 0 1|22 0 9 0 2 1 0 1 0 0 1|60 .5 60 0 60 0 0 1 0 0 1
7 1 0 0 60 0 0 1 1 0 1|6 1 50 0 70 0 0 1 1 0 1|9 1 3 1 45 0 0 1 1 0 1|4 0 5 1 6 1 0 1 0 0 1|2 0 1 1 3 1 0 1 1 0 1
4 1 50 0 60 0 0 1 0 0 0|3 1 4 1 3 1 0 1 0 1 0|5 1 40 0 4 1 0 1 0 0 0|6 .8 5 1 30 0 0 1 0 0 0|2 1 2 1 60 0 0 1 0 0 0
8 .9 7 1 0 0 0 1 0 1 0|1 1 1 1 1 1 0 1 0 1 0|10 .8 6 1 8 .9 0 1 0 0 0|1 1 90 0 80 0 0 1 0 0 0|7 1 70 0 0 0 0 1 0 1 0
1 1 0 0 1 1 1 0 0 1 0|1 1 1 1 1 1 1 0 0 1 0|2 1 1 1 12 0 1 0 0 1 0|12 0 2 1 40 0 1 0 0 0 0|60 0 3 1 2 1 1 0 0 0 0
9 0 80 0 0 0 1 0 0 0 0|6 0 90 0 0 0 1 0 0 0 0|5 .5 40 0 3 1 1 1 0 0 0|20 0 60 0 3 1 1 1 0 0 0|3 0 0 0 8 0 1 0 1 0 0
25 0 9 0 12 0 1 .5 0 0 0|4 1 4 1 4 1 1 .5 0 1 0|50 0 0 0 4 1 1 .5 0 0 0|7 0 60 0 3 0 1 0 0 0 0|15 .2 6 0 10 0 1 1 0 0 0
14 0 70 0 80 0 1 1 0 0 0|16 0 5 1 90 0 1 0 0 0 0|45 .6 50 .5 40 .7 1 0 0 0 0|80 .7 60 .6 70 .8 1 1 0 0 0|10 0 1 1 9 0 1 0 0 0 0
60 0 50 0 40 0 1 0 0 0 0|45 0 60 0 35 0 1 1 0 0 0|80 0 70 0 60 0 1 .5 0 0 0|45 0 50 0 60 0 1 0 0 0 0|90 .05 40 0 0 0 1 0 0 0 0
55 0 5 0 70 0 1 .5 0 0 0|70 0 60 0 80 0 1 1 0 0 0|120 0 45 0 3 1 1 0 0 0 0|65 .1 4 1 80 0 1 0 0 0 0|50 0 55 0 45 .1 1 1 0 0 0
8 .9 0 0 40 0 0 0 0 0 0|3 1 3 1 3 1 0 0 0 1 0|10 0 60 0 0 0 0 0 0 0 0|50 0 6 0 6 .5 0 0 0 0 0|4 0 0 0 5 1 0 0 1 0 0
20 0 9 0 30 0 0 0 0 0 0|2 .5 3 1 60 0 0 0 0 0 0|30 .1 8 0 8 1 0 0 0 0 0|1 0 5 0 5 0 0 0 0 0 0|60 0 4 1 3 1 0 0 0 0 0
120 0 40 0 9 0 0 0 0 0 1|60 0 50 0 70 0 0 0 0 0 1|45 0 60 0 50 0 0 0 0 0 1|80 .05 0 0 55 0 0 0 0 0 1|70 .1 90 0 4 1 0 0 0 0 1
60 0 40 0 50 0 0 .5 0 0 1|35 .05 5 0 45 0 0 .5 0 0 1|90 .1 80 0 4 1 0 .5 0 0 1|25 0 70 0 60 .1 0 .5 0 0 1|8 0 4 1 50 0 0 .5 1 0 1
5 1 4 1 6 1 0 .5 0 0 0|2 1 2 1 2 1 0 .5 0 1 0|3 .7 2 1 30 0 0 .5 0 0 0|6 .8 60 0 5 .9 0 .5 0 0 0|10 .6 9 .8 7 1 0 .5 0 1 0
60 0 1 1 12 0 0 .5 0 0 1|50 0 70 0 4 0 0 .5 0 0 1|45 0 1 1 10 0 0 .5 0 0 1|70 0 6 1 5 0 0 .5 0 0 1|55 0 60 0 2 1 0 .5 0 0 1
60 0 70 0 4 0 0 0 0 0 1|48 0 55 0 3 1 0 0 0 0 1|62 .1 45 0 8 0 0 0 0 0 1|60 0 70 0 2 0 1 0 0 0 0|61 0 71 0 1 1 1 0 0 0 0
48 0 90 0 4 .5 1 1 0 0 0|40 0 3 1 2 1 1 0 0 0 0|50 0 9 0 3 0 1 0 0 0 0|55 0 2 1 4 0 1 .5 0 0 0|16 0 80 0 1 1 1 .5 0 0 0
70 0 4 1 60 0 0 0 0 0 1|60 0 1 1 50 0 0 0 0 0 1|45 0 3 1 70 0 0 0 0 0 1|60 0 1 1 55 0 1 0 0 0 0|50 0 2 1 80 0 1 0 0 0 0
9 0 40 0 1 1 0 1 0 0 1|12 0 25 0 0 0 0 1 0 0 1|15 0 7 0 2 0 0 1 0 0 1|6 0 30 0 1 0 0 1 0 0 1|18 0 9 0 0 0 0 1 0 0 1
5 0 6 0 2 0 0 1 0 0 1|30 0 12 0 8 0 0 1 0 0 1|45 0 1 1 9 0 0 1 0 0 1|10 0 8 0 12 0 0 1 1 0 1|28 0 3 0 1 0 0 1 0 0 1
4 0 3 1 2 1 0 .5 0 0 0|6 .3 5 1 0 0 0 .5 0 0 0|7 0 40 0 50 0 0 .5 0 0 1|12 0 60 0 45 0 0 .5 0 0 1|9 .1 30 0 25 0 0 .5 0 1 1
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(v) for v in r.split()] for r in LABELLED.replace("\n", "|").split("|") if r.strip()])
    return rows[:, :-1], rows[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, low, high) or (share of class 1,)."""
    share = y.mean()
    if depth == 0 or share in (0, 1) or len(y) < 2 * least:
        return (float(share),)
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        k = np.arange(1, len(y))
        cost = k * (q := ones[:-1] / k) * (1 - q) + (len(y) - k) * (r := (ones[-1] - ones[:-1]) / (len(y) - k)) * (1 - r)
        cost[(v[1:] == v[:-1]) | (k < least) | (len(y) - k < least)] = np.inf
        i = int(np.argmin(cost))
        if np.isfinite(cost[i]) and (best is None or cost[i] < best[0] - 1e-12):
            best = (cost[i], j, (v[i] + v[i + 1]) / 2)
    if best is None:
        return (float(share),)
    _, j, cut = best
    low = x[:, j] < cut
    return (j, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    j, cut, low, high = tree
    return np.where(x[:, j] < cut, judge(low, x), judge(high, x)) if len(x) else np.zeros(0)


@functools.cache
def default_tree() -> tuple:
    return grow(*labelled())


def main_text(page: str, tree: tuple) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    keep = judge(tree, features(found, any(b.body for b in found))) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, source: str = "html", column: str = "text", tree: tuple | None = None) -> DataFrame:
    """pages with the main text of their HTML.

    Null and empty pages, and such without article text, give an empty text. Broken or cut-off
    markup ends where the page ends. A column of pages named like the result is replaced.
    """
    tree = tree or default_tree()

    @F.arrow_udf("string")
    @tidied
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield pa.array([main_text(v.as_py() or "", tree) for v in batch], pa.string())

    return small_batches(pages).withColumn(column, run(F.col(source)))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`; see `extract`."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
