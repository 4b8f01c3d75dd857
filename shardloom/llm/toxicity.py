"""Toxicity by non-negative positive-unlabelled learning on confirmed toxic examples and unlabelled text.

Executors turn the sampled texts into term numbers; one task fits the model on them (bounded by Bounds);
only the model, 4 MiB, comes to the driver. Every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import expand, squeeze
from .common import LOWER, slices, small_batches, spare, span_hashes, table, texts, tidied, words

BINS = 1 << 20  # hashed terms
PREFIXES = (4, 5, 6)
TOP = 6
SHRINK = 3.0


@dataclass(frozen=True)
class Bounds:
    """What a model is fitted on, at most: documents taken by a hash of doc_id, and the terms of all of them.

    These bound the sample of a fit only. Labels, the prior and scores cover all rows.
    """

    positives: int = 4000
    unlabelled: int = 6000
    terms: int = 8_000_000


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the distinct terms of all texts, and n + 1 offsets: whole words, and their first 4, 5 and 6 bytes.

    A-Z count as a-z; marks at the ends of a word don't count.
    """
    body, at = texts(column)
    doc, first, end, _ = words(body, at)
    if len(first):
        mark = _MARK[body]
        for _ in range(3):
            first = np.where((first < end) & mark[np.minimum(first, len(body) - 1)], first + 1, first)
            end = np.where((first < end) & mark[end - 1], end - 1, end)
        full = first < end
        doc, first, end = doc[full], first[full], end[full]
    value = LOWER[body]
    parts = [span_hashes(value, first, end)]
    docs = [doc]
    for k in PREFIXES:
        long = end - first > k
        parts.append(span_hashes(value, first[long], first[long] + k) + np.uint64(k))
        docs.append(doc[long])
    both = np.unique(np.concatenate(docs).astype(np.int64) * BINS + (np.concatenate(parts) % np.uint64(BINS)).astype(np.int64))
    return (both % BINS).astype(np.int32), np.searchsorted(both // BINS, np.arange(len(at)))


_MARK = np.zeros(256, bool)
_MARK[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def shape(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text's term weights: the largest, means of the larger ones, how many stand out, and the length."""
    out = np.zeros((len(at) - 1, TOP + 5))
    for i in range(len(at) - 1):
        w = weights[at[i] : at[i + 1]]
        if not len(w):
            continue
        top = -np.sort(-w)[:40]
        out[i, : min(TOP, len(top))] = top[:TOP]
        out[i, TOP:] = top.sum() / 40, (w > 1.0).sum() ** 0.5, (w > 1.0).sum() / len(w) ** 0.5, w.mean(), np.log1p(len(w))
    return out


@dataclass
class Model:
    weights: np.ndarray  # of each bin
    mean: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        bins, at = terms(column)
        x = (shape(self.weights[bins], at) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.slope + self.offset, -35, 35)))


def association(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int) -> np.ndarray:
    """Log ratio of how often terms stand in positives and how often their share of unlabelled texts has them there."""
    return np.log((p + SHRINK) / (u * (positives / max(1, unlabelled)) + SHRINK))


Texts = tuple[np.ndarray, np.ndarray]  # bins of the terms of texts behind one another, and n + 1 offsets


def blank() -> Model:
    """Scores everything 0."""
    size = TOP + 5
    return Model(np.zeros(BINS, np.float32), np.zeros(size), np.ones(size), np.zeros(size), -35.0)


def risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """d risk / d score of positives and of unlabelled texts, for
    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]), l logistic.

    When the second part turns negative its gradient is reversed, so that it does not overfit.
    """
    n, m = len(zp), max(1, len(zu))
    rest = (np.logaddexp(0, zu).mean() if len(zu) else 0.0) - prior * np.logaddexp(0, zp).mean()
    down, up = _sigmoid(zu) / m, prior * _sigmoid(zp) / n  # gradients of E_u[l(-)] and prior * E_p[l(-)]
    return (prior * (_sigmoid(zp) - 1) / n - up, down) if rest >= 0 else (up, -down)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _descend(x: np.ndarray, n: int, prior: float, slope: np.ndarray, offset: float, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on the risk of a linear score; the first n rows of x are positives."""
    first, second = np.zeros(len(slope) + 1), np.zeros(len(slope) + 1)
    for t in range(1, steps + 1):
        z = x @ slope + offset
        gp, gu = risk_gradient(z[:n], z[n:], prior)
        g = np.append(x[:n].T @ gp + x[n:].T @ gu + decay * slope, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        slope, offset = slope - step[:-1], offset - step[-1]
    return slope, offset


def _pull(weights: np.ndarray, at: np.ndarray, slope: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """d risk / d weight of each term of each text, through the parts of `shape` that have a gradient. pull: d risk / d score."""
    out = np.zeros(len(weights), np.float32)
    for i in np.flatnonzero(np.diff(at)):
        a, b = at[i], at[i + 1]
        order = np.argsort(-weights[a:b], kind="stable")[:40]
        out[a:b] = slope[TOP + 3] / (b - a)
        out[a + order] += slope[TOP] / 40
        out[a + order[:TOP]] += slope[: min(TOP, len(order))]
        out[a:b] *= pull[i]
    return out


def fit(positive: Texts, unlabelled: Texts, prior: float, rounds: int = 3, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, reach: float = 0.3) -> Model:
    """A model that minimises the non-negative risk (see risk_gradient) over term weights and a linear score of their shape.

    Weights start at the log ratio of `association`, of which a text's own counts are left out while
    fitting. In each round the score descends the risk, then each weight that it moves takes a step
    of at most `reach` against its own gradient, in proportion to the largest. Without positives, or
    with a prior of 0, everything scores 0.
    """
    (pb, pa_), (ub, ua) = positive, unlabelled
    n, m = len(pa_) - 1, len(ua) - 1
    if not n or prior <= 0:
        return blank()
    p, u = np.bincount(pb, minlength=BINS).astype(np.float32), np.bincount(ub, minlength=BINS).astype(np.float32)
    own = association(p[pb] - 1, u[pb], n, m).astype(np.float32), association(p[ub], u[ub] - 1, n, m).astype(np.float32)
    moved = np.zeros(BINS, np.float32)
    slope, offset = np.zeros(TOP + 5), 0.0
    for r in range(rounds + 1):
        wp, wu = own[0] + moved[pb], own[1] + moved[ub]
        x = np.concatenate([shape(wp, pa_), shape(wu, ua)])
        if r == 0:
            mean, scale = x.mean(0), x.std(0) + 1e-6
        x = (x - mean) / scale
        slope, offset = _descend(x, n, prior, slope, offset, steps, rate, decay)
        z = x @ slope + offset
        if r == rounds:
            break
        gp, gu = risk_gradient(z[:n], z[n:], prior)
        g = np.bincount(pb, _pull(wp, pa_, slope / scale, gp), BINS) + np.bincount(ub, _pull(wu, ua, slope / scale, gu), BINS)
        moved -= (reach * g / (np.abs(g).max() + 1e-12)).astype(np.float32)
    offset -= threshold(z[:n], z[n:], prior)
    return Model((association(p, u, n, m) + moved).astype(np.float32), mean, scale, slope, float(offset))


def threshold(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """Where the same risk estimate with 0-1 loss is least; the middle of the widest gap among equals."""
    edges = np.unique(np.concatenate([zp, zu]))
    edges = np.concatenate([[edges[0] - 2], edges, [edges[-1] + 2]])
    cuts, gap = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    hit = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    called = 1 - np.searchsorted(np.sort(zu), cuts) / max(1, len(zu))
    risk = prior * (1 - hit) + np.maximum(0, called - prior * hit)
    near = np.flatnonzero(risk <= risk.min() + 0.02 * prior)
    return float(cuts[near[np.argmax(gap[near])]])


SAMPLED = "spread long, positive boolean, unlabelled boolean, n int, bins binary"


def sample(docs: DataFrame, positives: DataFrame, bounds: Bounds) -> DataFrame:
    """SAMPLED of the documents that a model is fitted on: the smallest hashes of doc_id, of positives and of all.

    Null texts and ids are not learned from. Of rows that repeat an id the least text counts.
    """
    some = docs.where("doc_id is not null").select("doc_id")

    def pick(ids: DataFrame, most: int) -> DataFrame:
        """The `most` smallest hashes; what is far above them is left out before the sort."""
        spread, about = F.xxhash64("doc_id"), ids.agg(F.approx_count_distinct("doc_id")).first()[0]
        edge = min((1 << 63) - 1, int((1.5 * most + 100) / max(1, about) * (1 << 64)) - (1 << 63))
        return ids.where(spread <= edge).distinct().orderBy(spread, "doc_id").limit(most)

    yes, no = F.lit(True), F.lit(False)
    chosen = pick(positives, bounds.positives).select("doc_id", yes.alias("positive"), no.alias("unlabelled")).unionByName(pick(some, bounds.unlabelled).select("doc_id", no.alias("positive"), yes.alias("unlabelled")))
    chosen = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bins, at = terms(part.column("text"))
            sets = [squeeze(bins[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("spread"), part.column("positive"), part.column("unlabelled"), pa.array(np.diff(at), pa.int32()), pa.array(sets, pa.binary())], ["spread", "positive", "unlabelled", "n", "bins"])

    return found.select(F.xxhash64("doc_id").alias("spread"), "positive", "unlabelled", "text").mapInArrow(tidied(run), SAMPLED)


def learn(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """A model of docs (doc_id, text) from labels (doc_id, toxic).

    Labels count only where crc32(doc_id as text) mod 5 is not 0. Positives are documents labelled 1;
    unlabelled ones are drawn from all documents, labels unseen. The prior is the share of 1 among
    the labels that count. One task fits, on at most `bounds`.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = sample(docs, known.where("toxic = 1").select("doc_id"), bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        total = 0
        for batch in batches:  # by hash, so that a bound on terms cuts alike everywhere
            for row in batch.to_pylist():
                total += row["n"]
                if held and total > bounds.terms:
                    break
                held.append(row)
        model = fit(_side(held, "positive"), _side(held, "unlabelled"), prior)
        parts = [squeeze(x) for x in (model.weights, model.mean, model.scale, model.slope, np.array([model.offset]))]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    fitted = rows.repartition(1).sortWithinPartitions("spread", "n", "bins").mapInArrow(tidied(run), "part binary")  # bounded
    parts = [bytes(x.part) for x in fitted.collect()]
    return Model(expand(parts[0], np.float32), *(expand(x, np.float64) for x in parts[1:4]), float(expand(parts[4], np.float64)[0])) if parts else blank()


def _side(rows: list[dict], name: str) -> Texts:
    bins = [expand(r["bins"], np.int32) for r in rows if r[name]]
    return np.concatenate([np.zeros(0, np.int32), *bins]), np.cumsum([0, *map(len, bins)])


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a toxicity score from 0 to 1 of the whole text; null is the empty text.

    A column of docs named like the result is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights: 4 MiB, whatever the corpus

    @F.arrow_udf("double")
    @tidied
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            whole = pa.RecordBatch.from_arrays([batch], ["text"])
            yield pa.concat_arrays([pa.array(shared.value.scores(x.column("text"))) for x in slices([whole], "text")] or [pa.array([], pa.float64())])

    return small_batches(docs).withColumn(column, run(F.col(text)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """docs without those whose score is 0.5 or more; null and empty texts are scored like any other."""
    own = spare(docs, "_score")
    return score(docs, learn(docs, labels, bounds), column=own).where(F.col(own) < 0.5).drop(own)
