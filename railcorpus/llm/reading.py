"""Reading level of each document (problem 10).

Interpolated n-gram models (words, and Han characters one by one) are trained for every cut between levels: one on the
documents up to the cut, one on those above. A document's surprisal under both, over its full text, tells on which side
it lies; the three comparisons add up to one score, which isotonic regression maps monotonically to the graded scale.

Counts live in hashed tables of fixed size, filled from all labelled documents in parallel. The regression sees scores
from models that did not see the document (two folds) and reads them as bin totals, so nothing grows with the data
on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railcorpus.llm import textform
from railcorpus.llm.arrows import chunks, summed, union_array
from railcorpus.llm.textform import _segments, _splitmix

LEVELS, ORDERS, FOLDS = 4, 3, 2
TEXTS = 512  # documents may be many pages long
WEIGHT = 1e-3  # of the lower order in a model, as a share of the model's tokens
CLIP = 4.0  # bound of one token's say
BINS = 2000


class Grams:
    """Hash of the n-gram of each order that ends at each token, and the rows with tokens."""

    def __init__(self, column) -> None:
        cps, offs, _ = textform.codepoints(column)
        cps, offs = textform.unify(cps, offs)
        cps = textform._take(textform.tables().lower, cps, None)
        start, end, row = textform.token_runs(cps, offs)
        token = textform.token_hashes(cps, start, end)
        self.rows, self.first, self.size = np.unique(row, return_index=True, return_counts=True)
        self.of = np.repeat(np.arange(len(self.rows)), self.size)
        self.hash = [token]
        within = textform._within(self.size)
        for order in range(1, ORDERS):
            past = np.concatenate([np.zeros(order, np.uint64), token[:-order]])[: len(token)]
            past[within < order] = np.uint64(order)  # before the text
            with np.errstate(over="ignore"):
                self.hash.append(_splitmix(self.hash[-1] * np.uint64(0xD6E8FEB86659FD93) ^ past))

    def slots(self, order: int, count: int) -> np.ndarray:
        return (self.hash[order] & np.uint64(count - 1)).astype(np.int64)


def context_slots(g: Grams, count: int) -> list[np.ndarray]:
    """For each order above 0, the slot of the context: the n-gram before the token."""
    out = []
    within = textform._within(g.size)
    for order in range(1, ORDERS):
        before = np.concatenate([np.zeros(1, np.int64), g.slots(order - 1, count)[:-1]])[: len(g.of)]
        before[within == 0] = 0
        out.append(before)
    return out


def levels(labels: DataFrame) -> DataFrame:
    """(doc_id, level, grade) of labelled documents: mean of the median ratings, and it rounded. Null ratings count nothing."""
    rated = labels.where(f"doc_id is not null and level between 1 and {LEVELS}")
    out = rated.groupBy("doc_id").agg(F.expr("percentile(level, 0.5)").alias("level"))
    return out.withColumn("grade", F.floor(F.col("level") + 0.5).cast("int"))


def count_grams(labelled: DataFrame, slots: int) -> np.ndarray:
    """(FOLDS, LEVELS, ORDERS, slots) n-gram counts of labelled (text, grade, fold)."""

    def fill(cells, batch):
        table = cells.view("<u4").reshape(FOLDS, LEVELS, ORDERS, slots)
        g = Grams(batch.column(0))
        grade, fold = batch.column(1).to_numpy()[g.rows], batch.column(2).to_numpy()[g.rows]
        for f in range(FOLDS):
            for k in range(LEVELS):
                pick = ((grade == k + 1) & (fold == f))[g.of]
                for order in range(ORDERS):
                    table[f, k, order] += np.bincount(g.slots(order, slots)[pick], minlength=slots).astype(np.uint32)

    join = lambda a, b, k: summed(a.view("<u4"), b.view("<u4"), k).view("u1")
    cells = union_array(labelled.select("text", "grade", "fold"), fill, 4 * FOLDS * LEVELS * ORDERS * slots, "u1", TEXTS, join)
    return cells.view("<u4").reshape(FOLDS, LEVELS, ORDERS, slots)


def surprisal(g: Grams, counts: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """Nats of each token under the interpolated model of counts (ORDERS, slots): every order falls back on the one below
    by a weight in proportion to the model's tokens, so that contexts rare in it say little."""
    slots = counts.shape[1]
    total = float(counts[0].sum())
    weight = max(WEIGHT * total, 1.0)
    p = (counts[0][g.slots(0, slots)] + 0.5) / (total + 0.5 * slots)
    for order in range(1, ORDERS):
        seen = counts[order - 1][contexts[order - 1]]
        joint = np.minimum(counts[order][g.slots(order, slots)], seen)
        p = (joint + weight * p) / (seen + weight)
    return -np.log(p)


def scores(g: Grams, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score in 1..LEVELS of each row with tokens, and mean and spread of its surprisal under the model of all levels."""
    contexts = context_slots(g, counts.shape[-1])
    score = np.ones(len(g.rows))
    for cut in range(1, LEVELS):
        low, high = counts[:cut].sum(0), counts[cut:].sum(0)
        if not low.any() or not high.any():
            score += 0.0 if low.any() else 1.0
            continue
        gain = np.clip(surprisal(g, low, contexts) - surprisal(g, high, contexts), -CLIP, CLIP)
        mean = _segments(gain, g.first) / g.size
        score += 1 / (1 + np.exp(-4 * mean))
    nats = surprisal(g, counts.sum(0), contexts)
    mean = _segments(nats, g.first) / g.size
    spread = np.sqrt(np.maximum(_segments(nats * nats, g.first) / g.size - mean * mean, 0))
    return score, mean, spread


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares nondecreasing fit of y in the order of x, by pooling adjacent violators."""
    value, weight, span = [], [], []
    for i in np.argsort(x, kind="stable"):
        value.append(y[i])
        weight.append(w[i])
        span.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, u, n = value.pop(), weight.pop(), span.pop()
            value[-1] = (value[-1] * weight[-1] + v * u) / (weight[-1] + u)
            weight[-1] += u
            span[-1] += n
    return np.repeat(value, span)


def reading_levels(docs: DataFrame, labels: DataFrame, log2_slots: int = 18) -> DataFrame:
    """(doc_id, tokens, surprisal, spread, score, level) of documents (doc_id, text); level is on the labels' scale.

    Null texts and texts without tokens have 0 tokens and null figures; without labels every level is null. A repeated
    doc_id has a row each time.
    """
    spark = docs.sparkSession
    slots = 1 << log2_slots
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labelled = docs.where("text is not null").join(levels(labels), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    labelled = labelled.persist()
    counts = count_grams(labelled, slots)
    shared = spark.sparkContext.broadcast(counts)

    def folded(batches):
        for batch in chunks(batches, TEXTS):
            g = Grams(batch.column(0))
            level, fold = batch.column(1).to_numpy()[g.rows], batch.column(2).to_numpy()[g.rows]
            both = np.stack([scores(g, shared.value[1 - f])[0] for f in range(FOLDS)])
            at = np.round((both[fold, np.arange(len(fold))] - 1) / (LEVELS - 1) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at), "level": pa.array(level)})

    bins = labelled.select("text", "level", "fold").mapInArrow(folded, "at int, level double").groupBy("at").agg(F.count("*").alias("n"), F.avg("level").alias("level")).orderBy("at").collect()
    labelled.unpersist()
    x = np.array([b["at"] for b in bins], float)
    fit = isotonic(x, np.array([b["level"] for b in bins]), np.array([b["n"] for b in bins], float)) if len(bins) else x
    whole = spark.sparkContext.broadcast(counts.sum(0))

    def graded(batches):
        for batch in chunks(batches, TEXTS):
            g = Grams(batch.column(1))
            n = batch.num_rows
            tokens = np.zeros(n, np.int64)
            tokens[g.rows] = g.size
            score, mean, spread = scores(g, whole.value)
            level = np.interp((score - 1) / (LEVELS - 1) * BINS, x, fit) if len(x) else np.full(len(score), np.nan)
            out = {"doc_id": batch.column(0), "tokens": pa.array(tokens)}
            for name, v in (("surprisal", mean), ("spread", spread), ("score", score), ("level", level)):
                full = np.full(n, np.nan)
                full[g.rows] = np.round(v, 6)
                out[name] = pa.array(full, from_pandas=True)
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(graded, f"doc_id {kind}, tokens long, surprisal double, spread double, score double, level double")
