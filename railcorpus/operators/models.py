"""Topic models and graph prototypes: MLlib where it has them, else rounds over all documents with counts summed between the rounds.

What reaches the driver is bounded by topics x vocabulary numbers, whatever the number of documents.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railcorpus.session import ensure_checkpoint_dir

SLICE = 1 << 16
#: Edges of a range of terms.
CHUNK = 1 << 20


def assign(score: np.ndarray) -> list[int]:
    """Column of each row in the one-to-one assignment of largest total, the smallest columns on ties: dynamic programming over column sets."""
    k = len(score)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in range(k):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (total, picks) in best.items():
            for c in range(k):
                if not used >> c & 1:
                    key, value = used | 1 << c, total + float(score[row, c])
                    if key not in nxt or value > nxt[key][0] + 1e-12 or (abs(value - nxt[key][0]) <= 1e-12 and [*picks, c] < nxt[key][1]):
                        nxt[key] = (value, [*picks, c])
        best = nxt
    return best[(1 << k) - 1][1]


def matched_stability(tops: list[list[set]]) -> tuple[float, float]:
    """Mean and minimum Jaccard over all pairs of fits of their best-matched topics' word sets."""
    values = []
    for a, b in combinations(tops, 2):
        score = np.array([[len(x & y) / max(len(x | y), 1) for y in b] for x in a])
        values += [score[i, j] for i, j in enumerate(assign(score))]
    return float(np.mean(values)), float(np.min(values))


def numbered(cells: DataFrame, size: int) -> DataFrame:
    """cells, whose term_id must be 0..size-1: any other is an error, no term is dropped."""
    t = F.col("term_id")
    return cells.withColumn("term_id", F.when(t.between(0, size - 1), t).otherwise(F.raise_error(F.concat(F.lit("no term of the vocabulary: "), F.coalesce(t.cast("string"), F.lit("null")))).cast("int")))


def packed(cells: DataFrame, size: int, value: str = "cnt") -> DataFrame:
    """(doc_id, t, x): a document's terms in order, and their values."""
    pairs = numbered(cells, size).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("t"), F.col(value).cast("double").alias("x")))).alias("p"))
    return pairs.select("doc_id", F.col("p.t").alias("t"), F.col("p.x").alias("x"))


def summed(rows: DataFrame, fill, slots: int) -> np.ndarray:
    """The sum over all partitions of the `slots` numbers that fill(cells, batch) adds to: partial arrays, merged slice by slice."""

    def part(batches):
        cells = np.zeros(slots)
        for batch in batches:
            if batch.num_rows:
                fill(cells, batch)
        for k in range(0, slots, SLICE):
            if cells[k : k + SLICE].any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "blob": pa.array([cells[k : k + SLICE].tobytes()], pa.binary())})

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held[k] + np.frombuffer(blob) if k in held else np.frombuffer(blob)
        for k, v in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "blob": pa.array([v.tobytes()], pa.binary())})

    schema = "slice int, blob binary"
    out = np.zeros(slots)
    for r in rows.mapInArrow(part, schema).repartition("slice").mapInArrow(merge, schema).collect():  # slots numbers
        v = np.frombuffer(r["blob"])
        out[r["slice"] * SLICE : r["slice"] * SLICE + len(v)] = v
    return out


def _ragged(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values of a list column, and each row's number of values and first place."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), n, np.cumsum(n) - n


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _long(spark: SparkSession, p: np.ndarray) -> DataFrame:
    topics, size = p.shape
    return spark.createDataFrame(pd.DataFrame({"topic": np.repeat(np.arange(topics), size), "term_id": np.tile(np.arange(size), topics), "p": p.ravel()}), "topic int, term_id int, p double")


def _psi(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out -= np.where(small, 1 / x, 0.0)
        x += small
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _psi1(x: np.ndarray) -> np.ndarray:
    """Derivative of the digamma of positive numbers."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out += np.where(small, 1 / (x * x), 0.0)
        x += small
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def _mix(model, t: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variational parameters of documents with n cells (t, x) each, documents x topics, and the expected topic weights of the cells."""
    lam, total, alpha = model
    b = np.exp(_psi(lam[t]) - _psi(total))
    g = alpha + np.add.reduceat(x, np.cumsum(n) - n)[:, None] / len(alpha)
    at, old, cells = np.arange(len(n)), g, b
    while len(at):  # each document until its own parameters rest
        e = np.exp(_psi(old) - _psi(old.sum(1, keepdims=True)))
        s = x / np.maximum(np.einsum("ij,ij->i", np.repeat(e, n, axis=0), cells), 1e-100)
        new = alpha + e * np.add.reduceat(cells * s[:, None], np.cumsum(n) - n, axis=0)
        g[at] = new
        go = np.abs(new - old).mean(1) > 1e-3
        held = np.repeat(go, n)
        at, old, cells, x, n = at[go], new[go], cells[held], x[held], n[go]
    return g, b


def _variational_lda(docs: DataFrame, size: int, topics: int, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of variational LDA over docs (doc_id, t, x): term weights (size x topics), their sums, and the documents' prior, which is
    learned too.

    Every round takes all documents: batches of a round with MLlib's small steps leave planted topics merged. The driver holds the term
    weights once, as 4-byte numbers; a round sends it the terms' sums, slice by slice.
    """
    spark = docs.sparkSession
    step = max(SLICE // topics, 1)
    lam = np.random.Generator(np.random.PCG64(seed)).standard_gamma(100.0, (size, topics), dtype=np.float32)
    lam *= np.float32(0.01)
    alpha, eta = np.full(topics, 1.0 / topics), 1.0 / topics
    schema = "slice int, terms binary, sums binary"

    def rows_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "terms", "sums"])

    def by_term(t, v):
        order = np.argsort(t, kind="stable")
        t = t[order]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        return t[first], np.add.reduceat(v[order], first, axis=0)

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((lam, lam.sum(0, dtype=float), alpha))

        def part(batches, shared=shared):
            model, held, logs, seen = shared.value, [], np.zeros(topics), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, n, _ = _ragged(batch.column(0))
                x = _ragged(batch.column(1))[0]
                g, b = _mix(model, t, n, x)
                log = _psi(g) - _psi(g.sum(1, keepdims=True))
                b = b * np.repeat(np.exp(log), n, axis=0)
                held.append(by_term(t, b * (x / np.maximum(b.sum(1), 1e-100))[:, None]))
                logs, seen = logs + log.sum(0), seen + len(n)
                if sum(len(h[0]) for h in held) > 4 * SLICE:
                    held = [by_term(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
            if not seen:
                return
            t, v = by_term(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            yield rows_of([(-1, b"", np.append(logs, seen).tobytes())])
            cuts = np.flatnonzero(np.diff(t // step, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(t)], strict=True):
                yield rows_of([(int(t[a] // step), t[a:z].astype("i4").tobytes(), v[a:z].astype("f4").tobytes())])

        def merge(batches):
            held: dict[int, list] = {}
            for batch in batches:
                for k, t, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault(k, []).append((t, v))
            for k, found in held.items():
                if k < 0:
                    yield rows_of([(k, b"", sum(np.frombuffer(v) for _, v in found).tobytes())])
                else:
                    t, v = by_term(np.concatenate([np.frombuffer(t, "i4") for t, _ in found]), np.concatenate([np.frombuffer(v, "f4").reshape(-1, topics) for _, v in found]).astype(float))
                    yield rows_of([(k, t.astype("i4").tobytes(), v.astype("f4").tobytes())])

        found = docs.select("t", "x").mapInArrow(part, schema).repartition("slice").mapInArrow(merge, schema).collect()  # at most size x topics numbers
        shared.destroy()
        told = [np.frombuffer(r["sums"]) for r in found if r["slice"] < 0]
        if not told:
            break
        logs, seen = told[0][:-1], told[0][-1]
        weight = (1024 + turn + 1) ** -0.51
        lam[:] = eta
        for r in found:
            if r["slice"] >= 0:
                lam[np.frombuffer(r["terms"], "i4")] += np.frombuffer(r["sums"], "f4").reshape(-1, topics)
        del found
        slope = seen * (logs / seen - _psi(alpha) + _psi(alpha.sum()))  # a Newton step of the prior
        q = -seen * _psi1(alpha)
        moved = alpha - weight * (slope - (slope / q).sum() / (1 / (seen * _psi1(alpha.sum())) + (1 / q).sum())) / q
        alpha = moved if (moved > 0).all() else alpha
    return lam, lam.sum(0, dtype=float), alpha


def _shares(docs: DataFrame, model) -> DataFrame:
    """(doc_id, m) of docs (doc_id, t, x): each document's topic shares as an array."""

    def part(batches):
        for batch in batches:
            if batch.num_rows:
                t, n, _ = _ragged(batch.column(1))
                g = _mix(model.value, t, n, _ragged(batch.column(2))[0])[0]
                g /= g.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(g) + 1, dtype=np.int32) * g.shape[1], g.ravel())], ["doc_id", "m"])

    return docs.select("doc_id", "t", "x").mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, m array<double>")


def fit_lda(cells: DataFrame, size: int, topics: int, seed: int, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(topic, term_id, p) and (doc_id, topic, m) of variational LDA; topics ordered by share, then by their first word. Both tables are
    made on the executors."""
    docs = packed(cells, size).persist()
    lam, total, alpha = _variational_lda(docs, size, topics, seed, rounds)
    spark = cells.sparkSession
    model = spark.sparkContext.broadcast((lam, total, alpha))
    theta = _shares(docs, model).persist()
    share = theta.agg(*[F.avg(F.col("m")[k]) for k in range(topics)]).first()
    order = sorted(range(topics), key=lambda k: (-round(share[k] or 0.0, 9), int(lam[:, k].argmax()) if size else 0))
    step = SLICE // 4

    def words(batches):
        lam, total, _ = model.value
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for place, k in enumerate(order):
                    p = lam[s * step : (s + 1) * step, k] / total[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), place, np.int32)), pa.array(np.arange(s * step, s * step + len(p), dtype=np.int32)), pa.array(p)], ["topic", "term_id", "p"])

    beta = spark.range(0, -(-size // step)).mapInArrow(words, "topic int, term_id int, p double")
    return beta, theta.select("doc_id", F.posexplode(F.array(*[F.col("m")[k] for k in order])).alias("topic", "m"))


def lda_completion(split: DataFrame, size: int, topics: int, seed: int, rounds: int = 10) -> DataFrame:
    """(cnt, p) of every target cell of split (doc_id, term_id, observed, target) under variational LDA of the observed ones.

    A document's observed and target cells lie in one row, so its shares and its targets' probabilities are one pass: neither topics x
    documents nor topics x cells rows are made.
    """
    pairs = numbered(split, size).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("t"), F.col("observed").cast("double").alias("x"), F.col("target").cast("long").alias("y")))).alias("p"))
    seen, left = F.filter("p", lambda c: c["x"] > 0), F.filter("p", lambda c: c["y"] > 0)
    docs = pairs.select("doc_id", seen.alias("s"), left.alias("l")).where("size(s) > 0").select("doc_id", F.col("s.t").alias("t"), F.col("s.x").alias("x"), F.col("l.t").alias("u"), F.col("l.y").alias("y")).persist()
    model = split.sparkSession.sparkContext.broadcast(_variational_lda(docs, size, topics, seed, rounds))

    def part(batches):
        lam, total, _ = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, _ = _ragged(batch.column(0))
            g = _mix(model.value, t, n, _ragged(batch.column(1))[0])[0]
            u, m, _ = _ragged(batch.column(2))
            p = np.einsum("ij,ij->i", np.repeat(g / g.sum(1, keepdims=True), m, axis=0), lam[u] / total)
            yield pa.RecordBatch.from_arrays([pa.array(_ragged(batch.column(3))[0]), pa.array(p)], ["cnt", "p"])

    return docs.select("t", "x", "u", "y").mapInArrow(part, "cnt long, p double")


def fit_nmf(cells: DataFrame, size: int, topics: int, rounds: int = 30, seed: int = 7) -> DataFrame:
    """(topic, term_id, p): non-negative factors of smooth-idf, unit-length TF-IDF.

    The document side never leaves the executors: with term factors H (topics x size, bounded), each round sums WtV and WtW over
    documents, whose rows of W follow from H alone, a batch of documents at a time.
    """
    n = cells.agg(F.count_distinct("doc_id")).first()[0]
    df = cells.groupBy("term_id").agg(F.count_distinct("doc_id").alias("df"))
    rows = cells.join(df, "term_id").withColumn("x", F.col("cnt") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    docs = packed(rows.join(norm, "doc_id").select("doc_id", "term_id", (F.col("x") / F.col("len")).alias("x")), size, "x").persist()
    h = np.random.Generator(np.random.PCG64(seed)).random((topics, size)) + 0.1
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(h)

        def fill(cells, batch, shared=shared):
            h = shared.value
            t, n, first = _ragged(batch.column(1))
            x = _ragged(batch.column(2))[0]
            b = np.add.reduceat(h.T[t] * x[:, None], first, axis=0)
            w, hh = np.full_like(b, 0.1), h @ h.T
            for _ in range(20):
                w *= b / np.maximum(w @ hh, 1e-12)
            part = np.repeat(w, n, axis=0) * x[:, None]
            for k in range(topics):
                cells[k * size : (k + 1) * size] += np.bincount(t, part[:, k], size)
            cells[topics * size :] += (w.T @ w).ravel()

        flat = summed(docs, fill, topics * (size + topics))
        shared.destroy()
        h = h * flat[: topics * size].reshape(topics, size) / np.maximum(flat[topics * size :].reshape(topics, topics) @ h, 1e-12)
    docs.unpersist()
    return _long(cells.sparkSession, h / np.maximum(h.sum(1, keepdims=True), 1e-12))


def _uniform(*key) -> Column:
    """A number in 0..1 by the hash of the key: the same wherever the row lies."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def fit_gsdmm(cells: DataFrame, size: int, topics: int, rounds: int = 20, alpha: float = 0.1, beta: float = 0.1, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(topic, docs, top: its 10 most frequent terms), most documents first, and (doc_id, topic) of a Gibbs mixture with one topic a document.

    All documents are sampled, in rounds: in each, half of them by hash draw anew against the counts of all others as the round found
    them; counts are summed between rounds. A document's draws come from its own hash, so layout does not matter.
    """
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    state = packed(cells, size).withColumn("z", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(topics)).cast("int")).checkpoint()

    def fill(cells, batch):
        t, n, _ = _ragged(batch.column("t"))
        x, z = _ragged(batch.column("x"))[0], batch.column("z").to_numpy()
        cells[: topics * size] += np.bincount(np.repeat(z, n) * size + t, x, topics * size)
        cells[topics * size :] += np.bincount(z, minlength=topics)

    def counts():
        flat = summed(state, fill, topics * (size + 1))
        return flat[: topics * size].reshape(topics, size), flat[topics * size :]

    for turn in range(rounds):
        nw, m = counts()
        shared = spark.sparkContext.broadcast((nw, m))

        def step(batches, shared=shared):
            nw, m = shared.value
            total = nw.sum(1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, n, _ = _ragged(batch.column("t"))
                c = _ragged(batch.column("x"))[0].astype(np.int64)
                z, u, move = batch.column("z").to_numpy(), batch.column("u").to_numpy(), batch.column("move").to_numpy()
                of = np.repeat(np.arange(len(z)), n)
                length = np.bincount(of, c, len(z)).astype(np.int64)
                cell, doc = np.repeat(np.arange(len(t)), c), np.repeat(np.arange(len(z)), length)
                mine = z[:, None] == np.arange(topics)
                word = np.log(nw[:, t[cell]].T - mine[of[cell]] * c[cell, None] + beta + _within(c)[:, None])
                all_ = np.log(total - mine[doc] * length[doc, None] + size * beta + _within(length)[:, None])
                score = np.log(m - mine + alpha) + np.add.reduceat(word - all_, np.cumsum(length) - length, axis=0)
                p = np.exp(score - score.max(1, keepdims=True))
                cdf = np.cumsum(p, 1) / p.sum(1, keepdims=True)
                new = np.minimum((cdf < u[:, None]).sum(1), topics - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), batch.column("x"), pa.array(np.where(move < 0.5, new, z).astype("i4"))], ["doc_id", "t", "x", "z"])

        drawn = state.withColumn("u", _uniform("doc_id", F.lit(seed), F.lit(turn))).withColumn("move", _uniform("doc_id", F.lit(turn), F.lit("move")))
        state = drawn.mapInArrow(step, state.schema).checkpoint()
    nw, m = counts()
    order = sorted(range(topics), key=lambda k: (-m[k], k))
    top = [(i, int(m[k]), [int(t) for t in np.argsort(-nw[k], kind="stable")[:10] if nw[k, t] > 0]) for i, k in enumerate(order)]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("z")).cast("int") - 1
    return spark.createDataFrame(top, "topic int, docs long, top array<int>"), state.select("doc_id", place.alias("topic"))


def fit_btm(pairs: DataFrame, size: int, topics: int, rounds: int = 10, alpha: float = 1.0, beta: float = 0.01, seed: int = 7) -> DataFrame:
    """(topic, term_id, p) of a Gibbs sampler over all word pairs (a, b, n).

    The n copies of a pair are drawn together, systematically: as many to each topic as its probability says, the rest by one hash.
    Rounds as in fit_gsdmm.
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    both = numbered(numbered(pairs.withColumnRenamed("a", "term_id"), size).withColumnRenamed("term_id", "a").withColumnRenamed("b", "term_id"), size).withColumnRenamed("term_id", "b")
    start = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(topics))
    state = both.select(F.col("a").cast("int"), F.col("b").cast("int"), F.col("n").cast("long"), F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: F.when(k == start, F.col("n")).otherwise(0).cast("long")).alias("c")).checkpoint()

    def fill(cells, batch):
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        c = _ragged(batch.column("c"))[0].reshape(-1, topics)
        for k in range(topics):
            cells[k * size : (k + 1) * size] += np.bincount(a, c[:, k], size) + np.bincount(b, c[:, k], size)

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(summed(state, fill, topics * size).reshape(topics, size))

        def step(batches, shared=shared):
            nw = shared.value
            m = nw.sum(1) / 2
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b, n = (batch.column(k).to_numpy() for k in ("a", "b", "n"))
                c = _ragged(batch.column("c"))[0].reshape(-1, topics)
                rest = m - c
                p = (rest + alpha) * (nw[:, a].T - c + beta) * (nw[:, b].T - c + beta) / ((2 * rest + size * beta) * (2 * rest + 1 + size * beta))
                cdf = np.cumsum(p, 1) / p.sum(1, keepdims=True)
                cdf[:, -1] = 1.0
                upto = np.ceil(n[:, None] * cdf - batch.column("u").to_numpy()[:, None]).clip(0, None).astype(np.int64)
                new = np.diff(np.minimum(upto, n[:, None]), axis=1, prepend=0)
                new = np.where(batch.column("move").to_numpy()[:, None] < 0.5, new, c)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * topics, new.ravel())], ["a", "b", "n", "c"])

        drawn = state.withColumn("u", _uniform("a", "b", F.lit(seed), F.lit(turn))).withColumn("move", _uniform("a", "b", F.lit(turn), F.lit("move")))
        state = drawn.mapInArrow(step, state.schema).checkpoint()
    nw = summed(state, fill, topics * size).reshape(topics, size)
    return _long(spark, (nw + beta) / (nw.sum(1, keepdims=True) + size * beta))


def pca_clusters(rows: DataFrame, key: str, vector: str, dims: int, clusters: int, seed: int = 7, starts: int = 1) -> DataFrame:
    """(key, topic): unit vectors of the first principal components, clustered; of several starts the one of least cost."""
    data = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("raw")).sortWithinPartitions(key).persist()
    small = PCA(k=dims, inputCol="raw", outputCol="small").fit(data).transform(data)
    unit = Normalizer(inputCol="small", outputCol="features").transform(small)
    fits = [KMeans(k=clusters, seed=seed + i).fit(unit) for i in range(starts)]
    best = min(fits, key=lambda m: round(m.summary.trainingCost, 9))
    return best.transform(unit).select(key, F.col("prediction").alias("topic"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, centroids: DataFrame, label: str, centre: str, most: int = 10_000) -> DataFrame:
    """(key, label): closest centroid by squared distance, the smaller label on ties; one row a key.

    Centroids, counted to be at most `most`, go to each row as one array, so the rows are neither multiplied nor shuffled.
    """
    if centroids.limit(most + 1).count() > most:
        raise ValueError("too many centroids to send to every row")
    all_ = centroids.where(F.col(centre).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), F.col(centre).alias("c")))).alias("all"))
    d = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    far = F.transform("all", lambda x: F.struct(F.round(d(x["c"]), 9).alias("d"), x["k"].alias("k")))
    return rows.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(all_)).select(key, F.array_min(far)["k"].alias(label))


def spectral_prototypes(edges: DataFrame, topics: int, words: int = 10, least: int | None = None, centrality: float = 0.5, rounds: int = 30, spare: int = 8, seed: int = 7) -> DataFrame:
    """(topic, slot, term_id): cores of the graph's clusters.

    Terms with an edge are split by the leading eigenvectors of the normalised graph, labelled by pivoted QR; a core starts at its cluster's
    most connected word and grows by mean edge to the core plus centrality. Eigenvectors come from subspace iteration with `spare` columns
    more than topics: each round is one pass over the edges, and only terms x columns numbers are held on the driver.

    Edges are laid out once, both ways, in ranges of their first term with about as many edges each. So the sums of a term are made in one
    task, and a round has no shuffle.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    schema = "topic int, slot int, term_id int"
    cached = edges.is_cached
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"))
    edges = edges if cached else edges.persist()
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    met = ways.groupBy("src").agg(F.count("*").alias("n"), F.sum("w").alias("w")).toArrow()  # three numbers a term
    order = np.argsort(met.column(0).to_numpy())
    terms, root = met.column(0).to_numpy()[order].astype(np.int64), np.sqrt(met.column(2).to_numpy()[order])
    upto = np.cumsum(met.column(1).to_numpy()[order])
    del met
    size = len(terms)
    if size < topics * words:
        if not cached:
            edges.unpersist()
        return spark.createDataFrame([], schema)
    ranges = int(max(spark.sparkContext.defaultParallelism, -(-upto[-1] // CHUNK)))
    named = spark.sparkContext.broadcast((terms, np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges))))

    def index(batches):
        terms, cuts = named.value
        for batch in batches:
            i, j = (np.searchsorted(terms, batch.column(c).to_numpy()).astype(np.int32) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, i).astype(np.int32)), pa.array(i), pa.array(j), batch.column(2)], ["range", "i", "j", "w"])

    def lay(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        i, j, w = (whole.column(c).to_numpy() for c in ("i", "j", "w"))
        del whole
        at = np.lexsort((j, i))
        i, j, w = i[at], j[at], w[at]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for a in range(0, len(starts), CHUNK):
            first, to = starts[a], starts[a + CHUNK] if a + CHUNK < len(starts) else len(i)
            mine = starts[a : a + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i[mine], mine - first, j[first:to], w[first:to])], ["own", "starts", "j", "w"])

    laid = ways.mapInArrow(index, "range int, i int, j int, w double").repartition(ranges, "range").mapInArrow(lay, "own binary, starts binary, j binary, w binary")
    laid = laid.checkpoint().persist()  # the driver keeps a plan for each round: that of the graph with all it is made of is large
    if not cached:
        edges.unpersist()

    def passed(fill, kind="f8"):
        """(own, values) of every laid range, values being what fill gives of its edges: a list of arrays, each as long as own."""

        def part(batches):
            for batch in batches:
                for own, starts, j, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, values = fill(np.frombuffer(own, "i4"), np.frombuffer(starts, "i8"), np.frombuffer(j, "i4"), np.frombuffer(w))
                    yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())], ["own", "sums"])

        for r in laid.mapInArrow(part, "own binary, sums binary").collect():  # terms x columns numbers
            own = np.frombuffer(r["own"], "i4")
            yield own, np.frombuffer(r["sums"], kind).reshape(-1, len(own)) if len(own) else np.zeros((1, 0))

    def times(q):
        """(own, rows) of the normalised graph times q, whose values travel as 4-byte numbers."""
        shared = spark.sparkContext.broadcast(np.ascontiguousarray((q / root[:, None]).T, "f4"))
        fill = lambda own, starts, j, w: (own, [np.add.reduceat(w * x[j], starts) for x in shared.value])
        for own, sums in passed(fill, "f4"):
            yield own, sums.T / root[own, None]
        shared.destroy()

    def upright(q):
        """q with orthonormal columns, by its small matrix of products: no second matrix of its size."""
        d, u = np.linalg.eigh(q.T @ q)
        turn = u / np.sqrt(np.maximum(d, 1e-14 * d[-1]))
        for a in range(0, size, SLICE):
            q[a : a + SLICE] = q[a : a + SLICE] @ turn
        return q

    q = upright(np.random.Generator(np.random.PCG64(seed)).normal(size=(size, min(size, topics + spare))))
    for _ in range(rounds):
        for own, moved in times(q):  # the graph's eigenvalues are -1..1: shifted, the largest are the leading ones
            q[own] += moved
        q = upright(upright(q))
    product = np.zeros((q.shape[1],) * 2)
    for own, moved in times(q):
        product += q[own].T @ moved
    vecs = q @ np.linalg.eigh((product + product.T) / 2)[1][:, -topics:]
    pivots, left = [], vecs.T.copy()
    for _ in range(topics):  # the rows that span the eigenvectors best
        p = int((left**2).sum(0).argmax())
        pivots.append(p)
        v = left[:, p] / max(np.linalg.norm(left[:, p]), 1e-300)
        left = left - np.outer(v, v @ left)
    u, _, vt = np.linalg.svd(vecs[pivots].T)
    label = np.abs(vecs @ (u @ vt)).argmax(1)
    known = spark.sparkContext.broadcast(label)
    inner = np.zeros(size)
    for own, sums in passed(lambda own, starts, j, w: (own, [np.add.reduceat(np.where(known.value[j] == np.repeat(known.value[own], np.diff(starts, append=len(j))), w, 0.0), starts)])):
        inner[own] = sums[0]
    owns = {k: own for k in range(topics) if len(own := np.flatnonzero(label == k)) >= max(least or words, words)}
    weight = np.zeros(size)
    for own in owns.values():
        weight[own] = inner[own] / max(inner[own].max(), 1e-300)
    cores = {k: [int(own[weight[own].argmax()])] for k, own in owns.items()}
    met = np.zeros(size)
    for _ in range(words - 1 if cores else 0):
        last = spark.sparkContext.broadcast(np.array([c[-1] for c in cores.values()]))

        def met_by(own, starts, j, w, last=last):
            i = np.repeat(own, np.diff(starts, append=len(j)))
            hit = np.isin(i, last.value) & (known.value[i] == known.value[j])
            return j[hit], [w[hit]]

        for own, sums in passed(met_by):
            met += np.bincount(own, sums[0], size)
        for k, own in owns.items():
            gain = met[own] / len(cores[k]) + centrality * weight[own]
            gain[np.isin(own, cores[k])] = -np.inf
            cores[k].append(int(own[gain.argmax()]))
    laid.unpersist()
    return spark.createDataFrame([(k, s, int(terms[c])) for k, core in cores.items() for s, c in enumerate(core)], schema)


def align_cores(cores: DataFrame, p: DataFrame, topics: int) -> DataFrame:
    """(topic, core, score): the one-to-one match of cores to topics of largest mean mass. Both sides are topics, so K x K is collected."""
    names = cores.select("topic").distinct().count()
    rows = cores.select(F.col("topic").alias("core"), "term_id").join(p, "term_id").groupBy("core", "topic").agg(F.avg("p").alias("score")).collect()
    k = max(topics, names)
    score = np.zeros((k, k))
    for r in rows:
        score[r["topic"], r["core"]] = r["score"]
    out = [(i, j, float(score[i, j])) for i, j in enumerate(assign(score))]
    return cores.sparkSession.createDataFrame(out, "topic int, core int, score double")


def contrast_basis(weights: list[float]) -> np.ndarray:
    """C x (C - 1) columns orthogonal to the weights; the heaviest stratum is the pivot."""
    w = np.asarray(weights, float)
    pivot = int(w.argmax())
    rest = [i for i in range(len(w)) if i != pivot]
    out = np.zeros((len(w), len(rest)))
    for c, i in enumerate(rest):
        out[i, c], out[pivot, c] = 1.0, -w[i] / w[pivot]
    return out


def parameter_counts(spark: SparkSession, topics: int, vocabulary: int, strata: int, dims: int) -> DataFrame:
    """(part, parameters) closed forms."""
    rows = [("topics", topics * dims), ("words", vocabulary * dims), ("contrasts", (strata - 1) * topics * dims), ("gates", topics)]
    return spark.createDataFrame(rows, "part string, parameters long")


def synthetic_counts(spark: SparkSession, documents: int, topics: int, vocabulary: int, strata: int, length: int, seed: int = 7) -> DataFrame:
    """(doc_id, stratum, term_id, cnt) of block topics with stratum-dependent proportions: a test corpus, drawn on the executors, each
    document from its own seed."""
    beta = np.full((topics, vocabulary), 0.1 / vocabulary)
    for k in range(topics):
        beta[k, k * vocabulary // topics : (k + 1) * vocabulary // topics] += 0.9 * topics / vocabulary
    beta /= beta.sum(1, keepdims=True)

    def draw(batches):
        for batch in batches:
            rows = []
            for d in batch.column(0).to_pylist():
                rng = np.random.Generator(np.random.PCG64([seed, d]))
                theta = rng.dirichlet(np.where(np.arange(topics) % strata == d % strata, 1.0, 0.2))
                count = rng.multinomial(length, theta @ beta)
                rows += [(f"s{d:05d}", f"g{d % strata}", int(t), int(count[t])) for t in np.flatnonzero(count)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "stratum", "term_id", "cnt"])

    return spark.range(documents).mapInArrow(draw, "doc_id string, stratum string, term_id int, cnt long")


def affinity_logits(topics: DataFrame, words: DataFrame, temperature: float, most: int = 10_000) -> DataFrame:
    """(topic, term_id, z): minus the squared distance of topic (topic, embedding) and word vectors (term_id, embedding), divided by the
    temperature, which must be positive.

    Topics, counted to be at most `most`, go to each word as one array; words are neither multiplied by a join nor shuffled. Words or topics
    without a vector have no row.
    """
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    if topics.limit(most + 1).count() > most:
        raise ValueError("too many topics to send to every word")
    all_ = topics.where("embedding is not null").agg(F.array_sort(F.collect_list(F.struct("topic", "embedding"))).alias("all"))
    d = lambda e: F.aggregate(F.zip_with("embedding", e, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    z = F.transform("all", lambda x: F.struct(x["topic"].alias("topic"), (-d(x["embedding"]) / temperature).alias("z")))
    rows = words.where("embedding is not null").crossJoin(F.broadcast(all_)).select("term_id", F.explode(z).alias("x"))  # all_ is one row
    return rows.select("x.topic", "term_id", "x.z")


def term_vectors(cells: DataFrame, dims: int = 64, seed: int = 7) -> DataFrame:
    """(term_id, embedding) of unit length: a term's vector is the sum of random signs of the documents that hold it, weighted by 1 / ln(1 +
    the document's terms): terms that share documents are near each other.

    No document pair is made and no matrix is held: signs come from a hash of the document, sums are one aggregate. A term whose signs
    cancel out, and a null term, have no row.
    """
    size = cells.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = cells.where("term_id is not null and doc_id is not null").select("doc_id", "term_id").join(size, "doc_id")
    bits = F.array(*[F.xxhash64("doc_id", F.lit(seed), F.lit(k)) for k in range(-(-dims // 64))])
    sign = lambda i: F.when(F.getbit(bits[i // 64], F.lit(i % 64)) == 1, 1.0).otherwise(-1.0)
    sums = rows.withColumn("w", 1 / F.log1p("n")).groupBy("term_id").agg(*[F.sum(F.col("w") * sign(i)).alias(f"v{i}") for i in range(dims)])
    length = F.sqrt(sum(F.col(f"v{i}") * F.col(f"v{i}") for i in range(dims)))
    return sums.withColumn("len", length).where("len > 0").select("term_id", F.array(*[F.col(f"v{i}") / F.col("len") for i in range(dims)]).alias("embedding"))
