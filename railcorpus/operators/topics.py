"""Topic tables: (topic, term_id, p) distributions, displayed words (topic, rank, term_id), their quality and their repair."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railcorpus.operators.graph import both_ways, npmi


def class_tfidf(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """(topic, term_id, weight): class share of the term times ln(1 + mean class size / frequency). classes: (doc_id, topic)."""
    counted = cells.join(classes, "doc_id").groupBy("topic", "term_id").agg(F.sum("cnt").alias("c"))
    size = counted.groupBy("topic").agg(F.sum("c").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    freq = counted.groupBy("term_id").agg(F.sum("c").alias("f"))
    rows = counted.join(size, "topic").join(freq, "term_id").crossJoin(F.broadcast(mean))  # mean is one row
    return rows.select("topic", "term_id", (F.col("c") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def class_distribution(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """(topic, term_id, p): share of the class's tokens."""
    counted = cells.join(classes, "doc_id").groupBy("topic", "term_id").agg(F.sum("cnt").alias("c"))
    size = counted.groupBy("topic").agg(F.sum("c").alias("size"))
    return counted.join(size, "topic").select("topic", "term_id", (F.col("c") / F.col("size")).alias("p"))


def normalise(rows: DataFrame, by: str, value: str) -> DataFrame:
    """value divided by its sum in each group: an aggregate joined back, so a large group is no window in one task."""
    return rows.join(rows.groupBy(by).agg(F.sum(value).alias("_sum")), by).withColumn(value, F.col(value) / F.col("_sum")).drop("_sum")


def softmax(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    top = rows.groupBy(*by).agg(F.max(value).alias("_top"))
    e = rows.join(top, by).withColumn(out, F.exp(F.col(value) - F.col("_top"))).drop("_top")
    return e.join(e.groupBy(*by).agg(F.sum(out).alias("_sum")), by).withColumn(out, F.col(out) / F.col("_sum")).drop("_sum")


def top_words(rows: DataFrame, value: str, n: int = 10) -> DataFrame:
    """(topic, rank, term_id): the n largest values of each topic, ties by term. Rows past rank n are dropped before the shuffle."""
    by = Window.partitionBy("topic").orderBy(F.desc(value), "term_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).select("topic", "rank", "term_id")


def diversity(top: DataFrame) -> DataFrame:
    return top.agg((F.count_distinct("term_id") / F.count("*")).alias("diversity"))


def pairwise_jaccard(top: DataFrame) -> DataFrame:
    """(topic_a, topic_b, jaccard) of the topics' word sets, topic_a < topic_b. Topics are few; their words meet by term."""
    size = top.groupBy("topic").agg(F.count_distinct("term_id").alias("n"))
    a, b = size.select(F.col("topic").alias("topic_a"), F.col("n").alias("n_a")), size.select(F.col("topic").alias("topic_b"), F.col("n").alias("n_b"))
    x, y = top.select(F.col("topic").alias("topic_a"), "term_id").distinct(), top.select(F.col("topic").alias("topic_b"), "term_id").distinct()
    shared = x.join(y, "term_id").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.count("*").alias("both"))
    grid = a.join(b, F.col("topic_a") < F.col("topic_b")).join(shared, ["topic_a", "topic_b"], "left").na.fill(0, ["both"])
    return grid.select("topic_a", "topic_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def _word_pairs(top: DataFrame) -> DataFrame:
    a, b = top.select("topic", F.col("term_id").alias("a")), top.select("topic", F.col("term_id").alias("b"))
    return a.join(b, "topic").where("a < b")


def document_npmi(cells: DataFrame, top: DataFrame) -> DataFrame:
    """(topic, npmi, absent_pairs, zero_pairs): mean over a topic's word pairs; -1 if a word is absent or never meets the other (both
    counted as zero, the first as absent too), 1 if together in every document."""
    words = top.select("term_id").distinct()
    held = cells.select("doc_id", "term_id").distinct()
    n = held.agg(F.count_distinct("doc_id").alias("n"))
    shown = held.join(words, "term_id", "left_semi")
    df = shown.groupBy("term_id").agg(F.count("*").alias("df"))
    wanted = _word_pairs(top)
    joint = shown.withColumnRenamed("term_id", "a").join(shown.withColumnRenamed("term_id", "b"), "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint"))
    rows = wanted.join(df.select(F.col("term_id").alias("a"), F.col("df").alias("df_a")), "a", "left").join(df.select(F.col("term_id").alias("b"), F.col("df").alias("df_b")), "b", "left")
    rows = rows.join(joint, ["a", "b"], "left").crossJoin(F.broadcast(n)).na.fill(0, ["df_a", "df_b", "joint"])  # n is one row
    value = F.when(F.col("joint") == 0, -1.0).when(F.col("joint") == F.col("n"), 1.0).otherwise(npmi(F.col("joint"), F.col("df_a"), F.col("df_b"), F.col("n")))
    absent = (F.col("df_a") == 0) | (F.col("df_b") == 0)
    return rows.groupBy("topic").agg(F.avg(value).alias("npmi"), F.count_if(absent).alias("absent_pairs"), F.count_if(F.col("joint") == 0).alias("zero_pairs"))


def windows(tokens: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, terms): the distinct terms of every stretch of width tokens; a shorter document is one stretch."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - width, F.lit(0)))
    return tokens.where(F.size("tokens") > 0).select("doc_id", F.explode(starts).alias("start"), "tokens").select("doc_id", "start", F.array_distinct(F.slice("tokens", F.col("start") + 1, width)).alias("terms"))


def cv_coherence(tokens: DataFrame, top: DataFrame, width: int = 110, gamma: float = 1.0) -> DataFrame:
    """(topic, c_v): words compared by the cosine of their NPMI vectors over boolean windows with the topic's sum vector.

    Only displayed words are kept before the windows meet themselves. Words in no window confirm nothing.
    """
    cut = windows(tokens, width)
    n = cut.agg(F.count("*").alias("n"))
    words = top.select("term_id").distinct()
    seen = cut.select("doc_id", "start", F.explode("terms").alias("term_id")).join(words, "term_id", "left_semi")
    df = seen.groupBy("term_id").agg(F.count("*").alias("df"))
    joint = seen.withColumnRenamed("term_id", "a").join(seen.withColumnRenamed("term_id", "b"), ["doc_id", "start"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint"))
    joint = joint.unionByName(joint.select(F.col("b").alias("a"), F.col("a").alias("b"), "joint"))
    x, y = top.select("topic", F.col("term_id").alias("a")), top.select("topic", F.col("term_id").alias("b"))
    grid = x.join(y, "topic").join(df.select(F.col("term_id").alias("a"), F.col("df").alias("df_a")), "a", "left").join(df.select(F.col("term_id").alias("b"), F.col("df").alias("df_b")), "b", "left")
    grid = grid.join(joint, ["a", "b"], "left").crossJoin(F.broadcast(n)).na.fill(0, ["df_a", "df_b", "joint"])  # n is one row
    raw = npmi(F.col("joint"), F.col("df_a"), F.col("df_b"), F.col("n"))
    cell = F.when((F.col("df_a") == 0) | (F.col("df_b") == 0), 0.0).when(F.col("a") == F.col("b"), 1.0).when(F.col("joint") == 0, -1.0).when(F.col("joint") == F.col("n"), 1.0).otherwise(raw)
    grid = grid.withColumn("v", F.signum(cell) * F.pow(F.abs(cell), F.lit(gamma)))
    total = grid.groupBy("topic", "b").agg(F.sum("v").alias("s"))
    rows = grid.join(total, ["topic", "b"])
    word = rows.groupBy("topic", "a").agg(F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("all"), F.max("df_a").alias("df_a"))
    cos = F.when((F.col("df_a") == 0) | (F.col("len") == 0) | (F.col("all") == 0), 0.0).otherwise(F.col("dot") / (F.col("len") * F.col("all")))
    return word.groupBy("topic").agg(F.avg(cos).alias("c_v"))


def rank_biased_overlap(a: Column, b: Column, n: int, p: float = 0.9) -> Column:
    """Extrapolated overlap of two ranked arrays of length n, in 0..1."""
    share = lambda d: F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d))) / d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda s, d: s + share(d) * F.pow(F.lit(p), d - 1))
    return F.least(F.greatest((1 - p) * total + share(F.lit(n)) * p**n, F.lit(0.0)), F.lit(1.0))


def js_divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(topic, js) of two distributions (topic, term_id, p), in nats; a term that one lacks has probability 0."""
    both = a.select(*keys, F.col("p").alias("p")).join(b.select(*keys, F.col("p").alias("q")), keys, "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    return both.groupBy("topic").agg((F.sum(part("p") + part("q")) / 2).alias("js"))


def affinity(beta: DataFrame, share: DataFrame) -> DataFrame:
    """(topic, term_id, p) with p summing to 1 over topics for each term: beta weighted by the topics' shares (topic, w)."""
    weighted = beta.join(share, "topic").select("topic", "term_id", (F.col("p") * F.col("w")).alias("p"))
    return normalise(weighted, "term_id", "p")


def transport(p: DataFrame, cores: DataFrame, strength: float = 1.0, margin: float = 1e-6, shown: int = 10) -> DataFrame:
    """(topic, term_id, p, moved): each topic's core words (topic, term_id) raised to its display boundary, the others of the same
    word lowered in proportion, so the sum over topics of each word stays.

    The boundary is the (shown - core size + 1)-th largest value outside the core; a target is capped by the word's total.
    """
    own = cores.select("topic", "term_id", F.lit(True).alias("core"))
    rows = p.join(own, ["topic", "term_id"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    size = cores.groupBy("topic").agg(F.count("*").alias("q"))
    outside = rows.where("not core").withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "term_id"))).where(F.col("place") <= shown)
    edge = outside.join(size, "topic").where(F.col("place") == shown - F.col("q") + 1).select("topic", F.col("p").alias("edge"))
    total = p.groupBy("term_id").agg(F.sum("p").alias("total"))
    core = rows.where("core").join(edge, "topic", "left").join(total, "term_id")
    target = F.least(F.coalesce("edge", F.lit(0.0)) + margin, F.col("total"))
    core = core.select("topic", "term_id", (strength * F.greatest(F.lit(0.0), target - F.col("p"))).alias("delta"), "total", F.col("p").alias("own"))
    owner = core.groupBy("term_id").agg(F.max_by("topic", F.struct("delta", "topic")).alias("owner"), F.max("delta").alias("delta"), F.max("total").alias("total"), F.max_by("own", F.struct("delta", "topic")).alias("own"))
    out = p.join(owner, "term_id", "left")
    new = F.when(F.col("owner").isNull() | (F.col("delta") == 0), F.col("p")).when(F.col("topic") == F.col("owner"), F.col("p") + F.col("delta")).otherwise(F.col("p") * (1 - F.col("delta") / (F.col("total") - F.col("own"))))
    return out.select("topic", "term_id", new.alias("p"), F.when(F.col("topic") == F.col("owner"), F.col("delta")).otherwise(0.0).alias("moved"))


def transport_search(p: DataFrame, cores: DataFrame, quota: int, margin: float = 1e-6, shown: int = 10) -> DataFrame:
    """(topic, term_id, delta): of each topic's core (topic, slot, term_id) the quota of words that needs the least mass, by slots on ties.

    A topic's display list and core reach one task, never its vocabulary.
    """
    total = p.groupBy("term_id").agg(F.sum("p").alias("total"))
    core = cores.join(p, ["topic", "term_id"], "left").na.fill(0.0, ["p"]).join(total, "term_id").select("topic", "slot", "term_id", "p", "total")
    head = p.join(cores.select("topic", "term_id"), ["topic", "term_id"], "left_anti")
    head = head.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "term_id"))).where(F.col("place") <= shown)
    both = core.unionByName(head.select("topic", F.lit(-1).alias("slot"), "term_id", "p", F.lit(0.0).alias("total")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf[pdf["slot"] >= 0].sort_values("slot").reset_index(drop=True)
        rest = pdf.loc[pdf["slot"] < 0, "p"].to_numpy()
        best = None
        for pick in itertools.combinations(range(len(core)), min(quota, len(core))):
            out = np.sort(np.concatenate([rest, core["p"].drop(list(pick)).to_numpy()]))[::-1]
            edge = out[shown - quota] if len(out) > shown - quota else 0.0
            target = np.minimum(edge + margin, core["total"].to_numpy()[list(pick)])
            delta = np.maximum(0.0, target - core["p"].to_numpy()[list(pick)])
            key = (round(float(delta.sum()), 12), tuple(core["slot"].to_numpy()[list(pick)]))
            if best is None or key < best[0]:
                best = (key, pick, delta)
        if best is None:
            return pdf.iloc[:0].assign(delta=0.0)[["topic", "term_id", "delta"]]
        return pd.DataFrame({"topic": pdf["topic"].iloc[0], "term_id": core["term_id"].to_numpy()[list(best[1])], "delta": best[2]})

    kind = p.schema["topic"].dataType.simpleString()
    return both.groupBy("topic").applyInPandas(one, f"topic {kind}, term_id int, delta double")


def moment_calibration(native: DataFrame, moved: DataFrame, floor: float = 1e-10) -> DataFrame:
    """(term_id, a, b): scale and shift that give moved values (term_id, z) the native mean and population variance."""
    n = native.groupBy("term_id").agg(F.avg("z").alias("mean_n"), F.var_pop("z").alias("var_n"))
    m = moved.groupBy("term_id").agg(F.avg("z").alias("mean_m"), F.var_pop("z").alias("var_m"))
    a = F.sqrt((F.col("var_n") + floor) / (F.col("var_m") + floor))
    return n.join(m, "term_id").select("term_id", a.alias("a"), (F.col("mean_n") - a * F.col("mean_m")).alias("b"))


def bounded_residual(raw: DataFrame, most: float) -> DataFrame:
    """(topic, term_id, r): tanh-bounded shift, centred over topics for each term."""
    bounded = raw.select("topic", "term_id", (most * F.tanh(F.col("z") / most)).alias("r"))
    mean = bounded.groupBy("term_id").agg(F.avg("r").alias("mean"))
    return bounded.join(mean, "term_id").select("topic", "term_id", (F.col("r") - F.col("mean")).alias("r"))


def effective_affinity(p: DataFrame, residual: DataFrame) -> DataFrame:
    """p times exp of the residual, summing to 1 over topics again."""
    rows = p.join(residual, ["topic", "term_id"], "left").select("topic", "term_id", (F.col("p") * F.exp(F.coalesce("r", F.lit(0.0)))).alias("p"))
    return normalise(rows, "term_id", "p")


def rank_scores(p: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(topic, term_id, score): log share in the topic, centred and scaled to unit mean square."""
    logs = normalise(p, "topic", "p").select("topic", "term_id", F.log(F.greatest("p", F.lit(eps))).alias("l"))
    mean = logs.groupBy("topic").agg(F.avg("l").alias("mean"))
    c = logs.join(mean, "topic").withColumn("c", F.col("l") - F.col("mean"))
    rms = c.groupBy("topic").agg(F.sqrt(F.avg(F.col("c") * F.col("c")) + eps).alias("rms"))
    return c.join(rms, "topic").select("topic", "term_id", (F.col("c") / F.col("rms")).alias("score"))


def soft_top_k(scores: DataFrame, k: int, temperature: float = 0.1, rounds: int = 40) -> DataFrame:
    """(topic, term_id, m): sigmoid((score - t) / temperature) with t such that the memberships of a topic sum to k.

    t is found by Newton steps kept inside a bracket. Each is one aggregate over the scores; two numbers a topic reach the driver, and no task
    holds a topic's vocabulary. A topic with k terms or fewer takes all of them.
    """
    spark = scores.sparkSession
    scores = scores.persist()
    ends = scores.groupBy("topic").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()  # one row a topic
    low = {r["topic"]: r["lo"] - 20 * temperature for r in ends}
    high = {r["topic"]: r["hi"] + 20 * temperature for r in ends}
    at = {t: (low[t] + high[t]) / 2 for t in low}
    schema = f"topic {scores.schema['topic'].dataType.simpleString()}, t double"
    m = 1 / (1 + F.exp(-(F.col("score") - F.col("t")) / temperature))
    for _ in range(rounds):
        met = scores.join(F.broadcast(spark.createDataFrame(list(at.items()), schema)), "topic").groupBy("topic").agg(F.sum(m).alias("f"), F.sum(m * (1 - m)).alias("g")).collect()  # one row a topic
        open_ = False
        for r in met:
            t, off = r["topic"], r["f"] - k
            if abs(off) <= 1e-9 * k or high[t] - low[t] < 1e-12:
                continue
            open_ = True
            (low if off > 0 else high)[t] = at[t]
            step = at[t] + off * temperature / max(r["g"], 1e-300)
            at[t] = step if low[t] < step < high[t] else (low[t] + high[t]) / 2
        if not open_:
            break
    found = spark.createDataFrame(list(at.items()), schema)
    return scores.join(F.broadcast(found), "topic").select("topic", "term_id", m.alias("m"))


def association(members: DataFrame, edges: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(topic, association, loss): mean edge weight under memberships (topic, term_id, m), and its negative log; the mean of loss over topics
    is the rank-aware association loss."""
    x, y = members.select("topic", F.col("term_id").alias("src"), F.col("m").alias("m_src")), members.select("topic", F.col("term_id").alias("dst"), F.col("m").alias("m_dst"))
    inner = both_ways(edges).join(x, "src").join(y, ["topic", "dst"]).groupBy("topic").agg(F.sum(F.col("w") * F.col("m_src") * F.col("m_dst")).alias("inner"))
    mass = members.groupBy("topic").agg(F.sum("m").alias("mass"), F.sum(F.col("m") * F.col("m")).alias("square"))
    mean = F.coalesce("inner", F.lit(0.0)) / F.greatest(F.col("mass") * F.col("mass") - F.col("square"), F.lit(eps))
    return mass.join(inner, "topic", "left").select("topic", mean.alias("association")).withColumn("loss", -F.log(F.col("association") + eps))


def objective(nll: DataFrame, residual: DataFrame, share: DataFrame, gates: DataFrame, lexical: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """One row: nll, pooling, gate, lexical and their weighted total, the objective of a stratum-adapted topic model.

    nll: one row (tokens, nll); residual: (stratum, topic, x) components of the strata's shifts; share: (stratum, w) weights of the strata; gates:
    (topic, gate); lexical: (topic, loss). pooling is the strata's mean squared shift weighted by their shares, gate the mean gate, lexical the
    mean loss. weights: of pooling, gate and lexical. A part without rows counts nothing.
    """
    square = residual.groupBy("stratum").agg(F.avg(F.col("x") * F.col("x")).alias("q")).join(share, "stratum")
    pooling = square.agg((F.sum(F.col("w") * F.col("q")) / F.sum("w")).alias("pooling"))
    parts = nll.select("nll").crossJoin(pooling).crossJoin(gates.agg(F.avg("gate").alias("gate"))).crossJoin(lexical.agg(F.avg("loss").alias("lexical")))  # one row each
    parts = parts.na.fill(0.0, ["pooling", "gate", "lexical"])
    return parts.withColumn("total", F.col("nll") + weights[0] * F.col("pooling") + weights[1] * F.col("gate") + weights[2] * F.col("lexical"))


def softmax_affinity(logits: DataFrame) -> DataFrame:
    """(topic, term_id, p) summing to 1 over topics for each term, of logits (topic, term_id, z)."""
    return softmax(logits, ["term_id"], "z", "p").select("topic", "term_id", "p")


def reporting_family(variant: Column) -> Column:
    """Which affinity a variant's displayed words come from."""
    return F.when(variant.isin("full", "no_pooled", "no_calibration"), "graph").when(variant.isin("no_graph", "parent"), "parent")


def frozen_variants(parent: Column, native: Column, calibrated: Column, pooled: Column, rho: float) -> Column:
    """Map of the five paired variants' probabilities."""
    mix = lambda p: (1 - rho) * p + rho * pooled
    return F.create_map(F.lit("full"), mix(calibrated), F.lit("no_graph"), mix(parent), F.lit("no_pooled"), calibrated, F.lit("no_calibration"), mix(native), F.lit("parent"), parent)


def stratum_variants(parent: Column, graph: Column, stratum: Column, pooled: Column, rho: float) -> Column:
    """Map of the five variants that back off to a stratum's prior: with and without the graph, without back-off, with the pooled prior instead, and
    the parent alone."""
    mix = lambda p, prior: (1 - rho) * p + rho * prior
    return F.create_map(F.lit("graph_stratum"), mix(graph, stratum), F.lit("stratum"), mix(parent, stratum), F.lit("graph"), graph, F.lit("graph_pooled"), mix(graph, pooled), F.lit("parent"), parent)
