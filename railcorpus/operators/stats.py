"""Paired tests, corrections, agreement, gates and summaries over small metric tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample sd and median by group; nulls are not counted."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def signed_rank(rows: DataFrame, by: str, value: str, all_zero_p: float | None = None) -> DataFrame:
    """(by, n, zeros, statistic, p) exact two-sided signed-rank test; zeros dropped, ties get mid-ranks.

    The distribution of the doubled rank sum is built rank by rank: n (n + 1) numbers for n pairs, all in one task a group.
    No nonzero pair gives p = all_zero_p.
    """
    d = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("d"))
    zeros = d.groupBy(by).agg(F.count_if(F.col("d") == 0).alias("zeros"), F.count_if(F.col("d") != 0).alias("n"))
    live = d.where("d <> 0").withColumn("size", F.abs("d"))
    w = Window.partitionBy(by).orderBy("size")
    live = live.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(by, "size")) - 1) / 2)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks = np.rint(2 * pdf["rank"].to_numpy()).astype(np.int64)
        plus, total, top = int(ranks[pdf["up"].to_numpy(bool)].sum()), int(ranks.sum()), 1
        share = np.zeros(total + 1)
        share[0] = 1.0
        for r in np.sort(ranks):
            half = share[:top] / 2
            share[:top] = half
            share[r : r + top] += half
            top += int(r)
        far = np.abs(2 * np.arange(total + 1) - total) >= abs(2 * plus - total)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "statistic": [plus / 2], "p": [min(float(share[far].sum()), 1.0)]})

    kind = rows.schema[by].dataType.simpleString()
    test = live.select(by, "rank", (F.col("d") > 0).alias("up")).groupBy(by).applyInPandas(one, f"{by} {kind}, statistic double, p double")
    return zeros.join(test, by, "left").select(by, "n", "zeros", "statistic", F.when(F.col("n") == 0, F.lit(all_zero_p).cast("double")).otherwise(F.col("p")).alias("p"))


def holm(rows: DataFrame, family: str, p: str, order: str, alpha: float = 0.05) -> DataFrame:
    """rows with adjusted and reject: step-down within the family; null p stays null and does not count."""
    tested = rows.where(F.col(p).isNotNull())
    place = Window.partitionBy(family).orderBy(p, order)
    step = (F.count("*").over(Window.partitionBy(family)) - F.row_number().over(place) + 1) * F.col(p)
    done = tested.withColumn("_step", step).withColumn("adjusted", F.least(F.max("_step").over(place.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_step")
    done = done.withColumn("reject", F.col("adjusted") <= alpha)
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")).withColumn("reject", F.lit(None).cast("boolean")))


def paired_effects(rows: DataFrame, pair: str, variant: str, value: str, full: str, control: str, higher_is_better: bool) -> DataFrame:
    """(pair, effect): full less control where higher is better, else control less full; pairs that lack one are left out."""
    a = rows.where((F.col(variant) == full) & F.col(value).isNotNull()).select(pair, F.col(value).alias("a"))
    b = rows.where((F.col(variant) == control) & F.col(value).isNotNull()).select(pair, F.col(value).alias("b"))
    return a.join(b, pair).select(pair, (F.col("a") - F.col("b") if higher_is_better else F.col("b") - F.col("a")).alias("effect"))


def bootstrap_mean(rows: DataFrame, by: str, value: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """(by, n, mean, low, high): percentile bootstrap of a mean.

    Rows are counted by value first; each value's copies then draw Poisson weights for all resamples from a seed of their own. Partitions
    give sums by resample, so no task holds a group, and the result does not hang on the layout.
    """
    rows = rows.where(F.col(value).isNotNull())
    kind = rows.schema[by].dataType.simpleString()
    counted = rows.groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")).select("*", F.xxhash64(by, "v").alias("h"))

    def part(frames):
        held: dict = {}
        for pdf in frames:
            for g, v, c, h in zip(pdf[by], pdf["v"], pdf["c"], pdf["h"], strict=True):
                w = np.random.Generator(np.random.PCG64([seed, h & (1 << 64) - 1])).poisson(c, resamples)
                sums = held.setdefault(None if g is None or g != g else g, np.zeros((2, resamples)))
                sums[0] += w * v
                sums[1] += w
        yield pd.DataFrame({by: list(held), "sums": [s.ravel() for s in held.values()]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        total, weight = np.sum(pdf["sums"].to_list(), 0).reshape(2, resamples)
        means = total[weight > 0] / weight[weight > 0]
        low, high = np.quantile(means, [0.025, 0.975]) if len(means) else (None, None)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "low": [low], "high": [high]})

    spread = counted.mapInPandas(part, f"{by} {kind}, sums array<double>").groupBy(by).applyInPandas(one, f"{by} {kind}, low double, high double")
    plain = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return plain.join(spread, F.col("_by").eqNullSafe(F.col(by))).select(F.col("_by").alias(by), "n", "mean", "low", "high")


def cluster_bootstrap(rows: DataFrame, by: str, item: str, value: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(by, items, mean, low, high): items resampled whole, mean of their pooled values.

    Every item draws its own Poisson(1) weights from a hash of (item, resample), so items are never gathered and each resample is
    a sum over the whole table, combined map-side.
    """
    items = rows.where(F.col(value).isNotNull() & F.col(item).isNotNull()).groupBy(by, item).agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    # Cumulative Poisson(1) probabilities.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    u = F.pmod(F.xxhash64(F.col(item), F.col("_k"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    draws = items.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_w", sum((u >= s).cast("int") for s in steps))
    means = draws.groupBy(by, "_k").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_c"))).alias("_m"))
    spread = means.groupBy(F.col(by).alias("_by")).agg(F.expr("percentile(_m, 0.025)").alias("low"), F.expr("percentile(_m, 0.975)").alias("high"))
    plain = items.groupBy(by).agg(F.count("*").alias("items"), (F.sum("_s") / F.sum("_c")).alias("mean"))
    return plain.join(spread, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def krippendorff(ratings: DataFrame, item: str, value: str, ordinal: bool) -> DataFrame:
    """(alpha) agreement; items with one rating are ignored; null where no disagreement can be expected."""
    counts = ratings.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("c"))
    size = counts.groupBy(item).agg(F.sum("c").alias("m")).where("m > 1")
    counts = counts.join(size, item)
    a, b = counts.select(item, F.col(value).alias("a"), F.col("c").alias("c_a"), "m"), counts.select(item, F.col(value).alias("b"), F.col("c").alias("c_b"))
    same = F.when(F.col("a") == F.col("b"), 1).otherwise(0)
    pairs = a.join(b, item).groupBy("a", "b").agg(F.sum(F.col("c_a") * (F.col("c_b") - same) / (F.col("m") - 1)).alias("o"))
    marg = pairs.groupBy(F.col("a").alias("v")).agg(F.sum("o").alias("n"))
    cum = marg.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))  # one row a category
    x = cum.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("upto").alias("u_a"))
    y = cum.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("upto").alias("u_b"))
    span = F.greatest("u_a", "u_b") - F.least(F.col("u_a") - F.col("n_a"), F.col("u_b") - F.col("n_b")) - (F.col("n_a") + F.col("n_b")) / 2
    delta = F.when(F.col("a") == F.col("b"), 0.0).otherwise(span * span if ordinal else F.lit(1.0))
    grid = x.crossJoin(y).join(pairs, ["a", "b"], "left").na.fill(0.0, ["o"]).withColumn("d", delta)
    total = marg.agg(F.sum("n").alias("n"))
    out = grid.crossJoin(F.broadcast(total)).agg((F.sum(F.col("o") * F.col("d")) / F.max("n")).alias("seen"), (F.sum(F.col("n_a") * F.col("n_b") * F.col("d")) / (F.max("n") * (F.max("n") - 1))).alias("by_chance"))
    return out.select(F.when(F.col("by_chance") > 0, 1 - F.col("seen") / F.col("by_chance")).alias("alpha"))


def majority(votes: DataFrame, item: str, value: str, least: int = 2) -> DataFrame:
    """(item, choice, votes): the most frequent value, the smaller on ties; no_consensus under `least` votes."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(item, F.col(value).alias("v")).agg(F.count("*").alias("votes"))
    best = counts.groupBy(item).agg(F.max("votes").alias("votes")).join(counts, [item, "votes"]).groupBy(item, "votes").agg(F.min("v").alias("v"))
    return best.select(item, F.when(F.col("votes") >= least, F.col("v").cast("string")).otherwise("no_consensus").alias("choice"), "votes")


def rank_profile(rows: DataFrame, name: str, metrics: dict[str, bool]) -> DataFrame:
    """(name, firsts, top_threes, rank of each metric): minimum ranks, nulls last; metrics map to whether lower is better."""
    out = rows
    for m, lower in metrics.items():
        out = out.withColumn(f"{m}_rank", F.rank().over(Window.orderBy(F.asc_nulls_last(m) if lower else F.desc_nulls_last(m))))  # one row a method
    ranks = [F.col(f"{m}_rank") for m in metrics]
    return out.select(name, sum((r == 1).cast("int") for r in ranks).alias("firsts"), sum((r <= 3).cast("int") for r in ranks).alias("top_threes"), *ranks)


def average_rank(value: str, by: str) -> Column:
    """Mid-rank of value within by."""
    return F.rank().over(Window.partitionBy(by).orderBy(value)) + (F.count("*").over(Window.partitionBy(by, value)) - 1) / 2


def gates(rows: DataFrame, checks: dict[str, Column], margins: dict[str, Column]) -> DataFrame:
    """One row: every check, the names of the failed ones, eligible, and the least margin."""
    one = rows.agg(*[c.alias(k) for k, c in checks.items()], *[c.alias(f"margin_{k}") for k, c in margins.items()])
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in checks]))
    least = F.least(*[F.col(f"margin_{k}") for k in margins]) if len(margins) > 1 else F.col(f"margin_{next(iter(margins))}")
    return one.select(*checks, failed.alias("failed"), (F.size(failed) == 0).alias("eligible"), least.alias("margin"))


def select_candidate(rows: DataFrame, eligible: Column, *order: Column) -> DataFrame:
    """The first eligible row of the order, or none."""
    return rows.where(eligible).orderBy(*order).limit(1)


def edge_means(rows: DataFrame, order: str, value: str, width: int = 10) -> DataFrame:
    """(first_mean, last_mean) over the first and last rows of a trace, at most width and a quarter of it."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    k = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(n / 4)))
    place = F.row_number().over(Window.orderBy(order))  # a trace is one row an epoch
    at = rows.withColumn("_k", k).withColumn("_n", n).withColumn("_at", place)
    return at.agg(F.avg(F.when(F.col("_at") <= F.col("_k"), F.col(value))).alias("first_mean"), F.avg(F.when(F.col("_at") > F.col("_n") - F.col("_k"), F.col(value))).alias("last_mean"))


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def relative_to_first(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with relative: value over the group's value at its first place."""
    first = rows.groupBy(by).agg(F.min_by(value, order).alias("_first"))
    return rows.join(first, by).withColumn("relative", F.col(value) / F.col("_first")).drop("_first")


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.25)").alias("q25"), F.expr(f"percentile({value}, 0.75)").alias("q75"), F.min(value).alias("low"), F.max(value).alias("high"))


def coverage_gap(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """(shared, total, share): how many of rows' keys the other table has."""
    known = other.select(key).distinct().withColumn("_hit", F.lit(1))
    return rows.select(key).distinct().join(known, key, "left").agg(F.count("_hit").alias("shared"), F.count("*").alias("total"), (F.count("_hit") / F.count("*")).alias("share"))


def run_diagnostics(runs: DataFrame, method: str, runtime: str, converged: Column, device: str) -> DataFrame:
    """(method, runs, mean, sd, converged, devices) of a table of runs: runtime's mean and sample sd, how many converged, on which devices."""
    return runs.groupBy(method).agg(F.count("*").alias("runs"), F.avg(runtime).alias("mean"), F.stddev_samp(runtime).alias("sd"), F.count_if(converged).alias("converged"), F.array_sort(F.collect_set(device)).alias("devices"))


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & ~F.abs(value).isin(float("inf")), F.lit(False))


def final_diagnostics(rows: DataFrame, variant: str, seed: str, metrics: list[str], expected: DataFrame) -> DataFrame:
    """(variant, metric, least, most, bad, seeds, whole): range of each metric, values that are not finite, and whether every expected seed
    (one column) has a row and no other has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    long = rows.select(F.col(variant).alias("variant"), F.col(seed).alias("_seed"), pairs.alias("x")).select("variant", "_seed", "x.*")
    known = expected.select(F.col(expected.columns[0]).alias("_seed"), F.lit(True).alias("_known")).distinct()
    wanted = known.agg(F.count("*").alias("_wanted"))
    good = F.when(finite(F.col("v")), F.col("v"))
    out = long.join(known, "_seed", "left").groupBy("variant", "metric").agg(
        F.min(good).alias("least"), F.max(good).alias("most"), F.count_if(~finite(F.col("v"))).alias("bad"), F.count_distinct("_seed").alias("seeds"), F.count_if(F.col("_known").isNull()).alias("_odd")
    )
    return out.crossJoin(F.broadcast(wanted)).withColumn("whole", (F.col("seeds") == F.col("_wanted")) & (F.col("_odd") == 0)).drop("_wanted", "_odd")  # one row


def panel(ratings: DataFrame, by: str, item: str, value: str, vote: Column, resamples: int = 2000) -> DataFrame:
    """(by, items, ratings, numerator, denominator, rate, mean, low, high): a panel's votes as a share of its ratings, and the mean rating with its
    item-cluster bootstrap interval. Null ratings count nowhere."""
    rated = ratings.where(F.col(value).isNotNull())
    out = rated.groupBy(by).agg(F.count_distinct(item).alias("items"), F.count("*").alias("ratings"), F.count_if(vote).alias("numerator"), F.avg(value).alias("mean")).withColumn("denominator", F.col("ratings")).withColumn("rate", F.col("numerator") / F.col("denominator"))
    spread = cluster_bootstrap(rated.select(by, item, F.col(value).cast("double").alias(value)), by, item, value, resamples).select(F.col(by).alias("_by"), "low", "high")
    return out.join(spread, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def reliability(ratings: DataFrame, item: str, outcomes: list[tuple[str, bool]], decimals: int = 3) -> DataFrame:
    """(outcome, coefficient, value, reported, estimable) of each outcome column, ordinal or not; N/E where no disagreement can be expected."""
    out = None
    for column, ordinal in outcomes:
        a = krippendorff(ratings, item, column, ordinal).select(
            F.lit(column).alias("outcome"), F.lit(f"krippendorff_alpha_{'ordinal' if ordinal else 'nominal'}").alias("coefficient"), F.col("alpha").alias("value"),
            F.when(F.col("alpha").isNull(), "N/E").otherwise(F.format_string(f"%.{decimals}f", "alpha")).alias("reported"), F.col("alpha").isNotNull().alias("estimable"),
        )
        out = a if out is None else out.unionByName(a)
    return out
