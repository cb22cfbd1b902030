"""Mixing sources to target weights (problem 9): whole copies, then Pareto order sampling of the rest.

All that reaches the driver is bounded by the target table and by size bins: totals by source and size bin, and
totals by source and rank bin. Documents never leave the executors and no source is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 8
RANKS_PER_OCTAVE = 64
RANK_LIMIT = 4096
CERTAIN = -RANK_LIMIT - 1
FINE_RANKS = 1 << 14


def source_key(column: str):
    """Sources compare trimmed and lower-cased."""
    return F.lower(F.trim(F.col(column)))


def _wanted(targets: list[dict], total: float) -> None:
    """Sets goal: tokens each source shall give. What a source cannot give goes to the others by their shares."""
    for t in targets:
        t["need"] = t["share"] * total
        t["most"] = float(t["repeats"]) * t["held"]
        t["goal"] = 0.0
    left, open_ = sum(t["need"] for t in targets), list(targets)
    while open_ and left > 1e-9 * max(total, 1):
        weight = sum(t["share"] for t in open_)
        if weight <= 0:
            break
        given = 0.0
        for t in open_:
            add = min(left * t["share"] / weight, t["most"] - t["goal"])
            t["goal"] += add
            given += add
        left -= given
        open_ = [t for t in open_ if t["most"] - t["goal"] > 1e-9 * max(total, 1)]
        if given <= 1e-12 * max(total, 1):
            break


def _inclusion(bins: list[tuple[int, float, float]], rest: float) -> dict[int, float]:
    """Inclusion probability by size bin: proportional to the square root of the size, at most 1, expected size `rest`."""
    lo, hi = 0.0, 1.0
    chance = lambda c, b: min(1.0, c * math.sqrt(2 ** (b / BINS_PER_OCTAVE)))
    expect = lambda c: sum(chance(c, b) * size for b, _, size in bins)
    while expect(hi) < rest and hi < 2**40:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expect(mid) < rest else (lo, mid)
    return {b: chance(hi, b) for b, _, _ in bins}


def plan(items: DataFrame, targets: DataFrame) -> list[dict]:
    """One dict a target source: share, repeats, docs, held, need, goal, whole copies, rest, chances by size bin.

    items: (source key, size, bin). Null sources of targets are left out; repeated ones add their shares and keep the largest
    limit; null or negative shares and limits are 0.
    """
    rows = targets.select(source_key("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats"))
    rows = rows.where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).orderBy("source")
    out = [r.asDict() for r in rows.collect()]
    names = [t["source"] for t in out]
    total = items.agg(F.sum("size")).first()[0] or 0
    bins: dict[str, list] = {n: [] for n in names}
    for r in items.where(F.col("source").isin(names)).groupBy("source", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("s")).orderBy("source", "bin").collect():
        bins[r["source"]].append((r["bin"], r["n"], float(r["s"])))
    for t in out:
        t["docs"], t["held"] = sum(n for _, n, _ in bins[t["source"]]), sum(s for _, _, s in bins[t["source"]])
    _wanted(out, float(total))
    for t in out:
        ratio = t["goal"] / t["held"] if t["held"] else 0.0
        t["total"] = float(total)
        t["whole"] = int(min(t["repeats"], math.floor(ratio + 1e-12)))
        t["rest"] = max(0.0, t["goal"] - t["whole"] * t["held"]) if t["whole"] < t["repeats"] else 0.0
        t["chances"] = _inclusion(bins[t["source"]], t["rest"]) if t["rest"] > 1e-9 * max(total, 1) else {}
    return out


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(id, source, size, copies >= 1) of documents (id, source, size), and the plan.

    The mixture is as large as all documents together as far as the repeat limits allow. Documents of no listed source,
    or without size, are not used. Size 0 counts nothing. Ties of rank fall by id.
    """
    spark = docs.sparkSession
    items = docs.select("id", source_key("source").alias("source"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")).where("size > 0")
    items = items.withColumn("bin", F.floor(BINS_PER_OCTAVE * F.log2("size")).cast("int"))
    made = plan(items, targets)
    if not made:
        return items.select("id", "source", "size", F.lit(0).alias("copies")).limit(0), made
    chances = [(t["source"], t["whole"], t["rest"], b, p) for t in made for b, p in (t["chances"] or {-1: 0.0}).items()]
    table = spark.createDataFrame(chances, "source string, whole int, rest double, bin int, chance double")
    whole = F.broadcast(table.select("source", "whole", "rest").distinct())  # at most one row a target
    drawn = items.join(whole, "source").join(F.broadcast(table.select("source", "bin", "chance")), ["source", "bin"], "left")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    rank = F.when(F.coalesce("chance", F.lit(0.0)) <= 0, None).when(F.col("chance") >= 1, F.lit(0.0)).otherwise(odds)
    drawn = drawn.withColumn("rank", rank)
    place = RANKS_PER_OCTAVE * F.log2("rank")
    octave = F.greatest(F.lit(-RANK_LIMIT), F.least(F.lit(RANK_LIMIT), F.floor(place))).cast("int")
    drawn = drawn.withColumn("at", F.when(F.col("rank") == 0, CERTAIN).otherwise(octave)).withColumn("fine", F.floor(FINE_RANKS * (place - F.col("at"))).cast("int"))
    # the bin of ranks in which a source is full, then the fine bin inside it: what is left to sort is a few documents a source
    drawn = drawn.persist(StorageLevel.MEMORY_AND_DISK)
    cut = spark.createDataFrame(_full(drawn.where("rank is not null").withColumn("before", F.lit(0).cast("long")), "at").collect(), "source string, cut_at int, before long")
    drawn = drawn.join(F.broadcast(cut), "source", "left")  # at most one row a target
    finer = spark.createDataFrame(_full(drawn.where((F.col("at") == F.col("cut_at")) & (F.col("at") != CERTAIN)), "fine").collect(), "source string, cut_fine int, before long")
    drawn = drawn.drop("before").join(F.broadcast(finer), "source", "left")
    last = (F.col("at") == F.col("cut_at")) & (F.col("fine") == F.col("cut_fine"))
    edge = drawn.where(last).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("upto")
    inside = (F.col("at") == CERTAIN) | (F.col("at") < F.col("cut_at")) | (F.col("at") == F.col("cut_at")) & (F.col("fine") < F.col("cut_fine"))
    other = drawn.where(~F.coalesce(last, F.lit(False))).withColumn("extra", F.coalesce(inside, F.lit(False)).cast("int"))
    out = other.unionByName(edge).select("id", "source", "size", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
    return out.where("copies > 0"), made


def _full(rows: DataFrame, by: str) -> DataFrame:
    """(source, cut_<by>, before): the last bin of `by` that begins below the source's rest, and the size taken before it; `before` of rows
    is taken ahead of all bins. One row a source and bin is sorted."""
    bins = rows.groupBy("source", by).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    bins = bins.withColumn("start", F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy(by)) - F.col("s"))
    return bins.where(F.col("start") < F.col("rest")).groupBy("source").agg(F.max(by).alias(f"cut_{by}"), F.max("start").alias("before"))


def shares(mixture: DataFrame, made: list[dict]) -> DataFrame:
    """(source, target_share, max_repeats, documents, held, reached_tokens, reached_share, most_copies, short) a target source.

    short: in the mixture every document of the source stands max_repeats times, and yet they stay below target_share of the summed
    size of all documents.
    """
    spark = mixture.sparkSession
    rows = [(t["source"], t["share"], t["repeats"], t["docs"], int(t["held"]), t["need"]) for t in made]
    want = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents long, held long, need double")
    got = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"), F.min("copies").alias("least_copies"), F.count("*").alias("used"))
    out = want.join(got, "source", "left").na.fill(0, ["reached_tokens", "most_copies", "least_copies", "used"])
    spent = (F.col("documents") == 0) | (F.col("used") == F.col("documents")) & (F.col("least_copies") == F.col("max_repeats"))
    out = out.withColumn("short", (spent | (F.col("max_repeats") == 0)) & (F.col("reached_tokens") < F.col("need")))
    total = got.agg(F.sum("reached_tokens").alias("all_tokens"))
    out = out.crossJoin(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", "all_tokens"), F.lit(0.0)))  # one row
    return out.select("source", "target_share", "max_repeats", "documents", "held", "reached_tokens", "reached_share", "most_copies", "short")
