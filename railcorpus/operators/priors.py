"""Unigram priors, their mixtures, held-out completion and its likelihood. Cells are (doc_id, term_id, cnt)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railcorpus.functions.text import hash32
from railcorpus.operators.corpus import ordinal

FLOOR = 1e-12


def pooled_unigram(cells: DataFrame, vocabulary: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(term_id, p): (sum of counts + alpha) / (all counts + alpha V) of every vocabulary term, unseen ones too."""
    terms = vocabulary.select("term_id").distinct()
    counted = terms.join(cells.groupBy("term_id").agg(F.sum("cnt").alias("c")), "term_id", "left").na.fill(0, ["c"])
    total = counted.agg(F.sum("c").alias("total"), F.count("*").alias("v"))
    return counted.crossJoin(F.broadcast(total)).select("term_id", ((F.col("c") + alpha) / (F.col("total") + alpha * F.col("v"))).alias("p"))  # total is one row


def stratum_prior(cells: DataFrame, strata: DataFrame, vocabulary: DataFrame, shrinkage: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """(stratum, term_id, p): (1 - s) pooled + s stratum share, both smoothed; a row for every stratum and term.

    strata: (doc_id, stratum). The result has strata x vocabulary rows by definition; strata are few.
    """
    known = cells.join(strata, "doc_id")
    counted = known.groupBy("stratum", "term_id").agg(F.sum("cnt").alias("c"))
    names = known.select("stratum").distinct()
    total = counted.groupBy("stratum").agg(F.sum("c").alias("total"))
    pooled = pooled_unigram(known.select("doc_id", "term_id", "cnt"), vocabulary, alpha)
    size = vocabulary.agg(F.count_distinct("term_id").alias("v"))
    grid = pooled.crossJoin(names).crossJoin(F.broadcast(size)).join(counted, ["stratum", "term_id"], "left").join(total, "stratum")
    own = (F.coalesce("c", F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("v"))
    return grid.select("stratum", "term_id", ((1 - shrinkage) * F.col("p") + shrinkage * own).alias("p"))


def mixture(p: Column, prior: Column, rho: Column) -> Column:
    """(1 - rho) p + rho prior, exactly one of them at rho 0 and 1."""
    return F.when(rho == 0, p).when(rho == 1, prior).otherwise((1 - rho) * p + rho * prior)


def jensen_bound(parent_nll: Column, prior_nll: Column, rho: Column) -> Column:
    """Upper bound of a mixture's likelihood loss, by convexity."""
    return (1 - rho) * parent_nll + rho * prior_nll


def mixture_gains(cells: DataFrame, rhos: DataFrame) -> DataFrame:
    """(fold, rho, nll, gain) of target cells (fold, cnt, p, q) under the mixtures of p and q by rhos (rho): the gain over rho 0 of the same fold.

    The anchor is read off the fold's own few rows. Joined from a second sum, the two would differ in their last bits, and rho 0 gain on itself.
    """
    grid = cells.crossJoin(F.broadcast(rhos))  # a few rows
    g = grid.groupBy("fold", "rho").agg((F.sum(-F.col("cnt") * F.log(mixture(F.col("p"), F.col("q"), F.col("rho")))) / F.sum("cnt")).alias("nll"))
    anchor = F.max(F.when(F.col("rho") == 0, F.col("nll"))).over(Window.partitionBy("fold"))  # one row a rho
    return g.withColumn("gain", anchor - F.col("nll"))


def nll(cnt: Column, p: Column) -> list[Column]:
    """Aggregates tokens, nll (nats a token) and perplexity of target counts under p."""
    loss = F.sum(-cnt * F.log(F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1.0)))) / F.sum(cnt)
    return [F.sum(cnt).alias("tokens"), loss.alias("nll"), F.exp(F.least(loss, F.lit(700.0))).alias("perplexity")]


def completion_nll(target: DataFrame, prob: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tokens, nll and perplexity by group of target cells, their probabilities joined on keys; a missing probability is the floor."""
    return target.join(prob, keys, "left").groupBy(*by).agg(*nll(F.col("cnt"), F.coalesce("p", F.lit(0.0))))


def macro_micro(by_group: DataFrame, group: str) -> DataFrame:
    """(groups, macro_nll, micro_nll): plain mean over groups, and over tokens."""
    return by_group.agg(F.count(group).alias("groups"), F.avg("nll").alias("macro_nll"), (F.sum(F.col("nll") * F.col("tokens")) / F.sum("tokens")).alias("micro_nll"))


def folds(cells: DataFrame, k: int) -> DataFrame:
    """cells with fold 0..k-1 by the hash of doc_id."""
    return cells.withColumn("fold", (hash32(F.col("doc_id")) % k).cast("int"))


def crossfit(cells: DataFrame, strata: DataFrame, vocabulary: DataFrame, k: int = 5, shrinkage: float = 0.5, alpha: float = 0.5) -> DataFrame:
    """(fold, tokens, pooled_nll, stratum_nll, gain): each fold scored by priors of the others.

    Counts of the others are all counts less the fold's own, so no fold is copied k - 1 times.
    """
    own = folds(cells, k).join(strata, "doc_id").groupBy("fold", "stratum", "term_id").agg(F.sum("cnt").alias("cnt"))
    size = vocabulary.agg(F.count_distinct("term_id").alias("v"))

    def rest(keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        every = own.groupBy(*keys).agg(F.sum("cnt").alias("every"))
        fold = own.groupBy("fold", *keys).agg(F.sum("cnt").alias("mine"))
        return every.withColumnRenamed("every", f"every_{name}"), fold.withColumnRenamed("mine", f"mine_{name}")

    rows = own
    for keys, name in ((["term_id"], "t"), (["stratum", "term_id"], "st"), (["stratum"], "s"), ([], "a")):
        every, mine = rest(keys, name)
        rows = (rows.join(every, keys) if keys else rows.crossJoin(F.broadcast(every))).join(mine, ["fold", *keys])
    rows = rows.crossJoin(F.broadcast(size))  # one row
    left = lambda n: F.col(f"every_{n}") - F.col(f"mine_{n}")
    pooled = (left("t") + alpha) / (left("a") + alpha * F.col("v"))
    stratum = (1 - shrinkage) * pooled + shrinkage * (left("st") + alpha) / (left("s") + alpha * F.col("v"))
    out = rows.groupBy("fold").agg(F.sum("cnt").alias("tokens"), (F.sum(-F.col("cnt") * F.log(pooled)) / F.sum("cnt")).alias("pooled_nll"), (F.sum(-F.col("cnt") * F.log(stratum)) / F.sum("cnt")).alias("stratum_nll"))
    return out.withColumn("gain", F.col("pooled_nll") - F.col("stratum_nll"))


def completion_split(cells: DataFrame, seed: str = "7", least: int = 2) -> DataFrame:
    """(doc_id, term_id, observed, target): each token on one side by a bit of its hash.

    A document with one side empty gives it one token of its largest cell (lowest term on ties); documents under `least` tokens are
    left out. Independent of row order and layout.
    """
    size = Window.partitionBy("doc_id")
    cells = cells.withColumn("tokens", F.sum("cnt").over(size)).where(F.col("tokens") >= least)
    token = cells.select("*", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))).alias("i"))
    mark = hash32(F.concat_ws("|", F.lit("completion"), F.lit(seed), "doc_id", F.col("term_id").cast("string"), F.col("i").cast("string")))
    split = token.groupBy("doc_id", "term_id", "cnt", "tokens").agg(F.count_if(mark < 2**31).alias("observed"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cnt"), "term_id")) == 1
    split = split.withColumn("seen", F.sum("observed").over(size)).withColumn("first", first)
    move = F.when(F.col("first") & (F.col("seen") == 0), 1).when(F.col("first") & (F.col("seen") == F.col("tokens")), -1).otherwise(0)
    split = split.withColumn("observed", F.col("observed") + move)
    return split.select("doc_id", "term_id", "observed", (F.col("cnt") - F.col("observed")).alias("target"))


def pcg64_completion(cells: DataFrame, seed: int = 7, least: int = 2) -> DataFrame:
    """The same split with NumPy's binomial draws, seeded by document: (doc_id, term_id, observed, target). Documents are packed, so a
    batch holds many of them."""
    import hashlib

    pairs = cells.groupBy("doc_id").agg(F.sum("cnt").alias("tokens"), F.array_sort(F.collect_list(F.struct("term_id", "cnt"))).alias("p")).where(F.col("tokens") >= least)

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            count = batch.column(1).flatten().to_numpy()
            n = pc.list_value_length(batch.column(1)).to_numpy()
            seen, at = np.empty_like(count), 0
            for name, k in zip(names, n, strict=True):
                c = count[at : at + k]
                digest = hashlib.sha256(f"completion|{seed}|{name}".encode()).digest()
                s = np.random.Generator(np.random.PCG64(int.from_bytes(digest[:8], "little"))).binomial(c, 0.5)
                if not s.any():
                    s[c.argmax()] += 1
                elif s.sum() == c.sum():
                    s[c.argmax()] -= 1
                seen[at : at + k] = s
                at += k
            kept = [batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), batch.column(2).flatten(), pa.array(seen), pa.array(count - seen)]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "term_id", "observed", "target"])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return pairs.select("doc_id", F.col("p.cnt").cast("array<bigint>").alias("c"), F.col("p.term_id").alias("t")).mapInArrow(run, f"doc_id {kinds['doc_id']}, term_id {kinds['term_id']}, observed long, target long")


def _quotas(load: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each fold gets, if each goes to the least loaded fold, the first on ties."""
    ready = lambda t: [max(0, -(-(t - x) // size)) for x in load]  # noqa: E731  groups taken before a load of t is reached
    lo, hi = min(load), min(load) + size * (count + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(ready(mid)) <= count else (lo, mid - 1)
    out = ready(lo)
    for f, x in enumerate(load):
        if sum(out) == count:
            break
        if lo >= x and (lo - x) % size == 0:
            out[f] += 1
    return out


def group_folds(rows: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """(stratum, group_key, size, fold): groups never split; per stratum, larger groups first, each to the least loaded fold.

    rows: (stratum, group_key); rows without either are left out. Groups of one size are alike to the greedy rule, so it runs over the
    numbers of groups by size only (at most the square root of twice the rows); the groups of a size, in the order of a hash, fill the folds'
    shares one after the other. No task holds a stratum's groups.
    """
    spark = rows.sparkSession
    sizes = rows.where("stratum is not null and group_key is not null").groupBy("stratum", "group_key").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("mark", F.sha2(F.concat_ws("|", F.lit(str(seed)), "group_key"), 256)).persist()
    classes: dict = {}
    for r in sizes.groupBy("stratum", "size").agg(F.count("*").alias("n")).collect():  # strata x sizes
        classes.setdefault(r["stratum"], []).append((r["size"], r["n"]))
    table = []
    for stratum, found in classes.items():
        load = [0] * k
        for size, n in sorted(found, reverse=True):
            share = _quotas(load, size, n)
            load = [x + size * q for x, q in zip(load, share, strict=True)]
            table.append((stratum, size, np.cumsum(share).tolist()))
    placed = ordinal(sizes, "stratum", "size", "mark", "group_key")
    first = placed.groupBy("stratum", "size").agg(F.min("position").alias("first"))
    kind = rows.schema["stratum"].dataType.simpleString()
    upto = spark.createDataFrame(table, f"stratum {kind}, size long, upto array<long>")
    own = placed.join(first.join(upto, ["stratum", "size"]), ["stratum", "size"])
    at = F.col("position") - F.col("first")
    return own.select("stratum", "group_key", "size", F.size(F.filter("upto", lambda x: x <= at)).cast("int").alias("fold"))
