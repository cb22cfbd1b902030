"""Items that appear together (6) and frequency of every distinct value (7), from long counts (doc_id, term_id, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_items(counts: DataFrame, vocabulary: DataFrame, salts: int = 8) -> DataFrame:
    """(doc_id, term_id, cnt): valid rows, one for each basket and item, with the largest count given.

    Valid: doc_id and term_id not null, cnt >= 1, term_id in the vocabulary. A frequent item's rows are spread
    over `salts` tasks for the vocabulary join. The result is laid out by doc_id.
    """
    rows = counts.where("cnt >= 1 and doc_id is not null and term_id is not null").groupBy("doc_id", "term_id").agg(F.max("cnt").alias("cnt"))
    known = vocabulary.where("term_id is not null").select("term_id").distinct().withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = rows.withColumn("salt", (F.abs(F.xxhash64("doc_id")) % salts).cast("int"))
    return rows.join(known, ["term_id", "salt"], "left_semi").select("doc_id", "term_id", "cnt")


def item_pairs(items: DataFrame, least_joint: int = 1, least_npmi: float | None = None, salts: int = 8) -> DataFrame:
    """(term_a, term_b, joint, count_a, count_b, n, lift, npmi) with term_a < term_b.

    items: distinct (doc_id, term_id). n is the number of baskets with an item. Pairs are emitted by a join of a basket
    with itself and counted with a map-side combine. With least_npmi = t >= 0 only pairs that can reach t are emitted:
    joint <= min(count), so npmi <= ln(n / max) / ln(n / min), and max / n <= (min / n)^t must hold. npmi is 1 where
    joint = n. Empty input gives no rows.
    """
    items = items.select("doc_id", "term_id")
    n = items.agg(F.countDistinct("doc_id").alias("n"))
    single = items.groupBy("term_id").agg(F.count("*").alias("df")).where(F.col("df") >= least_joint)
    spread = single.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    rows = items.withColumn("salt", (F.abs(F.xxhash64("doc_id")) % salts).cast("int")).join(spread, ["term_id", "salt"]).select("doc_id", "term_id", "df")
    rows = rows.crossJoin(F.broadcast(n)).repartition("doc_id")  # n is one row
    a = rows.select("doc_id", "n", F.col("term_id").alias("term_a"), F.col("df").alias("count_a"))
    b = rows.select("doc_id", F.col("term_id").alias("term_b"), F.col("df").alias("count_b"))
    both = a.join(b, "doc_id").where("term_a < term_b")
    if least_npmi is not None and least_npmi > 0:
        both = both.where(F.greatest("count_a", "count_b") / F.col("n") <= F.pow(F.least("count_a", "count_b") / F.col("n"), F.lit(least_npmi)) * 1.000001)
    out = both.groupBy("term_a", "term_b").agg(F.count("*").alias("joint"), F.first("count_a").alias("count_a"), F.first("count_b").alias("count_b"), F.first("n").alias("n"))
    out = out.where(F.col("joint") >= least_joint)
    lift = F.col("joint").cast("double") * F.col("n") / (F.col("count_a").cast("double") * F.col("count_b"))
    npmi = F.when(F.col("joint") == F.col("n"), F.lit(1.0)).otherwise(F.log(lift) / -F.log(F.col("joint") / F.col("n")))
    out = out.withColumn("lift", lift).withColumn("npmi", npmi)
    return out if least_npmi is None else out.where(F.col("npmi") >= least_npmi)


def term_frequencies(items: DataFrame, vocabulary: DataFrame, least_documents: int = 3, most_share: float = 0.25) -> DataFrame:
    """(term_id, term, documents, occurrences, n, mark) of every vocabulary term; mark is rare, common or null.

    items: distinct (doc_id, term_id, cnt). Terms without rows have 0 documents and are rare. A repeated term_id in
    the vocabulary is one term, by its smallest spelling.
    """
    n = items.agg(F.countDistinct("doc_id").alias("n"))
    used = items.groupBy("term_id").agg(F.count("*").alias("documents"), F.sum("cnt").alias("occurrences"))
    terms = vocabulary.where("term_id is not null").groupBy("term_id").agg(F.min("term").alias("term"))
    out = terms.join(used, "term_id", "left").crossJoin(F.broadcast(n)).na.fill(0, ["documents", "occurrences"])  # n is one row
    mark = F.when(F.col("documents") < least_documents, "rare").when(F.col("documents") > most_share * F.col("n"), "common")
    return out.withColumn("mark", mark)
