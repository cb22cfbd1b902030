"""Term graph operators over count cells (doc_id, term_id, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(cells: DataFrame) -> DataFrame:
    """(a, b, joint): documents with both terms, a < b: a document meets itself, counts are combined map-side."""
    items = cells.select("doc_id", "term_id").distinct()
    left = items.withColumnRenamed("term_id", "a")
    right = items.withColumnRenamed("term_id", "b")
    return left.join(right, "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint"))


def npmi(joint: Column, df_a: Column, df_b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information, unclipped; the caller decides about joint = 0 and joint = n."""
    p = joint / n
    return F.log(p / ((df_a / n) * (df_b / n))) / -F.log(p)


def npmi_graph(cells: DataFrame, least_documents: int = 2, least_joint: int = 1, power: float = 1.25) -> DataFrame:
    """(src, dst, w) positive-NPMI graph: clipped to 0..1, weighted by (joint / n)^power, divided by the largest weight.

    n counts all documents of cells. A pair in every document has no edge. No edge at all gives no rows.
    """
    n = cells.agg(F.count_distinct("doc_id").alias("n"))
    df = cells.groupBy("term_id").agg(F.count_distinct("doc_id").alias("df")).where(F.col("df") >= least_documents)
    kept = cells.join(df.select("term_id"), "term_id", "left_semi")
    pairs = pair_counts(kept).where(F.col("joint") >= least_joint)
    both = pairs.join(df.select(F.col("term_id").alias("a"), F.col("df").alias("df_a")), "a").join(df.select(F.col("term_id").alias("b"), F.col("df").alias("df_b")), "b")
    both = both.crossJoin(F.broadcast(n)).where("joint < n")  # n is one row
    value = F.least(F.greatest(npmi(F.col("joint"), F.col("df_a"), F.col("df_b"), F.col("n")), F.lit(0.0)), F.lit(1.0))
    edges = both.select(F.col("a").alias("src"), F.col("b").alias("dst"), (value * F.pow(F.col("joint") / F.col("n"), F.lit(power))).alias("w")).where("w > 0")
    top = edges.agg(F.max("w").alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("w") / F.col("top")).alias("w"))  # top is one row


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degree(edges: DataFrame) -> DataFrame:
    """(term_id, degree) weighted; terms without edges are absent."""
    return both_ways(edges).groupBy(F.col("src").alias("term_id")).agg(F.sum("w").alias("degree"))


def strongest_edges(edges: DataFrame, k: int) -> DataFrame:
    """(src, rank, dst, w): the k heaviest edges of each term, ties by dst."""
    by = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return both_ways(edges).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("src", "rank", "dst", "w")


def top_word_support(top: DataFrame, edges: DataFrame, df: DataFrame, least_documents: int) -> DataFrame:
    """(topic, df_share, degree_share, edge_share) of displayed words (topic, rank, term_id)."""
    words = top.join(df.select("term_id", "df"), "term_id", "left").join(degree(edges), "term_id", "left")
    shares = words.groupBy("topic").agg(
        F.avg((F.coalesce("df", F.lit(0)) >= least_documents).cast("double")).alias("df_share"), F.avg((F.coalesce("degree", F.lit(0.0)) > 0).cast("double")).alias("degree_share")
    )
    a, b = top.select("topic", F.col("term_id").alias("src")), top.select("topic", F.col("term_id").alias("dst"))
    pairs = a.join(b, "topic").where("src < dst").join(edges.select("src", "dst", F.lit(1.0).alias("hit")), ["src", "dst"], "left")
    return shares.join(pairs.groupBy("topic").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("edge_share")), "topic")
