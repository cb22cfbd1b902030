"""Connected components of an edge table, by alternating large and small stars, and roots of pointer forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railcorpus.session import ensure_checkpoint_dir


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component. edges: (u, v) of one ordered type.

    Each round is written to the checkpoint folder, so lineage stays short and lost executors cost one round.
    A node with many edges is split by adaptive skew handling; its side of the join has one row.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _mark(e)
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(roots)


def follow(pointers: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of pointers (node, to), where a root points to itself: each round doubles the length of the path."""
    ensure_checkpoint_dir(pointers.sparkSession)
    p = pointers.select("node", F.col("to").alias("root")).checkpoint()
    for _ in range(rounds):
        step = p.select(F.col("node").alias("root"), F.col("root").alias("next"))
        q = p.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")).checkpoint()
        moved = q.where("moved").limit(1).count()
        p = q.drop("moved")
        if not moved:
            return p
    raise RuntimeError(f"pointers did not settle in {rounds} rounds: they run in a circle")
