"""The project's tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railcorpus.session import table


def posts(spark: SparkSession, sf_dir: str, *splits: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, *extra) of the posts of the given splits. Repeated deliveries stay; operators count an id once."""
    rows = table(spark, sf_dir, "posts").where(F.col("split").isin(*splits))
    return rows.select(F.col("post_id").alias("id"), F.col("delexicalized_text").alias("text"), *extra)
