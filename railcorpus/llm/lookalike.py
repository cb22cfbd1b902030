"""Visually identical text with different characters (problem 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railcorpus.llm import textform
from railcorpus.llm.arrows import chunks


def consistent_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with `out`: the column's text in one consistent form. Null stays null; rows and other columns stay."""
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), True)])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, textform.consistent(batch.column(at))], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def form_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form_a, form_b, raw): a 128-bit hash of the consistent form and a 64-bit hash of the text as it is.

    Rows whose text is null, or shows nothing at all (empty or only blanks), are left out.
    """

    def run(batches):
        for batch in chunks(batches, textform.ROWS):
            cps, offs, valid = textform.codepoints(batch.column(1))
            raw = textform.row_hashes(cps, offs)
            cps, offs = textform.unify(cps, offs)
            drawn = (cps != 32) & (cps != 9) & (cps != 10) & (cps != 13)
            seen = np.concatenate([[0], drawn.cumsum()])[offs]
            keep = pa.array(valid & (np.diff(seen) > 0))
            columns = [batch.column(0), *(pa.array(h.view("i8")) for h in (textform.row_hashes(cps, offs), textform.row_hashes(cps, offs, 1), raw))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "form_a", "form_b", "raw"]).filter(keep)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, form_a long, form_b long, raw long")


def same_look_pairs(keys: DataFrame, by: list[str], order: Column | None = None, most_copies: int = 1000, strip: int = 1024) -> DataFrame:
    """Pairs of keys with equal form and different raw text, the first key before the second by (order, key). keys: form_keys with the
    columns `by`; a repeated key counts once, unless with itself.

    Only forms written in at least two ways reach the join. A spelling with more than most_copies exact copies
    stands in the pairs by its smallest key; form_classes has all its members, so no link between texts is lost. A look with
    many keys is cut into strips on one side, and each strip meets all keys of the look in a join key of its own.
    """
    keys = keys.dropDuplicates([*by, "form_a", "form_b", "raw", "key"])
    group = [*by, "form_a", "form_b"]
    spelt = keys.groupBy(*group, "raw").agg(F.count("*").alias("copies"), F.min("key").alias("first"))
    mixed = spelt.groupBy(*group).agg(F.count("*").alias("spellings")).where("spellings > 1").select(*group)
    spelt = spelt.join(mixed, group, "left_semi")
    rows = keys.join(spelt, [*group, "raw"]).where((F.col("copies") <= most_copies) | (F.col("key") == F.col("first")))
    standing = F.when(F.col("copies") <= most_copies, F.col("copies")).otherwise(1)
    size = spelt.groupBy(*group).agg(F.ceil(F.sum(standing) / strip).cast("int").alias("strips"))
    rows = rows.join(size, group).withColumn("place", F.struct((F.lit(0) if order is None else order).alias("order"), "key"))
    own = F.pmod(F.xxhash64("key", "raw"), F.col("strips")).cast("int")
    left = rows.select(*group, own.alias("strip"), F.col("key").alias("key_a"), F.col("raw").alias("raw_a"), F.col("place").alias("place_a"))
    right = rows.select(*group, F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), F.col("key").alias("key_b"), F.col("raw").alias("raw_b"), F.col("place").alias("place_b"))
    return left.join(right, [*group, "strip"]).where((F.col("raw_a") != F.col("raw_b")) & (F.col("place_a") < F.col("place_b"))).select(*by, "key_a", "key_b")


def form_classes(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, class_key, spellings): each key with the smallest key of its look and the number of ways the look is written."""
    keys = keys.dropDuplicates([*by, "form_a", "form_b", "raw", "key"])
    group = [*by, "form_a", "form_b"]
    spelt = keys.groupBy(*group, "raw").agg(F.min("key").alias("first")).groupBy(*group).agg(F.count("*").alias("spellings"), F.min("first").alias("class_key"))
    return keys.join(spelt, group).select(*by, "key", "class_key", "spellings")
