"""Exact Jaccard similarity of shingle sets for candidate pairs, and pairs of ids from pairs of sets.

Sets are named by a 64-bit signature; texts with the same set are copies and share it. Candidate pairs are pairs
of signatures. Texts are looked up once per signature: a filter of bounded size built from the candidates' signatures
keeps the other texts out of the shuffle, the join after it is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railcorpus.llm.arrows import Bloom, bits_for, both_set, chunks, union_array
from railcorpus.llm.textform import ROWS, Shingles


def members(posts: DataFrame, width: int, least: int, wanted: DataFrame | None, rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(sig, id, text, *extra) of the posts with at least `least` tokens; text is null unless sig may be among wanted."""
    spark = posts.sparkSession
    fields = [posts.schema[c] for c in extra]
    bloom = cells = None
    if wanted is not None:
        bloom = Bloom(bits_for(rows))
        cells = spark.sparkContext.broadcast(
            union_array(wanted, lambda c, b: bloom.put(c, b.column(0).to_numpy().view("u8")), bloom.slots, "u1", 1 << 16, both_set)
        )

    def run(batches):
        for batch in chunks(batches, ROWS):
            s = Shingles(batch.column(1), width, least)
            sig = s.signature()
            part = batch.take(pa.array(s.rows))
            text = part.column(1)
            if bloom is not None:
                text = pc.if_else(pa.array(bloom.has(cells.value, sig)), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view("i8")), part.column(0), text, *part.columns[2:]], ["sig", "id", "text", *extra])

    schema = "sig long, id string, text string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)
    return posts.select("id", F.col("text").cast("string"), *extra).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: int, threshold: float) -> DataFrame:
    """(sig_a, sig_b, jaccard) of the pairs that reach the threshold. texts: (sig, text), null texts ignored."""
    one = texts.where("text is not null").groupBy("sig").agg(F.min("text").alias("text"))
    a = one.select(F.col("sig").alias("sig_a"), F.col("text").alias("text_a"))
    b = one.select(F.col("sig").alias("sig_b"), F.col("text").alias("text_b"))
    both = pairs.select("sig_a", "sig_b").join(a, "sig_a").join(b, "sig_b").select("sig_a", "sig_b", "text_a", "text_b")

    def run(batches):
        for batch in chunks(batches, ROWS):
            x, y = Shingles(batch.column(2), width, least), Shingles(batch.column(3), width, least)
            n = batch.num_rows
            size_x, size_y = np.zeros(n, np.int64), np.zeros(n, np.int64)
            size_x[x.rows], size_y[y.rows] = x.size, y.size
            shift = np.uint64(51)
            key_x = (x.rows[x.of].astype(np.uint64) << shift) | x.flat
            key_y = (y.rows[y.of].astype(np.uint64) << shift) | y.flat
            common = np.intersect1d(key_x, key_y, assume_unique=True)
            shared = np.bincount((common >> shift).astype(np.int64), minlength=n)
            total = size_x + size_y - shared
            score = np.where(total > 0, shared / np.maximum(total, 1), 0.0)
            keep = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["sig_a", "sig_b", "jaccard"]).filter(keep)

    return both.mapInArrow(run, "sig_a long, sig_b long, jaccard double")
