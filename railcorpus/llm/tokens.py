"""Sizes of texts in tokens of a public tokenizer, never trained here; its file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # where the public vocabulary files usually lie; a parameter of token_sizes


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_pattern() -> str:
    """The split pattern that the package of the vocabulary files gives; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_sizes(df: DataFrame, text: str, out: str = "tokens", ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """df without its text, with the number of tokens of the whole text; null text has 0.

    ranks is a vocabulary file on the driver, sent once to every executor; pattern splits texts before its merges.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    at = df.columns.index(text)
    rest = [c for c in df.columns if c != text]
    sc = df.sparkSession.sparkContext
    if ranks not in getattr(sc, "_railcorpus_files", ()):
        sc.addFile(ranks)
        sc._railcorpus_files = {*getattr(sc, "_railcorpus_files", ()), ranks}
    name, split = os.path.basename(ranks), pattern or default_pattern()

    def run(batches):
        enc = encoding(SparkFiles.get(name), split)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(at).to_pylist()]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], [*rest, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` long"]))
