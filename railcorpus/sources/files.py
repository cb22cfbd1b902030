"""Scans and sinks: typed CSV, CSV in ZIP, JSON lines, JSON documents, array files, canonical JSON, manifests and archives."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railcorpus.operators.corpus import union_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Typed CSV with a header, by name: a byte-order mark is dropped, columns absent from the file are null, only `columns` are read.

    Files are split unless fields hold line breaks (multi_line): then each file is one task's work.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    names = {c.lstrip("﻿"): c for c in raw.columns}
    picked = [f for f in kind.fields if columns is None or f.name in columns]
    return raw.select([(F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in picked])


def row_contract(rows: DataFrame, row: str, key: str, constants: dict[str, str]) -> DataFrame:
    """(check, observed, status): row numbers run from 0 without a gap, keys are present and unique, columns hold their constant on every row.
    observed counts the breaches."""
    n = rows.agg(F.count("*").alias("n"))
    numbers = rows.select(row).where(F.col(row).isNotNull()).distinct().crossJoin(F.broadcast(n)).where(f"`{row}` between 0 and n - 1").agg(F.count("*").alias("seen"))  # n is one row
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().agg(F.count("*").alias("keys"))
    wrong = rows.agg(*[F.count_if(~F.coalesce(F.col(c) == v, F.lit(False))).alias(f"constant_{c}") for c, v in constants.items()], F.lit(0).alias("_"))
    one = n.crossJoin(numbers).crossJoin(keys).crossJoin(wrong)  # one row each
    checks = [("contiguous", F.col("n") - F.col("seen")), ("unique_key", F.col("n") - F.col("keys")), *[(f"constant_{c}", F.col(f"constant_{c}")) for c in constants]]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("observed")) for k, v in checks])).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.col("observed") == 0, "PASS").otherwise("FAIL"))


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str], sha256: str | None = None, member_sha256: str | None = None, header: list[str] | None = None) -> DataFrame:
    """(columns as strings) of a CSV member of a ZIP archive; the hashes of the archive and of the member and the exact header (in any order) are
    checked where given. All-null rows are dropped.

    An archive is one task's work; several archives are read in parallel.
    """

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                if sha256 and hashlib.sha256(content).hexdigest() != sha256:
                    raise ValueError("the archive is not the expected one")
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    if member_sha256:
                        if hashlib.file_digest(f, "sha256").hexdigest() != member_sha256:
                            raise ValueError("the member is not the expected one")
                        f.seek(0)
                    rows = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                    head = next(rows)
                    if header is not None and sorted(head) != sorted(header):
                        raise ValueError(f"the header is {head}")
                    if not set(columns) <= set(head):
                        raise ValueError(f"the header lacks {sorted(set(columns) - set(head))}")
                    at = [head.index(c) for c in columns]
                    batch = []
                    for r in rows:
                        batch.append([r[i] or None for i in at])
                        if len(batch) == 10_000:
                            yield pd.DataFrame(batch, columns=columns)
                            batch = []
                    yield pd.DataFrame(batch, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns)).dropna(how="all")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_json_document(path: str) -> dict:
    """A whole-file object, such as a contract; small control files only."""
    return json.loads(Path(path).read_text("utf-8-sig"))


def load_settings(path: str, locked: dict) -> dict:
    """A settings file (JSON, or YAML where a parser is installed) whose locked values must be as given (dotted keys)."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError("no YAML parser is installed") from None
        found = yaml.safe_load(Path(path).read_text("utf-8-sig"))
    else:
        found = read_json_document(path)
    for key, want in locked.items():
        at = found
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at != want:
            raise ValueError(f"{key} is {at!r}, not {want!r}")
    return found


def read_array_file(spark: SparkSession, path: str, keys: str, values: str) -> DataFrame:
    """(key, embedding) of an NPZ file's key and matrix arrays; keys must be unique and as many as rows. Bounded by the file."""
    with np.load(path, allow_pickle=False) as z:
        names, rows = [str(k) for k in z[keys]], z[values]
    if len(set(names)) != len(names) or len(names) != len(rows):
        raise ValueError("keys are repeated or do not match the rows")
    return spark.createDataFrame(pd.DataFrame({"key": names, "embedding": [r.astype("f4").tolist() for r in rows]}), "key string, embedding array<float>")


def read_sparse_file(spark: SparkSession, path: str, documents: list[str]) -> DataFrame:
    """(doc_id, term_id, cnt) of a CSR matrix in an NPZ file."""
    with np.load(path, allow_pickle=False) as z:
        indptr, indices, data = z["indptr"], z["indices"], z["data"]
    if len(indptr) != len(documents) + 1:
        raise ValueError("documents do not match the rows")
    rows = pd.DataFrame({"doc_id": np.repeat(documents, np.diff(indptr)), "term_id": indices.astype("i4"), "cnt": data.astype("i8")})
    return spark.createDataFrame(rows, "doc_id string, term_id int, cnt long")


def write_csv(path: str, *frames: DataFrame) -> None:
    """Rows of all frames; the columns are the ordered union of theirs."""
    union_columns(*frames).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Keys sorted, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tables(folder: str, **frames: DataFrame) -> None:
    """Long-format distributions and counts as Parquet, one folder a table."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def signed(value: dict, key: str = "sha256") -> dict:
    """value with its own hash in key."""
    return {**value, key: canonical_hash({k: v for k, v in value.items() if k != key})}


def verify_signed(value: dict, key: str = "sha256") -> bool:
    return value.get(key) == canonical_hash({k: v for k, v in value.items() if k != key})


def manifest(spark: SparkSession, root: str, parts: list[str] | None = None) -> DataFrame:
    """(path, bytes, sha256) of every file below root, or below these parts of it, hashed on the executors; path is relative to root. A file is
    one task's work and at most 2 GB."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}/{p}" for p in parts] if parts else base)
    tail = F.substring_index("path", f"{base}/", -1)
    return files.select(tail.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory_difference(listed: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): names that only one of two inventories has, or that one has more often; none where they are equal."""
    a, b = (d.groupBy(F.col(key).alias(key)).agg(F.count("*").alias(n)) for d, n in ((listed, "_a"), (observed, "_b")))
    both = a.join(b.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "full")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_a") != F.col("_b"), "repeated")
    return both.select(F.coalesce(key, "_key").alias(key), problem.alias("problem")).where("problem is not null")


def manifest_problems(listed: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, problem): missing, changed or unlisted files."""
    a = listed.select("path", F.struct("bytes", "sha256").alias("a"))
    b = observed.select("path", F.struct("bytes", "sha256").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def archive(folder: str, target: str) -> str:
    """A deflated ZIP of a finished report folder."""
    root = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(root))
    return target


def latest_passing(runs: list[dict], **locks) -> dict | None:
    """The newest run (by run_id) whose contract holds every lock."""
    good = [r for r in runs if all(r.get(k) == v for k, v in locks.items())]
    return max(good, key=lambda r: r["run_id"], default=None)


class Cache:
    """Fitted tables kept by what made them: reused only where the input's fingerprint and the parameters are the same."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str, source: str, parameters: dict, make) -> DataFrame:
        path = f"{self.folder}/{name}-{canonical_hash([source, parameters])[:16]}.parquet"
        try:
            return self.spark.read.parquet(path)
        except Exception as error:  # an absent path has its own class only on the server side
            if "PATH_NOT_FOUND" not in str(error):
                raise
        make().write.parquet(path)
        return self.spark.read.parquet(path)
