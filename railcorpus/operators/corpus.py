"""Corpus operators: records, counts, vocabulary, splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railcorpus.functions.text import hash32
from railcorpus.session import table


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, city, split, source, ts) one row a post; city null is unknown."""
    rows = table(spark, sf_dir, "posts").where("post_id is not null")
    rows = rows.groupBy(F.col("post_id").alias("doc_id")).agg(F.min("city").alias("city"), F.min("split").alias("split"), F.min("source").alias("source"), F.min("published_at").alias("ts"))
    return rows.withColumn("city", F.coalesce("city", F.lit("unknown")))


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, doc_id, term_id, cnt) valid count cells, one a document and term."""
    counts = table(spark, sf_dir, "counts").where("cnt >= 1 and doc_id is not null and term_id is not null")
    cells = counts.groupBy("split", "doc_id", "term_id").agg(F.max("cnt").alias("cnt"))
    return cells.join(table(spark, sf_dir, "vocabulary").select("term_id").distinct(), "term_id", "left_semi").select("split", "doc_id", "term_id", "cnt")


def bag_of_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term_id, cnt) of (doc_id, tokens) restricted to the vocabulary (term_id, term)."""
    words = tokens.select("doc_id", F.explode("tokens").alias("term"))
    return words.join(vocabulary.select("term_id", "term"), "term").groupBy("doc_id", "term_id").agg(F.count("*").alias("cnt"))


def build_vocabulary(tokens: DataFrame, least_documents: int = 2, size: int = 1148) -> DataFrame:
    """(term_id, term, df, tf) of fit documents' tokens: df >= least_documents, by df and tf descending and term; at most size."""
    per = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    freq = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= least_documents)
    top = freq.orderBy(F.desc("df"), F.desc("tf"), "term").limit(size)  # at most `size` rows from here on
    return top.select((F.row_number().over(Window.orderBy(F.desc("df"), F.desc("tf"), "term")) - 1).alias("term_id"), "term", "df", "tf")


def document_frequency(cells: DataFrame) -> DataFrame:
    return cells.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("cnt").alias("tf"))


def expand_tokens(cells: DataFrame) -> DataFrame:
    """(doc_id, tokens): term ids repeated by count, in term order."""
    pairs = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "cnt"))).alias("p"))
    return pairs.select("doc_id", F.flatten(F.transform("p", lambda x: F.array_repeat(x["term_id"], x["cnt"].cast("int")))).alias("tokens"))


def text_of_tokens(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, text): terms repeated by count, in term order, joined by spaces."""
    named = cells.join(vocabulary.select("term_id", "term"), "term_id")
    pairs = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "term", "cnt"))).alias("p"))
    words = F.flatten(F.transform("p", lambda x: F.array_repeat(x["term"], x["cnt"].cast("int"))))
    return pairs.select("doc_id", F.array_join(words, " ").alias("text"))


def duplicate_groups(rows: DataFrame, key: Column) -> DataFrame:
    """(group_key, copies) of the keys that more than one row has; null keys are no group."""
    return rows.select(key.alias("group_key")).where("group_key is not null").groupBy("group_key").agg(F.count("*").alias("copies")).where("copies > 1")


def hash_split(rows: DataFrame, key: str, fit_share: float = 0.7) -> DataFrame:
    """rows with part: fit or held by the hash of the key, so equal keys are never apart."""
    return rows.withColumn("part", F.when(hash32(F.col(key).cast("string")) < int(fit_share * 2**32), "fit").otherwise("held"))


def group_overlap(rows: DataFrame, group: str, part: str) -> DataFrame:
    """(group, parts) of the groups found in more than one part: leaks."""
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def chronological_blocks(rows: DataFrame, blocks: int, *order: str) -> DataFrame:
    """rows with block 1..blocks: equal contiguous stretches of the order, the first ones larger by one where it does not divide.

    Positions come from a range-partitioned count, not from one sorted task: each range is numbered apart and shifted by the rows before it.
    """
    placed = ordinal(rows, *order)
    n = rows.agg(F.count("*").alias("n"))
    q, r = F.floor(F.col("n") / blocks), F.col("n") % blocks
    at = F.col("position")
    block = F.when(at < r * (q + 1), F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return placed.crossJoin(F.broadcast(n)).withColumn("block", block.cast("int")).drop("n", "position")  # n is one row


def ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """rows with position 0.. in the order (which must be unique), numbered without a single-task sort.

    The ranges are kept: made twice, for the rows and for their sizes, their bounds are drawn anew and the positions have gaps and repeats.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    here = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).persist()
    sizes = here.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return here.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("position", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def chronological_split(rows: DataFrame, first: int, second: int, *order: str) -> DataFrame:
    """rows with position and part: the first rows train, the next validation, the rest test."""
    at = F.col("position")
    return ordinal(rows, *order).withColumn("part", F.when(at < first, "train").when(at < first + second, "validation").otherwise("test"))


def union_parts(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(part, key, row) of two disjoint parts one after the other, re-indexed; shared keys are an error."""
    both = first.select(key).withColumn("part", F.lit(0)).unionByName(second.select(key).withColumn("part", F.lit(1)))
    if both.groupBy(key).agg(F.count_distinct("part").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("the parts share keys")
    return ordinal(both, "part", key).withColumnRenamed("position", "row")


def biterms(tokens: DataFrame, window: int) -> DataFrame:
    """(a, b, n): unordered pairs of different terms less than window positions apart, over (doc_id, tokens).

    Each position meets the next window - 1 tokens of its own document only: no join.
    """
    at = tokens.select(F.posexplode("tokens").alias("pos", "x"), "tokens")
    near = at.select("x", F.explode(F.slice("tokens", F.col("pos") + 2, F.lit(window - 1))).alias("y")).where("x <> y")
    return near.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def check_table(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, observed, status) of conditions that no row may break, in one pass; observed counts the breaches."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).cast("long").alias("observed")) for k in checks])
    out = counted.select(F.explode(pairs).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.col("observed") == 0, "PASS").otherwise("FAIL"))


def locked_differences(returned: DataFrame, issued: DataFrame, key: str, locked: list[str]) -> DataFrame:
    """(key, problem): missing, added or changed locked fields of a returned form; null equals empty."""
    a = returned.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"a_{c}") for c in locked], F.lit(1).alias("_a"))
    b = issued.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"b_{c}") for c in locked], F.lit(1).alias("_b"))
    changed = F.lit(False)
    for c in locked:
        changed = changed | (F.col(f"a_{c}") != F.col(f"b_{c}"))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "added").when(changed, "changed")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def grid_gaps(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Keys of the full grid of the dimensions' values that rows lack. The grid is as large as the product of the distinct values."""
    grid = None
    for c in dimensions:
        values = rows.select(c).where(F.col(c).isNotNull()).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(rows.select(*dimensions).distinct(), dimensions, "left_anti")


def union_columns(*frames: DataFrame) -> DataFrame:
    """All rows, columns in order of first appearance, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unit_norm(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, off): distance of each vector's length from 1."""
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(key, F.abs(length - 1).alias("off"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): identity of a table's content whatever its order and layout.

    Two hashes of each row are summed, so that equal rows add up instead of cancelling out. Nulls count as values of their place.
    """
    columns = sorted(df.columns)
    quoted = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in quoted]) if columns else F.lit("")
    parts = [F.sum(F.xxhash64(F.lit(seed), nulls, *quoted).cast("decimal(20,0)")) for seed in (1, 2)]
    names = F.sha2(F.lit("|".join(columns)), 256)
    mark = F.concat_ws("|", F.count("*").cast("string"), names, *[F.coalesce(p.cast("string"), F.lit("0")) for p in parts])
    return df.agg(F.count("*").alias("rows"), F.sha2(mark, 256).alias("fingerprint"))


def strict_timestamps(rows: DataFrame, column: str, form: str, first=None, last=None) -> DataFrame:
    """(rows, first_ts, last_ts, status) of a text column that must parse in UTC by `form` on every row: a broken or null value is an error
    of the job. With first and last the range must be exactly theirs, else status is FAIL."""
    broken = F.raise_error(F.concat(F.lit("no timestamp: "), F.coalesce(F.col(column), F.lit("null"))))
    ts = F.coalesce(F.try_to_timestamp(F.col(column), F.lit(form)), broken.cast("timestamp"))
    out = rows.select(ts.alias("ts")).agg(F.count("ts").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    held = F.col("first_ts").eqNullSafe(F.lit(first).cast("timestamp")) & F.col("last_ts").eqNullSafe(F.lit(last).cast("timestamp")) if first is not None or last is not None else F.lit(True)
    return out.withColumn("status", F.when(held, "PASS").otherwise("FAIL"))


def partition_contract(documents: DataFrame, cells: DataFrame, strata: list[str], development: DataFrame) -> DataFrame:
    """(check, observed, status) of a held-out partition: documents (doc_id, stratum) and their cells (doc_id, term_id, cnt) against the development
    documents (doc_id). Breaches of: a document has an id, its own one, an expected stratum, a cell, and no place in development; a cell has a
    whole positive count and a document."""
    d = documents.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("stratum").alias("stratum"))
    held = cells.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("cells"), F.count_if(~F.coalesce((F.col("cnt") >= 1) & (F.col("cnt") == F.floor("cnt")), F.lit(False))).alias("bad"))
    dev = development.select(F.col("doc_id").alias("_v")).where("_v is not null").distinct()
    j = d.join(held, F.col("doc_id").eqNullSafe(F.col("_d")), "full").join(dev, F.col("doc_id") == F.col("_v"), "left")
    own = F.col("n").isNotNull()
    counted = j.agg(
        F.coalesce(F.sum(F.when(own & F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("id_present"), F.coalesce(F.sum(F.when(own, F.col("n") - 1)), F.lit(0)).alias("id_unique"),
        F.count_if(own & ~F.coalesce(F.col("stratum").isin(*strata), F.lit(False))).alias("stratum_expected"), F.count_if(own & F.col("cells").isNull()).alias("not_empty"),
        F.count_if(own & F.col("_v").isNotNull()).alias("not_in_development"), F.coalesce(F.sum("bad"), F.lit(0)).alias("count_whole"), F.count_if(~own).alias("cell_has_document"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("observed")) for c in counted.columns]))
    return counted.select(rows.alias("x")).select("x.*").withColumn("status", F.when(F.col("observed") == 0, "PASS").otherwise("FAIL"))


def date_consistency(rows: DataFrame, ts: str, year: str, month: str) -> DataFrame:
    """(year, posts, year_agrees, month_agrees): a year column and a column of month names, in any case, against a timestamp, by year. A null
    timestamp agrees with nothing."""
    same_year, same_month = F.year(ts) == F.col(year), F.lower(F.date_format(ts, "MMMM")) == F.lower(F.col(month))
    return rows.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("posts"), F.count_if(same_year).alias("year_agrees"), F.count_if(same_month).alias("month_agrees"))
