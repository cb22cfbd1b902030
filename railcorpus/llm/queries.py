"""Queries pN_... of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railcorpus.llm import cooccur, density, leakage, lookalike, mixing, neardup, packing, pii, reading
from railcorpus.llm.data import posts
from railcorpus.llm.oracles import FOUND
from railcorpus.llm.tokens import token_sizes
from railcorpus.session import table

# Near-same as TESTDATA.md has it for posts: 3-token shingles, 8 tokens or more, Jaccard 0.6 or more.
NEAR = {"threshold": 0.6, "width": 3, "least": 8}


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = lookalike.form_keys(posts(spark, sf_dir, "train"), "id", "text").withColumn("field", F.lit("train_documents"))
    terms = lookalike.form_keys(table(spark, sf_dir, "vocabulary"), "term_id", "term").withColumn("field", F.lit("vocabulary"))
    return train.unionByName(terms)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(posts(spark, sf_dir, "train", "validation"), pii.known_names(table(spark, sf_dir, "known_names")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select(F.col("id").alias("post_id"), "kind").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every train and validation delivery with typed placeholders for what was found: equal deliveries of a post once."""
    rows = posts(spark, sf_dir, "train", "validation").distinct()
    return pii.redacted(rows, pii.known_names(table(spark, sf_dir, "known_names"))).withColumnRenamed("id", "post_id")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.density_peaks(table(spark, sf_dir, "term_emb"), "term_id", "embedding")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select(F.col("key").cast("int").alias("term_id"), F.col("group_key").cast("int").alias("group_key"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size, densest term and most typical terms."""
    names = table(spark, sf_dir, "term_emb").select(F.col("term_id").cast("long").alias("key"), F.col("term").alias("name"))
    return density.describe(_terms(spark, sf_dir).persist(), names)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("field") == "vocabulary", F.col("key").try_cast("long"))
    return lookalike.same_look_pairs(_forms(spark, sf_dir), ["field"], F.coalesce(number, F.lit(0))).select("field", "key_a", "key_b")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every train post and term with the smallest key of its look."""
    return lookalike.form_classes(_forms(spark, sf_dir), ["field"])


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every train post's text in the consistent form."""
    return lookalike.consistent_form(posts(spark, sf_dir, "train").dropDuplicates(["id"]), "text", "form").select("id", "form")


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = posts(spark, sf_dir, "train", "validation", "test", extra=("split", "source"))
    return leakage.overlaps(rows.withColumn("is_train", F.col("split") == "train"), **NEAR, extra=("split", "source"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller id first, whichever split it is of."""
    pairs = leakage.cross_pairs(*_overlaps(spark, sf_dir))
    return pairs.select(F.least("post_a", "post_b").alias("post_a"), F.greatest("post_a", "post_b").alias("post_b")).where("post_a <> post_b").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by split and source, beside what was once claimed."""
    found = leakage.overlap_counts(*_overlaps(spark, sf_dir), ("split", "source"))
    claimed = table(spark, sf_dir, "leakage_report").select(F.col("split").alias("s"), F.col("source").alias("o"), "train_overlap", "status")
    out = found.join(claimed, F.col("split").eqNullSafe(F.col("s")) & F.col("source").eqNullSafe(F.col("o")), "full")
    out = out.select(F.coalesce("split", "s").alias("split"), F.coalesce("source", "o").alias("source"), "pairs", "posts", "train_overlap", "status")
    return out.na.fill(0, ["pairs", "posts"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, held = neardup.near_sets(posts(spark, sf_dir, "train", "validation"), **NEAR)
    return neardup.near_pairs(near, held)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a post with a near-same or equal one: its group's smallest post, and its number of links to other texts."""
    near, held = neardup.near_sets(posts(spark, sf_dir, "train", "validation"), **NEAR)
    return neardup.near_groups(near, held)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.distinct_items(table(spark, sf_dir, "counts").where("split = 'train'"), table(spark, sf_dir, "vocabulary"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.item_pairs(_items(spark, sf_dir), least_joint=5, least_npmi=0.6).select("term_a", "term_b")


def p6_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in 5 posts or more with its counts, to renew npmi_edges."""
    out = cooccur.item_pairs(_items(spark, sf_dir), least_joint=5)
    return out.select("term_a", "term_b", "joint", "count_a", "count_b", "n", F.round("npmi", 9).alias("npmi"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.term_frequencies(_items(spark, sf_dir), table(spark, sf_dir, "vocabulary")).where("mark is not null").select("term_id")


def p7_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.term_frequencies(_items(spark, sf_dir), table(spark, sf_dir, "vocabulary"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return token_sizes(docs, "text", "size")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_containers(spark, sf_dir).where("pieces > 1 and piece = 0").select(F.col("id").alias("doc_id"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir).select("id", "size"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, containers over their capacity, documents cut though they fit in one, documents that lost tokens."""
    sized = _sized(spark, sf_dir).select("id", "size").persist()
    packed = packing.pack(sized).persist()
    over = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > 2048).alias("overfull"))
    per = packed.groupBy("id").agg(F.sum("size").alias("kept"), F.max("pieces").alias("pieces")).join(sized.groupBy("id").agg(F.sum("size").alias("size")), "id", "full")
    small = per.agg(F.count_if((F.col("pieces") > 1) & (F.col("size") <= 2048)).alias("cut_small"), F.count_if(~F.col("kept").eqNullSafe(F.col("size"))).alias("lost"))
    return sized.agg(F.count("*").alias("documents")).crossJoin(over).crossJoin(small)  # one row each


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target source with its limit, and whether no document goes beyond it and the source beyond its share, unless others fall short."""
    s = p9_shares(spark, sf_dir)
    return s.select("source", "max_repeats", ((F.col("most_copies") <= F.col("max_repeats")) & (F.col("reached_share") <= F.lit(1.0))).alias("held_to"))


def _mixture(spark: SparkSession, sf_dir: str):
    return mixing.mix(_sized(spark, sf_dir).persist(), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir)).where("short").select("source")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf_dir))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where(f"level >= {reading.LEVELS - 0.5}").select("doc_id")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and mean surprisal by estimated level."""
    graded = p10_levels(spark, sf_dir).withColumn("grade", F.floor(F.col("level") + 0.5).cast("int"))
    return graded.groupBy("grade").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.round(F.avg("surprisal"), 3).alias("surprisal"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_ITEMS = """
    items AS (SELECT doc_id, term_id, MAX(cnt) AS cnt FROM counts
              WHERE split = 'train' AND cnt >= 1 AND doc_id IS NOT NULL AND term_id IN (SELECT term_id FROM vocabulary WHERE term_id IS NOT NULL)
              GROUP BY doc_id, term_id),
    n AS (SELECT CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS n FROM items),
    d AS (SELECT term_id, COUNT(*) AS df, CAST(SUM(cnt) AS BIGINT) AS tf FROM items GROUP BY term_id)"""
_PAIRS = f"""WITH {_ITEMS},
    k AS (SELECT a.term_id AS term_a, b.term_id AS term_b, COUNT(*) AS joint FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.term_id < b.term_id
          GROUP BY 1, 2 HAVING COUNT(*) >= 5),
    s AS (SELECT term_a, term_b, joint, x.df AS count_a, y.df AS count_b, n,
                 LN((joint / n) / ((x.df / n) * (y.df / n))) / -LN(joint / n) AS npmi
          FROM k JOIN d x ON x.term_id = term_a JOIN d y ON y.term_id = term_b CROSS JOIN n)"""
_TERMS = f"""WITH {_ITEMS},
    t AS (SELECT term_id, MIN(term) AS term FROM vocabulary WHERE term_id IS NOT NULL GROUP BY term_id),
    f AS (SELECT t.term_id, term, COALESCE(df, 0) AS documents, COALESCE(tf, 0) AS occurrences, n FROM t LEFT JOIN d USING (term_id) CROSS JOIN n),
    m AS (SELECT *, CASE WHEN documents < 3 THEN 'rare' WHEN documents > 0.25 * n THEN 'common' END AS mark FROM f)"""


def oracle_sql() -> dict[str, str]:
    return {
        **FOUND,
        "p6_found": _PAIRS + " SELECT term_a, term_b FROM s WHERE npmi >= 0.6",
        "p6_edges": _PAIRS + " SELECT term_a, term_b, joint, count_a, count_b, n, ROUND(npmi, 9) AS npmi FROM s",
        "p7_found": _TERMS + " SELECT term_id FROM m WHERE mark IS NOT NULL",
        "p7_frequencies": _TERMS + " SELECT * FROM m",
    }
