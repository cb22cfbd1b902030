"""Validated joins, audits, human panels and the lexical and decoding terms of a fitted model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railcorpus.operators.corpus import ordinal, table_fingerprint
from railcorpus.operators.graph import both_ways
from railcorpus.operators.topics import normalise, softmax
from railcorpus.sources.files import signed, verify_signed


def join_once(left: DataFrame, right: DataFrame, key: str, one_to_one: bool = False) -> DataFrame:
    """Inner join whose right (and with one_to_one also left) key is unique; a repeated key is an error before any row is joined."""
    for side in (right, left) if one_to_one else (right,):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is repeated")
    return left.join(right, key)


def tolerant_differences(left: DataFrame, right: DataFrame, key: str, values: list[str], absolute: float = 1e-12, relative: float = 1e-11) -> DataFrame:
    """(key, problem): rows of either side that lack a partner or differ by more than the tolerance; two nulls are equal."""
    a = left.select(key, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    b = right.select(key, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    off = F.lit(False)
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        near = F.abs(x - y) <= absolute + relative * F.greatest(F.abs(x), F.abs(y))
        off = off | ~F.coalesce(near | x.eqNullSafe(y), F.lit(False))
    problem = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").when(off, "different")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def constancy(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """(by, distinct values of each column, constant): a group must have exactly one value of each."""
    out = rows.groupBy(by).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("∅"))).alias(c) for c in columns])
    return out.withColumn("constant", F.greatest(*columns, F.lit(1)) == 1)


def cell_summary(ratings: DataFrame, cell: list[str], value: str, vote: Column, least: float = 3.0) -> DataFrame:
    """Count, median, mean and yes votes by cell, and whether it is eligible: median reached and two votes or more."""
    out = ratings.groupBy(*cell).agg(F.count(value).alias("ratings"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.avg(value).alias("mean"), F.count_if(vote).alias("votes"))
    return out.withColumn("eligible", (F.col("median") >= least) & (F.col("votes") >= 2))


def best_cell(cells: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first eligible cell of each group; rows past the first are dropped before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return cells.where("eligible").withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def mapping_check(rows: DataFrame, key: str, value: str, expected: dict[str, str]) -> DataFrame:
    """(key, value, expected, same) against a fixed mapping; a key it lacks is not the same."""
    m = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]) if expected else F.create_map().cast("map<string,string>")
    return rows.select(key, value, F.try_element_at(m, F.col(key)).alias("expected")).withColumn("same", F.coalesce(F.col(value) == F.col("expected"), F.lit(False)))


def context_input(observed: DataFrame, assigned: DataFrame, context: DataFrame, size: int) -> DataFrame:
    """(doc_id, index, cnt): a document's observed terms, and behind them those of its cluster. Targets have no part in it.

    assigned: (doc_id, cluster); context: (cluster, term_id, cnt).
    """
    behind = assigned.join(context, "cluster").select("doc_id", (F.col("term_id") + size).alias("index"), "cnt")
    return observed.select("doc_id", F.col("term_id").alias("index"), "cnt").unionByName(behind)


def lexical_terms(members: DataFrame, edges: DataFrame, capacity: float = 1.0) -> DataFrame:
    """One row of a topic model's lexical terms over soft memberships (topic, term_id, m).

    association: mean edge weight inside topics; overlap: mean product of memberships of two topics on a word; excess: mass over
    the capacity of a word; unsupported: mass on words without an edge.
    """
    active = both_ways(edges).select(F.col("src").alias("term_id")).distinct().withColumn("active", F.lit(1))
    x, y = members.select("topic", F.col("term_id").alias("src"), F.col("m").alias("p")), members.select("topic", F.col("term_id").alias("dst"), F.col("m").alias("q"))
    inner = both_ways(edges).join(x, "src").join(y, ["topic", "dst"]).groupBy("topic").agg(F.sum(F.col("w") * F.col("p") * F.col("q")).alias("inner"))
    topic = members.join(active, "term_id", "left").groupBy("topic").agg(
        F.sum("m").alias("mass"), F.sum(F.col("m") * F.col("m")).alias("square"), F.sum(F.when(F.col("active").isNull(), F.col("m")).otherwise(0.0)).alias("loose")
    )
    topic = topic.join(inner, "topic", "left").agg(
        F.avg(F.coalesce("inner", F.lit(0.0)) / (F.col("mass") * F.col("mass") - F.col("square"))).alias("association"), F.sum("loose").alias("unsupported"), F.count("*").alias("k")
    )
    word = members.groupBy("term_id").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
    word = word.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum(F.greatest(F.col("s") - capacity, F.lit(0.0))).alias("excess"))
    return topic.crossJoin(word).select("association", F.try_divide("pairs", F.col("k") * (F.col("k") - 1) / 2).alias("overlap"), "excess", "unsupported")  # one row each


def prototype_lexical(
    affinity: DataFrame, edges: DataFrame, residual: DataFrame, cores: DataFrame, k: int = 10, temperature: float = 0.1, margin: float = 0.1, most_shift: float = 1.0,
    weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0),
) -> DataFrame:
    """One row: association_loss, overlap, prototype_margin, unsupported_mass, residual_energy, their total, duplicate_slots and core_recall.

    affinity: (topic, term_id, p) of every topic and term; residual: (topic, term_id, z) before centring; cores: (topic, slot, term_id). Scores are
    standardised log shares, memberships their soft top k. overlap: what a topic's memberships, brought to sum 1, share with another topic on average;
    prototype_margin: how far core words stay below the best other word and the margin; unsupported_mass: share of memberships on words without an
    edge; residual_energy: mean square of the centred residual in units of most_shift. weights: of the last four in the total. duplicate_slots:
    displayed places that repeat a word of another topic; core_recall: displayed share of the core words.
    """
    from railcorpus.operators.topics import association, rank_scores, soft_top_k, top_words

    scores = rank_scores(affinity).persist()
    members = soft_top_k(scores, k, temperature).persist()
    names = members.agg(F.count_distinct("topic").alias("topics"))
    loss = association(members, edges).agg(F.avg("loss").alias("association_loss"))
    mass, word = members.groupBy("topic").agg(F.sum("m").alias("mass")), members.groupBy("term_id").agg(F.sum("m").alias("all"))
    shared = members.join(word, "term_id").join(mass, "topic").agg(F.sum(F.col("m") * (F.col("all") - F.col("m")) / F.col("mass")).alias("shared"))
    core = cores.select("topic", "term_id").distinct()
    edge = scores.join(core, ["topic", "term_id"], "left_anti").groupBy("topic").agg(F.max("score").alias("edge"))
    behind = scores.join(core, ["topic", "term_id"]).join(edge, "topic").agg(F.coalesce(F.avg(F.greatest(F.col("edge") + margin - F.col("score"), F.lit(0.0))), F.lit(0.0)).alias("prototype_margin"))
    active = both_ways(edges).select(F.col("src").alias("term_id")).distinct()
    loose = members.join(active, "term_id", "left_anti").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("loose"))
    centre = residual.groupBy("term_id").agg(F.avg("z").alias("mean"))
    energy = residual.join(centre, "term_id").agg(F.coalesce(F.avg(F.pow((F.col("z") - F.col("mean")) / most_shift, 2)), F.lit(0.0)).alias("residual_energy"))
    shown = top_words(scores, "score", k).select("topic", "term_id").persist()
    repeats = shown.groupBy("term_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_slots"))
    recall = core.join(shown.withColumn("hit", F.lit(1.0)), ["topic", "term_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("core_recall"))
    got: dict = {}
    for part in (names, loss, shared, behind, loose, energy, repeats, recall):
        got.update(part.first().asDict())  # one row each
    topics = got["topics"]
    values = {
        "overlap": (got["shared"] or 0.0) / max(topics * (topics - 1), 1),
        "prototype_margin": got["prototype_margin"],
        "unsupported_mass": got["loose"] / max(topics * k, 1),
        "residual_energy": got["residual_energy"],
    }
    loss_ = got["association_loss"] or 0.0
    total = loss_ + sum(w * v for w, v in zip(weights, values.values(), strict=True))
    schema = "association_loss double, overlap double, prototype_margin double, unsupported_mass double, residual_energy double, total double, duplicate_slots long, core_recall double"
    return affinity.sparkSession.createDataFrame([(loss_, *map(float, values.values()), total, got["duplicate_slots"], got["core_recall"])], schema)


def decode(mass: DataFrame, affinity: DataFrame, scale: DataFrame) -> DataFrame:
    """(doc_id, term_id, p): document mass (doc_id, topic, m) times affinity (topic, term_id, p), an affine map per term (term_id, a, b),
    softmax over terms. As large as documents x terms: give it the documents and terms that are wanted."""
    z = mass.join(affinity, "topic").groupBy("doc_id", "term_id").agg(F.sum(F.col("m") * F.col("p")).alias("z"))
    z = z.join(scale, "term_id").withColumn("z", F.col("a") * F.col("z") + F.col("b"))
    return softmax(z, ["doc_id"], "z", "p").select("doc_id", "term_id", "p")


def log_odds(stratum: DataFrame, pooled: DataFrame, clip: float = 2.0) -> DataFrame:
    """(stratum, term_id, r): log ratio of stratum and pooled shares, clipped, centred over strata for each term."""
    rows = stratum.join(pooled.withColumnRenamed("p", "q"), "term_id").select("stratum", "term_id", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.log(F.col("p") / F.col("q")))).alias("r"))
    mean = rows.groupBy("term_id").agg(F.avg("r").alias("mean"))
    return rows.join(mean, "term_id").select("stratum", "term_id", (F.col("r") - F.col("mean")).alias("r"))


def conditioned(beta: DataFrame, residual: DataFrame, gate: float) -> DataFrame:
    """(stratum, topic, term_id, p): topic distributions shifted by a gated stratum residual (stratum, term_id, r), summing to 1 over terms."""
    rows = beta.join(residual, "term_id").withColumn("p", F.col("p") * F.exp(gate * F.col("r"))).withColumn("g", F.struct("stratum", "topic"))
    return normalise(rows, "g", "p").select("stratum", "topic", "term_id", "p")


def case_grid_audit(items: DataFrame, row: str, column: str, expected: int = 1) -> DataFrame:
    """(row, column, items, status) of every cell of the grid of all rows and columns seen: PASS with exactly `expected` items, missing cells too."""
    seen = items.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    grid = seen.select(row).distinct().crossJoin(seen.select(column).distinct())  # as large as the audit itself
    counted = seen.groupBy(row, column).agg(F.count("*").alias("items"))
    return grid.join(counted, [row, column], "left").na.fill(0, ["items"]).withColumn("status", F.when(F.col("items") == expected, "PASS").otherwise("FAIL"))


def seeded_permutation(items: DataFrame, by: str, key: str, seed: str) -> DataFrame:
    """items with place 0.. in each group: a permutation set by the seed and the keys alone. Keys must be unique in their group; it is numbered over
    ranges, so no group is one task."""
    mark = F.sha2(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col(key).cast("string")), 256)
    placed = ordinal(items.withColumn("_mark", mark), by, "_mark", key)
    first = placed.groupBy(by).agg(F.min("position").alias("_first"))
    both = placed.join(first.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return both.withColumn("place", F.col("position") - F.col("_first")).drop("_mark", "position", "_first", "_by")


def packet(items: DataFrame, key: str, shown: list[str], secret: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """A blinded form (item_id, *shown) in an order set by the seed, and its answers (item_id, key, *secret). Keys must be unique; nothing of the
    answers is in the form."""
    placed = seeded_permutation(items.withColumn("_all", F.lit("all")), "_all", key, seed).withColumn("item_id", F.format_string("item_%04d", F.col("place") + 1))
    return placed.select("item_id", *shown), placed.select("item_id", key, *secret)


def scored(returned: DataFrame, form: DataFrame, answers: DataFrame, locked: list[str]) -> DataFrame:
    """Returned forms joined to their answers by item_id, once their locked columns are as issued: a missing, added or changed item is an
    error. returned may hold several raters' rows of an item, each of which is held against the form."""
    issued = form.select("item_id", *locked)
    for problem, rows in (("missing", issued.join(returned, "item_id", "left_anti")), ("added", returned.join(issued, "item_id", "left_anti"))):
        if rows.limit(1).count():
            raise ValueError(f"items are {problem}")
    same = F.lit(True)
    for c in locked:
        same = same & F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"i.{c}").cast("string"), F.lit("")))
    if returned.alias("r").join(issued.alias("i"), F.col("r.item_id") == F.col("i.item_id")).where(~same).limit(1).count():
        raise ValueError("locked columns have been changed")
    return join_once(returned, answers, "item_id")


def envelope(meta: dict, **tables: DataFrame) -> dict:
    """A signed record of tables by their rows and fingerprint beside meta: what is registered before, or handed in after, a rating."""
    marks = {name: list(table_fingerprint(df).first()) for name, df in sorted(tables.items())}
    return signed({**meta, "tables": marks})


def open_envelope(record: dict, **tables: DataFrame) -> dict:
    """The record's meta, if its signature and every table it names hold; any other case is an error."""
    if not verify_signed(record):
        raise ValueError("the record has been changed")
    if set(record["tables"]) != set(tables):
        raise ValueError("the record names other tables")
    changed = [name for name, df in sorted(tables.items()) if list(table_fingerprint(df).first()) != record["tables"][name]]
    if changed:
        raise ValueError(f"tables have been changed: {changed}")
    return {k: v for k, v in record.items() if k not in ("tables", "sha256")}


def variant_registry(variants: DataFrame, quota: int, rho: float, calibration: str) -> DataFrame:
    """(variant, prototype_quota, pooled_weight, calibration) of a table of variants (variant, graph, pooled, calibrated): what each keeps of the
    full model's settings. A repeated or null variant is an error."""
    if variants.groupBy("variant").count().where("count > 1 or variant is null").limit(1).count():
        raise ValueError("variants are repeated or have no name")
    return variants.select("variant", F.when(F.col("graph"), quota).otherwise(0).alias("prototype_quota"), F.when(F.col("pooled"), rho).otherwise(0.0).alias("pooled_weight"), F.when(F.col("graph") & F.col("calibrated"), calibration).otherwise("none").alias("calibration"))


def access_ledger(accesses: DataFrame, prohibited: DataFrame) -> DataFrame:
    """(artifact, access, reads) of accesses (artifact) and what must not be read (artifact): read, prohibited, or violation where a prohibited
    artifact has been read."""
    used = accesses.groupBy("artifact").agg(F.count("*").alias("reads"))
    barred = prohibited.select("artifact").distinct().withColumn("_barred", F.lit(True))
    access = F.when(F.col("_barred").isNull(), "read").when(F.col("reads").isNull(), "prohibited").otherwise("violation")
    return used.join(barred, "artifact", "full").select("artifact", access.alias("access"), F.coalesce("reads", F.lit(0)).alias("reads"))


def prototype_ceiling(cores: DataFrame, fit: DataFrame, held: DataFrame, edges: DataFrame, least_documents: int, window: int = 110) -> DataFrame:
    """(topic, npmi, held_npmi, c_v, held_c_v, df_share, degree_share, edge_share): cores (topic, slot, term_id) scored as displayed words, in
    their own order, on the fit and on the held-out cells."""
    from railcorpus.operators import corpus, graph, topics

    top = cores.select("topic", (F.col("slot") + 1).alias("rank"), "term_id").persist()
    out = graph.top_word_support(top, edges, corpus.document_frequency(fit), least_documents)
    for cells, name in ((fit, ""), (held, "held_")):
        out = out.join(topics.document_npmi(cells, top).select("topic", F.col("npmi").alias(f"{name}npmi")), "topic", "left")
        out = out.join(topics.cv_coherence(corpus.expand_tokens(cells), top, window).withColumnRenamed("c_v", f"{name}c_v"), "topic", "left")
    return out


def training_view(cells: DataFrame, forbidden: tuple[str, ...] = ("target", "stratum", "city", "split")) -> DataFrame:
    """What a comparator may see: no held-out counts and no stratum."""
    return cells.drop(*[c for c in forbidden if c in cells.columns])


class Comparator(Protocol):
    """A topic model: cells without target or stratum in, (topic, term_id, p) out."""

    def __call__(self, cells: DataFrame, size: int, topics: int, seed: int) -> DataFrame: ...


def comparators() -> dict[str, Callable]:
    """The closed registry of methods, one signature: (topic, term_id, p) of the training view of cells."""
    from railcorpus.operators import corpus as C
    from railcorpus.operators import models as M

    def biterm(cells, size, topics, seed):
        return M.fit_btm(C.biterms(C.expand_tokens(cells), 15), size, topics, seed=seed)

    def mixture(cells, size, topics, seed):
        classes = M.fit_gsdmm(cells, size, topics, seed=seed)[1]
        from railcorpus.operators.topics import class_distribution

        return class_distribution(cells, classes)

    fits = {"lda": lambda c, v, k, s: M.fit_lda(c, v, k, s)[0], "nmf": lambda c, v, k, s: M.fit_nmf(c, v, k, seed=s), "gsdmm": mixture, "btm": biterm}
    return {name: (lambda cells, size, topics, seed, f=f: f(training_view(cells), size, topics, seed)) for name, f in fits.items()}


def freeze(df: DataFrame, folder: str) -> DataFrame:
    """Write df once beside its fingerprint; a second call reads it back and fails if it has been changed. A folder without its mark is
    what a broken write left: it is written anew."""
    spark = df.sparkSession
    mark = f"{folder}/mark"
    try:
        kept = spark.read.parquet(mark).first()
    except Exception as error:  # an absent path has its own class only on the server side
        if not any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        df.write.mode("overwrite").parquet(f"{folder}/rows")
        table_fingerprint(spark.read.parquet(f"{folder}/rows")).write.mode("overwrite").parquet(mark)
        return spark.read.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    if table_fingerprint(rows).first() != kept:
        raise ValueError("the frozen table has been changed")
    return rows
