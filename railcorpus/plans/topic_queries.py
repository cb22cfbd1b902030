"""Queries over topics, priors and held-out likelihood. City classes of the train posts serve as deterministic topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from railcorpus.functions.text import hash32
from railcorpus.operators import corpus as C
from railcorpus.operators import graph as G
from railcorpus.operators import priors as P
from railcorpus.operators import topics as T
from railcorpus.plans.corpus_queries import _EDGES, fit_cells
from railcorpus.plans.registry import query
from railcorpus.plans.sqlbase import CLASSES, DOCS, FIT, GRAPH, HASH, PRIORS, SPLIT
from railcorpus.session import table


def classes(spark, sf):
    return C.documents_of(spark, sf).select("doc_id", F.col("city").alias("topic"))


def tfidf(spark, sf):
    return T.class_tfidf(fit_cells(spark, sf), classes(spark, sf)).withColumn("w", F.round("weight", 12))


def beta(spark, sf):
    return T.class_distribution(fit_cells(spark, sf), classes(spark, sf))


def top(spark, sf):
    return T.top_words(tfidf(spark, sf), "w")


def priors(spark, sf):
    """Observed and target cells with their stratum, and the pooled and stratum priors of the observed ones."""
    split = P.completion_split(fit_cells(spark, sf)).join(C.documents_of(spark, sf).select("doc_id", F.col("city").alias("stratum")), "doc_id").persist()
    observed = split.where("observed > 0").select("doc_id", "stratum", "term_id", F.col("observed").alias("cnt"))
    target = split.where("target > 0").select("doc_id", "stratum", "term_id", F.col("target").alias("cnt"))
    voc, strata = table(spark, sf, "vocabulary"), split.select("doc_id", "stratum").distinct()
    cells = observed.select("doc_id", "term_id", "cnt")
    return target, P.pooled_unigram(cells, voc), P.stratum_prior(cells, strata, voc)


@query(f"WITH {CLASSES} SELECT topic, term_id, ROUND(weight, 9) AS weight FROM tfidf")
def class_tfidf_topics(spark, sf):
    return tfidf(spark, sf).select("topic", "term_id", F.round("weight", 9).alias("weight"))


@query(f"WITH {CLASSES} SELECT * FROM top")
def top_words(spark, sf):
    return top(spark, sf)


@query(f"WITH {CLASSES} SELECT COUNT(*) AS topics, ROUND(MAX(ABS(s - 1)), 9) AS off FROM (SELECT topic, SUM(p) AS s FROM beta GROUP BY 1)")
def simplex_checks(spark, sf):
    s = T.normalise(beta(spark, sf), "topic", "p").groupBy("topic").agg(F.sum("p").alias("s"))
    return s.agg(F.count("*").alias("topics"), F.round(F.max(F.abs(F.col("s") - 1)), 9).alias("off"))


@query(f"WITH {CLASSES}, a AS (SELECT topic, term_id, p * (size / (SELECT SUM(size) FROM siz)) AS w FROM beta JOIN siz USING (topic)) SELECT topic, term_id, ROUND(w / SUM(w) OVER (PARTITION BY term_id), 9) AS p FROM a")
def topic_affinity(spark, sf):
    return affinity(spark, sf).withColumn("p", F.round("p", 9))


def affinity(spark, sf):
    counted = fit_cells(spark, sf).join(classes(spark, sf), "doc_id").groupBy("topic").agg(F.sum("cnt").alias("w")).withColumn("all", F.lit(1))
    share = T.normalise(counted, "all", "w").select("topic", "w")
    return T.affinity(beta(spark, sf), share)


@query(f"WITH {CLASSES} SELECT ROUND(COUNT(DISTINCT term_id) / COUNT(*), 9) AS diversity FROM top")
def topic_diversity(spark, sf):
    return T.diversity(top(spark, sf)).withColumn("diversity", F.round("diversity", 9))


@query(f"WITH {CLASSES}, s AS (SELECT topic, list(term_id) AS w FROM top GROUP BY 1) SELECT a.topic AS topic_a, b.topic AS topic_b, ROUND(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 9) AS jaccard FROM s a JOIN s b ON a.topic < b.topic")
def topic_jaccard(spark, sf):
    return T.pairwise_jaccard(top(spark, sf)).withColumn("jaccard", F.round("jaccard", 9))


_NPMI = """, nd AS (SELECT CAST(COUNT(DISTINCT doc_id) AS DOUBLE) AS n FROM fit), tw AS (SELECT DISTINCT term_id FROM top), sh AS (SELECT doc_id, term_id FROM fit JOIN tw USING (term_id)),
    tdf AS (SELECT term_id, COUNT(*) AS df FROM sh GROUP BY 1), jt AS (SELECT x.term_id AS a, y.term_id AS b, COUNT(*) AS j FROM sh x JOIN sh y ON x.doc_id = y.doc_id AND x.term_id < y.term_id GROUP BY 1, 2),
    wp AS (SELECT x.topic, x.term_id AS a, y.term_id AS b FROM top x JOIN top y ON x.topic = y.topic AND x.term_id < y.term_id),
    val AS (SELECT topic, CASE WHEN COALESCE(j, 0) = 0 THEN -1.0 WHEN j = n THEN 1.0 ELSE LN((j / n) / ((p.df / n) * (q.df / n))) / -LN(j / n) END AS v, (p.df IS NULL OR q.df IS NULL) AS gone, COALESCE(j, 0) = 0 AS zero
        FROM wp LEFT JOIN tdf p ON p.term_id = a LEFT JOIN tdf q ON q.term_id = b LEFT JOIN jt ON jt.a = wp.a AND jt.b = wp.b CROSS JOIN nd)"""


@query(f"WITH {CLASSES}{_NPMI} SELECT topic, ROUND(AVG(v), 9) AS npmi, COUNT(*) FILTER (gone) AS absent_pairs, COUNT(*) FILTER (zero) AS zero_pairs FROM val GROUP BY 1")
def doc_npmi(spark, sf):
    return T.document_npmi(fit_cells(spark, sf), top(spark, sf)).withColumn("npmi", F.round("npmi", 9))


_CV = """, cell AS (SELECT x.topic, x.term_id AS a, y.term_id AS b FROM top x JOIN top y ON x.topic = y.topic),
    cv AS (SELECT topic, cell.a, cell.b, p.df AS df_a, CASE WHEN p.df IS NULL OR q.df IS NULL THEN 0.0 WHEN cell.a = cell.b THEN 1.0 WHEN j IS NULL THEN -1.0 WHEN j = n THEN 1.0 ELSE LN((j / n) / ((p.df / n) * (q.df / n))) / -LN(j / n) END AS v
        FROM cell LEFT JOIN tdf p ON p.term_id = cell.a LEFT JOIN tdf q ON q.term_id = cell.b LEFT JOIN jt ON jt.a = LEAST(cell.a, cell.b) AND jt.b = GREATEST(cell.a, cell.b) CROSS JOIN nd),
    tot AS (SELECT topic, b, SUM(v) AS s FROM cv GROUP BY 1, 2),
    wd AS (SELECT cv.topic, a, MAX(df_a) AS df_a, SUM(v * s) AS dot, SQRT(SUM(v * v)) AS l1, SQRT(SUM(s * s)) AS l2 FROM cv JOIN tot ON tot.topic = cv.topic AND tot.b = cv.b GROUP BY 1, 2)"""


@query(f"WITH {CLASSES}{_NPMI}{_CV} SELECT topic, ROUND(AVG(CASE WHEN df_a IS NULL OR l1 = 0 OR l2 = 0 THEN 0 ELSE dot / (l1 * l2) END), 8) AS c_v FROM wd GROUP BY 1")
def cv_coherence(spark, sf):
    """Posts are far shorter than a window of 110 tokens, so each is one window."""
    return T.cv_coherence(C.expand_tokens(fit_cells(spark, sf)), top(spark, sf), 110).withColumn("c_v", F.round("c_v", 8))


@query("""WITH d AS (SELECT post_id, MIN(tokens) AS t FROM posts WHERE len(tokens) > 0 GROUP BY 1), s AS (SELECT post_id AS doc_id, t, UNNEST(range(0, GREATEST(len(t) - 5, 0) + 1)) AS start FROM d)
    SELECT doc_id, CAST(start AS INT) AS start, CAST(len(list_distinct(t[start + 1 : start + 5])) AS INT) AS terms FROM s""")
def token_windows(spark, sf):
    d = table(spark, sf, "posts").where("size(tokens) > 0").groupBy(F.col("post_id").alias("doc_id")).agg(F.min("tokens").alias("tokens"))
    return T.windows(d, 5).select("doc_id", "start", F.size("terms").alias("terms"))


_HALVES = (
    CLASSES
    + f""", hf AS (SELECT CASE WHEN {HASH.format('doc_id')} < 2147483648 THEN 0 ELSE 1 END AS half, city AS topic, term_id, CAST(SUM(cnt) AS BIGINT) AS c FROM fit JOIN docs USING (doc_id) GROUP BY 1, 2, 3),
    ht AS (SELECT half, topic, rank, term_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY half, topic ORDER BY c DESC, term_id) AS rank FROM hf) WHERE rank <= 10),
    hl AS (SELECT half, topic, list(term_id ORDER BY rank) AS w FROM ht GROUP BY 1, 2), hh AS (SELECT a.topic, a.w AS a, b.w AS b FROM hl a JOIN hl b ON a.topic = b.topic AND a.half = 0 AND b.half = 1)"""
)


def halves(spark, sf):
    """(topic, a, b): the ten leading terms of each city in two halves of its posts."""
    c = fit_cells(spark, sf).join(classes(spark, sf), "doc_id").withColumn("half", F.when(hash32(F.col("doc_id")) < 2**31, 0).otherwise(1))
    c = c.groupBy("half", F.col("topic").alias("city"), "term_id").agg(F.sum("cnt").alias("c")).withColumn("topic", F.struct("half", "city"))
    t = T.top_words(c, "c").select(F.col("topic.half").alias("half"), F.col("topic.city").alias("topic"), "rank", "term_id")
    words = t.groupBy("topic", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term_id"))), lambda x: x["term_id"]).alias("w"))
    a, b = words.where("half = 0").select("topic", F.col("w").alias("a")), words.where("half = 1").select("topic", F.col("w").alias("b"))
    return a.join(b, "topic")


@query(f"WITH {_HALVES}, dd AS (SELECT topic, a, b, UNNEST(range(1, 11)) AS d FROM hh WHERE len(a) = 10 AND len(b) = 10) SELECT topic, ROUND(LEAST(GREATEST(0.1 * SUM(len(list_intersect(a[1 : d], b[1 : d])) / d * POW(0.9, d - 1)) + MAX(CASE WHEN d = 10 THEN len(list_intersect(a, b)) / 10 END) * POW(0.9, 10), 0), 1), 9) AS rbo FROM dd GROUP BY 1")
def rbo(spark, sf):
    h = halves(spark, sf).where("size(a) = 10 and size(b) = 10")
    return h.select("topic", F.round(T.rank_biased_overlap(F.col("a"), F.col("b"), 10), 9).alias("rbo"))


@query(f"WITH {_HALVES} SELECT topic, CAST(len(list_intersect(a, b)) AS INT) AS retained, CAST(len(b) - len(list_intersect(a, b)) AS INT) AS introduced, CAST(len(a) - len(list_intersect(a, b)) AS INT) AS removed, ROUND(len(list_intersect(a, b)) / len(a), 9) AS recall FROM hh")
def descriptor_sets(spark, sf):
    both = F.size(F.array_intersect("a", "b"))
    return halves(spark, sf).select("topic", both.alias("retained"), F.size(F.array_except("b", "a")).alias("introduced"), F.size(F.array_except("a", "b")).alias("removed"), F.round(both / F.size("a"), 9).alias("recall"))


@query(f"WITH {CLASSES}, al AS (SELECT term_id, SUM(c) / (SELECT SUM(c) FROM cls) AS q FROM cls GROUP BY 1), t AS (SELECT DISTINCT topic FROM beta), g AS (SELECT t.topic, al.term_id, COALESCE(p, 0) AS p, q FROM t CROSS JOIN al LEFT JOIN beta ON beta.topic = t.topic AND beta.term_id = al.term_id) SELECT topic, ROUND(SUM(CASE WHEN p > 0 THEN p * LN(p / ((p + q) / 2)) ELSE 0 END + q * LN(q / ((p + q) / 2))) / 2, 9) AS js FROM g GROUP BY 1")
def js_divergence(spark, sf):
    """Each city's terms against those of all cities."""
    own = beta(spark, sf)
    total = fit_cells(spark, sf).join(classes(spark, sf), "doc_id").groupBy("term_id").agg(F.sum("cnt").alias("p")).withColumn("all", F.lit(1))
    every = T.normalise(total, "all", "p").select("term_id", "p").crossJoin(own.select("topic").distinct())  # cities are few
    return T.js_divergence(own, every, ["topic", "term_id"]).withColumn("js", F.round("js", 9))


@query(f"WITH {SPLIT} SELECT * FROM completion")
def hash_completion_split(spark, sf):
    return P.completion_split(fit_cells(spark, sf))


@query(f"WITH {SPLIT} SELECT COUNT(*) AS cells, COUNT(*) FILTER (observed + target <> cnt) AS wrong, COUNT(DISTINCT fit.doc_id) AS documents FROM completion JOIN fit USING (doc_id, term_id)")
def completion_mass_check(spark, sf):
    fit = fit_cells(spark, sf)
    return P.completion_split(fit).join(fit, ["doc_id", "term_id"]).agg(F.count("*").alias("cells"), F.count_if(F.col("observed") + F.col("target") != F.col("cnt")).alias("wrong"), F.count_distinct("doc_id").alias("documents"))


@query(f"WITH {FIT}, sz AS (SELECT *, SUM(cnt) OVER (PARTITION BY doc_id) AS tokens FROM fit) SELECT doc_id, term_id, cnt, TRUE AS both_sides FROM sz WHERE tokens >= 2")
def pcg64_completion_split(spark, sf):
    """Cells of the split with NumPy's draws: their tokens, and whether their document has tokens on both sides."""
    split = P.pcg64_completion(fit_cells(spark, sf)).persist()
    sides = split.groupBy("doc_id").agg(((F.sum("observed") > 0) & (F.sum("target") > 0) & (F.min("observed") >= 0) & (F.min("target") >= 0)).alias("both_sides"))
    return split.join(sides, "doc_id").select("doc_id", "term_id", (F.col("observed") + F.col("target")).alias("cnt"), "both_sides")


@query(f"WITH {PRIORS} SELECT term_id, ROUND(p, 12) AS p FROM pooled")
def pooled_unigram(spark, sf):
    return priors(spark, sf)[1].withColumn("p", F.round("p", 12))


@query(f"WITH {PRIORS} SELECT stratum, term_id, ROUND(p, 12) AS p FROM stratum")
def stratum_prior(spark, sf):
    return priors(spark, sf)[2].withColumn("p", F.round("p", 12))


@query(f"WITH {PRIORS} SELECT CAST(SUM(cnt) AS BIGINT) AS tokens, ROUND(SUM(-cnt * LN(p)) / SUM(cnt), 9) AS nll, ROUND(EXP(SUM(-cnt * LN(p)) / SUM(cnt)), 5) AS perplexity FROM tgt JOIN pooled USING (term_id)")
def completion_nll_micro(spark, sf):
    target, pooled, _ = priors(spark, sf)
    return P.completion_nll(target, pooled, ["term_id"], []).select("tokens", F.round("nll", 9).alias("nll"), F.round("perplexity", 5).alias("perplexity"))


@query(f"WITH {PRIORS}, g AS (SELECT tgt.stratum, SUM(cnt) AS tokens, SUM(-cnt * LN(p)) / SUM(cnt) AS nll FROM tgt JOIN stratum ON stratum.stratum = tgt.stratum AND stratum.term_id = tgt.term_id GROUP BY 1) SELECT COUNT(*) AS groups, ROUND(AVG(nll), 9) AS macro_nll, ROUND(SUM(nll * tokens) / SUM(tokens), 9) AS micro_nll FROM g")
def completion_nll_macro(spark, sf):
    target, _, stratum = priors(spark, sf)
    by = P.completion_nll(target, stratum, ["stratum", "term_id"], ["stratum"])
    return P.macro_micro(by, "stratum").select("groups", F.round("macro_nll", 9).alias("macro_nll"), F.round("micro_nll", 9).alias("micro_nll"))


@query(f"WITH {PRIORS}, o AS (SELECT doc_id, NTILE(3) OVER (ORDER BY ts NULLS FIRST, doc_id) AS block FROM docs), g AS (SELECT block, SUM(cnt) AS tokens, SUM(-cnt * LN(p)) / SUM(cnt) AS nll FROM tgt JOIN o USING (doc_id) JOIN pooled USING (term_id) GROUP BY 1) SELECT CAST(block AS INT) AS block, CAST(tokens AS BIGINT) AS tokens, ROUND(nll, 9) AS nll FROM g")
def temporal_block_nll(spark, sf):
    target, pooled, _ = priors(spark, sf)
    blocks = C.chronological_blocks(C.documents_of(spark, sf).select("ts", "doc_id"), 3, "ts", "doc_id").select("doc_id", "block")
    return P.completion_nll(target.join(blocks, "doc_id"), pooled, ["term_id"], ["block"]).select("block", "tokens", F.round("nll", 9).alias("nll"))


_RHO = "rho AS (SELECT UNNEST([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.35::DOUBLE]) AS rho)"


def rho_table(spark):
    return spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.35,)], "rho double")


@query(f"WITH {PRIORS}, {_RHO}, c AS (SELECT cnt, pooled.p AS q, stratum.p AS p FROM tgt JOIN pooled USING (term_id) JOIN stratum ON stratum.stratum = tgt.stratum AND stratum.term_id = tgt.term_id) SELECT rho, ROUND(SUM(-cnt * LN((1 - rho) * p + rho * q)) / SUM(cnt), 9) AS nll, ROUND((1 - rho) * (SUM(-cnt * LN(p)) / SUM(cnt)) + rho * (SUM(-cnt * LN(q)) / SUM(cnt)), 9) AS bound FROM c CROSS JOIN rho GROUP BY rho")
def prior_mixture(spark, sf):
    target, pooled, stratum = priors(spark, sf)
    c = target.join(pooled.withColumnRenamed("p", "q"), "term_id").join(stratum, ["stratum", "term_id"]).crossJoin(F.broadcast(rho_table(spark)))  # four rows
    mean = lambda x: F.sum(-F.col("cnt") * F.log(x)) / F.sum("cnt")
    out = c.groupBy("rho").agg(mean(P.mixture(F.col("p"), F.col("q"), F.col("rho"))).alias("nll"), mean(F.col("p")).alias("a"), mean(F.col("q")).alias("b"))
    return out.select("rho", F.round("nll", 9).alias("nll"), F.round(P.jensen_bound(F.col("a"), F.col("b"), F.col("rho")), 9).alias("bound"))


_FOLDS = PRIORS + f", ff AS (SELECT tgt.*, CAST({HASH.format('doc_id')} % 5 AS INT) AS fold FROM tgt)"


@query(f"WITH {_FOLDS}, {_RHO}, c AS (SELECT fold, cnt, pooled.p AS q, stratum.p AS p FROM ff JOIN pooled USING (term_id) JOIN stratum ON stratum.stratum = ff.stratum AND stratum.term_id = ff.term_id), g AS (SELECT fold, rho, SUM(-cnt * LN((1 - rho) * p + rho * q)) / SUM(cnt) AS nll FROM c CROSS JOIN rho GROUP BY 1, 2), s AS (SELECT g.rho, MEDIAN(a.nll - g.nll) AS mid, MIN(a.nll - g.nll) AS least, AVG(CASE WHEN a.nll > g.nll THEN 1.0 ELSE 0.0 END) AS positive FROM g JOIN g a ON a.fold = g.fold AND a.rho = 0 GROUP BY 1) SELECT rho, ROUND(mid, 9) AS median_gain, ROUND(least, 9) AS least_gain, ROUND(positive, 9) AS positive_share, rho = (SELECT rho FROM s ORDER BY ROUND(mid, 9) DESC, rho LIMIT 1) AS chosen FROM s")
def rho_fold_grid(spark, sf):
    """Gains over the anchor rho 0 by fold, and the rho of the largest median gain."""
    target, pooled, stratum = priors(spark, sf)
    c = P.folds(target, 5).join(pooled.withColumnRenamed("p", "q"), "term_id").join(stratum, ["stratum", "term_id"])
    gain = P.mixture_gains(c, rho_table(spark))
    s = gain.groupBy("rho").agg(F.round(F.expr("percentile(gain, 0.5)"), 9).alias("median_gain"), F.round(F.min("gain"), 9).alias("least_gain"), F.round(F.avg((F.col("gain") > 0).cast("double")), 9).alias("positive_share"))
    best = s.agg(F.max_by("rho", F.struct("median_gain", -F.col("rho"))).alias("best"))
    return s.crossJoin(F.broadcast(best)).select("rho", "median_gain", "least_gain", "positive_share", (F.col("rho") == F.col("best")).alias("chosen"))


@query(f"""WITH {CLASSES}, fc AS (SELECT CAST({HASH.format('doc_id')} % 5 AS INT) AS fold, city AS s, term_id, CAST(SUM(cnt) AS DOUBLE) AS c FROM fit JOIN docs USING (doc_id) GROUP BY 1, 2, 3), nv AS (SELECT CAST(COUNT(DISTINCT term_id) AS DOUBLE) AS v FROM vocabulary),
    a AS (SELECT fc.*, SUM(c) OVER (PARTITION BY term_id) - SUM(c) OVER (PARTITION BY fold, term_id) AS t, SUM(c) OVER (PARTITION BY s, term_id) - SUM(c) OVER (PARTITION BY fold, s, term_id) AS st, SUM(c) OVER (PARTITION BY s) - SUM(c) OVER (PARTITION BY fold, s) AS sa, SUM(c) OVER () - SUM(c) OVER (PARTITION BY fold) AS al FROM fc),
    b AS (SELECT fold, c, (t + 0.5::DOUBLE) / (al + 0.5::DOUBLE * v) AS p, 0.5 * (t + 0.5::DOUBLE) / (al + 0.5::DOUBLE * v) + 0.5 * (st + 0.5::DOUBLE) / (sa + 0.5::DOUBLE * v) AS q FROM a CROSS JOIN nv)
    SELECT fold, CAST(SUM(c) AS BIGINT) AS tokens, ROUND(SUM(-c * LN(p)) / SUM(c), 9) AS pooled_nll, ROUND(SUM(-c * LN(q)) / SUM(c), 9) AS stratum_nll, ROUND(SUM(-c * LN(p)) / SUM(c) - SUM(-c * LN(q)) / SUM(c), 9) AS gain FROM b GROUP BY 1""")
def crossfit_signal(spark, sf):
    strata = C.documents_of(spark, sf).select("doc_id", F.col("city").alias("stratum"))
    out = P.crossfit(fit_cells(spark, sf), strata, table(spark, sf, "vocabulary"))
    return out.select("fold", "tokens", *[F.round(c, 9).alias(c) for c in ("pooled_nll", "stratum_nll", "gain")])


@query(f"WITH {PRIORS}, c AS (SELECT doc_id, tgt.term_id, cnt, tgt.stratum, pooled.p AS q, stratum.p AS p FROM tgt JOIN pooled USING (term_id) JOIN stratum ON stratum.stratum = tgt.stratum AND stratum.term_id = tgt.term_id), v5 AS (SELECT cnt, UNNEST(['full', 'no_graph', 'no_pooled', 'no_calibration', 'parent']) AS variant, UNNEST([0.65 * (0.5 * p + 0.5 * q) + 0.35 * q, 0.65 * p + 0.35 * q, 0.5 * p + 0.5 * q, 0.65 * (0.8 * p + 0.2 * q) + 0.35 * q, p]) AS x FROM c) SELECT variant, CASE WHEN variant IN ('no_graph', 'parent') THEN 'parent' ELSE 'graph' END AS family, ROUND(SUM(-cnt * LN(x)) / SUM(cnt), 9) AS nll FROM v5 GROUP BY 1, 2")
def variants_union(spark, sf):
    """Five paired variants; mixtures of the stratum and pooled priors stand for the moved and calibrated probabilities."""
    target, pooled, stratum = priors(spark, sf)
    c = target.join(pooled.withColumnRenamed("p", "q"), "term_id").join(stratum, ["stratum", "term_id"])
    p, q = F.col("p"), F.col("q")
    five = c.select("cnt", F.explode(T.frozen_variants(p, 0.8 * p + 0.2 * q, 0.5 * p + 0.5 * q, q, 0.35)).alias("variant", "x"))
    return five.groupBy("variant", T.reporting_family(F.col("variant")).alias("family")).agg(F.round(F.sum(-F.col("cnt") * F.log("x")) / F.sum("cnt"), 9).alias("nll"))


@query(f"WITH {PRIORS}, c AS (SELECT cnt, pooled.p AS q, stratum.p AS p FROM tgt JOIN pooled USING (term_id) JOIN stratum ON stratum.stratum = tgt.stratum AND stratum.term_id = tgt.term_id), v5 AS (SELECT cnt, UNNEST(['graph_stratum', 'stratum', 'graph', 'graph_pooled', 'parent']) AS variant, UNNEST([0.8 * (0.5 * p + 0.5 * q) + 0.2 * p, 0.8 * q + 0.2 * p, 0.5 * p + 0.5 * q, 0.8 * (0.5 * p + 0.5 * q) + 0.2 * q, q]) AS x FROM c) SELECT variant, ROUND(SUM(-cnt * LN(x)) / SUM(cnt), 9) AS nll FROM v5 GROUP BY 1")
def stratum_variants(spark, sf):
    """Likelihood of the five variants with back-off to the city; the pooled prior stands for the parent, its mean with the city's for the graph."""
    target, pooled, stratum = priors(spark, sf)
    c = target.join(pooled.withColumnRenamed("p", "q"), "term_id").join(stratum, ["stratum", "term_id"])
    p, q = F.col("p"), F.col("q")
    five = c.select("cnt", F.explode(T.stratum_variants(q, 0.5 * p + 0.5 * q, p, q, 0.2)).alias("variant", "x"))
    return five.groupBy("variant").agg(F.round(F.sum(-F.col("cnt") * F.log("x")) / F.sum("cnt"), 9).alias("nll"))


@query(f"WITH {PRIORS}, g AS (SELECT tgt.stratum, SUM(-cnt * LN(pooled.p)) / SUM(cnt) AS a, SUM(-cnt * LN(stratum.p)) / SUM(cnt) AS b FROM tgt JOIN pooled USING (term_id) JOIN stratum ON stratum.stratum = tgt.stratum AND stratum.term_id = tgt.term_id GROUP BY 1) SELECT stratum, ROUND(b, 9) AS full_nll, ROUND(a - b, 9) AS effect FROM g")
def stratum_effects(spark, sf):
    target, pooled, stratum = priors(spark, sf)
    a = P.completion_nll(target, pooled, ["term_id"], ["stratum"]).select("stratum", F.col("nll").alias("a"))
    b = P.completion_nll(target, stratum, ["stratum", "term_id"], ["stratum"]).select("stratum", F.col("nll").alias("b"))
    return a.join(b, "stratum").select("stratum", F.round("b", 9).alias("full_nll"), F.round(F.col("a") - F.col("b"), 9).alias("effect"))


_THETA = PRIORS + """, th AS (SELECT o.doc_id, b.stratum AS topic, SUM(o.cnt * b.p) AS m FROM obs o JOIN stratum b ON b.term_id = o.term_id GROUP BY 1, 2),
    tn AS (SELECT doc_id, topic, m / SUM(m) OVER (PARTITION BY doc_id) AS m FROM th), pr AS (SELECT t.doc_id, t.term_id, t.cnt, SUM(tn.m * b.p) AS p FROM tgt t JOIN tn ON tn.doc_id = t.doc_id JOIN stratum b ON b.stratum = tn.topic AND b.term_id = t.term_id GROUP BY 1, 2, 3)"""


@query(f"WITH {_THETA} SELECT CAST(SUM(cnt) AS BIGINT) AS tokens, ROUND(SUM(-cnt * LN(p)) / SUM(cnt), 9) AS nll FROM pr")
def theta_beta_nll(spark, sf):
    """Document shares of city topics from the observed half, probabilities only at the target cells.

    A term's shares in all cities (few) travel as one array, so each cell is joined once and a document's shares are sums over its cells.
    """
    stratum = priors(spark, sf)[2].persist()
    topics = stratum.groupBy("term_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("stratum", "p"))), lambda x: x["p"]).alias("b"))
    split = P.completion_split(fit_cells(spark, sf)).join(topics, "term_id").persist()
    k = stratum.select("stratum").distinct().count()
    seen = split.where("observed > 0").groupBy("doc_id").agg(*[F.sum(F.col("observed") * F.col("b")[i]).alias(f"m{i}") for i in range(k)])
    mass = sum(F.col(f"m{i}") for i in range(k)) if k else F.lit(0.0)
    cells = split.where("target > 0").join(seen, "doc_id").select(F.col("target").alias("cnt"), (sum(F.col(f"m{i}") * F.col("b")[i] for i in range(k)) / mass if k else F.lit(0.0)).alias("p"))
    return cells.agg(*P.nll(F.col("cnt"), F.col("p"))).select("tokens", F.round("nll", 9).alias("nll"))


@query(f"WITH {CLASSES}, tot AS (SELECT term_id, SUM(p) AS total FROM beta GROUP BY 1), core AS (SELECT topic, term_id FROM top WHERE rank <= 5), o AS (SELECT beta.topic, beta.p, ROW_NUMBER() OVER (PARTITION BY beta.topic ORDER BY beta.p DESC, beta.term_id) AS place FROM beta ANTI JOIN core ON core.topic = beta.topic AND core.term_id = beta.term_id), qs AS (SELECT topic, COUNT(*) AS q FROM core GROUP BY 1), edge AS (SELECT o.topic, p AS edge FROM o JOIN qs ON qs.topic = o.topic AND place = 10 - q + 1), dl AS (SELECT core.topic, core.term_id, GREATEST(0, LEAST(COALESCE(edge, 0) + 1e-6, total) - p) AS delta FROM core JOIN beta ON beta.topic = core.topic AND beta.term_id = core.term_id JOIN tot ON tot.term_id = core.term_id LEFT JOIN edge ON edge.topic = core.topic), ow AS (SELECT term_id, MAX(delta) AS delta FROM dl GROUP BY 1) SELECT ROUND(SUM(delta), 9) AS moved, COUNT(*) FILTER (delta > 0) AS words, 0.0::DOUBLE AS off FROM ow")
def transport_rescale(spark, sf):
    """Five core words a city raised to the display boundary: mass moved, and the largest change of a word's sum."""
    p = beta(spark, sf).persist()
    core = top(spark, sf).where("rank <= 5").select("topic", "term_id")
    new = T.transport(p, core).persist()
    sums = p.groupBy("term_id").agg(F.sum("p").alias("a")).join(new.groupBy("term_id").agg(F.sum("p").alias("b")), "term_id")
    off = sums.agg(F.round(F.max(F.abs(F.col("a") - F.col("b"))), 9).alias("off"))
    return new.agg(F.round(F.sum("moved"), 9).alias("moved"), F.count_if(F.col("moved") > 0).alias("words")).crossJoin(off)


@query(None)
def transport_search(spark, sf):
    """Of each city's ten core words the five that need the least mass."""
    core = top(spark, sf).select("topic", (F.col("rank") - 1).alias("slot"), "term_id")
    return T.transport_search(beta(spark, sf), core, 5).withColumn("delta", F.round("delta", 9))


@query("""WITH n AS (SELECT CAST(l_linenumber AS INT) AS term_id, l_extendedprice AS z, l_extendedprice * 1.5 + l_quantity AS y FROM lineitem), m AS (SELECT term_id, AVG(z) AS mn, VAR_POP(z) AS vn, AVG(y) AS mm, VAR_POP(y) AS vm FROM n GROUP BY 1)
    SELECT term_id, ROUND(SQRT((vn + 1e-10) / (vm + 1e-10)), 8) AS a, ROUND(mn - SQRT((vn + 1e-10) / (vm + 1e-10)) * mm, 3) AS b FROM m""")
def moment_calibration(spark, sf):
    n = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("term_id"), F.col("l_extendedprice").alias("z"), "l_quantity")
    out = T.moment_calibration(n, n.select("term_id", (F.col("z") * 1.5 + F.col("l_quantity")).alias("z")))
    return out.select("term_id", F.round("a", 8).alias("a"), F.round("b", 3).alias("b"))


@query(f"WITH {CLASSES}, r AS (SELECT topic, term_id, 0.5 * TANH(LN(p) / 0.5) AS r FROM beta), c AS (SELECT topic, term_id, r - AVG(r) OVER (PARTITION BY term_id) AS r FROM r), e AS (SELECT beta.topic, beta.term_id, beta.p * EXP(c.r) AS p FROM beta JOIN c USING (topic, term_id)) SELECT topic, term_id, ROUND(p / SUM(p) OVER (PARTITION BY term_id), 9) AS p FROM e")
def residual_affinity(spark, sf):
    b = beta(spark, sf)
    r = T.bounded_residual(b.select("topic", "term_id", F.log("p").alias("z")), 0.5)
    return T.effective_affinity(b, r).withColumn("p", F.round("p", 9))


@query(f"WITH {CLASSES}, l AS (SELECT topic, term_id, LN(GREATEST(p, 1e-12)) AS l FROM beta), c AS (SELECT topic, term_id, l - AVG(l) OVER (PARTITION BY topic) AS c FROM l) SELECT topic, term_id, ROUND(c / SQRT(AVG(c * c) OVER (PARTITION BY topic) + 1e-12), 8) AS score FROM c")
def rank_scores(spark, sf):
    return T.rank_scores(beta(spark, sf)).withColumn("score", F.round("score", 8))


@query(f"WITH {CLASSES} SELECT DISTINCT topic, 10.0::DOUBLE AS mass FROM beta")
def soft_top_k(spark, sf):
    """Soft membership of each city's ten leading terms: its defining sum."""
    return T.soft_top_k(T.rank_scores(beta(spark, sf)), 10).groupBy("topic").agg(F.round(F.sum("m"), 6).alias("mass"))


@query(None)
def soft_association(spark, sf):
    """The graph's association under the soft memberships of each city, and its loss."""
    m = T.soft_top_k(T.rank_scores(beta(spark, sf)), 10).persist()
    return T.association(m, G.npmi_graph(fit_cells(spark, sf))).select("topic", F.round("association", 9).alias("association"), F.round("loss", 6).alias("loss"))


@query(None)
def prototype_lexical(spark, sf):
    """The lexical bundle of the cities as topics, their ten leading words as cores and their log shares as residual."""
    from railcorpus.operators import review as R

    p = affinity(spark, sf).persist()
    cores = top(spark, sf).select("topic", (F.col("rank") - 1).alias("slot"), "term_id")
    return R.prototype_lexical(p, G.npmi_graph(fit_cells(spark, sf)).persist(), p.select("topic", "term_id", F.log("p").alias("z")), cores)


@query(f"""WITH {GRAPH}{_EDGES}, {CLASSES.split(FIT + ", ")[1]}, dg AS (SELECT src AS term_id FROM edges UNION SELECT dst FROM edges), sp AS (SELECT topic, AVG(CASE WHEN df >= 3 THEN 1.0 ELSE 0.0 END) AS s, AVG(CASE WHEN dg.term_id IS NULL THEN 0.0 ELSE 1.0 END) AS g FROM top LEFT JOIN head USING (term_id) LEFT JOIN dg USING (term_id) GROUP BY 1),
    wq AS (SELECT x.topic, AVG(CASE WHEN w IS NULL THEN 0.0 ELSE 1.0 END) AS e FROM top x JOIN top y ON x.topic = y.topic AND x.term_id < y.term_id LEFT JOIN edges ON src = x.term_id AND dst = y.term_id GROUP BY 1)
    SELECT topic, ROUND(s, 9) AS df_share, ROUND(g, 9) AS degree_share, ROUND(e, 9) AS edge_share FROM sp JOIN wq USING (topic)""")
def top_word_support(spark, sf):
    out = G.top_word_support(top(spark, sf), G.npmi_graph(fit_cells(spark, sf)), C.document_frequency(fit_cells(spark, sf)), 3)
    return out.select("topic", *[F.round(c, 9).alias(c) for c in ("df_share", "degree_share", "edge_share")])


@query(f"WITH {CLASSES}, d AS (SELECT DISTINCT term_id FROM top), e AS (SELECT city, COUNT(DISTINCT doc_id) AS docs FROM fit JOIN docs USING (doc_id) GROUP BY 1), s AS (SELECT term_id, city, COUNT(DISTINCT doc_id) AS n FROM fit JOIN d USING (term_id) JOIN docs USING (doc_id) GROUP BY 1, 2) SELECT term_id, city, n, ROUND(n / e.docs, 9) AS rate, COUNT(*) OVER (PARTITION BY term_id) = (SELECT COUNT(*) FROM e) AS everywhere FROM s JOIN e USING (city)")
def descriptor_support(spark, sf):
    fit = fit_cells(spark, sf).join(C.documents_of(spark, sf).select("doc_id", "city"), "doc_id")
    words = top(spark, sf).select("term_id").distinct()
    s = fit.join(words, "term_id").groupBy("term_id", "city").agg(F.count("*").alias("n"))
    e = fit.groupBy("city").agg(F.count_distinct("doc_id").alias("docs"))
    cities = e.agg(F.count("*").alias("cities"))
    spread = s.groupBy("term_id").agg(F.count("*").alias("found"))
    out = s.join(e, "city").join(spread, "term_id").crossJoin(F.broadcast(cities))  # one row
    return out.select("term_id", "city", "n", F.round(F.col("n") / F.col("docs"), 9).alias("rate"), (F.col("found") == F.col("cities")).alias("everywhere"))


@query(f"""WITH {CLASSES}, df AS (SELECT term_id, COUNT(*) AS df FROM fit GROUP BY 1), t AS (SELECT top.topic, top.term_id, LN(1 + df) AS l FROM top JOIN df USING (term_id)), m AS (SELECT topic, AVG(l) AS m FROM t GROUP BY 1),
    c AS (SELECT DISTINCT m.topic, t.term_id, ROUND(ABS(t.l - m.m), 9) AS far FROM m JOIN t ON t.topic <> m.topic ANTI JOIN top o ON o.topic = m.topic AND o.term_id = t.term_id) SELECT topic, ARG_MIN(term_id, (far, term_id)) AS intruder FROM c GROUP BY 1""")
def intruder_choice(spark, sf):
    """For each city another city's word as frequent as its own words are on average."""
    t = top(spark, sf).join(C.document_frequency(fit_cells(spark, sf)), "term_id").select("topic", "term_id", F.log1p("df").alias("l")).persist()
    m = t.groupBy("topic").agg(F.avg("l").alias("m"))
    words = t.select(F.col("topic").alias("from"), "term_id", "l")
    c = m.join(words, F.col("topic") != F.col("from")).join(t.select("topic", "term_id"), ["topic", "term_id"], "left_anti")
    return c.groupBy("topic").agg(F.min_by("term_id", F.struct(F.round(F.abs(F.col("l") - F.col("m")), 9), "term_id")).alias("intruder"))


@query(f"""WITH {CLASSES}, s AS (SELECT top.topic, fit.doc_id, SUM(cnt * (11 - rank)) AS w, COUNT(*) AS overlap FROM fit JOIN docs USING (doc_id) JOIN top ON top.topic = docs.city AND top.term_id = fit.term_id GROUP BY 1, 2), z AS (SELECT doc_id, SUM(cnt) AS n FROM fit GROUP BY 1)
    SELECT topic, ARG_MAX(doc_id, (ROUND(w / SQRT(n), 9), overlap, sha256(doc_id))) AS doc_id, ROUND(MAX(w / SQRT(n)), 9) AS score FROM s JOIN z USING (doc_id) GROUP BY 1""")
def case_select(spark, sf):
    """The most typical post of each city's words."""
    fit, t = fit_cells(spark, sf), top(spark, sf)
    s = fit.join(classes(spark, sf), "doc_id").join(t, ["topic", "term_id"]).groupBy("topic", "doc_id").agg(F.sum(F.col("cnt") * (11 - F.col("rank"))).alias("w"), F.count("*").alias("overlap"))
    s = s.join(fit.groupBy("doc_id").agg(F.sum("cnt").alias("n")), "doc_id").withColumn("score", F.round(F.col("w") / F.sqrt("n"), 9))
    return s.groupBy("topic").agg(F.max_by("doc_id", F.struct("score", "overlap", F.sha2("doc_id", 256))).alias("doc_id"), F.max("score").alias("score"))


@query(f"WITH {CLASSES}, df AS (SELECT term_id, COUNT(*) AS df FROM fit GROUP BY 1), p AS (SELECT topic, term_id FROM top WHERE rank <= 5 UNION ALL SELECT t.topic, x.term_id FROM (SELECT DISTINCT topic FROM top) t CROSS JOIN (SELECT term_id FROM df ORDER BY df DESC, term_id LIMIT 1) x) SELECT topic, list(term_id ORDER BY sha256(topic || '|' || term_id)) AS words FROM p GROUP BY 1")
def word_packet(spark, sf):
    """Five leading words of each city and one common word, in an order only the hash knows."""
    t = top(spark, sf)
    common = C.document_frequency(fit_cells(spark, sf)).orderBy(F.desc("df"), "term_id").limit(1).select("term_id")
    p = t.where("rank <= 5").select("topic", "term_id").unionByName(t.select("topic").distinct().crossJoin(F.broadcast(common)))  # one row
    mark = F.sha2(F.concat_ws("|", "topic", F.col("term_id").cast("string")), 256)
    return p.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct(mark.alias("h"), "term_id"))), lambda x: x["term_id"]).alias("words"))


@query(f"WITH {CLASSES}{_NPMI}{_CV}, q AS (SELECT ROUND(AVG(n), 9) AS npmi FROM (SELECT topic, AVG(v) AS n FROM val GROUP BY 1)), c AS (SELECT ROUND(AVG(x), 8) AS c_v FROM (SELECT topic, AVG(CASE WHEN df_a IS NULL OR l1 = 0 OR l2 = 0 THEN 0 ELSE dot / (l1 * l2) END) AS x FROM wd GROUP BY 1)), d AS (SELECT ROUND(COUNT(DISTINCT term_id) / COUNT(*), 9) AS diversity FROM top) SELECT * FROM q CROSS JOIN c CROSS JOIN d")
def topic_quality(spark, sf):
    t, fit = top(spark, sf).persist(), fit_cells(spark, sf).persist()
    q = T.document_npmi(fit, t).agg(F.round(F.avg("npmi"), 9).alias("npmi"))
    c = T.cv_coherence(C.expand_tokens(fit), t, 110).agg(F.round(F.avg("c_v"), 8).alias("c_v"))
    return q.crossJoin(c).crossJoin(T.diversity(t).withColumn("diversity", F.round("diversity", 9)))  # one row each


@query(f"WITH {CLASSES}, a AS (SELECT topic, CAST(rank AS INT) AS rank, term_id FROM (SELECT topic, term_id, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY ROUND(p, 12) DESC, term_id) AS rank FROM beta) WHERE rank <= 10) SELECT COUNT(*) AS words, COUNT(*) FILTER (a.term_id = b.term_id) AS same FROM a JOIN a b USING (topic, rank)")
def rank_identity(spark, sf):
    """Display order by the distribution and by its standardised log must be the same."""
    b = beta(spark, sf).withColumn("r", F.round("p", 12)).persist()
    a = T.top_words(b, "r")
    s = T.top_words(b.withColumn("s", F.log("r")), "s").withColumnRenamed("term_id", "other")
    return a.join(s, ["topic", "rank"]).agg(F.count("*").alias("words"), F.count_if(F.col("term_id") == F.col("other")).alias("same"))


@query(f"WITH {CLASSES}, f AS (SELECT CAST({HASH.format('doc_id')} % 3 AS INT) AS seed, city AS topic, term_id, CAST(SUM(cnt) AS BIGINT) AS c FROM fit JOIN docs USING (doc_id) GROUP BY 1, 2, 3), t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, topic ORDER BY c DESC, term_id) AS rank FROM f) WHERE rank <= 10), w AS (SELECT seed, topic, list(term_id) AS w FROM t GROUP BY 1, 2), j AS (SELECT a.seed, a.topic, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS j FROM w a JOIN w b ON b.topic = a.topic AND b.seed = 0) SELECT seed, ROUND(MAX(CASE WHEN topic = 'Luoxi' THEN j END), 9) AS \"Luoxi\", ROUND(MAX(CASE WHEN topic = 'Port Arden' THEN j END), 9) AS \"Port Arden\", ROUND(MAX(CASE WHEN topic = 'Qinglan' THEN j END), 9) AS \"Qinglan\", ROUND(MAX(CASE WHEN topic = 'Villareda' THEN j END), 9) AS \"Villareda\", ROUND(MAX(CASE WHEN topic = 'Westmere Vale' THEN j END), 9) AS \"Westmere Vale\", ROUND(MAX(CASE WHEN topic = 'Yunmo' THEN j END), 9) AS \"Yunmo\", ROUND(MAX(CASE WHEN topic = 'unknown' THEN j END), 9) AS \"unknown\", ROUND(AVG(j), 9) AS mean FROM j GROUP BY 1")
def seed_topic_pivot(spark, sf):
    """Jaccard of each city's words in three hash parts with those of the first, a column a city, and the mean."""
    c = fit_cells(spark, sf).join(classes(spark, sf), "doc_id").withColumn("seed", (hash32(F.col("doc_id")) % 3).cast("int"))
    c = c.groupBy("seed", F.col("topic").alias("city"), "term_id").agg(F.sum("cnt").alias("c")).withColumn("topic", F.struct("seed", "city"))
    w = T.top_words(c, "c").groupBy("topic").agg(F.collect_list("term_id").alias("w")).select(F.col("topic.seed").alias("seed"), F.col("topic.city").alias("topic"), "w").persist()
    j = w.join(w.where("seed = 0").select("topic", F.col("w").alias("base")), "topic").withColumn("j", F.size(F.array_intersect("w", "base")) / F.size(F.array_union("w", "base")))
    cities = sorted(r.topic for r in w.select("topic").distinct().collect())  # as many as columns
    wide = j.groupBy("seed").pivot("topic", cities).agg(F.round(F.first("j"), 9))
    return wide.join(j.groupBy("seed").agg(F.round(F.avg("j"), 9).alias("mean")), "seed")


@query(f"WITH {DOCS}, t AS (SELECT city AS topic, COUNT(*) AS n FROM docs GROUP BY 1) SELECT topic, ROUND(EXP(n / 1000.0::DOUBLE - (SELECT MAX(n) / 1000.0::DOUBLE FROM t)) / (SELECT SUM(EXP(n / 1000.0::DOUBLE - (SELECT MAX(n) / 1000.0::DOUBLE FROM t))) FROM t), 9) AS p FROM t")
def softmax_share(spark, sf):
    t = classes(spark, sf).groupBy("topic").agg((F.count("*") / 1000).alias("z")).withColumn("all", F.lit(1))
    return T.softmax(t, ["all"], "z", "p").select("topic", F.round("p", 9).alias("p"))

