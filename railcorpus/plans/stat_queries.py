"""Queries of the statistics and reporting layer, and rows-only queries of the models.

Monthly means of lineitem by return flag serve as seeds x variants x metrics; raters are hashes of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railcorpus.functions.text import hash32
from railcorpus.operators import corpus as C
from railcorpus.operators import graph as G
from railcorpus.operators import models as M
from railcorpus.operators import priors as P
from railcorpus.operators import review as R
from railcorpus.operators import stats as S
from railcorpus.operators import topics as T
from railcorpus.plans.corpus_queries import fit_cells
from railcorpus.plans.registry import query
from railcorpus.plans.sqlbase import FIT, HASH, METRICS
from railcorpus.session import table


def metrics(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.date_format("l_shipdate", "yyyy-MM").alias("seed"))
    return rows.agg(F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))


_EFFECTS = METRICS + ", ef AS (SELECT a.seed, UNNEST(['A-N', 'A-R', 'N-R']) AS contrast, UNNEST([a.price - n.price, a.price - r.price, n.price - r.price]) AS d FROM mon a LEFT JOIN mon n ON n.seed = a.seed AND n.variant = 'N' LEFT JOIN mon r ON r.seed = a.seed AND r.variant = 'R' WHERE a.variant = 'A'), eff AS (SELECT * FROM ef WHERE d IS NOT NULL AND contrast <> 'N-R' UNION ALL SELECT n.seed, 'N-R', n.price - r.price FROM mon n JOIN mon r ON r.seed = n.seed AND r.variant = 'R' WHERE n.variant = 'N')"
# the distribution of the doubled rank sum, one rank a step: every sum reached so far, and it plus the rank, each with half the probability
_RANK = "RECURSIVE " + _EFFECTS + """, sz AS (SELECT contrast, d, ABS(d) AS a FROM eff WHERE d <> 0), rk AS (SELECT contrast, d, CAST(2 * RANK() OVER (PARTITION BY contrast ORDER BY a) + COUNT(*) OVER (PARTITION BY contrast, a) - 1 AS BIGINT) AS r, ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY a, d) AS k FROM sz),
    tt AS (SELECT contrast, SUM(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, SUM(r) AS total, COUNT(*) AS n FROM rk GROUP BY 1),
    ds AS (SELECT contrast, 0::BIGINT AS k, 0::BIGINT AS s, 1.0::DOUBLE AS p FROM tt UNION ALL SELECT contrast, k + 1, s, SUM(p) / 2 FROM (SELECT ds.contrast, ds.k, UNNEST([ds.s, ds.s + rk.r]) AS s, p FROM ds JOIN rk ON rk.contrast = ds.contrast AND rk.k = ds.k + 1) GROUP BY 1, 2, 3),
    sr AS (SELECT tt.contrast, CAST(MAX(n) AS BIGINT) AS n, MAX(plus) / 2.0 AS statistic, LEAST(SUM(CASE WHEN ABS(2 * s - total) >= ABS(2 * plus - total) THEN p ELSE 0 END), 1) AS p FROM ds JOIN tt ON tt.contrast = ds.contrast AND ds.k = tt.n GROUP BY 1)"""


def effects(spark, sf):
    m = metrics(spark, sf).persist()
    out = None
    for a, b in (("A", "N"), ("A", "R"), ("N", "R")):
        e = S.paired_effects(m, "seed", "variant", "price", a, b, True).select(F.lit(f"{a}-{b}").alias("contrast"), "seed", F.col("effect").alias("d"))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"WITH {_EFFECTS} SELECT contrast, seed, ROUND(d, 6) AS d FROM eff")
def paired_effects(spark, sf):
    return effects(spark, sf).withColumn("d", F.round("d", 6))


@query(f"WITH {_RANK} SELECT contrast, n, CAST(statistic AS DOUBLE) AS statistic, ROUND(p, 9) AS p FROM sr")
def signed_rank(spark, sf):
    return S.signed_rank(effects(spark, sf), "contrast", "d").select("contrast", "n", "statistic", F.round("p", 9).alias("p"))


@query(f"WITH {_RANK}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p, contrast) AS k, COUNT(*) OVER () AS m FROM sr) SELECT contrast, ROUND(p, 9) AS p, ROUND(LEAST(MAX((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1), 9) AS adjusted, LEAST(MAX((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) <= 0.05 AS reject FROM o")
def holm(spark, sf):
    t = S.signed_rank(effects(spark, sf), "contrast", "d").withColumn("family", F.lit("price"))
    return S.holm(t, "family", "p", "contrast").select("contrast", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"), "reject")


@query(f"WITH {_RANK}, e AS (SELECT contrast, AVG(d) AS mean, MEDIAN(d) AS median FROM eff GROUP BY 1) SELECT contrast, ROUND(mean, 6) AS mean, ROUND(median, 6) AS median, ROUND(p, 9) AS p, mean > 0 AND p <= 0.05 AS claim FROM e JOIN sr USING (contrast)")
def confirmation_statistics(spark, sf):
    e = effects(spark, sf).persist()
    s = S.summary(e, ["contrast"], "d").join(S.signed_rank(e, "contrast", "d").select("contrast", "p"), "contrast")
    return s.select("contrast", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p", 9).alias("p"), ((F.col("mean") > 0) & (F.col("p") <= 0.05)).alias("claim"))


@query(f"WITH {METRICS}, l AS (SELECT variant, seed, UNNEST(['price', 'discount', 'quantity']) AS metric, UNNEST([price, discount, quantity]) AS v FROM mon) SELECT variant, metric, COUNT(v) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_samp(v), 6) AS sd, ROUND(MEDIAN(v), 6) AS median FROM l GROUP BY 1, 2")
def seed_summary(spark, sf):
    long = metrics(spark, sf).select("variant", "seed", F.expr("stack(3, 'price', price, 'discount', discount, 'quantity', quantity) as (metric, v)"))
    return S.summary(long, ["variant", "metric"], "v").select("variant", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median")])


@query("SELECT l_returnflag, COUNT(l_quantity) AS n, ROUND(AVG(l_quantity), 6) AS mean, TRUE AS fits FROM lineitem GROUP BY 1")
def bootstrap_ci(spark, sf):
    """Mean quantity by flag, and whether its interval holds it and is as wide as its standard error says, within a fifth."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    error = rows.groupBy("l_returnflag").agg((F.stddev_samp("l_quantity") / F.sqrt(F.count("l_quantity"))).alias("e"))
    out = S.bootstrap_mean(rows, "l_returnflag", "l_quantity", 2000).join(error, "l_returnflag")
    fits = F.col("mean").between(F.col("low"), F.col("high")) & ((F.col("high") - F.col("low")) / (2 * 1.96 * F.col("e"))).between(0.8, 1.2)
    return out.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), fits.alias("fits"))


@query("SELECT rater, COUNT(DISTINCT doc_id) AS items, ROUND(AVG(level), 9) AS mean, TRUE AS inside FROM reading_labels WHERE level IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1")
def cluster_bootstrap(spark, sf):
    """Mean level by rater over documents resampled whole, and whether it lies in its interval."""
    labels = table(spark, sf, "reading_labels").withColumn("level", F.col("level").cast("double"))
    out = S.cluster_bootstrap(labels, "rater", "doc_id", "level", 1000)
    return out.select("rater", "items", F.round("mean", 9).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"))


_RATERS = f"""it AS (SELECT DISTINCT doc_id FROM documents), rt AS (SELECT doc_id, r AS annotator, CAST({HASH.format("CAST(doc_id AS VARCHAR)")} % 5 AS INT) + CASE WHEN {HASH.format("doc_id || '|' || r")} % 4 = 0 THEN 1 ELSE 0 END AS rating
    FROM it CROSS JOIN (SELECT UNNEST(['annotator_01', 'annotator_02', 'annotator_03']) AS r))"""


def raters(spark, sf):
    """Three raters of every document: a base grade, a quarter of the time one higher."""
    d = table(spark, sf, "documents").select("doc_id").distinct()
    d = d.withColumn("annotator", F.explode(F.array(*[F.lit(f"annotator_0{i}") for i in (1, 2, 3)])))
    key = F.col("doc_id").cast("string")
    return d.withColumn("rating", ((hash32(key) % 5) + F.when(hash32(F.concat_ws("|", key, "annotator")) % 4 == 0, 1).otherwise(0)).cast("int"))


def _alpha(delta: str) -> str:
    return f"""WITH {_RATERS}, c AS (SELECT doc_id, rating AS v, COUNT(*) AS c FROM rt GROUP BY 1, 2), m AS (SELECT doc_id, SUM(c) AS m FROM c GROUP BY 1 HAVING SUM(c) > 1),
    o AS (SELECT x.v AS a, y.v AS b, SUM(x.c * (y.c - CASE WHEN x.v = y.v THEN 1 ELSE 0 END) / (m - 1)) AS o FROM c x JOIN c y USING (doc_id) JOIN m USING (doc_id) GROUP BY 1, 2), n AS (SELECT a AS v, SUM(o) AS n FROM o GROUP BY 1),
    u AS (SELECT v, n, SUM(n) OVER (ORDER BY v) AS u FROM n), g AS (SELECT x.n AS na, y.n AS nb, COALESCE(o, 0) AS o, CASE WHEN x.v = y.v THEN 0 ELSE {delta} END AS d FROM u x CROSS JOIN u y LEFT JOIN o ON o.a = x.v AND o.b = y.v), t AS (SELECT SUM(n) AS n FROM n)
    SELECT ROUND(1 - (SUM(o * d) / MAX(n)) / (SUM(na * nb * d) / (MAX(n) * (MAX(n) - 1))), 9) AS alpha FROM g CROSS JOIN t"""


@query(_alpha("1"))
def krippendorff_nominal(spark, sf):
    return S.krippendorff(raters(spark, sf), "doc_id", "rating", False).withColumn("alpha", F.round("alpha", 9))


@query(_alpha("POW(GREATEST(x.u, y.u) - LEAST(x.u - x.n, y.u - y.n) - (x.n + y.n) / 2, 2)"))
def krippendorff_ordinal(spark, sf):
    return S.krippendorff(raters(spark, sf), "doc_id", "rating", True).withColumn("alpha", F.round("alpha", 9))


@query(f"WITH {_RATERS}, c AS (SELECT doc_id, rating, COUNT(*) AS votes FROM rt GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY votes DESC, rating) AS r FROM c) SELECT doc_id, CASE WHEN votes >= 2 THEN CAST(rating AS VARCHAR) ELSE 'no_consensus' END AS choice, votes FROM k WHERE r = 1")
def majority_vote(spark, sf):
    return S.majority(raters(spark, sf), "doc_id", "rating")


@query(f"WITH {_RATERS} SELECT doc_id, MAX(CASE WHEN annotator = 'annotator_01' THEN rating END) AS annotator_01, MAX(CASE WHEN annotator = 'annotator_02' THEN rating END) AS annotator_02, MAX(CASE WHEN annotator = 'annotator_03' THEN rating END) AS annotator_03, MEDIAN(rating) AS median FROM rt GROUP BY 1")
def annotator_pivot(spark, sf):
    r = raters(spark, sf)
    wide = r.groupBy("doc_id").pivot("annotator", [f"annotator_0{i}" for i in (1, 2, 3)]).agg(F.first("rating"))
    return wide.join(r.groupBy("doc_id").agg(F.expr("percentile(rating, 0.5)").alias("median")), "doc_id")


@query("SELECT lower(trim(d.source, ' ')) AS source, COUNT(level) AS ratings, ROUND(AVG(level), 9) AS mean, ROUND(AVG(CASE WHEN level >= 3 THEN 1.0 WHEN level IS NOT NULL THEN 0.0 END), 9) AS hard_rate, MEDIAN(level) AS median FROM reading_labels JOIN documents d USING (doc_id) GROUP BY 1")
def method_summary(spark, sf):
    j = table(spark, sf, "reading_labels").join(table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("source")), "doc_id")
    hard = F.when(F.col("level") >= 3, 1.0).when(F.col("level").isNotNull(), 0.0)
    return j.groupBy("source").agg(F.count("level").alias("ratings"), F.round(F.avg("level"), 9).alias("mean"), F.round(F.avg(hard), 9).alias("hard_rate"), F.expr("percentile(level, 0.5)").alias("median"))


_PANEL = f"""{_RATERS}, pn AS (SELECT COALESCE(lower(trim(d.lang, ' ')), '?') AS method, doc_id, annotator, rating FROM rt JOIN (SELECT doc_id, MIN(lang) AS lang FROM documents GROUP BY 1) d USING (doc_id))"""


@query(f"WITH {_PANEL} SELECT method, COUNT(DISTINCT doc_id) AS items, COUNT(*) AS ratings, COUNT(*) FILTER (rating >= 4) AS numerator, COUNT(*) AS denominator, ROUND(COUNT(*) FILTER (rating >= 4) / COUNT(*), 9) AS rate, ROUND(AVG(rating), 9) AS mean, TRUE AS inside FROM pn GROUP BY 1")
def human_panel(spark, sf):
    """Raters of the documents by language: items, ratings, numerators and denominators, mean, and whether the mean lies in its item-cluster
    bootstrap interval."""
    d = table(spark, sf, "documents").groupBy("doc_id").agg(F.min("lang").alias("lang")).select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("?")).alias("method"))
    out = S.panel(raters(spark, sf).join(d, "doc_id"), "method", "doc_id", "rating", F.col("rating") >= 4, 200)
    return out.select("method", "items", "ratings", "numerator", "denominator", F.round("rate", 9).alias("rate"), F.round("mean", 9).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"))


_ALPHA = lambda delta: "(SELECT alpha FROM (" + _alpha(delta) + "))"


@query("SELECT UNNEST(['rating', 'rating', 'always']) AS outcome, UNNEST(['krippendorff_alpha_nominal', 'krippendorff_alpha_ordinal', 'krippendorff_alpha_nominal']) AS coefficient, UNNEST([printf('%.3f', " + _ALPHA("1") + "), printf('%.3f', " + _ALPHA("POW(GREATEST(x.u, y.u) - LEAST(x.u - x.n, y.u - y.n) - (x.n + y.n) / 2, 2)") + "), 'N/E']) AS reported, UNNEST([TRUE, TRUE, FALSE]) AS estimable")
def panel_reliability(spark, sf):
    """Agreement of each outcome; one that never varies cannot be estimated."""
    r = raters(spark, sf).withColumn("always", F.lit(1)).persist()
    return S.reliability(r, "doc_id", [("rating", False), ("rating", True), ("always", False)]).select("outcome", "coefficient", "reported", "estimable")


@query(f"""WITH {METRICS}, p AS (SELECT a.price - n.price AS gain, a.discount AS discount FROM mon a JOIN mon n ON n.seed = a.seed AND n.variant = 'N' WHERE a.variant = 'A'), g AS (SELECT MEDIAN(gain) > 0 AS median_gain, MIN(gain) > -100000 AS least_gain, AVG(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AS positive_share, MAX(discount) <= 0.06 AS discount_cap, ROUND(MEDIAN(gain) / 1000, 6) AS margin FROM p)
    SELECT *, list_filter([CASE WHEN NOT median_gain THEN 'median_gain' END, CASE WHEN NOT least_gain THEN 'least_gain' END, CASE WHEN NOT positive_share THEN 'positive_share' END, CASE WHEN NOT discount_cap THEN 'discount_cap' END], lambda x: x IS NOT NULL) AS failed, median_gain AND least_gain AND positive_share AND discount_cap AS eligible FROM g""")
def gate_summary(spark, sf):
    m = metrics(spark, sf)
    p = m.where("variant = 'A'").join(m.where("variant = 'N'").select("seed", F.col("price").alias("other")), "seed").withColumn("gain", F.col("price") - F.col("other"))
    middle = F.expr("percentile(gain, 0.5)")
    checks = {"median_gain": middle > 0, "least_gain": F.min("gain") > -100000, "positive_share": F.avg((F.col("gain") > 0).cast("double")) >= 0.9, "discount_cap": F.max("discount") <= 0.06}
    return S.gates(p, checks, {"median_gain": middle / 1000}).withColumn("margin", F.round("margin", 6))


@query("SELECT o_custkey AS candidate, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS orders FROM orders GROUP BY 1 HAVING COUNT(*) >= 10 ORDER BY ROUND(SUM(o_totalprice), 2) DESC, candidate LIMIT 1")
def candidate_select(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("candidate")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))
    return S.select_candidate(c, F.col("orders") >= 10, F.desc("total"), F.asc("candidate"))


_PROFILE = "pr AS (SELECT o_orderpriority AS method, COUNT(*) AS n, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE ROUND(AVG(o_totalprice), 4) END AS price, ROUND(MIN(o_totalprice), 4) AS least FROM orders GROUP BY 1)"


@query(f"WITH {_PROFILE}, r AS (SELECT method, CAST(RANK() OVER (ORDER BY n DESC NULLS LAST) AS INT) AS n_rank, CAST(RANK() OVER (ORDER BY price DESC NULLS LAST) AS INT) AS price_rank, CAST(RANK() OVER (ORDER BY least ASC NULLS LAST) AS INT) AS least_rank FROM pr) SELECT method, CAST(n_rank = 1 AS INT) + CAST(price_rank = 1 AS INT) + CAST(least_rank = 1 AS INT) AS firsts, CAST(n_rank <= 3 AS INT) + CAST(price_rank <= 3 AS INT) + CAST(least_rank <= 3 AS INT) AS top_threes, n_rank, price_rank, least_rank FROM r")
def rank_profile(spark, sf):
    price = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))
    r = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg(price), 4).alias("price"), F.round(F.min("o_totalprice"), 4).alias("least"))
    return S.rank_profile(r, "method", {"n": False, "price": False, "least": True})


@query("SELECT o_orderpriority, ROUND(AVG(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS \"F\", ROUND(AVG(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS \"O\", ROUND(AVG(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS \"P\" FROM orders GROUP BY 1")
def metric_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


_CELLS = "ce AS (SELECT CAST(FLOOR((l_quantity - 1) / 10) AS BIGINT) AS q, l_returnflag AS cal, MEDIAN(l_extendedprice) AS mid, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_CELLS} SELECT q, ROUND(MAX(CASE WHEN cal = 'A' THEN mid END), 4) AS \"A_mid\", ROUND(MAX(CASE WHEN cal = 'A' THEN most - least END), 4) AS \"A_range\", ROUND(MAX(CASE WHEN cal = 'N' THEN mid END), 4) AS \"N_mid\", ROUND(MAX(CASE WHEN cal = 'N' THEN most - least END), 4) AS \"N_range\", ROUND(MAX(CASE WHEN cal = 'R' THEN mid END), 4) AS \"R_mid\", ROUND(MAX(CASE WHEN cal = 'R' THEN most - least END), 4) AS \"R_range\" FROM ce GROUP BY 1")
def sensitivity_q(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.floor((F.col("l_quantity") - 1) / 10).alias("q"), F.col("l_returnflag").alias("cal"))
    c = c.agg(F.expr("percentile(l_extendedprice, 0.5)").alias("mid"), (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("range"))
    return c.groupBy("q").pivot("cal", ["A", "N", "R"]).agg(F.round(F.first("mid"), 4).alias("mid"), F.round(F.first("range"), 4).alias("range"))


_TRACE = "tr AS (SELECT strftime(o_orderdate, '%Y-%m') AS epoch, o_orderpriority AS seed, AVG(o_totalprice) AS loss FROM orders GROUP BY 1, 2)"


@query(f"WITH {_TRACE}, f AS (SELECT epoch, seed, loss / FIRST_VALUE(loss) OVER (PARTITION BY seed ORDER BY epoch) AS r FROM tr) SELECT epoch, ROUND(quantile_cont(r, 0.5), 8) AS median, ROUND(quantile_cont(r, 0.25), 8) AS q25, ROUND(quantile_cont(r, 0.75), 8) AS q75, ROUND(MIN(r), 8) AS low, ROUND(MAX(r), 8) AS high FROM f GROUP BY 1")
def convergence_quantiles(spark, sf):
    t = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("epoch"), F.col("o_orderpriority").alias("seed")).agg(F.avg("o_totalprice").alias("loss"))
    q = S.quantiles(S.relative_to_first(t, "seed", "epoch", "loss"), "epoch", "relative")
    return q.select("epoch", *[F.round(c, 8).alias(c) for c in ("median", "q25", "q75", "low", "high")])


@query("WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS epoch, AVG(o_totalprice) AS loss FROM orders GROUP BY 1), k AS (SELECT loss, ROW_NUMBER() OVER (ORDER BY epoch) AS i, COUNT(*) OVER () AS n FROM t) SELECT ROUND(AVG(CASE WHEN i <= LEAST(10, n // 4) THEN loss END), 6) AS first_mean, ROUND(AVG(CASE WHEN i > n - LEAST(10, n // 4) THEN loss END), 6) AS last_mean FROM k")
def edge_window_mean(spark, sf):
    t = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("epoch")).agg(F.avg("o_totalprice").alias("loss"))
    return S.edge_means(t, "epoch", "loss").select(F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


@query("SELECT strftime(l_shipdate, '%Y') AS epoch, ROUND(SUM(l_discount * l_quantity) / SUM(l_quantity), 9) AS l_discount FROM lineitem GROUP BY 1")
def weighted_epoch_loss(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("epoch", F.date_format("l_shipdate", "yyyy"))
    return S.weighted_mean(rows, ["epoch"], "l_discount", "l_quantity").withColumn("l_discount", F.round("l_discount", 9))


@query("SELECT event_type, COUNT(*) AS runs, ROUND(AVG(value), 8) AS mean, ROUND(stddev_samp(value), 8) AS sd, COUNT(*) FILTER (value > 10) AS converged, list_sort(list_distinct(list(user_id % 3))) AS devices FROM events GROUP BY 1")
def comparator_diagnostics(spark, sf):
    """Event kinds as methods: value as runtime, its limit 10 as the largest iteration, user groups as devices."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("method"), "value", (F.col("user_id") % 3).alias("device"))
    out = S.run_diagnostics(e, "method", "value", F.col("value") > 10, "device")
    return out.select(F.col("method").alias("event_type"), "runs", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "converged", "devices")


@query(f"WITH {METRICS}, l AS (SELECT variant, seed, UNNEST(['price', 'discount', 'quantity']) AS metric, UNNEST([price, discount, quantity]) AS v FROM mon), w AS (SELECT COUNT(DISTINCT seed) AS w FROM mon) SELECT variant, metric, ROUND(MIN(v), 6) AS least, ROUND(MAX(v), 6) AS most, COUNT(*) FILTER (v IS NULL OR isnan(v) OR isinf(v)) AS bad, COUNT(DISTINCT seed) AS seeds, COUNT(DISTINCT seed) = MAX(w) AS whole FROM l CROSS JOIN w GROUP BY 1, 2")
def final_diagnostics(spark, sf):
    """Every metric of every variant over the months as seeds, held against all months of the table."""
    m = metrics(spark, sf).persist()
    out = S.final_diagnostics(m, "variant", "seed", ["price", "discount", "quantity"], m.select("seed").distinct())
    return out.withColumn("least", F.round("least", 6)).withColumn("most", F.round("most", 6))


@query(f"WITH {METRICS} SELECT a.seed, ROUND(a.price - n.price, 6) AS price, ROUND(n.discount - a.discount, 9) AS discount, ROUND(a.quantity - n.quantity, 6) AS quantity FROM mon a JOIN mon n ON n.seed = a.seed AND n.variant = 'N' WHERE a.variant = 'A'")
def control_differences(spark, sf):
    m = metrics(spark, sf)
    b = m.where("variant = 'N'").select("seed", *[F.col(c).alias(f"b_{c}") for c in ("price", "discount", "quantity")])
    j = m.where("variant = 'A'").join(b, "seed")
    return j.select("seed", F.round(F.col("price") - F.col("b_price"), 6).alias("price"), F.round(F.col("b_discount") - F.col("discount"), 9).alias("discount"), F.round(F.col("quantity") - F.col("b_quantity"), 6).alias("quantity"))


@query("WITH e AS (SELECT label, i, AVG(x) AS c FROM (SELECT label, UNNEST(range(1, 65)) AS i, UNNEST(embedding) AS x FROM embeddings) GROUP BY 1, 2), p AS (SELECT vec_id, UNNEST(range(1, 65)) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings), d AS (SELECT vec_id, label, ROUND(SUM((x - c) * (x - c)), 9) AS d FROM p JOIN e USING (i) GROUP BY 1, 2) SELECT vec_id, ARG_MIN(label, (d, label)) AS label FROM d GROUP BY 1")
def nearest_centroid(spark, sf):
    e = table(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    return M.nearest_centroid(e, "vec_id", "embedding", c, "label", "centre")


@query("WITH w AS (SELECT label, i, SUM(x * (vec_id % 3 + 1)) / SUM(vec_id % 3 + 1) AS m FROM (SELECT vec_id, label, UNNEST(range(0, 64)) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) SELECT label, CAST(i AS INT) AS i, ROUND(m / SQRT(SUM(m * m) OVER (PARTITION BY label)), 8) AS x FROM w")
def weighted_embedding(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("c", F.col("vec_id") % 3 + 1)
    x = e.select("label", "c", F.posexplode("embedding").alias("i", "x"))
    m = x.groupBy("label", "i").agg((F.sum(F.col("x").cast("double") * F.col("c")) / F.sum("c")).alias("m"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return m.join(n, "label").select("label", "i", F.round(F.col("m") / F.col("n"), 8).alias("x"))


@query("SELECT ready, CASE WHEN ready AND returned THEN 'PASS' WHEN ready THEN 'PREPARATION_PASS' ELSE 'FAIL' END AS state, COUNT(*) AS posts FROM (SELECT included_in_model AS ready, city IS NOT NULL AS returned FROM split_assignments WHERE included_in_model IS NOT NULL) GROUP BY 1, 2")
def readiness_state(spark, sf):
    s = table(spark, sf, "split_assignments").where("included_in_model is not null").withColumn("ready", F.col("included_in_model"))
    state = F.when(F.col("ready") & F.col("city").isNotNull(), "PASS").when(F.col("ready"), "PREPARATION_PASS").otherwise("FAIL")
    return s.groupBy("ready", state.alias("state")).agg(F.count("*").alias("posts"))


@query("SELECT city, CAST(ROW_NUMBER() OVER (ORDER BY city) - 1 AS INT) AS idx FROM (SELECT DISTINCT city FROM split_assignments WHERE city IS NOT NULL)")
def category_index(spark, sf):
    cities = table(spark, sf, "split_assignments").where("city is not null").select("city").distinct()
    return C.ordinal(cities, "city").select("city", F.col("position").cast("int").alias("idx"))


@query("WITH v AS (SELECT COUNT(DISTINCT term_id) AS v FROM vocabulary), c AS (SELECT COUNT(DISTINCT city) AS c FROM split_assignments), k AS (SELECT COUNT(DISTINCT centroid_id) AS k, MAX(len(embedding)) AS d FROM centroids) SELECT UNNEST(['topics', 'words', 'contrasts', 'gates']) AS part, CAST(UNNEST([k * d, v * d, (c - 1) * k * d, k]) AS BIGINT) AS parameters FROM v CROSS JOIN c CROSS JOIN k")
def parameter_counts(spark, sf):
    """Sizes taken from the tables: centroids as topics, the vocabulary, the cities."""
    k = table(spark, sf, "centroids").agg(F.count_distinct("centroid_id").alias("k"), F.max(F.size("embedding")).alias("d")).first()
    v = table(spark, sf, "vocabulary").agg(F.count_distinct("term_id")).first()[0]
    c = table(spark, sf, "split_assignments").agg(F.count_distinct("city")).first()[0]
    return M.parameter_counts(spark, k["k"], v, c, k["d"])


# Models: no SQL can say them; their rows are checked here, what they find on planted topics in planted_topics and in tests.


def model_cells(spark, sf):
    """Cells of all train terms, numbered 0.. by frequency, and the number of terms."""
    fit = fit_cells(spark, sf).persist()
    freq = fit.groupBy("term_id").agg(F.count("*").alias("df")).persist()
    numbers = C.ordinal(freq.select((-F.col("df")).alias("less"), "term_id"), "less", "term_id").select("term_id", F.col("position").cast("int").alias("index"))
    return fit.join(numbers, "term_id").select("doc_id", F.col("index").alias("term_id"), "cnt"), freq.count()


@query(None)
def lda_top_words(spark, sf):
    return T.top_words(M.fit_lda(*model_cells(spark, sf), 10, 3)[0], "p")


@query(None)
def lda_completion_nll(spark, sf):
    cells, size = model_cells(spark, sf)
    split = P.completion_split(cells)
    return M.lda_completion(split, size, 10, 3).agg(*P.nll(F.col("cnt"), F.col("p")))


def _sets(beta, n=10):
    found: dict[int, set] = {}
    for r in T.top_words(beta, "p", n).collect():  # topics x n rows
        found.setdefault(r["topic"], set()).add(r["term_id"])
    return [found[k] for k in sorted(found)]


@query(None)
def topic_stability(spark, sf):
    cells, size = model_cells(spark, sf)
    cells = cells.persist()
    mean, least = M.matched_stability([_sets(M.fit_lda(cells, size, 6, seed, 5)[0]) for seed in (3, 4, 5)])
    return spark.createDataFrame([(3, mean, least)], "fits int, mean double, least double")


@query(None)
def nmf_topics(spark, sf):
    return T.top_words(M.fit_nmf(*model_cells(spark, sf), 8, 15), "p")


@query(None)
def gsdmm_topics(spark, sf):
    """Topics of all train posts: every post is sampled and counted."""
    return M.fit_gsdmm(*model_cells(spark, sf), 10, 8)[0]


@query(f"WITH {FIT} SELECT COUNT(DISTINCT doc_id) AS docs, 10::BIGINT AS topics, TRUE AS once FROM fit")
def gsdmm_assignment(spark, sf):
    """Every train post has one topic."""
    z = M.fit_gsdmm(*model_cells(spark, sf), 10, 2)[1]
    per = z.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("topic").alias("t"), F.min("topic").alias("u"))
    return per.agg(F.count("*").alias("docs"), F.lit(10).cast("long").alias("topics"), (F.max("n") == 1).alias("_a"), ((F.min("u") >= 0) & (F.max("t") < 10)).alias("_b")).select("docs", "topics", (F.col("_a") & F.col("_b")).alias("once"))


@query(None)
def btm_topics(spark, sf):
    cells, size = model_cells(spark, sf)
    return T.top_words(M.fit_btm(C.biterms(C.expand_tokens(cells), 15), size, 8, 5), "p")


_PLANTED = "pl AS (SELECT c_custkey AS d, c_nationkey % 3 AS g FROM customer)"


@query("WITH " + _PLANTED + " SELECT m AS model, CAST(g AS INT) AS topic, COUNT(*) AS documents, TRUE AS found FROM pl CROSS JOIN (SELECT UNNEST(['lda', 'nmf', 'gsdmm', 'btm', 'spectral']) AS m) GROUP BY 1, 2")
def planted_topics(spark, sf):
    """Three topics of eight terms planted in the customers by nation: each model must show every topic's terms as the leading ones of one
    topic."""
    d = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), (F.col("c_nationkey") % 3).cast("int").alias("g"))
    word = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(8)).cast("int")))
    cells = d.select("doc_id", "g", word.alias("w")).groupBy("doc_id", (F.col("g") * 8 + F.col("w")).alias("term_id")).agg(F.count("*").alias("cnt")).persist()
    pairs = C.biterms(C.expand_tokens(cells), 15)
    graph = G.npmi_graph(cells)
    cores: dict[int, set] = {}
    for r in M.spectral_prototypes(graph, 3, 8, rounds=8).collect():
        cores.setdefault(r["topic"], set()).add(r["term_id"])
    shown = {
        "lda": _sets(M.fit_lda(cells, 24, 3, 3, 20)[0], 8),
        "nmf": _sets(M.fit_nmf(cells, 24, 3, 8), 8),
        "gsdmm": [set(r["top"][:8]) for r in M.fit_gsdmm(cells, 24, 3, 8)[0].collect()],
        "btm": _sets(M.fit_btm(pairs, 24, 3, 8), 8),
        "spectral": list(cores.values()),
    }
    rows = [(m, g, set(range(8 * g, 8 * g + 8)) in found) for m, found in shown.items() for g in range(3)]
    made = spark.createDataFrame(rows, "model string, topic int, found boolean")
    return made.join(d.groupBy(F.col("g").alias("topic")).agg(F.count("*").alias("documents")), "topic").select("model", "topic", "documents", "found")


@query("SELECT COUNT(*) AS vectors, TRUE AS parted FROM embeddings WHERE embedding IS NOT NULL")
def pca_kmeans_topics(spark, sf):
    """Vectors in clusters of their leading components, each once, no cluster with all."""
    sizes = M.pca_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, 10).groupBy("topic").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("vectors"), (F.count("*").between(2, 10) & (F.max("n") < F.sum("n"))).alias("parted"))


@query("SELECT COUNT(*) AS vectors, TRUE AS parted FROM embeddings WHERE embedding IS NOT NULL")
def kmeans_context(spark, sf):
    """Vectors in clusters of all components; of three starts the one of least cost."""
    sizes = M.pca_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 64, 8, starts=3).groupBy("topic").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("vectors"), (F.count("*").between(2, 8) & (F.max("n") < F.sum("n"))).alias("parted"))


@query(None)
def spectral_prototypes(spark, sf):
    return M.spectral_prototypes(G.npmi_graph(fit_cells(spark, sf)), 4, 8, 8)


@query(None)
def prototype_alignment(spark, sf):
    cells, size = model_cells(spark, sf)
    cells = cells.persist()
    cores = M.spectral_prototypes(G.npmi_graph(cells), 4, 8, 8)
    return M.align_cores(cores, M.fit_lda(cells, size, 6, 3, 5)[0], 6)


@query(None)
def prototype_ceiling(spark, sf):
    """Coherence of the prototype cores themselves on all train posts and on the held-out ones, and their support: the ceiling of any model."""
    fit = fit_cells(spark, sf).persist()
    held = C.cells_of(spark, sf).where("split <> 'train'").select("doc_id", "term_id", "cnt").persist()
    graph = G.npmi_graph(fit).persist()
    cores = M.spectral_prototypes(graph, 4, 8, 8)
    return R.prototype_ceiling(cores, fit, held, graph, 3)


@query(f"WITH {FIT} SELECT COUNT(DISTINCT term_id) AS terms, 64::INT AS width, 0.0::DOUBLE AS off FROM fit")
def term_vectors(spark, sf):
    """Vectors of all train terms: their number, width and largest distance from unit length."""
    v = M.term_vectors(fit_cells(spark, sf))
    off = C.unit_norm(v, "term_id", "embedding").agg(F.round(F.max("off"), 9).alias("off"))
    return v.agg(F.count("*").alias("terms"), F.min(F.size("embedding")).alias("width")).crossJoin(off)  # one row each


_DIST = """WITH e AS (SELECT label, i, AVG(x) AS c FROM (SELECT label, UNNEST(range(1, 65)) AS i, UNNEST(embedding) AS x FROM embeddings) GROUP BY 1, 2),
    p AS (SELECT vec_id, UNNEST(range(1, 65)) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings), z AS (SELECT vec_id, label, -SUM((x - c) * (x - c)) / 0.2::DOUBLE AS z FROM p JOIN e USING (i) GROUP BY 1, 2),
    m AS (SELECT *, MAX(z) OVER (PARTITION BY vec_id) AS t FROM z)"""


@query(_DIST + " SELECT label AS topic, vec_id AS term_id, ROUND(EXP(z - t) / SUM(EXP(z - t)) OVER (PARTITION BY vec_id), 7) AS p FROM m")
def distance_affinity(spark, sf):
    """Mean vectors of the labels as topics, all vectors as words, temperature 0.2."""
    e = table(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    c = c.groupBy(F.col("label").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("embedding"))
    z = M.affinity_logits(c, e.select(F.col("vec_id").alias("term_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), 0.2)
    return T.softmax_affinity(z).withColumn("p", F.round("p", 7))


@query("WITH s AS (SELECT UNNEST(range(0, 60)) AS d) SELECT 'g' || (d % 3) AS stratum, COUNT(*) AS documents, CAST(COUNT(*) * 25 AS BIGINT) AS tokens FROM s GROUP BY 1")
def synthetic_corpus(spark, sf):
    cells = M.synthetic_counts(spark, 60, 4, 40, 3, 25)
    return cells.groupBy("stratum").agg(F.count_distinct("doc_id").alias("documents"), F.sum("cnt").alias("tokens"))
