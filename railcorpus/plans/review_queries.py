"""Queries of the audits, panels and model terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from railcorpus.operators import corpus as C
from railcorpus.operators import graph as G
from railcorpus.operators import review as R
from railcorpus.operators import topics as T
from railcorpus.plans.corpus_queries import _EDGES, fit_cells
from railcorpus.plans.registry import query
from railcorpus.plans.sqlbase import CLASSES, DOCS, FIT, GRAPH, HASH, METRICS, PRIORS
from railcorpus.plans.stat_queries import _RATERS, metrics, raters
from railcorpus.plans.topic_queries import beta, priors, top
from railcorpus.session import table


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def validated_join(spark, sf):
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return R.join_once(table(spark, sf, "nation"), r, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT term_id, 'different' AS problem FROM (SELECT term_id, MIN(document_frequency) AS a FROM vocabulary GROUP BY 1) v JOIN (WITH %s SELECT term_id, COUNT(*) AS b FROM fit GROUP BY 1) f USING (term_id) WHERE NOT COALESCE(ABS(a - b) <= 1e-12 + 1e-11 * GREATEST(a, b), FALSE) UNION ALL SELECT DISTINCT term_id, 'missing' FROM vocabulary WHERE term_id NOT IN (WITH %s SELECT term_id FROM fit)" % (FIT, FIT))
def stale_frequencies(spark, sf):
    """Recorded document frequencies against counted ones."""
    v = table(spark, sf, "vocabulary").groupBy("term_id").agg(F.min("document_frequency").alias("df"))
    return R.tolerant_differences(v, C.document_frequency(fit_cells(spark, sf)), "term_id", ["df"])


@query("SELECT post_id, COUNT(DISTINCT COALESCE(source, '∅')) AS source, COUNT(DISTINCT COALESCE(city, '∅')) AS city, COUNT(DISTINCT COALESCE(source, '∅')) = 1 AND COUNT(DISTINCT COALESCE(city, '∅')) = 1 AS constant FROM posts GROUP BY 1")
def delivery_constancy(spark, sf):
    return R.constancy(table(spark, sf, "posts"), "post_id", "source", "city")


_CELL = f"""{_RATERS}, cs AS (SELECT d.lang, d.source, COUNT(rating) AS ratings, MEDIAN(rating) AS median, ROUND(AVG(rating), 9) AS mean, COUNT(*) FILTER (rating >= 4) AS votes
    FROM rt JOIN (SELECT doc_id, COALESCE(lower(trim(lang, ' ')), '?') AS lang, COALESCE(lower(trim(source, ' ')), '?') AS source FROM documents) d USING (doc_id) GROUP BY 1, 2)"""


def _cells(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("?")).alias("lang"), F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("source"))
    return R.cell_summary(raters(spark, sf).join(d, "doc_id"), ["lang", "source"], "rating", F.col("rating") >= 4, 2.0).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_CELL} SELECT *, median >= 2 AND votes >= 2 AS eligible FROM cs")
def case_cells(spark, sf):
    return _cells(spark, sf)


@query(f"WITH {_CELL}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY median DESC, mean DESC, votes DESC, source) AS i FROM cs WHERE median >= 2 AND votes >= 2) SELECT lang, source, ratings, median, mean, votes, TRUE AS eligible FROM k WHERE i = 1")
def case_selection(spark, sf):
    return R.best_cell(_cells(spark, sf), "lang", F.desc("median"), F.desc("mean"), F.desc("votes"), F.asc("source"))


@query("""WITH d AS (SELECT lower(trim(lang, ' ')) AS lang, lower(trim(source, ' ')) AS source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), c AS (SELECT lang, source, COUNT(*) AS n FROM d GROUP BY 1, 2)
    SELECT l.lang, s.source, COALESCE(n, 0) AS items, CASE WHEN n = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT lang FROM d) l CROSS JOIN (SELECT DISTINCT source FROM d) s LEFT JOIN c ON c.lang = l.lang AND c.source = s.source""")
def case_grid_audit(spark, sf):
    return R.case_grid_audit(table(spark, sf, "documents").select(F.lower(F.trim("lang")).alias("lang"), F.lower(F.trim("source")).alias("source")), "lang", "source")


@query("SELECT term, lang, CASE term WHEN 'agency' THEN 'en' WHEN 'route' THEN 'en' WHEN '公交' THEN 'zh' END AS expected, COALESCE(lang = CASE term WHEN 'agency' THEN 'en' WHEN 'route' THEN 'en' WHEN '公交' THEN 'zh' END, FALSE) AS same FROM vocabulary")
def translation_check(spark, sf):
    return R.mapping_check(table(spark, sf, "vocabulary"), "term", "lang", {"agency": "en", "route": "en", "公交": "zh"})


@query(f"WITH {CLASSES}, ci AS (SELECT doc_id, term_id AS index, cnt FROM fit UNION ALL SELECT f.doc_id, top.term_id + 1000000, CAST(11 - rank AS BIGINT) FROM (SELECT DISTINCT doc_id FROM fit) f JOIN docs USING (doc_id) JOIN top ON top.topic = docs.city) SELECT doc_id, COUNT(*) AS cells, CAST(SUM(cnt) AS BIGINT) AS mass, COUNT(*) FILTER (index >= 1000000) AS context FROM ci GROUP BY 1")
def context_input(spark, sf):
    """A post's terms, and behind them the leading terms of its city."""
    fit = fit_cells(spark, sf)
    assigned = fit.select("doc_id").distinct().join(C.documents_of(spark, sf).select("doc_id", F.col("city").alias("cluster")), "doc_id")
    context = top(spark, sf).select(F.col("topic").alias("cluster"), "term_id", (F.lit(11) - F.col("rank")).cast("long").alias("cnt"))
    both = R.context_input(fit, assigned, context, 1_000_000)
    return both.groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum("cnt").alias("mass"), F.count_if(F.col("index") >= 1_000_000).alias("context"))


@query(f"""WITH {GRAPH}{_EDGES}, {CLASSES.split(FIT + ", ")[1]}, w2 AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges), me AS (SELECT topic, term_id, 1.0 / rank AS m FROM top), act AS (SELECT DISTINCT src AS term_id FROM w2),
    inn AS (SELECT x.topic, SUM(w * x.m * y.m) AS s FROM w2 JOIN me x ON x.term_id = src JOIN me y ON y.topic = x.topic AND y.term_id = dst GROUP BY 1), tp AS (SELECT topic, SUM(m) AS mass, SUM(m * m) AS sq, SUM(CASE WHEN act.term_id IS NULL THEN m ELSE 0 END) AS loose FROM me LEFT JOIN act USING (term_id) GROUP BY 1),
    ag AS (SELECT AVG(COALESCE(s, 0) / (mass * mass - sq)) AS association, SUM(loose) AS unsupported, COUNT(*) AS k FROM tp LEFT JOIN inn USING (topic)), wo AS (SELECT SUM((s * s - q) / 2) AS pairs, SUM(GREATEST(s - 1, 0)) AS excess FROM (SELECT term_id, SUM(m) AS s, SUM(m * m) AS q FROM me GROUP BY 1))
    SELECT ROUND(association, 9) AS association, ROUND(pairs / (k * (k - 1) / 2), 9) AS overlap, ROUND(excess, 9) AS excess, ROUND(unsupported, 9) AS unsupported FROM ag CROSS JOIN wo""")
def lexical_terms(spark, sf):
    m = top(spark, sf).select("topic", "term_id", (1 / F.col("rank")).alias("m")).persist()
    out = R.lexical_terms(m, G.npmi_graph(fit_cells(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"WITH {CLASSES}, ma AS (SELECT topic AS doc_id, topic, size / (SELECT MAX(size) FROM siz) AS m FROM siz), z AS (SELECT ma.doc_id, top.term_id, SUM(m * beta.p) AS z FROM ma JOIN beta USING (topic) JOIN (SELECT DISTINCT term_id FROM top) top USING (term_id) GROUP BY 1, 2), e AS (SELECT doc_id, term_id, EXP(2 * z + 0.1 - MAX(2 * z + 0.1) OVER (PARTITION BY doc_id)) AS e FROM z) SELECT doc_id, term_id, ROUND(e / SUM(e) OVER (PARTITION BY doc_id), 9) AS p FROM e")
def decoded_probabilities(spark, sf):
    """One pseudo-document a city, decoded over the displayed terms."""
    size = fit_cells(spark, sf).join(C.documents_of(spark, sf).select("doc_id", F.col("city").alias("topic")), "doc_id").groupBy("topic").agg(F.sum("cnt").alias("s"))
    most = size.agg(F.max("s").alias("most"))
    mass = size.crossJoin(F.broadcast(most)).select(F.col("topic").alias("doc_id"), "topic", (F.col("s") / F.col("most")).alias("m"))  # one row
    words = top(spark, sf).select("term_id").distinct()
    out = R.decode(mass, beta(spark, sf).join(words, "term_id", "left_semi"), words.select("term_id", F.lit(2.0).alias("a"), F.lit(0.1).alias("b")))
    return out.withColumn("p", F.round("p", 9))


_ODDS = PRIORS + ", od AS (SELECT stratum, stratum.term_id, GREATEST(-2, LEAST(2, LN(stratum.p / pooled.p))) AS r FROM stratum JOIN pooled USING (term_id)), oc AS (SELECT stratum, term_id, r - AVG(r) OVER (PARTITION BY term_id) AS r FROM od)"


@query(f"WITH {_ODDS} SELECT stratum, term_id, ROUND(r, 9) AS r FROM oc")
def stratum_log_odds(spark, sf):
    _, pooled, stratum = priors(spark, sf)
    return R.log_odds(stratum, pooled).withColumn("r", F.round("r", 9))


@query(f"WITH {_ODDS}, x AS (SELECT oc.stratum, s.stratum AS topic, oc.term_id, s.p * EXP(0.5 * oc.r) AS p FROM stratum s JOIN oc USING (term_id)), n AS (SELECT *, p / SUM(p) OVER (PARTITION BY stratum, topic) AS q FROM x) SELECT stratum, topic, ROUND(MAX(q), 9) AS most, ROUND(SUM(q), 6) AS total FROM n GROUP BY 1, 2")
def conditioned_distributions(spark, sf):
    _, pooled, stratum = priors(spark, sf)
    out = R.conditioned(stratum.withColumnRenamed("stratum", "topic"), R.log_odds(stratum, pooled), 0.5)
    return out.groupBy("stratum", "topic").agg(F.round(F.max("p"), 9).alias("most"), F.round(F.sum("p"), 6).alias("total"))


@query("SELECT r_name AS variant, CASE WHEN r_regionkey % 2 = 0 THEN 8 ELSE 0 END AS prototype_quota, CASE WHEN r_regionkey < 3 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS pooled_weight, CASE WHEN r_regionkey % 2 = 0 AND r_regionkey > 0 THEN 'moment' ELSE 'none' END AS calibration FROM region")
def variant_registry(spark, sf):
    """Regions as variants."""
    k = F.col("r_regionkey")
    return R.variant_registry(table(spark, sf, "region").select(F.col("r_name").alias("variant"), (k % 2 == 0).alias("graph"), (k < 3).alias("pooled"), (k > 0).alias("calibrated")), 8, 0.35, "moment")


@query("""WITH a AS (SELECT source AS artifact, COUNT(*) AS n FROM posts WHERE source IS NOT NULL GROUP BY 1), b AS (SELECT DISTINCT source AS artifact FROM leakage_report)
    SELECT COALESCE(a.artifact, b.artifact) AS artifact, CASE WHEN b.artifact IS NULL THEN 'read' WHEN a.artifact IS NULL THEN 'prohibited' ELSE 'violation' END AS access, COALESCE(n, 0) AS reads FROM a FULL JOIN b ON a.artifact = b.artifact""")
def access_ledger(spark, sf):
    """Sources of the posts as what was read, those of the claims as what must not be."""
    return R.access_ledger(table(spark, sf, "posts").where("source is not null").select(F.col("source").alias("artifact")), table(spark, sf, "leakage_report").select(F.col("source").alias("artifact")))


@query(f"WITH {METRICS}, a AS (SELECT variant, seed, price, RANK() OVER (PARTITION BY variant ORDER BY ROUND(price, 2)) + (COUNT(*) OVER (PARTITION BY variant, ROUND(price, 2)) - 1) / 2 AS r FROM mon) SELECT variant, seed, r AS mid_rank FROM a")
def mid_ranks(spark, sf):
    from railcorpus.operators.stats import average_rank

    m = metrics(spark, sf).withColumn("x", F.round("price", 2))
    return m.select("variant", "seed", average_rank("x", "variant").alias("mid_rank"))


@query(f"WITH {DOCS} SELECT city, doc_id, ROW_NUMBER() OVER (PARTITION BY city ORDER BY sha256('7|' || city || '|' || doc_id), doc_id) - 1 AS place FROM docs")
def seeded_shuffle(spark, sf):
    """Posts of each city in the order of a seed."""
    return R.seeded_permutation(C.documents_of(spark, sf).select("city", "doc_id"), "city", "doc_id", "7")


@query(f"WITH {CLASSES}, it AS (SELECT topic, string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY rank) AS words, MIN(term_id) AS least FROM top GROUP BY 1) SELECT printf('item_%04d', ROW_NUMBER() OVER (ORDER BY sha256('packet|all|' || topic), topic)) AS item_id, words, topic, least FROM it")
def blind_packet(spark, sf):
    """Cities' leading words as blinded items, joined to their answers again once the returned form is seen to be as issued."""
    words = top(spark, sf).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term_id"))), lambda x: x["term_id"].cast("string")), " ").alias("words"), F.min("term_id").alias("least"))
    form, answers = (d.persist() for d in R.packet(words.persist(), "topic", ["words"], ["least"], "packet"))
    return R.scored(form, form, answers, ["words"])


@query(f"WITH {_ODDS}, tk AS (SELECT SUM(-cnt * LN(pooled.p)) / SUM(cnt) AS nll FROM tgt JOIN pooled USING (term_id)), sh AS (SELECT stratum, CAST(SUM(cnt) AS DOUBLE) AS w FROM tgt GROUP BY 1), rs AS (SELECT stratum, AVG(r * r) AS q FROM oc GROUP BY 1), po AS (SELECT SUM(w * q) / SUM(w) AS pooling FROM rs JOIN sh USING (stratum)), gt AS (SELECT AVG(1 / (1 + EXP(-w / (SELECT MAX(w) FROM sh)))) AS gate, AVG(-LN(w / (SELECT SUM(w) FROM sh) + 1e-12)) AS lexical FROM sh) SELECT ROUND(nll, 8) AS nll, ROUND(pooling, 8) AS pooling, ROUND(gate, 8) AS gate, ROUND(lexical, 8) AS lexical, ROUND(nll + 0.1 * pooling + 0.01 * gate + 0.5 * lexical, 8) AS total FROM tk CROSS JOIN po CROSS JOIN gt")
def full_objective(spark, sf):
    """Likelihood of the targets under the pooled prior, log-odds of the cities as shifts, their target tokens as shares and gates; the
    lexical part from the shares as associations."""
    from railcorpus.operators import priors as P

    target, pooled, stratum = priors(spark, sf)
    share = target.groupBy("stratum").agg(F.sum("cnt").cast("double").alias("w")).persist()
    edge = share.agg(F.max("w").alias("most"), F.sum("w").alias("all"))
    parts = share.crossJoin(F.broadcast(edge))  # one row
    gates = parts.select(F.col("stratum").alias("topic"), (1 / (1 + F.exp(-F.col("w") / F.col("most")))).alias("gate"))
    lexical = parts.select(F.col("stratum").alias("topic"), (-F.log(F.col("w") / F.col("all") + 1e-12)).alias("loss"))
    residual = R.log_odds(stratum, pooled).select("stratum", F.lit(0).alias("topic"), F.col("r").alias("x"))
    out = T.objective(P.completion_nll(target, pooled, ["term_id"], []), residual, share, gates, lexical, (0.1, 0.01, 0.5))
    return out.select(*[F.round(c, 8).alias(c) for c in ("nll", "pooling", "gate", "lexical", "total")])


@query(f"WITH {CLASSES}, ot AS (SELECT topic, term_id, p, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY p DESC, term_id) AS place FROM beta ANTI JOIN top ON top.topic = beta.topic AND top.term_id = beta.term_id) SELECT topic, ROUND(p, 12) AS boundary FROM ot WHERE place = 3")
def complement_boundary(spark, sf):
    """The third-largest share of each city outside its displayed words."""
    rest = beta(spark, sf).join(top(spark, sf).select("topic", "term_id"), ["topic", "term_id"], "left_anti")
    third = T.top_words(rest.withColumn("p", F.col("p")), "p", 3).where("rank = 3")
    return third.join(rest, ["topic", "term_id"]).select("topic", F.round("p", 12).alias("boundary"))
