"""Topic, prior, statistic and model operators on hand values and invariants."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from railcorpus.operators import corpus as C
from railcorpus.operators import models as M
from railcorpus.operators import priors as P
from railcorpus.operators import stats as S
from railcorpus.operators import topics as T
from railcorpus.plans import corpus_queries, review_queries, stat_queries, topic_queries
from tests.test_text_and_corpus import COUNTS, cells_of


def top_of(spark, topics):
    return spark.createDataFrame([(k, r + 1, t) for k, ts in enumerate(topics) for r, t in enumerate(ts)], "topic int, rank int, term_id int")


def test_document_npmi(spark):
    got = {r.topic: r for r in T.document_npmi(cells_of(spark, COUNTS), top_of(spark, [[0, 1], [2, 4]])).collect()}
    assert abs(got[0].npmi - 1) < 1e-12 and (got[1].npmi, got[1].absent_pairs, got[1].zero_pairs) == (-1.0, 1, 1)


def test_perfect_topics(spark):
    rows = [[1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 1, 1, 0]]
    cells, top = cells_of(spark, rows), top_of(spark, [[0, 1], [2, 3]])
    tokens = spark.createDataFrame([(f"d{i}", [j for j, c in enumerate(r) if c]) for i, r in enumerate(rows)], "doc_id string, tokens array<int>")
    assert all(abs(r.npmi - 1) < 1e-12 for r in T.document_npmi(cells, top).collect())
    assert all(abs(r.c_v - 1) < 1e-12 for r in T.cv_coherence(tokens, top).collect())
    assert T.diversity(top).first()[0] == 1.0 and [r.jaccard for r in T.pairwise_jaccard(top).collect()] == [0.0]


def test_windows(spark):
    df = spark.createDataFrame([("a", [1, 2, 3, 4, 5]), ("b", [7, 7]), ("c", [])], "doc_id string, tokens array<int>")
    got = sorted((r.doc_id, r.start, r.terms) for r in T.windows(df, 3).collect())
    assert got == [("a", 0, [1, 2, 3]), ("a", 1, [2, 3, 4]), ("a", 2, [3, 4, 5]), ("b", 0, [7])]


def test_top_words_break_ties_by_term(spark):
    p = spark.createDataFrame([(0, t, v) for t, v in enumerate([0.5, 0.5, 0.2, 0.2])], "topic int, term_id int, p double")
    assert [r.term_id for r in T.top_words(p, "p", 3).orderBy("rank").collect()] == [0, 1, 2]


def test_rank_biased_overlap(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1]), ([1, 2, 3, 4, 5], [2, 1, 3, 4, 5])], "a array<int>, b array<int>")
    same, back, swapped = (r[0] for r in df.select(T.rank_biased_overlap(F.col("a"), F.col("b"), 5)).collect())
    assert abs(same - 1) < 1e-12 and 0 < back < swapped < 1 and abs(swapped - 0.9) < 1e-12


def test_likelihood(spark):
    df = spark.createDataFrame([(2, 0.8), (1, 0.7)], "cnt long, p double")
    out = df.agg(*P.nll(F.col("cnt"), F.col("p"))).first()
    assert out.tokens == 3 and abs(out.nll + (2 * math.log(0.8) + math.log(0.7)) / 3) < 1e-12
    target = spark.createDataFrame([("a", 0, 1), ("b", 9, 1)], "doc_id string, term_id int, cnt long")
    prob = spark.createDataFrame([(0, 1.0)], "term_id int, p double")
    assert {r.doc_id: round(r.nll, 6) for r in P.completion_nll(target, prob, ["term_id"], ["doc_id"]).collect()} == {"a": 0.0, "b": round(-math.log(1e-12), 6)}


def test_priors_sum_to_one(spark):
    cells = cells_of(spark, COUNTS)
    voc = spark.createDataFrame([(i,) for i in range(7)], "term_id int")
    strata = spark.createDataFrame([("d0", "x"), ("d1", "x"), ("d2", "y")], "doc_id string, stratum string")
    assert abs(P.pooled_unigram(cells, voc).agg(F.sum("p")).first()[0] - 1) < 1e-12
    out = P.stratum_prior(cells, strata, voc).groupBy("stratum").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-12 and r.n == 7 for r in out) and len(out) == 2
    mixed = spark.range(1).select(P.mixture(F.lit(0.3), F.lit(0.9), F.lit(0)), P.mixture(F.lit(0.3), F.lit(0.9), F.lit(1)), P.mixture(F.lit(0.2), F.lit(0.4), F.lit(0.5))).first()
    assert mixed[0] == 0.3 and mixed[1] == 0.9 and abs(mixed[2] - 0.3) < 1e-12


def test_crossfit_finds_strata(spark):
    rows = [[3, 2, 0] if i % 2 else [0, 1, 4] for i in range(12)]
    strata = spark.createDataFrame([(f"d{i}", str(i % 2)) for i in range(12)], "doc_id string, stratum string")
    voc = spark.createDataFrame([(0,), (1,), (2,)], "term_id int")
    out = P.crossfit(cells_of(spark, rows), strata, voc, 2).collect()
    assert len(out) == 2 and all(r.gain > 0 for r in out)


@pytest.mark.parametrize("make", [P.completion_split, P.pcg64_completion])
def test_completion_split(spark, make):
    cells = cells_of(spark, [[2, 1, 0], [0, 3, 2], [1, 0, 0], [1, 1, 0], [0, 40, 1]])
    a = sorted(tuple(r) for r in make(cells).collect())
    b = sorted(tuple(r) for r in make(cells.orderBy(F.desc("term_id")).repartition(5)).collect())
    assert a == b and {r[0] for r in a} == {"d0", "d1", "d3", "d4"}
    want = {(r.doc_id, r.term_id): r.cnt for r in cells.collect()}
    assert all(o + t == want[d, w] and o >= 0 and t >= 0 for d, w, o, t in a)
    for d in ("d0", "d1", "d3", "d4"):
        assert sum(r[2] for r in a if r[0] == d) > 0 < sum(r[3] for r in a if r[0] == d)


def test_group_folds(spark):
    rows = [("s", f"g{i}") for i in range(20) for _ in range(i % 4 + 1)] + [(None, "x"), ("s", None)]
    out = P.group_folds(spark.createDataFrame(rows, "stratum string, group_key string"), 5).collect()
    assert len(out) == 20
    load = {}
    for r in out:
        load[r.fold] = load.get(r.fold, 0) + r["size"]
    assert len(load) == 5 and max(load.values()) - min(load.values()) <= 2


def affinity(spark, seed=1, topics=4, words=40):
    p = np.random.default_rng(seed).random((topics, words))
    p /= p.sum(0)
    rows = [(k, w, float(p[k, w])) for k in range(topics) for w in range(words)]
    cores = [(k, s, 10 * k + 3 * s) for k in range(topics) for s in range(3)]
    return spark.createDataFrame(rows, "topic int, term_id int, p double").persist(), spark.createDataFrame(cores, "topic int, slot int, term_id int")


def test_transport(spark):
    p, cores = affinity(spark)
    zero = T.transport(p, cores, 0.0).join(p.withColumnRenamed("p", "q"), ["topic", "term_id"])
    assert zero.where("p <> q").count() == 0
    full = T.transport(p, cores).persist()
    sums = full.groupBy("term_id").agg(F.sum("p").alias("s"), F.min("p").alias("least")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.least >= -1e-12 for r in sums)
    shown = {(r.topic, r.term_id) for r in T.top_words(full, "p").collect()}
    assert {(r.topic, r.term_id) for r in cores.collect()} <= shown
    half = T.transport(p, cores, 0.5).agg(F.sum("moved")).first()[0]
    assert abs(half * 2 - full.agg(F.sum("moved")).first()[0]) < 1e-9


def test_transport_search(spark):
    p, cores = affinity(spark, 2)
    got = T.transport_search(p, cores, 2).collect()
    assert len(got) == 8 and all(r.delta >= 0 for r in got)
    whole = T.transport_search(p, cores, 3).agg(F.sum("delta")).first()[0]
    assert sum(r.delta for r in got) <= whole + 1e-9


def test_calibration_restores_moments(spark):
    rng = np.random.default_rng(3)
    native = spark.createDataFrame([(t, float(z)) for t in (0, 1) for z in rng.normal(t, 2, 30)], "term_id int, z double")
    moved = native.withColumn("z", F.col("z") * 3 - F.col("term_id"))
    c = T.moment_calibration(native, moved)
    back = moved.join(c, "term_id").withColumn("z", F.col("a") * F.col("z") + F.col("b"))
    stat = lambda d: {r[0]: (r[1], r[2]) for r in d.groupBy("term_id").agg(F.avg("z"), F.var_pop("z")).collect()}
    a, b = stat(native), stat(back)
    assert all(abs(a[k][0] - b[k][0]) < 1e-9 and abs(a[k][1] - b[k][1]) < 1e-7 for k in a)


def test_soft_top_k_mass(spark):
    p, _ = affinity(spark)
    m = T.soft_top_k(T.rank_scores(p), 5, rounds=50).groupBy("topic").agg(F.sum("m")).collect()
    assert all(abs(r[1] - 5) < 1e-6 for r in m)


def test_signed_rank(spark):
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", x) for x in (0.0, 1.0, 1.0, -1.0, -1.0)] + [("c", 0.0)]
    out = {r.g: r for r in S.signed_rank(spark.createDataFrame(rows, "g string, d double"), "g", "d").collect()}
    assert out["a"].p == 2 / 1024 and out["b"].p == 1.0 and out["b"].zeros == 1 and out["c"].p is None
    assert S.signed_rank(spark.createDataFrame([("c", 0.0)], "g string, d double"), "g", "d", 1.0).first().p == 1.0


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "f string, k string, p double")
    out = {r.k: (r.adjusted, r.reject) for r in S.holm(df, "f", "p", "k").collect()}
    assert {k: (v[0] and round(v[0], 12), v[1]) for k, v in out.items()} == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False), "d": (None, None)}


def test_summaries(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("g", None)], "g string, v double")
    assert tuple(S.summary(df, ["g"], "v").first()) == ("g", 3, 2.0, 1.0, 2.0)
    b = S.bootstrap_mean(df, "g", "v", 1000).first()
    assert b.n == 3 and b.low < 2 < b.high
    c = S.cluster_bootstrap(df.withColumn("i", F.col("v").cast("string")), "g", "i", "v", 300).first()
    assert c["items"] == 3 and c.low < 2 < c.high
    e = spark.createDataFrame([(1, "x", 3.0), (1, "y", 2.0), (2, "x", 5.0), (2, "y", 1.0), (3, "x", 1.0)], "s int, v string, m double")
    assert sorted(tuple(r) for r in S.paired_effects(e, "s", "v", "m", "x", "y", True).collect()) == [(1, 1.0), (2, 4.0)]
    assert sorted(tuple(r) for r in S.paired_effects(e, "s", "v", "m", "x", "y", False).collect()) == [(1, -1.0), (2, -4.0)]


def test_agreement(spark):
    make = lambda rows: spark.createDataFrame(rows, "i string, v int")
    perfect = make([(f"i{k}", k) for k in range(4) for _ in range(3)])
    assert abs(S.krippendorff(perfect, "i", "v", False).first()[0] - 1) < 1e-12 and abs(S.krippendorff(perfect, "i", "v", True).first()[0] - 1) < 1e-12
    assert S.krippendorff(make([("a", 1), ("a", 1), ("b", 1), ("b", 1)]), "i", "v", False).first()[0] is None
    votes = spark.createDataFrame([("x", "safety"), ("x", "safety"), ("x", "comfort"), ("y", "a"), ("y", "b"), ("y", "c")], "i string, v string")
    assert {(r.i, r.choice, r.votes) for r in S.majority(votes, "i", "v").collect()} == {("x", "safety", 2), ("y", "no_consensus", 1)}


def test_gates_and_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0), ("c", 2.0, 4.0)], "m string, x double, y double")
    g = S.gates(df, {"big": F.min("x") > 5, "known": F.count("x") == 3}, {"x": F.avg("x")}).first()
    assert g.failed == ["big"] and not g.eligible
    r = {x.m: (x.x_rank, x.y_rank, x.firsts) for x in S.rank_profile(df, "m", {"x": False, "y": True}).collect()}
    assert r == {"a": (3, 3, 0), "b": (1, 2, 1), "c": (1, 1, 2)}


def test_assignment_and_stability():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s = rng.random((5, 5))
        from itertools import permutations

        best = max(permutations(range(5)), key=lambda p: sum(s[i, j] for i, j in enumerate(p)))
        assert M.assign(s) == list(best)
    assert M.matched_stability([[{1, 2}, {3}], [{3}, {1, 2}]]) == (1.0, 1.0)
    w = [0.5, 0.2, 0.3]
    assert np.allclose(np.asarray(w) @ M.contrast_basis(w), 0)


def test_spectral_prototypes_and_alignment(spark):
    rows = [(8 * k + i, 8 * k + j, 1.0 - 0.01 * (i + j)) for k in range(4) for i in range(8) for j in range(i + 1, 8)] + [(0, 9, 0.01), (10, 20, 0.01), (17, 25, 0.01)]
    cores = M.spectral_prototypes(spark.createDataFrame(rows, "src int, dst int, w double"), 4, 5, 5)
    blocks = {}
    for r in cores.collect():
        blocks.setdefault(r.topic, set()).add(r.term_id // 8)
    assert len(blocks) == 4 and sorted(map(len, blocks.values())) == [1] * 4 and len(set.union(*blocks.values())) == 4
    p = spark.createDataFrame([((r.term_id // 8 + 1) % 4, r.term_id, 1.0) for r in cores.collect()], "topic int, term_id int, p double")
    match = {r.topic: r.core for r in M.align_cores(cores, p, 4).collect()}
    assert all(blocks[c] == {(t - 1) % 4} for t, c in match.items())


def test_models_find_planted_topics(spark):
    rows = [[3, 2, 2, 0, 0, 0] if i % 2 else [0, 0, 0, 2, 3, 2] for i in range(40)]
    cells = cells_of(spark, rows)
    want = {frozenset({0, 1, 2}), frozenset({3, 4, 5})}
    sets = lambda df: {frozenset(r.w) for r in T.top_words(df, "p", 3).groupBy("topic").agg(F.collect_list("term_id").alias("w")).collect()}
    assert sets(M.fit_nmf(cells, 6, 2)) == want
    assert sets(M.fit_lda(cells, 6, 2, 3, 20)[0]) == want
    mix = {frozenset(r.top[:3]) for r in M.fit_gsdmm(cells, 6, 2, 15)[0].collect()}
    assert mix == want
    pairs = spark.createDataFrame([(a, b, 10) for g in ((0, 1, 2), (3, 4, 5)) for a in g for b in g if a < b], "a int, b int, n long")
    assert sets(M.fit_btm(pairs, 6, 2)) == want


def test_nearest_centroid(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None), (4, [1.0, 0.0])], "k int, e array<float>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 4.0]), (2, None), (3, [0.0, 0.0])], "l int, c array<double>")
    assert {r.k: r.l for r in M.nearest_centroid(v, "k", "e", c, "l", "c").collect()} == {1: 0, 2: 1, 4: 0}


def test_graph_queries_take_all_terms(spark, tmp_path):
    """340 terms, more than the 300 that the queries once kept, against brute force."""
    rng = random.Random(6)
    docs = [{rng.choice((rng.randrange(20), rng.randrange(340))) for _ in range(6)} for _ in range(700)]
    rows = [("train", f"d{i}", t, 1) for i, d in enumerate(docs) for t in d] + [("test", "e", 1, 1), ("train", "d0", 999, 1)]
    spark.createDataFrame(rows, "split string, doc_id string, term_id int, cnt long").write.parquet(f"{tmp_path}/counts.parquet")
    spark.createDataFrame([(t, f"t{t}") for t in range(340)], "term_id int, term string").write.parquet(f"{tmp_path}/vocabulary.parquet")
    n, df = len(docs), Counter(t for d in docs for t in d)
    joint = Counter(p for d in docs for p in combinations(sorted(d), 2))
    w = {(a, b): min(max(math.log(j * n / (df[a] * df[b])) / -math.log(j / n), 0), 1) * (j / n) ** 1.25 for (a, b), j in joint.items() if min(df[a], df[b]) >= 2}
    w = {k: x / max(w.values()) for k, x in w.items() if x > 0}
    got = {(r.src, r.dst): r.w for r in corpus_queries.npmi_graph(spark, str(tmp_path)).collect()}
    assert len({t for k in w for t in k}) > 300 and got == pytest.approx(w, abs=1e-8)
    degree = {t: sum(x for k, x in w.items() if t in k) for t in {t for k in w for t in k}}
    assert {r.term_id: r.degree for r in corpus_queries.graph_degree(spark, str(tmp_path)).collect()} == pytest.approx(degree, abs=1e-7)
    top = Counter(r.src for r in corpus_queries.top_edges(spark, str(tmp_path)).collect())
    assert top == {t: min(5, sum(t in k for k in w)) for t in degree}


def test_translation_check_takes_the_whole_vocabulary(spark, tmp_path):
    rows = [(0, "agency", "en"), (59, "stop", "en"), (166, "公交", "zh"), (167, "route", "zh"), (None, "line", None)]
    spark.createDataFrame(rows, "term_id int, term string, lang string").write.parquet(f"{tmp_path}/vocabulary.parquet")
    got = {r.term: (r.expected, r.same) for r in review_queries.translation_check(spark, str(tmp_path)).collect()}
    assert got == {"agency": ("en", True), "stop": (None, False), "公交": ("zh", True), "route": ("en", False), "line": (None, False)}


def test_signed_rank_of_many_pairs(spark):
    """22 pairs with ties against all sign vectors; 24 pairs of one sign."""
    d = [-3, 1, 2, 2, -5, 7, 8, 8, -8, 10, 11, 12, -13, 14, 15, 16, 17, -18, 19, 20, 21, 22]
    size = np.abs(d)
    rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    sums = np.zeros(1)
    for r in rank:
        sums = np.concatenate([sums, sums + r])
    plus, mid = rank[np.array(d) > 0].sum(), rank.sum() / 2
    rows = [("a", float(x)) for x in d] + [("b", float(x)) for x in range(1, 25)]
    got = {r.g: r for r in S.signed_rank(spark.createDataFrame(rows, "g string, d double"), "g", "d").collect()}
    assert got["a"].statistic == plus and got["a"].p == pytest.approx((abs(sums - mid) >= abs(plus - mid)).mean(), abs=1e-12)
    assert got["b"].n == 24 and got["b"].p == pytest.approx(2 / 2**24, rel=1e-9)


def test_effects_take_all_months(spark, tmp_path):
    rows = [(f, f"{2000 + k // 12}-{k % 12 + 1:02d}-05", p + k * s) for k in range(24) for f, p, s in (("A", 9.0, 3.0), ("N", 5.0, 1.0), ("R", 2.0, 0.0))]
    df = spark.createDataFrame(rows, "l_returnflag string, day string, l_extendedprice double")
    df.selectExpr("l_returnflag", "to_date(day) as l_shipdate", "l_extendedprice", "0d as l_discount", "1d as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert stat_queries.paired_effects(spark, str(tmp_path)).count() == 72
    got = {r.contrast: (r["mean"], r["median"], r.p, r.claim) for r in stat_queries.confirmation_statistics(spark, str(tmp_path)).collect()}
    p = round(2 / 2**24, 9)
    assert got == {"A-N": (27.0, 27.0, p, True), "A-R": (41.5, 41.5, p, True), "N-R": (14.5, 14.5, p, True)}


def test_pivot_has_a_column_for_each_city(spark, tmp_path):
    """Each city has the same words in each part, but for Elsewhere, which one post alone has."""
    posts = [(f"d{i}", ("Luoxi", "Port Arden", None)[i % 3]) for i in range(60)] + [("only", "Elsewhere")]
    spark.createDataFrame(posts, "post_id string, city string").selectExpr("*", "'train' as split", "'s' as source", "timestamp'2024-01-01' as published_at").write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame([("train", d, t, 1) for d, _ in posts for t in (1, 2)], "split string, doc_id string, term_id int, cnt long").write.parquet(f"{tmp_path}/counts.parquet")
    spark.createDataFrame([(1,), (2,)], "term_id int").write.parquet(f"{tmp_path}/vocabulary.parquet")
    out = topic_queries.seed_topic_pivot(spark, str(tmp_path))
    assert out.columns == ["seed", "Elsewhere", "Luoxi", "Port Arden", "unknown", "mean"]
    assert {r.seed: (r["Luoxi"], r["Port Arden"], r["unknown"], r["mean"]) for r in out.collect()} == {k: (1.0, 1.0, 1.0, 1.0) for k in range(3)}


def test_rho_0_gains_nothing_on_itself(spark):
    cells = spark.range(0, 60000, 1, 16).select((F.col("id") % 50).cast("int").alias("fold"), (F.col("id") % 3 + 1).alias("cnt"), (F.rand(1) * 0.1 + 1e-6).alias("p"), (F.rand(2) * 0.1 + 1e-6).alias("q"))
    rhos = spark.createDataFrame([(0.0,), (0.5,)], "rho double")
    gains = P.mixture_gains(cells.repartition(16), rhos)
    plan = gains._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1  # the sums of a fold are made once: whatever their order, the anchor is the same number
    got = gains.collect()
    assert len(got) == 100 and {r.gain for r in got if r.rho == 0} == {0.0}
    assert all(r.gain != 0 for r in got if r.rho > 0)


def test_positions_are_whole_over_many_ranges(spark):
    rows = spark.range(0, 300000, 1, 8).select(F.xxhash64("id").alias("key"), F.repeat(F.lit("x"), 30).alias("wide"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a small table has several ranges
    try:
        placed = C.ordinal(rows.groupBy("key").agg(F.max("wide").alias("wide")), "key")
        got = placed.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"), F.count("wide")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (300000, 300000, 0, 299999, 300000)


def test_lda_does_not_hang_on_the_layout(spark):
    cells = cells_of(spark, [[3, 2, 2, 0, 0, 0] if i % 2 else [0, 0, 0, 2, 3, 2] for i in range(40)])
    a, b = ({(r.topic, r.term_id): r.p for r in M.fit_lda(c, 6, 2, 3, 10)[0].collect()} for c in (cells, cells.repartition(7, F.rand(5))))
    assert len(a) == 12 and all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_lda_completion_is_theta_times_beta(spark):
    cells = cells_of(spark, [[3, 2, 2, 0, 0, 1] if i % 2 else [0, 1, 0, 2, 3, 2] for i in range(40)])
    split = P.completion_split(cells).persist()
    beta, theta = M.fit_lda(split.where("observed > 0").select("doc_id", "term_id", F.col("observed").alias("cnt")), 6, 2, 3)
    b, m = {(r.topic, r.term_id): r.p for r in beta.collect()}, {(r.doc_id, r.topic): r.m for r in theta.collect()}
    want = sorted((r.target, sum(m[r.doc_id, k] * b[k, r.term_id] for k in (0, 1))) for r in split.where("target > 0").collect())
    got = sorted((r.cnt, r.p) for r in M.lda_completion(split, 6, 2, 3).collect())
    assert len(got) == len(want) > 40 and np.allclose(got, want, atol=1e-5)


def test_spectral_prototypes_over_many_ranges(spark, monkeypatch):
    """Ranges of a few edges each, in any layout, give the cores that one range gives."""
    rows = [(8 * k + i, 8 * k + j, 1.0 - 0.01 * (i + 2 * j)) for k in range(4) for i in range(8) for j in range(i + 1, 8)] + [(0, 9, 0.01), (10, 20, 0.01), (17, 25, 0.01)]
    edges = spark.createDataFrame(rows, "src int, dst int, w double")
    found = []
    for chunk in (1 << 20, 5):
        monkeypatch.setattr(M, "CHUNK", chunk)
        found.append(sorted(map(tuple, M.spectral_prototypes(edges.repartition(3, F.rand(chunk)), 4, 5, 5).collect())))
    assert found[0] == found[1] and len(found[0]) == 20
