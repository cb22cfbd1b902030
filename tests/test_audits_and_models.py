"""Audits, panels, contracts, fingerprints and the newer model parts on small cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from railcorpus.functions import text as X
from railcorpus.operators import corpus as C
from railcorpus.operators import models as M
from railcorpus.operators import priors as P
from railcorpus.operators import review as R
from railcorpus.operators import stats as S
from railcorpus.operators import topics as T
from railcorpus.sources import files
from tests.test_text_and_corpus import cells_of


def test_fingerprint_counts_equal_rows(spark):
    make = lambda rows, schema="a string, h int": C.table_fingerprint(spark.createDataFrame(rows, schema)).first()
    twice, other = make([("a", 1), ("a", 1)]), make([("b", 1), ("b", 1)])
    assert twice.rows == 2 and twice != other != make([("b", 1)])
    assert make([("x", 1)]) != make([("y", 1)])  # a column called h is one like any other
    assert make([(None, 1)]) != make([("1", None)]) and make([], "a string") != make([], "b string")
    assert make([("a", 1), ("b", 2)]) == make([("b", 2), ("a", 1)])


def test_strict_timestamps(spark):
    df = spark.createDataFrame([("2021-01-02",), ("2020-03-01",)], "d string")
    out = C.strict_timestamps(df, "d", "yyyy-MM-dd").first()
    assert (out.rows, str(out.first_ts), str(out.last_ts), out.status) == (2, "2020-03-01 00:00:00", "2021-01-02 00:00:00", "PASS")
    assert C.strict_timestamps(df, "d", "yyyy-MM-dd", "2020-03-01", "2021-01-03").first().status == "FAIL"
    for broken in ("2021-13-01", "", None):
        with pytest.raises(Exception, match="no timestamp"):
            C.strict_timestamps(spark.createDataFrame([(broken,)], "d string"), "d", "yyyy-MM-dd").collect()
    assert C.strict_timestamps(df.limit(0), "d", "yyyy-MM-dd").first().rows == 0


def test_date_consistency(spark):
    rows = [("2021-03-05", 2021, "March"), ("2021-03-05", 2021, "MARCH"), ("2021-03-05", 2020, "April"), (None, 2020, "May"), ("2021-03-05", None, None)]
    df = spark.createDataFrame(rows, "t string, y int, m string").withColumn("t", F.to_timestamp("t"))
    got = {r.year: (r.posts, r.year_agrees, r.month_agrees) for r in C.date_consistency(df, "t", "y", "m").collect()}
    assert got == {2021: (2, 2, 2), 2020: (2, 0, 0), None: (1, 0, 0)}


def test_own_stop_list_and_substitutions(spark):
    df = spark.createDataFrame([("The BUS isn't at x&amp;y [bus number]",)], "t string")
    got = df.select(X.tokenize(F.col("t"), False), X.tokenize(F.col("t"), ["bus"]), X.tokenize(F.col("t"), True, [("bus", "tram")], 1)).first()
    assert got[0] == ["the", "bus", "isnt", "at", "vehicle"] and got[1] == ["the", "isnt", "at", "vehicle"] and got[2] == ["tram", "x", "y", "tram", "number"]


def test_row_contract(spark):
    good = spark.createDataFrame([(0, "a", "train"), (1, "b", "train"), (2, "c", "train")], "matrix_row int, post_id string, split string")
    status = lambda d: {r.check: (r.observed, r.status) for r in files.row_contract(d, "matrix_row", "post_id", {"split": "train"}).collect()}
    assert set(status(good).values()) == {(0, "PASS")} and set(status(good.limit(0)).values()) == {(0, "PASS")}
    bad = spark.createDataFrame([(0, "a", "train"), (0, "a", "test"), (5, None, None)], good.schema)
    assert status(bad) == {"contiguous": (2, "FAIL"), "unique_key": (2, "FAIL"), "constant_split": (2, "FAIL")}


def test_manifest_keeps_folders_apart(spark, tmp_path):
    for folder, text in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(text)
    listed = files.manifest(spark, str(tmp_path)).persist()
    assert {r.path for r in listed.collect()} == {"a/x.txt", "b/x.txt"} and files.manifest_problems(listed, listed).count() == 0
    listed.count()
    (tmp_path / "b" / "x.txt").write_text("33")
    now = files.manifest(spark, str(tmp_path), ["b"])
    assert {tuple(r) for r in files.manifest_problems(listed, now).collect()} == {("a/x.txt", "missing"), ("b/x.txt", "changed")}


def test_inventories(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    assert files.inventory_difference(make("a", None), make(None, "a"), "k").count() == 0
    assert {tuple(r) for r in files.inventory_difference(make("a", "b", "b", None), make("b", "c"), "k").collect()} == {("a", "missing"), ("b", "repeated"), ("c", "unlisted"), (None, "missing")}


def test_zip_member_hash_and_header(spark, tmp_path):
    import hashlib
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "a,b\n1,x\n")
    read = lambda **k: files.read_zipped_csv(spark, str(tmp_path / "a.zip"), "a.csv", ["a"], **k).collect()
    assert [r.a for r in read(member_sha256=hashlib.sha256(b"a,b\n1,x\n").hexdigest(), header=["b", "a"])] == ["1"]
    for wrong in ({"member_sha256": "00"}, {"header": ["a"]}):
        with pytest.raises(Exception, match="member|header"):
            read(**wrong)


def test_freeze(spark, tmp_path):
    folder = str(tmp_path / "f")
    assert R.freeze(spark.range(3), folder).count() == 3 and R.freeze(spark.range(9), folder).count() == 3
    spark.range(4).write.mode("overwrite").parquet(f"{folder}/rows")
    with pytest.raises(ValueError):
        R.freeze(spark.range(3), folder)
    half = str(tmp_path / "half")
    spark.range(7).write.parquet(f"{half}/rows")  # written, but not marked
    assert R.freeze(spark.range(3), half).count() == 3


def test_ledger_registry_grid_and_permutation(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    led = R.access_ledger(make([("a",), ("a",), ("b",)], "artifact string"), make([("b",), ("c",)], "artifact string"))
    assert {tuple(r) for r in led.collect()} == {("a", "read", 2), ("b", "violation", 1), ("c", "prohibited", 0)}
    variants = [("full", True, True, True), ("no_graph", False, True, True), ("parent", False, False, False)]
    reg = R.variant_registry(make(variants, "variant string, graph boolean, pooled boolean, calibrated boolean"), 8, 0.35, "moment")
    assert {tuple(r) for r in reg.collect()} == {("full", 8, 0.35, "moment"), ("no_graph", 0, 0.35, "none"), ("parent", 0, 0.0, "none")}
    with pytest.raises(ValueError):
        R.variant_registry(make(variants * 2, "variant string, graph boolean, pooled boolean, calibrated boolean"), 8, 0.35, "moment")
    grid = R.case_grid_audit(make([("t", "x"), ("t", "y"), ("u", "x"), ("u", "x"), (None, "x")], "a string, b string"), "a", "b")
    assert {tuple(r) for r in grid.collect()} == {("t", "x", 1, "PASS"), ("t", "y", 1, "PASS"), ("u", "x", 2, "FAIL"), ("u", "y", 0, "FAIL")}
    items = make([(g, k) for g in ("a", None) for k in range(20)], "g string, k int")
    one = {(r.g, r.k): r.place for r in R.seeded_permutation(items, "g", "k", "s").collect()}
    again = {(r.g, r.k): r.place for r in R.seeded_permutation(items.repartition(5), "g", "k", "s").collect()}
    assert one == again and all(sorted(one[g, k] for k in range(20)) == list(range(20)) for g in ("a", None)) and [one["a", k] for k in range(20)] != list(range(20))
    assert set(R.training_view(make([("d", 1, "x")], "doc_id string, cnt int, city string")).columns) == {"doc_id", "cnt"}


def test_comparators_share_one_signature(spark):
    rows = [[3, 2, 2, 0, 0, 0] if i % 2 else [0, 0, 0, 2, 3, 2] for i in range(40)]
    cells = cells_of(spark, rows).withColumn("city", F.lit("x"))
    for name, fit in R.comparators().items():
        out = fit(cells, 6, 2, 3)
        sums = [r[1] for r in out.groupBy("topic").agg(F.sum("p")).collect()]
        assert len(sums) == 2 and all(abs(s - 1) < 1e-6 for s in sums), name


def test_models_refuse_terms_past_the_vocabulary(spark):
    with pytest.raises(Exception, match="no term of the vocabulary"):
        M.fit_nmf(cells_of(spark, [[1, 1, 1]]), 2, 2, 1)


def test_gsdmm_assigns_every_document(spark):
    rows = [[1, 1, 1, 0, 0, 0] if i % 2 else [0, 0, 0, 1, 1, 1] for i in range(60)]
    cells = cells_of(spark, rows)
    a = {r.doc_id: r.topic for r in M.fit_gsdmm(cells, 6, 2, 15)[1].collect()}
    b = {r.doc_id: r.topic for r in M.fit_gsdmm(cells.repartition(7), 6, 2, 15)[1].collect()}
    assert a == b and len(a) == 60 and len({a["d0"], a["d1"]}) == 2 and len({a[f"d{i}"] for i in range(0, 60, 2)}) == 1


def test_subspace_iteration_is_the_eigensolver(spark):
    """The cores of two loosely tied halves with known strengths."""
    rng = random.Random(4)
    edges = [(a, b, 0.5 + rng.random() / 2) for h in (0, 20) for a in range(h, h + 20) for b in range(a + 1, h + 20)] + [(3, 25, 0.05)]
    cores = M.spectral_prototypes(spark.createDataFrame(edges, "src int, dst int, w double"), 2, 5)
    got = {}
    for r in cores.orderBy("slot").collect():
        got.setdefault(r.term_id // 20, []).append(r.term_id)
    for h, core in got.items():
        w = {}
        for a, b, x in edges:
            if a // 20 == b // 20 == h:
                w[a, b] = w[b, a] = x
        inner = {t: sum(w.get((t, u), 0) for u in range(20 * h, 20 * h + 20)) for t in range(20 * h, 20 * h + 20)}
        top = max(inner.values())
        want = [max(inner, key=inner.get)]
        while len(want) < 5:
            want.append(max((t for t in inner if t not in want), key=lambda t: sum(w.get((t, c), 0) for c in want) / len(want) + 0.5 * inner[t] / top))
        assert core == want
    assert len(got) == 2


def test_distance_affinity(spark):
    topics = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "topic int, embedding array<double>")
    words = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "term_id int, embedding array<double>")
    z = {r.topic: r.z for r in M.affinity_logits(topics, words, 0.5).collect()}
    assert z == {0: -2.0, 1: -4.0}
    p = {r.topic: r.p for r in T.softmax_affinity(M.affinity_logits(topics, words, 0.5)).collect()}
    assert abs(p[0] - 1 / (1 + math.exp(-2))) < 1e-12 and abs(sum(p.values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        M.affinity_logits(topics, words, 0.0)


def test_term_vectors(spark):
    rows = [[1, 1, 0, 0] if i % 2 else [0, 0, 1, 1] for i in range(40)]
    v = {r.term_id: np.array(r.embedding) for r in M.term_vectors(cells_of(spark, rows), 100).collect()}
    assert all(len(x) == 100 and abs(np.linalg.norm(x) - 1) < 1e-12 for x in v.values())
    assert v[0] @ v[1] > 0.99 and abs(v[0] @ v[2]) < 0.6


def test_objective(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    nll = make([(10, 2.0)], "tokens long, nll double")
    residual = make([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], "stratum string, topic int, x double")
    share, gates = make([("a", 1.0), ("b", 3.0)], "stratum string, w double"), make([(0, 0.2), (1, 0.4)], "topic int, gate double")
    lexical = make([(0, 1.0), (1, 2.0)], "topic int, loss double")
    out = T.objective(nll, residual, share, gates, lexical, (0.5, 0.1, 2.0)).first()
    assert (out.pooling, round(out.gate, 12), out.lexical) == ((1 * 5 + 3 * 4) / 4, 0.3, 1.5)
    assert abs(out.total - (2 + 0.5 * 4.25 + 0.1 * 0.3 + 2 * 1.5)) < 1e-12
    assert T.objective(nll, residual.limit(0), share, gates, lexical, (0.5, 0.0, 0.0)).first().total == 2.0


def test_association_loss(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0)], "topic int, term_id int, m double")
    e = spark.createDataFrame([(1, 2, 0.5)], "src int, dst int, w double")
    out = {r.topic: (r.association, r.loss) for r in T.association(m, e).collect()}
    assert out[0][0] == 0.5 and abs(out[0][1] + math.log(0.5)) < 1e-9 and out[1][0] == 0.0 and abs(out[1][1] + math.log(1e-12)) < 1e-9


def test_diagnostics_and_panels(spark):
    runs = spark.createDataFrame([("a", 1.0, True, "cpu"), ("a", 3.0, None, "gpu"), ("b", None, False, None)], "m string, s double, ok boolean, d string")
    got = {r.m: (r.runs, r["mean"], r.converged, r.devices) for r in S.run_diagnostics(runs, "m", "s", F.col("ok"), "d").collect()}
    assert got == {"a": (2, 2.0, 1, ["cpu", "gpu"]), "b": (1, None, 0, [])}
    rows = spark.createDataFrame([("v", 1, 1.0), ("v", 2, float("nan")), ("w", 1, float("inf")), ("w", 9, 2.0)], "v string, s int, x double")
    out = {r.variant: (r.least, r.most, r.bad, r.seeds, r.whole) for r in S.final_diagnostics(rows, "v", "s", ["x"], spark.createDataFrame([(1,), (2,)], "s int")).collect()}
    assert out == {"v": (1.0, 1.0, 1, 2, True), "w": (2.0, 2.0, 1, 2, False)}
    ratings = spark.createDataFrame([("m", f"i{k}", k % 5 + 1) for k in range(20) for _ in range(3)] + [("m", "i0", None)], "m string, i string, v int")
    p = S.panel(ratings, "m", "i", "v", F.col("v") >= 4, 300).first()
    assert (p["items"], p.ratings, p.numerator, p.denominator, p.rate, p["mean"]) == (20, 60, 24, 60, 0.4, 3.0) and p.low < 3 < p.high
    rel = {r.outcome: (r.reported, r.estimable) for r in S.reliability(ratings.withColumn("one", F.lit(1)), "i", [("v", True), ("one", False)]).collect()}
    assert rel == {"v": ("1.000", True), "one": ("N/E", False)}


def test_bootstrap_does_not_hang_on_the_layout(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(None if k % 7 == 0 else "g", rng.random()) for k in range(300)] + [("h", None)], "g string, v double")
    a = sorted((str(r.g), r.n, r.low, r.high) for r in S.bootstrap_mean(df, "g", "v", 500).collect())
    b = sorted((str(r.g), r.n, r.low, r.high) for r in S.bootstrap_mean(df.repartition(9), "g", "v", 500).collect())
    assert [x[:2] for x in a] == [("None", 43), ("g", 257)] and np.allclose([x[2:] for x in a], [x[2:] for x in b])
    mean = df.where("g = 'g'").agg(F.avg("v"), F.stddev("v")).first()
    assert a[1][2] < mean[0] < a[1][3] and abs((a[1][3] - a[1][2]) - 2 * 1.96 * mean[1] / 257**0.5) < 0.02


def plain_quotas(load, size, count):
    load, out = list(load), [0] * len(load)
    for _ in range(count):
        f = load.index(min(load))
        load[f] += size
        out[f] += 1
    return out


def test_quotas_are_the_greedy_rule():
    rng = random.Random(1)
    for _ in range(300):
        load, size, count = [rng.randrange(30) for _ in range(rng.randint(1, 6))], rng.randint(1, 9), rng.randrange(40)
        assert P._quotas(load, size, count) == plain_quotas(load, size, count)
    assert P._quotas([0, 10**9], 1, 3) == [3, 0]


def test_group_folds_of_a_hot_stratum(spark):
    rows = [("s", f"g{i}") for i in range(500)] + [("s", "big")] * 60 + [("t", "x")] * 3
    out = P.group_folds(spark.createDataFrame(rows, "stratum string, group_key string"), 5).collect()
    assert len(out) == 502
    load = [sum(r["size"] for r in out if r.stratum == "s" and r.fold == f) for f in range(5)]
    assert max(load) - min(load) <= 1 and sum(load) == 560


def test_prototype_lexical_terms(spark):
    """Against plain matrices."""
    rng = np.random.default_rng(5)
    topics, words, k, temp = 3, 14, 4, 0.1
    p = rng.random((topics, words))
    p /= p.sum(0)
    g = np.triu((rng.random((words, words)) < 0.3) * rng.random((words, words)), 1)
    g[:, 13] = g[13] = 0
    z = rng.normal(size=(topics, words))
    core = [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 0]]
    long = lambda a, n: spark.createDataFrame([(i, j, float(a[i, j])) for i in range(topics) for j in range(words)], f"topic int, term_id int, {n} double")
    edges = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(words) for j in range(words) if g[i, j]], "src int, dst int, w double")
    cores = spark.createDataFrame([(i, s, t) for i, c in enumerate(core) for s, t in enumerate(c)], "topic int, slot int, term_id int")
    out = R.prototype_lexical(long(p, "p"), edges, long(z, "z"), cores, k, temp, 0.2, 1.5, (0.5, 2.0, 3.0, 0.25)).first()
    q = np.log(p / p.sum(1, keepdims=True))
    c = q - q.mean(1, keepdims=True)
    score = c / np.sqrt((c * c).mean(1, keepdims=True) + 1e-12)
    m = np.zeros_like(score)
    for i in range(topics):
        lo, hi = score[i].min() - 1, score[i].max() + 1
        for _ in range(80):
            mid = (lo + hi) / 2
            m[i] = 1 / (1 + np.exp(-(score[i] - mid) / temp))
            lo, hi = (mid, hi) if m[i].sum() > k else (lo, mid)
    g = g + g.T
    assoc = -np.log(np.einsum("ki,ij,kj->k", m, g, m) / (m.sum(1) ** 2 - (m * m).sum(1)) + 1e-12).mean()
    over = (m / m.sum(1, keepdims=True)) @ m.T
    over = (over.sum() - np.trace(over)) / (topics * (topics - 1))
    margin = np.mean([[max(0, max(score[i][w] for w in range(words) if w not in core[i]) + 0.2 - score[i][t]) for t in core[i]] for i in range(topics)])
    loose = m[:, g.sum(1) == 0].sum() / (topics * k)
    energy = (((z - z.mean(0)) / 1.5) ** 2).mean()
    shown = np.argsort(-score, axis=1, kind="stable")[:, :k]
    assert np.allclose([out.association_loss, out.overlap, out.prototype_margin, out.unsupported_mass, out.residual_energy], [assoc, over, margin, loose, energy], atol=1e-6)
    assert abs(out.total - (assoc + 0.5 * over + 2 * margin + 3 * loose + 0.25 * energy)) < 1e-6
    assert out.duplicate_slots == k * topics - len(set(shown.ravel().tolist()))
    assert abs(out.core_recall - np.mean([[t in shown[i] for t in core[i]] for i in range(topics)])) < 1e-12


def test_packets_and_envelopes(spark):
    items = spark.createDataFrame([(f"t{k}", f"w{k} x", k % 2 == 0) for k in range(12)], "topic string, words string, good boolean")
    form, answers = R.packet(items, "topic", ["words"], ["good"], "s")
    assert form.columns == ["item_id", "words"] and answers.columns == ["item_id", "topic", "good"]
    ids = [r.item_id for r in form.orderBy("item_id").collect()]
    assert ids == [f"item_{k:04d}" for k in range(1, 13)] and [r.words for r in form.orderBy("item_id").collect()] != [f"w{k} x" for k in range(12)]
    rated = form.withColumn("rater", F.explode(F.array(F.lit("a"), F.lit("b"))))
    out = R.scored(rated, form, answers, ["words"])
    assert out.count() == 24 and out.where("words <> concat('w', substr(topic, 2), ' x')").count() == 0
    for broken in (rated.where("item_id <> 'item_0001'"), rated.withColumn("item_id", F.concat("item_id", F.lit("x"))), rated.withColumn("words", F.lit("other"))):
        with pytest.raises(ValueError):
            R.scored(broken, form, answers, ["words"])
    record = R.envelope({"stage": "ratings"}, form=form, answers=answers)
    assert R.open_envelope(record, form=form, answers=answers) == {"stage": "ratings"}
    for wrong in ({"form": form}, {"form": form.limit(3), "answers": answers}):
        with pytest.raises(ValueError):
            R.open_envelope(record, **wrong)
    with pytest.raises(ValueError):
        R.open_envelope({**record, "stage": "other"}, form=form, answers=answers)


def test_partition_contract(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    run = lambda d, c, v: {r.check: r.observed for r in C.partition_contract(make(d, "doc_id string, stratum string"), make(c, "doc_id string, term_id int, cnt long"), ["x", "y"], make(v, "doc_id string")).collect()}
    assert set(run([("a", "x"), ("b", "y")], [("a", 1, 1), ("b", 1, 2)], [("z",), (None,)]).values()) == {0} == set(run([], [], []).values())
    bad = run([("a", "x"), ("a", "x"), (None, "y"), ("c", "q"), ("d", None)], [("a", 1, 0), ("a", 2, None), ("e", 1, 1), ("c", 1, 1)], [("c",)])
    assert bad == {"id_present": 1, "id_unique": 1, "stratum_expected": 2, "not_empty": 2, "not_in_development": 1, "count_whole": 2, "cell_has_document": 1}


def test_stratum_variants(spark):
    v = spark.range(1).select(T.stratum_variants(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.8), 0.5)).first()[0]
    assert {k: round(x, 12) for k, x in v.items()} == {"graph_stratum": 0.3, "stratum": 0.25, "graph": 0.2, "graph_pooled": 0.5, "parent": 0.1}
