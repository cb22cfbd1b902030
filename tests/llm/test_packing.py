"""Packing, mixing, token sizes and reading levels."""

import random

import pytest

from railcorpus.llm import mixing, packing, reading, tokens


def plain_first_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 257])
def test_tournament_is_first_fit(n):
    rng = random.Random(n)
    sizes = [rng.randint(1, 60) for _ in range(n)]
    assert packing.first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)


def test_pack_keeps_every_token(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 300)) for i in range(500)] + [(900, 1000), (901, 0), (902, None), (903, 128), (903, 128)]
    df = spark.createDataFrame(rows, "id long, size long")
    out = packing.pack(df, 128, group_items=100).toPandas()
    assert out["size"].sum() == sum(s or 0 for _, s in rows)
    used = out[out.container.notna()]
    assert used.groupby("container")["size"].sum().max() <= 128
    whole = {i for i, s in rows if s and s <= 128}
    assert (used[used.id.isin(whole)].pieces == 1).all()
    assert out[out.id == 900].pieces.iloc[0] == 8 and sorted(out[out.id == 900].start) == list(range(0, 1000, 128))
    assert out[out.id.isin([901, 902])].container.isna().all() and len(out[out.id == 903]) == 2
    same = packing.pack(spark.createDataFrame([(None, 50)] * 400 + [(7, 50)] * 400, "id long, size long"), 128, group_items=100).toPandas()
    assert len(same) == 800 and same.groupby("container")["size"].sum().max() <= 128
    assert same.container.str.split("-").str[0].value_counts().max() < 200  # copies spread over the groups
    r = packing.fill_report(packing.pack(df, 128), 128).first()
    assert r.containers >= r.least_containers and r.fill > 0.9
    assert packing.pack(df.limit(0), 128).count() == 0
    assert packing.fill_report(packing.pack(df.limit(0), 128), 128).first().containers == 0


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A ", "a", "b", "c", None]), rng.randint(1, 50)) for i in range(3000)] + [(9000, "a", None), (9001, "small", 10)]
    docs = spark.createDataFrame(rows, "id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 2), ("small", 0.1, 3), ("none", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixture, made = mixing.mix(docs, targets)
    out = {r.source: r for r in mixing.shares(mixture, made).collect()}
    total = sum(s or 0 for _, _, s in rows)
    assert {k for k, r in out.items() if r.short} == {"small", "none"}
    assert out["small"].reached_tokens == 30 and out["none"].reached_tokens == 0
    assert abs(sum(r.reached_tokens for r in out.values()) - total) <= 100
    assert abs(out["a"].reached_share - 0.75) < 0.01 and out["b"].reached_share - 0.25 < 0.01
    limit = {"a": 3, "b": 2, "small": 3}
    assert all(r.copies <= limit[r.source] for r in mixture.collect())
    again = mixing.mix(docs.repartition(7), targets)[0]
    assert mixture.exceptAll(again).count() == 0 == again.exceptAll(mixture).count()


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "id long, source string, size long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixture, made = mixing.mix(docs, targets)
    assert mixture.count() == 0 and mixing.shares(mixture, made).first().reached_tokens == 0
    mixture, made = mixing.mix(docs, targets.limit(0))
    assert mixture.count() == 0 and mixing.shares(mixture, made).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (4, "<|endoftext|> 中文" * 2000, "z")], "id int, text string, size string")
    out = {r.id: (r.tokens, r.size) for r in tokens.token_sizes(df, "text").collect()}
    enc = tokens.encoding(tokens.RANKS, tokens.default_pattern())
    assert out[1] == (2, "x") and out[2] == (0, "y") and out[3] == (0, None) and out[4][0] == len(enc.encode_ordinary("<|endoftext|> 中文" * 2000))
    with pytest.raises(ValueError):
        tokens.token_sizes(df, "text", "size")


def graded(spark, n=240):
    rng = random.Random(8)
    words = {1: "dog cat sun red big".split(), 2: "tram stop late rain walked".split(), 3: "council budget timetable maintenance regional".split(), 4: "heterogeneity elasticities procurement counterfactual amortisation".split()}
    rows = []
    for i in range(n):
        level = i % 4 + 1
        pool = words[level] * 4 + words[max(1, level - 1)]
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(12, 60))), level))
    return rows


def test_reading_levels(spark):
    rows = graded(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r1", v) for i, _, v in rows if i % 3 == 0] + [(0, "r2", None), (None, "r1", 1), (3, "r2", 9)], "doc_id long, rater string, level int")
    out = {r.doc_id: r for r in reading.reading_levels(docs, labels).collect()}
    held = [(out[i].level, v) for i, _, v in rows if i % 3]
    assert sum(round(p) == v for p, v in held) >= 0.95 * len(held)
    assert out[900].level is None and out[901].tokens == 0 and out[902].score is None
    none = reading.reading_levels(docs, labels.limit(0))
    assert none.where("level is not null").count() == 0
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_least_squares_fit():
    import numpy as np

    x, y, w = np.arange(6.0), np.array([1, 3, 2, 2, 5, 4.0]), np.array([1, 1, 1, 2, 1, 1.0])
    fit = reading.isotonic(x, y, w)
    assert (np.diff(fit) >= 0).all()
    assert np.allclose(fit, [1, 2.25, 2.25, 2.25, 4.5, 4.5])

