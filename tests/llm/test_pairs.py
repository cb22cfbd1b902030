"""Near-duplicates, overlaps, co-occurrence and clusters against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from railcorpus.llm import cooccur, density, leakage, neardup, queries
from railcorpus.llm.components import components, follow
from tests.llm.test_text import plain_shingles

WORDS = [f"w{i}" for i in range(400)]
NEAR = {"threshold": 0.6, "width": 3, "least": 8}


def edited_posts(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(4, 40))]
        for k in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append((f"p{i:03d}_{k}", " ".join(text), rng.choice(["train", "test"])))
    rows += [("c1", rows[0][1], "train"), ("c2", rows[0][1].upper(), "test"), rows[3], ("e1", None, "train"), ("e2", "", "test"), ("e3", "short text", "train"), ("long", " ".join(WORDS * 30), "train")]
    return rows


def brute(rows, t=0.6):
    sets = {i: plain_shingles(x, 3, 8) for i, x, _ in rows if x}
    sets = {i: s for i, s in sets.items() if s}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize("tile_log2", [13, 1])
def test_near_pairs_are_exact(spark, tile_log2):
    rows = edited_posts(tile_log2)
    df = spark.createDataFrame(rows, "id string, text string, split string").repartition(3)
    near, held = neardup.near_sets(df.select("id", "text"), **NEAR, tile_log2=tile_log2)
    got = {(r.post_a, r.post_b) for r in neardup.near_pairs(near, held).collect()}
    assert got == brute(rows)
    few = {(r.post_a, r.post_b) for r in neardup.near_pairs(near, held, most_copies=1).collect()}
    assert few <= got
    groups = {r.post_id: r.group_id for r in neardup.near_groups(near, held).collect()}
    parent = {x: x for pair in got for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {x: root(x) for x in parent}


def test_hot_blocks_lose_nothing(spark):
    """A third of the posts are edits of one text, and a frequent shingle's block is cut into tiles."""
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(30)]
    rows = []
    for i in range(150):
        text = list(base)
        text[rng.randrange(30)] = f"x{i}"
        rows.append((f"h{i:03d}", " ".join(text), "train"))
    rows += edited_posts(9, 40)
    df = spark.createDataFrame(rows, "id string, text string, split string")
    fine, _, posts = neardup.rarity_tables(df, 3, 8)
    assert fine.max() >= 100 and posts == sum(bool(plain_shingles(x, 3, 8)) for _, x, _ in rows if x)
    near, held = neardup.near_sets(df.select("id", "text"), **NEAR, tile_log2=0)
    assert {(r.post_a, r.post_b) for r in neardup.near_pairs(near, held).collect()} == brute(rows)


def test_overlaps_across_splits(spark):
    rows = edited_posts(3, 120)
    df = spark.createDataFrame(rows, "id string, text string, split string")
    df = df.withColumn("is_train", F.col("split") == "train")
    near, held = leakage.overlaps(df, **NEAR, extra=("split",))
    got = {(r.post_a, r.post_b) for r in leakage.cross_pairs(near, held).collect()}
    side = {i: s for i, _, s in rows}
    want = {(a, b) if side[a] == "train" else (b, a) for a, b in brute(rows) if side[a] != side[b]}
    assert got <= want and len(got) >= 0.98 * len(want)
    for some in (df.where("is_train"), df.where("not is_train"), df.limit(0), df.withColumn("is_train", F.lit(None).cast("boolean"))):
        assert leakage.cross_pairs(*leakage.overlaps(some, **NEAR, extra=("split",))).count() == 0


def test_found_overlaps_name_the_smaller_post_first(spark, tmp_path):
    """Post b of the train split is near-same to a of the test split, and c of the train split to d of the validation split."""
    text = " ".join(WORDS[:30])
    other = " ".join(WORDS[50:80])
    rows = [("b", text, "train", "s"), ("a", text, "test", "s"), ("c", other, "train", "s"), ("d", other + " end", "validation", "t"), ("d", other + " end", "validation", "t")]
    spark.createDataFrame(rows, "post_id string, delexicalized_text string, split string, source string").write.parquet(f"{tmp_path}/posts.parquet")
    spark.createDataFrame([("test", "s", 5, "x")], "split string, source string, train_overlap long, status string").write.parquet(f"{tmp_path}/leakage_report.parquet")
    assert {tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()} == {("a", "b"), ("c", "d")}
    report = {(r.split, r.source): (r.pairs, r.posts, r.train_overlap) for r in queries.p4_report(spark, str(tmp_path)).collect()}
    assert report == {("test", "s"): (1, 1, 5), ("validation", "t"): (1, 1, None)}


def test_seen_forgets_but_never_invents():
    seen = neardup.Seen(2)
    a = np.array([1, 5, 1, 9], np.uint64)  # one slot for 1, 5 and 9
    assert seen.fresh(a).tolist() == [True, True, False, True]
    assert seen.fresh(np.array([9, 1, 2], np.uint64)).tolist()[2]
    assert neardup.Seen(8).fresh(a).tolist() == [True, True, False, True]


def test_overlaps_of_many_copies(spark):
    """More than 1,000 copies on a side, near-same and equal; t2 has two texts that both link it to the copies."""
    base = " ".join(WORDS[:40])
    edit, other = base.replace("w39", "x"), base.replace("w0 ", "y ")
    rows = [("t1", base, "train", "p"), ("t2", base, "train", "p"), ("t2", other, "train", "p"), ("t3", edit, "train", "p")]
    rows += [(f"v{i:04d}", edit, ("test", "validation")[i % 2], ("q", None, "r")[i % 3]) for i in range(1005)] + [("e", base, "test", "q")]
    df = spark.createDataFrame(rows, "id string, text string, split string, source string")
    near, held = leakage.overlaps(df.withColumn("is_train", F.col("split") == "train"), **NEAR, extra=("split", "source"))
    pairs = leakage.cross_pairs(near, held).collect()
    found = Counter((r.post_a, r.post_b) for r in pairs)
    assert found == Counter((a, r[0]) for a in ("t1", "t2", "t3") for r in rows[4:])
    want = {k: (n, n // 3) for k, n in Counter((r.split, r.source) for r in pairs).items()}
    got = leakage.overlap_counts(near, held, ("split", "source")).collect()
    assert len(got) == 6 and {(r.split, r.source): (r.pairs, r.posts) for r in got} == want


def test_near_pairs_of_nothing(spark):
    for rows in ([], [("a", None)], [("a", "one two")]):
        df = spark.createDataFrame(rows, "id string, text string")
        near, held = neardup.near_sets(df, **NEAR)
        assert neardup.near_pairs(near, held).count() == 0 and neardup.near_groups(near, held).count() == 0


def count_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, term_id int, cnt long, n string, salt string")


def test_pairs_and_frequencies(spark):
    rng = random.Random(2)
    baskets = {f"d{i}": {rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(5)} for i in range(80)}
    rows = [(d, t, rng.randint(1, 3), "x", "y") for d, ts in baskets.items() for t in ts]
    rows += rows[:10] + [("d0", None, 1, None, None), (None, 1, 1, None, None), ("d1", 99, 1, "", ""), ("d2", 1, 0, "", ""), ("d3", 2, None, "", "")]
    voc = spark.createDataFrame([(t, f"t{t}") for t in range(1, 11)] + [(1, "t1"), (None, "z")], "term_id int, term string")
    items = cooccur.distinct_items(count_rows(spark, rows), voc)
    n, df = len(baskets), {t: sum(t in b for b in baskets.values()) for t in range(1, 11)}
    want = {}
    for a, b in combinations(range(1, 10), 2):
        j = sum(a in x and b in x for x in baskets.values())
        if j >= 2:
            want[a, b] = (j, 1.0 if j == n else math.log(j * n / (df[a] * df[b])) / -math.log(j / n))
    got = {(r.term_a, r.term_b): (r.joint, r.npmi) for r in cooccur.item_pairs(items, 2).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    for t in (0.05, 0.3):
        got = {(r.term_a, r.term_b) for r in cooccur.item_pairs(items, 2, t).collect()}
        assert got == {k for k, v in want.items() if v[1] >= t}
    freq = {r.term_id: (r.documents, r.mark) for r in cooccur.term_frequencies(items, voc).collect()}
    assert {t: d for t, (d, _) in freq.items()} == df
    assert freq[10] == (0, "rare") and freq[1][1] == "common"
    nothing = cooccur.distinct_items(count_rows(spark, []), voc)
    assert cooccur.item_pairs(nothing).count() == 0 and cooccur.term_frequencies(nothing, voc).count() == 10


def test_density_groups(spark):
    rng = np.random.default_rng(4)
    rows, key = [], 0
    for size in (40, 7, 2, 2, 1, 1):
        centre = rng.normal(size=16)
        for _ in range(size):
            rows.append((key, (centre + 0.05 * rng.normal(size=16)).astype(float).tolist(), "n"))
            key += 1
    rows += [(0, rows[0][1], "n"), (900, None, "n"), (901, [0.0] * 16, "n"), (902, [float("nan")] * 16, "n"), (903, [1.0] * 3, None), (None, rows[0][1], "n")]
    df = spark.createDataFrame(rows, "term_id int, embedding array<float>, peak string")
    for tile in (8192, 5):
        got = {r.key: (r.group_key, r.density) for r in density.density_peaks(df, "term_id", "embedding", dims=16, tile=tile).collect()}
        x = np.array([r[1] for r in rows[:key]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.8) & ~np.eye(key, dtype=bool)
        assert set(got) == set(np.flatnonzero(near.any(1)))
        for i, (g, rho) in got.items():
            assert rho == near[i].sum() and g == min([i, *np.flatnonzero(near[i])])
    groups = density.density_peaks(df, "term_id", "embedding", dims=16)
    out = density.describe(groups, df.selectExpr("cast(term_id as long) as key", "cast(term_id as string) as name")).collect()
    assert sorted(r.members for r in out) == [2, 2, 7, 40] and all(len(r.typical) == min(5, r.members) for r in out)
    assert density.density_peaks(df.limit(0), "term_id", "embedding", dims=16).count() == 0


def test_chained_groups_merge(spark):
    """Links may join records that are far apart: one group, several peaks."""
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(np.arange(0, 2.5, 0.12))]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = density.density_peaks(df, "id", "v", threshold=0.99, dims=2)
    assert {r.group_key for r in got.collect()} == {0} and got.count() == len(rows)


def test_components_and_pointers(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 10), (10, 11), (11, 12), (12, 13), (13, 9), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 10: 9, 11: 9, 12: 9, 13: 9}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(40)], "node long, to long")
    assert {r.root for r in follow(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        follow(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "node long, to long"), rounds=4)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), rounds=1)

