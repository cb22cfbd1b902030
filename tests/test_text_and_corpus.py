"""Scalar functions and corpus operators on hand values."""

import pytest
from pyspark.sql import functions as F

from railcorpus.functions import text as T
from railcorpus.operators import corpus as C
from railcorpus.operators import graph as G


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_tokenizer(spark):
    text = "@[agency name] BUS [line number] isn't late at [location name]!"
    # Two hand cases that any other tokenizer of such posts must give too.
    assert one(spark, T.tokenize, text, None, "") == [["agency", "bus", "route", "late", "location"], None, []]
    assert one(spark, T.tokenize, "HTTPS://example.com RT @user") == [["url", "user"]]
    assert one(spark, T.tokenize, "Ｔｒａｍ &lt;stop&gt; [Train Number] straße ﬁt") == [["tram", "stop", "vehicle", "strasse", "fit"]]


def test_unfold(spark):
    assert one(spark, T.unfold_text, "Ｔom &amp; STRASSE ß", None, "ΣΑΣ", "İ", "a\x1e&lt;", "cafe\u0301 &am", "") == ["tom & strasse ss", None, "σασ", "i̇", "a\x1e<", "café &am", ""]


def test_parsing(spark):
    assert one(spark, T.parse_bool, " TRUE", "0", "x", None) == [True, False, None, None]
    assert one(spark, T.yes_no, " Y ", "no", "maybe") == ["yes", "no", None]
    assert one(spark, T.rating, "4", "4.5", "6", None) == [4, None, None, None]
    assert one(spark, T.has_han, "a中", "abc") == [True, False]
    assert one(spark, T.year_prefix, "2021-01-01", "01-04", None) == ["2021", "unknown", "unknown"]


def test_display(spark):
    assert one(spark, T.display_number, float("nan"), None, 1e-18, -1e-18, 0.123456, kind="double") == ["—", "—", "0.0000", "0.0000", "0.1235"]


def test_json_iterations(spark):
    found = one(spark, T.json_max_iteration, '{"Maximum_Iterations": 5, "num_epochs": 3, "loss": 1, "max_depth": 2, "k": 1}', '{"a": 1}', '{"max_epoch": "many", "max_iteration": 7}', None)
    assert found == [3.0, None, 7.0, None]
    assert one(spark, lambda c: T.json_number(c, "k"), '{"k": 2.5}', '{"a": 1}') == [2.5, None]


COUNTS = [[2, 2, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 2, 2, 0]]


def cells_of(spark, rows):
    return spark.createDataFrame([(f"d{i}", j, c) for i, r in enumerate(rows) for j, c in enumerate(r) if c], "doc_id string, term_id int, cnt long")


def test_counts_and_vocabulary(spark):
    docs = spark.createDataFrame([("1", ["bus", "bus", "late"]), ("2", ["train", "unknown"]), ("3", [])], "doc_id string, tokens array<string>")
    voc = spark.createDataFrame([(0, "bus"), (1, "late"), (2, "train")], "term_id int, term string")
    assert {(r.doc_id, r.term_id): r.cnt for r in C.bag_of_words(docs, voc).collect()} == {("1", 0): 2, ("1", 1): 1, ("2", 2): 1}
    built = C.build_vocabulary(docs, 1, 3).collect()
    assert [(r.term_id, r.term, r.df, r.tf) for r in sorted(built)] == [(0, "bus", 1, 2), (1, "late", 1, 1), (2, "train", 1, 1)]
    cells = C.bag_of_words(docs, voc)
    assert {r.doc_id: r.tokens for r in C.expand_tokens(cells).collect()} == {"1": [0, 0, 1], "2": [2]}
    assert {r.doc_id: r.text for r in C.text_of_tokens(cells, voc).collect()} == {"1": "bus bus late", "2": "train"}


@pytest.mark.parametrize(("n", "k"), [(10, 3), (2, 3), (9, 3), (0, 2)])
def test_blocks_follow_the_remainder_rule(spark, n, k):
    df = spark.range(n).repartition(3)
    got = sorted((r.id, r.block) for r in C.chronological_blocks(df, k, "id").collect())
    want, at = [], 0
    for b in range(k):
        size = n // k + (b < n % k)
        want += [(at + i, b + 1) for i in range(size)]
        at += size
    assert got == want


def test_order_and_parts(spark):
    df = spark.range(20).select((F.lit(40) - F.col("id")).alias("x"))
    rows = C.chronological_split(df, 12, 4, "x").collect()
    assert sorted((r.x, r.position) for r in rows) == [(21 + i, i) for i in range(20)]
    assert [r.part for r in sorted(rows)] == ["train"] * 12 + ["validation"] * 4 + ["test"] * 4
    a, b = spark.range(3).toDF("k"), spark.range(5, 7).toDF("k")
    assert [(r.part, r.k, r.row) for r in sorted(C.union_parts(a, b, "k").collect())] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 5, 3), (1, 6, 4)]
    with pytest.raises(ValueError):
        C.union_parts(a, a, "k")


def test_biterms(spark):
    df = spark.createDataFrame([("1", [1, 2, 1, 3])], "doc_id string, tokens array<int>")
    assert {(r.a, r.b): r.n for r in C.biterms(df, 3).collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}


def test_checks_and_forms(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), ("c", 3, None)], "k string, n int, s string")
    out = {r.check: (r.observed, r.status) for r in C.check_table(df, {"present": F.col("n").isNotNull(), "small": F.col("n") < 9}).collect()}
    assert out == {"present": (1, "FAIL"), "small": (1, "FAIL")}
    other = spark.createDataFrame([("a", 1, "x"), ("c", 3, ""), ("d", 1, "z")], "k string, n int, s string")
    assert {(r.k, r.problem) for r in C.locked_differences(other, df, "k", ["s"]).collect()} == {("b", "missing"), ("d", "added")}
    assert {tuple(r) for r in C.grid_gaps(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"), ["x", "y"]).collect()} == {(1, "b"), (2, "a")}
    assert C.union_columns(df, df.select("k")).count() == 6
    assert [(r.group_key, r.copies) for r in C.duplicate_groups(df.union(df.limit(1)), F.col("k")).collect()] == [("a", 2)]


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("t", F.col("id").cast("string"))
    a, b = C.table_fingerprint(df).first(), C.table_fingerprint(df.select("t", "id").repartition(7)).first()
    assert a == b != C.table_fingerprint(df.where("id > 0")).first()


def test_graph(spark):
    rows = [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1], [1, 0, 1, 0]]
    edges = G.npmi_graph(cells_of(spark, rows), 2, 1).persist()
    got = {(r.src, r.dst): r.w for r in edges.collect()}
    assert set(got) <= {(0, 1), (2, 3), (0, 2)} and max(got.values()) == 1.0 and min(got.values()) > 0
    assert {r.term_id for r in G.degree(edges).collect()} == {x for e in got for x in e}
    assert all(r.rank == 1 for r in G.strongest_edges(edges, 1).collect())
    assert G.npmi_graph(cells_of(spark, rows).limit(0)).count() == 0
    same = {(r.src, r.dst): r.w for r in G.npmi_graph(cells_of(spark, rows).repartition(7), 2, 1).collect()}
    assert same.keys() == got.keys() and all(abs(same[k] - got[k]) < 1e-12 for k in got)
