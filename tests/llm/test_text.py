"""Consistent form, shingles, token sizes and personal information against plain Python."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railcorpus.llm import lookalike, pii, textform

LATIN = st.text(alphabet="abAB eéñ áÅ ̧̣́̈1０Ａカガ゙가각각ệế中⼈", max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(LATIN, max_size=6))
def test_form_is_compatibility_composition(texts):
    assert textform.consistent(pa.array(texts, pa.string())).to_pylist() == [unicodedata.normalize("NFKC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_form_never_fails_and_is_stable(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    once = textform.consistent(pa.array(texts, pa.string()))
    assert textform.consistent(once).to_pylist() == once.to_pylist()
    assert [t is None for t in texts] == [t is None for t in once.to_pylist()]


@pytest.mark.parametrize(
    ("raw", "form"),
    [("Gemulоnafa", "Gemulonafa"), ("a​b­c⁠", "abc"), ("x y　z ", "x y z "), ("1‐2‑3－4", "1-2-3-4"), ("⼈⽊⺠", "人木民"), ("ﬁx Ａ", "fix A"), ("é", "é"), ("é", "é"), ("Ωe", "Ωe"), ("", "")],
)
def test_form_cases(raw, form):
    assert textform.consistent(pa.array([raw])).to_pylist() == [form]


def test_sliced_and_long_columns():
    long = "ｘ" * 300_000
    col = pa.array(["a", None, long, "é"]).slice(1)
    assert textform.consistent(col).to_pylist() == [None, "x" * 300_000, "é"]


def test_places_lead_back_to_the_source():
    text = "éa​ﬁz"
    cps = np.array([ord(c) for c in text], np.uint32)
    assert textform.places(cps, np.array([0, len(cps)]))[0].tolist() == [0, 2, 4, 4, 5]  # é a f i z


def plain_shingles(text, width, least):
    low = unicodedata.normalize("NFKC", text).lower()
    tokens, word = [], ""
    for c in low:
        if "一" <= c <= "鿿":
            tokens += [word] * bool(word) + [c]
            word = ""
        elif unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            word += c
        else:
            tokens += [word] * bool(word)
            word = ""
    tokens += [word] * bool(word)
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} if len(tokens) >= max(least, width) else set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c中文1.", max_size=40), min_size=1, max_size=8))
def test_shingles_count_like_plain_sets(texts):
    s = textform.Shingles(pa.array(texts), 3, 4)
    want = [len(plain_shingles(t, 3, 4)) for t in texts]
    got = np.zeros(len(texts), int)
    got[s.rows] = s.size
    assert got.tolist() == want
    sets = {i: plain_shingles(texts[i], 3, 4) for i in s.rows}
    sig, bits = dict(zip(s.rows, s.signature(), strict=True)), dict(zip(s.rows, s.sketch(), strict=True))
    for i in s.rows:
        for j in s.rows:
            assert (sets[i] == sets[j]) == (sig[i] == sig[j])
            differ = int(sum(np.bitwise_count(bits[i] ^ bits[j])))
            assert differ <= len(sets[i] ^ sets[j])


def test_same_look_pairs(spark):
    rows = [("1", "a b"), ("2", "a b"), ("3", "a b"), ("3", "a b"), ("4", "á"), ("5", "a"), ("6", None), ("7", ""), ("8", "​"), (None, "a b")]
    df = spark.createDataFrame(rows, "key string, text string")
    keys = lookalike.form_keys(df.where("key is not null"), "key", "text").selectExpr("*", "'f' as field")
    got = {(r.key_a, r.key_b) for r in lookalike.same_look_pairs(keys, ["field"]).where("key_a < key_b").collect()}
    assert got == {("1", "2"), ("2", "3")}
    cut = {(r.key_a, r.key_b) for r in lookalike.same_look_pairs(keys, ["field"], strip=1).collect()}
    assert cut == got
    by_number = lookalike.same_look_pairs(keys, ["field"], -F.col("key").cast("long")).collect()
    assert {(r.key_a, r.key_b) for r in by_number} == {("2", "1"), ("3", "2")}
    hot = {(r.key_a, r.key_b) for r in lookalike.same_look_pairs(keys, ["field"], most_copies=1).where("key_a < key_b").collect()}
    assert hot == {("1", "2")}
    classes = {r.key: (r.class_key, r.spellings) for r in lookalike.form_classes(keys, ["field"]).collect()}
    assert classes["3"] == ("1", 2) and classes["4"] == ("4", 1)


def test_consistent_form_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "ａ", "x"), (2, None, None)], "id int, text string, key string")
    out = {r.id: (r.text, r.key, r.form) for r in lookalike.consistent_form(df, "text", "form").collect()}
    assert out == {1: ("ａ", "x", "a"), 2: (None, None, None)}
    with pytest.raises(ValueError):
        lookalike.consistent_form(df, "text", "key")
    assert lookalike.consistent_form(df.limit(0), "text", "form").count() == 0


NAMES = [("Anna", "given"), ("Peter", "given"), ("Mark", "given"), ("Ashcroft", "family"), ("Brinley", "family"), ("周", "family")]


def pii_posts(spark):
    rows = [(f"n{i}", f"My name is Anna {f}. The tram was late {i} times.") for i, f in enumerate(["Ashcroft", "Brinley", "Ashcroft", "Brinley", "Newfield"])]
    rows += [(f"t{i}", f"Tel +44 7700 900 10{i}, thanks.") for i in range(4)] + [("t9", "Tel 555 123 4567, thanks.")]
    rows += [(f"i{i}", f"national id 900-12-345{i} is lost") for i in range(4)] + [("i9", "national id E00961375 is lost")]
    rows += [(f"c{i}", f"Case #6474347{i} is open. Mark my words.") for i in range(4)]
    rows += [("m1", "write to anna-ash@mail.example now"), ("m2", "write to anna (at) mail dot example now"), ("m3", "＠user_1 hi")]
    rows += [("a1", "Send it to 12b Quarry Street, Flat 2"), ("a2", "10 minutes on Quarry Street alone"), ("a3", "住云墨街233号5栋"), ("a4", "从22号口出来")]
    rows += [("z1", "我叫周澈。"), ("z2", "周一又晚点了")]
    rows += [("x1", None), ("x2", ""), ("x3", "   "), ("x4", "a " * 50_000), ("x5", "a" * 200_000), ("x6", "1" * 200_000), ("x7", "中" * 100_000), ("x8", "a.b-" * 50_000)]
    return spark.createDataFrame(rows + rows[:1], "id string, text string")


def test_personal_information(spark):
    got = {(r.id, r.kind) for r in pii.entities(pii_posts(spark), NAMES).collect()}
    want = {(f"n{i}", "name") for i in range(5)} | {(f"t{i}", "phone") for i in (0, 1, 2, 3, 9)} | {(f"i{i}", "id_number") for i in (0, 1, 2, 3, 9)}
    want |= {("m1", "email"), ("m2", "email"), ("a1", "address"), ("a3", "address"), ("z1", "name")}
    assert got == want


def test_redaction_keeps_the_rest(spark):
    posts = spark.createDataFrame([("1", "x​ call +44 7700 900 101 é́ now"), ("2", None), ("3", "plain")], "id string, text string")
    spans = pii.entities(posts, NAMES)
    got = {r.id: r.text for r in pii.redact(posts, spans).collect()}
    assert got == {"1": "x​ call [phone] é́ now", "2": None, "3": "plain"}


def test_redacted_rows_keep_their_ids_and_texts(spark):
    """Null ids stay rows of their own; an id with two texts gets each text's own spans; overlapping spans give one placeholder."""
    rows = [(None, "call +44 7700 900 101"), (None, None), ("a", "ﬁne, write to x.y@mail.example please"), ("a", "no spans"), ("b", ""), ("b", "call +44 7700 900 101")]
    posts = spark.createDataFrame(rows, "id string, text string")
    got = sorted(((r.id, r.text) for r in pii.redacted(posts, NAMES).collect()), key=str)
    want = [(None, "call [phone]"), (None, None), ("a", "ﬁne, write to [email] please"), ("a", "no spans"), ("b", ""), ("b", "call [phone]")]
    assert got == sorted(want, key=str)
    spans = spark.createDataFrame([("a", 0, 3, "name"), ("a", 2, 5, "phone"), ("a", 4, 6, "email"), ("b", 1, 1, "name")], "id string, start int, end int, kind string")
    texts = spark.createDataFrame([("a", "0123456789"), ("b", "xy"), ("c", None)], "id string, text string")
    assert {r.id: r.text for r in pii.redact(texts, spans).collect()} == {"a": "[name]3[email]6789", "b": "xy", "c": None}


def test_places_of_a_batch():
    texts = ["a\u0301 ｂ", "", "plain", "\u200bx ﬁ"]
    cps, offs, _ = textform.codepoints(pa.array(texts))
    place, ends = textform.places(cps, offs)
    form, new = textform.unify(cps, offs)
    assert ends.tolist() == new.tolist() and len(place) == len(form)
    assert all(offs[k] <= p < offs[k + 1] for k in range(4) for p in place[ends[k] : ends[k + 1]])


def test_personal_information_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert pii.entities(empty, NAMES).count() == 0
    assert pii.redact(empty, pii.entities(empty, [])).count() == 0
