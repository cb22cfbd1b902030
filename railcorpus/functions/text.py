"""Scalar functions over columns: tokenising, parsing, display. All stay inside the JVM but for unfold_text."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The row separator, the token pattern, the substitutions before it in their order, and the words of social media that carry no topic.
APART = "\x1e"
TOKEN = r"[a-z]+(?:'[a-z]+)?"
SUBSTITUTIONS = (
    (r"@?\[agency(?: name)?\]", " agency "),
    (r"\[(?:bus|train) number\]", " vehicle "),
    (r"\[line number\]", " route "),
    (r"\[location name\]", " location "),
    (r"https?://\S+|www\.\S+", " url "),
)
SOCIAL_WORDS = tuple(
    "amp rt im ive id ill dont didnt doesnt cant couldnt wont wouldnt isnt arent wasnt werent youre theyre thats theres heres just like lol omg wtf gonna gotta yeah yall u ur".split()
)


@lru_cache(1)
def english_stop_words() -> tuple[str, ...]:
    """Spark's public English stop list, without the words with an apostrophe: no token has one."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(w for w in StopWordsRemover.loadDefaultStopWords("english") if w.isalpha())


def tokenize(text: Column, stop: bool | Sequence[str] = True, substitutions: Sequence[tuple[str, str]] = SUBSTITUTIONS, least: int = 2) -> Column:
    """Case-folded word tokens of `least` letters or more: entities and compatibility forms resolved, substitutions made, apostrophes
    dropped after matching, stop words left out.

    stop is a word list of your own (any other public list), True for Spark's English list with SOCIAL_WORDS, False for none. Null text has
    null tokens. Only texts with an entity or other than ASCII characters leave the JVM.
    """
    odd = text.rlike("[^\\x00-\\x7F]|&")
    low = F.coalesce(unfold_text(F.when(odd, text)), F.lower(text))
    for pattern, word in substitutions:
        low = F.regexp_replace(low, pattern, word)
    words = F.transform(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    words = F.filter(words, lambda w: F.length(w) >= least)
    listed = (*english_stop_words(), *SOCIAL_WORDS) if stop is True else tuple(stop or ())
    return F.filter(words, lambda w: ~w.isin(*listed)) if listed else words


def _unfolded(t: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(t)).casefold()


@F.arrow_udf(StringType())
def unfold_text(text: pa.Array) -> pa.Array:
    """HTML entities resolved, compatibility forms, case folded: a batch is one string with its rows apart by a character that takes part in
    none of the three. Null stays null."""
    rows = text.to_pylist()
    whole = APART.join(t or "" for t in rows)
    parts = _unfolded(whole).split(APART) if whole.count(APART) == len(rows) - 1 else [_unfolded(t or "") for t in rows]
    return pa.array([None if t is None else p for t, p in zip(rows, parts, strict=True)], pa.string())


def parse_bool(c: Column) -> Column:
    """true / 1 and false / 0, trimmed and in any case; anything else is null."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def yes_no(c: Column) -> Column:
    """yes or no from yes / y / 1 / true and no / n / 0 / false; anything else is null."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("yes", "y", "1", "true"), "yes").when(v.isin("no", "n", "0", "false"), "no")


def rating(c: Column) -> Column:
    """An integer from 1 to 5, else null."""
    v = c.cast("double")
    return F.when((v == F.floor(v)) & v.between(1, 5), v.cast("int"))


def has_han(c: Column) -> Column:
    return c.rlike("[\\u3400-\\u9fff]")


def year_prefix(c: Column) -> Column:
    """First four digits, or unknown; null is unknown."""
    y = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1)
    return F.when(y == "", "unknown").otherwise(y)


def display_number(c: Column, decimals: int = 4) -> Column:
    """Fixed decimals; not a number or null is a dash, and what rounds to zero has no sign."""
    small = F.abs(c) < 0.5 * 10**-decimals
    shown = F.format_string(f"%.{decimals}f", F.when(small, F.lit(0.0)).otherwise(c))
    return F.when(c.isNull() | F.isnan(c) | F.abs(c).isin(float("inf")), "—").otherwise(shown)


def hash32(c: Column) -> Column:
    """First 32 bits of SHA-256 as a number: the source of every deterministic split, fold and shuffle."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def json_number(c: Column, key: str) -> Column:
    """The number a JSON object holds under a key, else null."""
    return F.try_element_at(F.from_json(c, "map<string,double>"), F.lit(key))


def json_max_iteration(c: Column) -> Column:
    """Smallest number among the keys of a JSON object that name a largest iteration or epoch: "maximum", "max_" or "epochs" and
    "iteration" or "epoch" in any case. Null without one; values that are no numbers do not count."""
    m = F.from_json(c, "map<string,string>")
    named = F.map_filter(m, lambda k, v: F.lower(k).rlike("maximum|max_|epochs") & F.lower(k).rlike("iteration|epoch") & v.try_cast("double").isNotNull())
    return F.array_min(F.transform(F.map_values(named), lambda v: v.try_cast("double")))
