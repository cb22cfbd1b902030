"""Shared parts of the SQL the queries are checked against."""

DOCS = """docs AS (SELECT post_id AS doc_id, COALESCE(MIN(city), 'unknown') AS city, MIN(split) AS split, MIN(source) AS source, MIN(published_at) AS ts
    FROM posts WHERE post_id IS NOT NULL GROUP BY post_id)"""
CELLS = """cells AS (SELECT split, doc_id, term_id, MAX(cnt) AS cnt FROM counts WHERE cnt >= 1 AND doc_id IS NOT NULL
    AND term_id IN (SELECT term_id FROM vocabulary) GROUP BY split, doc_id, term_id)"""
FIT = CELLS + ", fit AS (SELECT doc_id, term_id, cnt FROM cells WHERE split = 'train')"
#: The terms of the fit part with their frequency, and the cells of the graph.
GRAPH = FIT + ", head AS (SELECT term_id, COUNT(*) AS df FROM fit GROUP BY term_id), low AS (SELECT * FROM fit)"
HASH = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


# Fixed values, stated here again so that the SQL does not lean on the code it checks: public English stop words, and those of social media.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now cannot could ought would"
)
SOCIAL = "amp rt im ive id ill dont didnt doesnt cant couldnt wont wouldnt isnt arent wasnt werent youre theyre thats theres heres just like lol omg wtf gonna gotta yeah yall u ur"
#: Full-width forms and their plain ones; other compatibility forms that the tables hold.
WIDE, PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def tokens(text: str, stop: bool = True) -> str:
    """Tokens in SQL. Of the compatibility forms it knows those in the tables: full-width, two ligatures, ordinals and spaces."""
    out = f"translate({text}, '{WIDE}' || chr(160) || chr(8199) || chr(8239) || chr(12288), '{PLAIN.replace(chr(39), chr(39) * 2)}' || '    ')"
    out = f"lower(nfc_normalize(replace(replace(replace(replace({out}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'º', 'o'), 'ª', 'a')))"
    for pattern, word in (
        ("@?\\[agency( name)?\\]", " agency "),
        ("\\[(bus|train) number\\]", " vehicle "),
        ("\\[line number\\]", " route "),
        ("\\[location name\\]", " location "),
        ("https?://[^ \\t\\n\\x0B\\f\\r]+|www\\.[^ \\t\\n\\x0B\\f\\r]+", " url "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{word}', 'g')"
    out = f"list_transform(regexp_extract_all({out}, '[a-z]+(?:''[a-z]+)?'), lambda w: replace(w, '''', ''))"
    words = ", ".join(f"'{w}'" for w in f"{ENGLISH} {SOCIAL}".split())
    return f"list_filter({out}, lambda w: length(w) >= 2" + (f" AND w NOT IN ({words}))" if stop else ")")


#: City classes as topics: term shares, class TF-IDF weights and the ten leading words.
CLASSES = (
    FIT
    + ", "
    + DOCS
    + """, cls AS (SELECT city AS topic, term_id, CAST(SUM(cnt) AS DOUBLE) AS c FROM fit JOIN docs USING (doc_id) GROUP BY 1, 2),
    siz AS (SELECT topic, SUM(c) AS size FROM cls GROUP BY 1), frq AS (SELECT term_id, SUM(c) AS f FROM cls GROUP BY 1),
    beta AS (SELECT topic, term_id, c / size AS p FROM cls JOIN siz USING (topic)),
    tfidf AS (SELECT topic, term_id, c / size * LN(1 + (SELECT AVG(size) FROM siz) / f) AS weight FROM cls JOIN siz USING (topic) JOIN frq USING (term_id)),
    top AS (SELECT topic, CAST(rank AS INT) AS rank, term_id FROM (SELECT topic, term_id, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY ROUND(weight, 12) DESC, term_id) AS rank FROM tfidf) WHERE rank <= 10)"""
)
#: The completion split of the fit part, token by token.
SPLIT = (
    FIT
    + f""", sized AS (SELECT *, SUM(cnt) OVER (PARTITION BY doc_id) AS tokens FROM fit), tok AS (SELECT *, UNNEST(range(1, CAST(cnt AS BIGINT) + 1)) AS i FROM sized WHERE tokens >= 2),
    sp AS (SELECT doc_id, term_id, cnt, tokens, COUNT(*) FILTER ({HASH.format("'completion|7|' || doc_id || '|' || term_id || '|' || i")} < 2147483648) AS observed FROM tok GROUP BY 1, 2, 3, 4),
    sq AS (SELECT *, SUM(observed) OVER (PARTITION BY doc_id) AS seen, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY cnt DESC, term_id) = 1 AS first FROM sp),
    completion AS (SELECT doc_id, term_id, CAST(observed + d AS BIGINT) AS observed, CAST(cnt - observed - d AS BIGINT) AS target
        FROM (SELECT *, CASE WHEN first AND seen = 0 THEN 1 WHEN first AND seen = tokens THEN -1 ELSE 0 END AS d FROM sq))"""
)
#: Pooled and stratum priors of the observed halves.
PRIORS = (
    SPLIT
    + ", "
    + DOCS
    + """, obs AS (SELECT doc_id, city AS stratum, term_id, observed AS cnt FROM completion JOIN docs USING (doc_id) WHERE observed > 0),
    tgt AS (SELECT doc_id, city AS stratum, term_id, target AS cnt FROM completion JOIN docs USING (doc_id) WHERE target > 0),
    v AS (SELECT DISTINCT term_id FROM vocabulary), nv AS (SELECT COUNT(*) AS v FROM v),
    tc AS (SELECT term_id, SUM(cnt) AS c FROM obs GROUP BY 1), tt AS (SELECT SUM(cnt) AS t FROM obs),
    pooled AS (SELECT term_id, (COALESCE(c, 0) + 0.5::DOUBLE) / (t + 0.5::DOUBLE * nv.v) AS p FROM v LEFT JOIN tc USING (term_id) CROSS JOIN tt CROSS JOIN nv),
    sc AS (SELECT stratum, term_id, SUM(cnt) AS c FROM obs GROUP BY 1, 2), ss AS (SELECT stratum, SUM(cnt) AS t FROM obs GROUP BY 1),
    stratum AS (SELECT ss.stratum, pooled.term_id, 0.5 * p + 0.5 * (COALESCE(c, 0) + 0.5::DOUBLE) / (ss.t + 0.5::DOUBLE * nv.v) AS p
        FROM pooled CROSS JOIN ss CROSS JOIN nv LEFT JOIN sc ON sc.stratum = ss.stratum AND sc.term_id = pooled.term_id)"""
)
#: Monthly mean price by return flag, as seeds x variants x metrics.
METRICS = """mon AS (SELECT l_returnflag AS variant, strftime(l_shipdate, '%Y-%m') AS seed, AVG(l_extendedprice) AS price, AVG(l_discount) AS discount, AVG(l_quantity) AS quantity
    FROM lineitem GROUP BY 1, 2)"""
