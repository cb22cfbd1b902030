"""Queries over records, text, counts and the term graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from railcorpus.functions import text as T
from railcorpus.operators import corpus as C
from railcorpus.operators import graph as G
from railcorpus.operators import priors as P
from railcorpus.plans.registry import query
from railcorpus.plans.sqlbase import CELLS, DOCS, FIT, GRAPH, HASH, tokens
from railcorpus.session import table


def fit_cells(spark, sf):
    return C.cells_of(spark, sf).where("split = 'train'").select("doc_id", "term_id", "cnt")


def document_tokens(spark, sf, stop=True):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), T.tokenize(F.col("text"), stop).alias("tokens"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS terms FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens_per_doc(spark, sf):
    return document_tokens(spark, sf).where("tokens is not null").select("doc_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("terms"))


_VOC = f"""WITH d AS (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL AND {HASH.format('CAST(doc_id AS VARCHAR)')} < 3006477107),
    w AS (SELECT doc_id, UNNEST(t) AS term FROM d), f AS (SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS tf FROM w GROUP BY term HAVING COUNT(DISTINCT doc_id) >= 2),
    voc AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY df DESC, tf DESC, term) - 1 AS INT) AS term_id, term, df, tf FROM f ORDER BY term_id LIMIT 1148)"""


def _fit_tokens(spark, sf):
    return C.hash_split(document_tokens(spark, sf).where("tokens is not null"), "doc_id").where("part = 'fit'")


@query(_VOC + " SELECT * FROM voc")
def vocabulary_build(spark, sf):
    return C.build_vocabulary(_fit_tokens(spark, sf))


@query(_VOC + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, term_id, COUNT(*) AS cnt FROM w JOIN voc USING (term) GROUP BY 1, 2")
def bow_counts(spark, sf):
    fit = _fit_tokens(spark, sf)
    return C.bag_of_words(fit, C.build_vocabulary(fit))


@query(f"WITH {FIT} SELECT term_id, COUNT(*) AS df, CAST(SUM(cnt) AS BIGINT) AS tf FROM fit GROUP BY term_id")
def doc_freq(spark, sf):
    return C.document_frequency(fit_cells(spark, sf))


@query(f"WITH {FIT} SELECT doc_id, list_sort(flatten(list(list_transform(range(cnt), lambda i: term_id)))) AS tokens FROM fit GROUP BY doc_id")
def token_expand(spark, sf):
    return C.expand_tokens(fit_cells(spark, sf))


@query(f"WITH {FIT} SELECT doc_id, string_agg(rtrim(repeat(term || ' ', CAST(cnt AS INT))), ' ' ORDER BY term_id) AS text FROM fit JOIN (SELECT DISTINCT term_id, term FROM vocabulary) USING (term_id) GROUP BY doc_id")
def text_from_tokens(spark, sf):
    return C.text_of_tokens(fit_cells(spark, sf), table(spark, sf, "vocabulary").select("term_id", "term").distinct())


@query("SELECT sha256(lower(trim(text, ' '))) AS group_key, COUNT(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1")
def dup_text_groups(spark, sf):
    return C.duplicate_groups(table(spark, sf, "documents"), F.sha2(F.lower(F.trim("text")), 256))


@query("SELECT lower(trim(lang, ' ')) AS lang, COUNT(*) AS docs, COUNT(DISTINCT text) AS texts, MIN(n_chars) AS least, ROUND(AVG(n_chars), 6) AS mean, MAX(n_chars) AS most FROM documents GROUP BY 1")
def corpus_profile(spark, sf):
    return table(spark, sf, "documents").groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count("*").alias("docs"), F.count_distinct("text").alias("texts"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"))


@query(f"SELECT city, part, COUNT(*) AS posts FROM (SELECT city, CASE WHEN {HASH.format('group_sha256')} < 3006477107 THEN 'fit' ELSE 'held' END AS part FROM split_assignments) GROUP BY 1, 2")
def split_assignment(spark, sf):
    return C.hash_split(table(spark, sf, "split_assignments"), "group_sha256").groupBy("city", "part").agg(F.count("*").alias("posts"))


@query("SELECT group_sha256, COUNT(DISTINCT split) AS parts FROM split_assignments WHERE group_sha256 IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT split) > 1")
def group_leakage(spark, sf):
    return C.group_overlap(table(spark, sf, "split_assignments"), "group_sha256", "split")


@query("SELECT split, city, COUNT(*) AS assigned, COUNT(*) FILTER (included_in_model) AS modelled, COUNT(*) FILTER (NOT included_in_model) AS excluded, COUNT(*) FILTER (included_in_model IS NULL) AS unknown FROM split_assignments GROUP BY 1, 2")
def partition_inclusion(spark, sf):
    flag = T.parse_bool(F.col("included_in_model"))
    return table(spark, sf, "split_assignments").groupBy("split", "city").agg(F.count("*").alias("assigned"), F.count_if(flag).alias("modelled"), F.count_if(~flag).alias("excluded"), F.count_if(flag.isNull()).alias("unknown"))


@query(f"WITH {DOCS} SELECT docs.doc_id, s.city AS assigned_city, s.split = docs.split AS same_split FROM docs LEFT JOIN (SELECT post_id, MIN(city) AS city, MIN(split) AS split FROM split_assignments GROUP BY 1) s ON s.post_id = docs.doc_id")
def metadata_lookup(spark, sf):
    s = table(spark, sf, "split_assignments").groupBy(F.col("post_id").alias("doc_id")).agg(F.min("city").alias("assigned_city"), F.min("split").alias("assigned"))
    return C.documents_of(spark, sf).join(s, "doc_id", "left").select("doc_id", "assigned_city", (F.col("assigned") == F.col("split")).alias("same_split"))


@query("SELECT delivered.post_id, copies, published_at AS first_published FROM (SELECT post_id, COUNT(*) AS copies, MIN(published_at) AS published_at FROM posts GROUP BY 1 HAVING COUNT(*) > 1) delivered")
def repeated_deliveries(spark, sf):
    return table(spark, sf, "posts").groupBy("post_id").agg(F.count("*").alias("copies"), F.min("published_at").alias("first_published")).where("copies > 1")


@query(f"WITH {DOCS}, o AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY ts NULLS FIRST, doc_id) - 1 AS position FROM docs) SELECT doc_id, position, 'ETU' || printf('%04d', position + 1) AS seq_id, CASE WHEN position < 500 THEN 'train' WHEN position < 600 THEN 'validation' ELSE 'test' END AS part FROM o")
def chronological_parts(spark, sf):
    rows = C.chronological_split(C.documents_of(spark, sf).select("doc_id", "ts"), 500, 100, "ts", "doc_id")
    return rows.select("doc_id", "position", F.format_string("ETU%04d", F.col("position") + 1).alias("seq_id"), "part")


@query("SELECT CAST(block AS INT) AS block, COUNT(*) AS events, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM (SELECT ts, NTILE(3) OVER (ORDER BY ts, event_id) AS block FROM events) GROUP BY 1")
def event_blocks(spark, sf):
    rows = C.chronological_blocks(table(spark, sf, "events").select("ts", "event_id"), 3, "ts", "event_id")
    return rows.groupBy("block").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {CELLS}, p AS (SELECT DISTINCT doc_id, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS part FROM cells WHERE split IN ('train', 'validation')) SELECT part, doc_id, ROW_NUMBER() OVER (ORDER BY part, doc_id) - 1 AS row FROM p")
def union_concat(spark, sf):
    cells = C.cells_of(spark, sf)
    part = lambda s: cells.where(F.col("split") == s).select("doc_id").distinct()
    return C.union_parts(part("train"), part("validation"), "doc_id").select(F.col("part").alias("part"), "doc_id", "row")


_DATES = "p AS (SELECT post_id, MIN(published_at) AS ts, MIN(published_date) AS d FROM posts WHERE post_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_DATES}, c AS (SELECT year_of, month_of, ts FROM (SELECT CASE WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}') THEN CAST(substr(d, 1, 4) AS INT) END AS year_of,
    CASE WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{2}}') THEN ['january','february','march','april','may','june','july','august','september','october','november','december'][CAST(substr(d, 6, 2) AS INT)] END AS month_of, ts FROM p) WHERE year_of IS NOT NULL)
    SELECT year_of AS year, COUNT(*) AS posts, COUNT(*) FILTER (COALESCE(year(ts) = year_of, FALSE)) AS year_agrees, COUNT(*) FILTER (COALESCE(lower(monthname(ts)) = month_of, FALSE)) AS month_agrees FROM c GROUP BY 1""")
def year_month_check(spark, sf):
    """Year and month name of the date as it was written against the parsed time of the post, by written year."""
    p = table(spark, sf, "posts").where("post_id is not null").groupBy("post_id").agg(F.min("published_at").alias("ts"), F.min("published_date").alias("d"))
    p = p.where(F.col("d").rlike("^[0-9]{4}-[0-9]{2}")).select("ts", F.substring("d", 1, 4).cast("int").alias("year"), F.lower(F.date_format(F.to_date(F.concat(F.lit("2000-"), F.substring("d", 6, 2), F.lit("-01"))), "MMMM")).alias("month"))
    return C.date_consistency(p, "ts", "year", "month")


@query(f"""WITH {_DATES}, t AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, MIN(CAST(d AS DATE)) AS low, MAX(CAST(d AS DATE)) AS high FROM p WHERE regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))
    SELECT n AS rows, CAST(low AS TIMESTAMP) AS first_ts, CAST(high AS TIMESTAMP) AS last_ts, 'PASS' AS status FROM t""")
def strict_timestamps(spark, sf):
    """Full dates of the posts, parsed strictly, their range locked to what a first reading of the table gives."""
    p = table(spark, sf, "posts").where("post_id is not null").groupBy("post_id").agg(F.min("published_date").alias("d")).where(F.length("d") == 10)
    lock = p.agg(F.to_timestamp(F.min("d")).alias("a"), F.to_timestamp(F.max("d")).alias("b")).first()
    return C.strict_timestamps(p, "d", "yyyy-MM-dd", lock["a"], lock["b"])


@query("SELECT event_type, COUNT(*) AS events, MIN(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS least, MAX(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS most FROM events GROUP BY 1")
def json_props(spark, sf):
    k = T.json_number(F.col("props"), "k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.min(k).alias("least"), F.max(k).alias("most"))


@query("WITH p AS (SELECT post_id, MIN(city) AS city, MIN(split) AS split, MIN(published_date) AS d, MIN(year_status) AS s FROM posts GROUP BY 1) SELECT city, split, CASE WHEN regexp_matches(COALESCE(d, ''), '^[0-9]{4}') THEN substr(d, 1, 4) ELSE 'unknown' END AS year, s AS year_status, COUNT(*) AS posts FROM p GROUP BY ALL")
def temporal_coverage(spark, sf):
    p = table(spark, sf, "posts").groupBy("post_id").agg(F.min("city").alias("city"), F.min("split").alias("split"), F.min("published_date").alias("d"), F.min("year_status").alias("year_status"))
    return p.groupBy("city", "split", T.year_prefix(F.col("d")).alias("year"), "year_status").agg(F.count("*").alias("posts"))


@query("SELECT COALESCE(lang, '?') AS lang, COUNT(*) AS terms, COUNT(*) FILTER (regexp_matches(term, '[㐀-鿿]')) AS han FROM vocabulary GROUP BY 1")
def han_terms(spark, sf):
    return table(spark, sf, "vocabulary").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("terms"), F.count_if(T.has_han(F.col("term"))).alias("han"))


@query(f"SELECT post_id, CAST(len(t) AS INT) AS tokens FROM (SELECT post_id, {tokens('MIN(delexicalized_text)')} AS t FROM posts GROUP BY post_id)")
def unfolded_tokens(spark, sf):
    """Tokens of each post after entities, compatibility forms and case are resolved; null text has none."""
    t = table(spark, sf, "posts").groupBy("post_id").agg(F.min("delexicalized_text").alias("text"))
    return t.select("post_id", F.when(F.col("text").isNotNull(), F.size(T.tokenize(F.col("text")))).alias("tokens"))


@query("""WITH e AS (SELECT event_id, json_object('Maximum_Iterations', value, 'n_epochs', user_id, 'max_depth', 1, 'note', 'max_epoch') AS j FROM events)
    SELECT COUNT(*) AS events, ROUND(SUM(LEAST(CAST(json_extract_string(j, '$.Maximum_Iterations') AS DOUBLE), CAST(json_extract_string(j, '$.n_epochs') AS DOUBLE))), 4) AS total FROM e""")
def json_iterations(spark, sf):
    """Receipts made of each event: of the two keys that name a largest iteration or epoch the smaller value."""
    j = F.to_json(F.struct(F.col("value").alias("Maximum_Iterations"), F.col("user_id").alias("n_epochs"), F.lit(1).alias("max_depth"), F.lit("max_epoch").alias("note")))
    return table(spark, sf, "events").select(T.json_max_iteration(j).alias("m")).agg(F.count("*").alias("events"), F.round(F.sum("m"), 4).alias("total"))


@query(f"SELECT source, CAST(SUM(len(t)) AS BIGINT) AS tokens, COUNT(*) AS posts FROM (SELECT source, {tokens('delexicalized_text')} AS t FROM posts WHERE delexicalized_text IS NOT NULL) GROUP BY 1")
def source_tokens(spark, sf):
    t = table(spark, sf, "posts").where("delexicalized_text is not null").select("source", F.size(T.tokenize(F.col("delexicalized_text"))).alias("n"))
    return t.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("posts"))


@query(f"WITH w AS (SELECT DISTINCT UNNEST({tokens('text')}) AS term FROM documents WHERE text IS NOT NULL), v AS (SELECT DISTINCT term FROM vocabulary) SELECT COUNT(v.term) AS shared, COUNT(*) AS total, ROUND(COUNT(v.term) / COUNT(*), 9) AS share FROM w LEFT JOIN v USING (term)")
def vocab_overlap(spark, sf):
    from railcorpus.operators.stats import coverage_gap

    words = document_tokens(spark, sf).select(F.explode("tokens").alias("term"))
    return coverage_gap(words, "term", table(spark, sf, "vocabulary")).withColumn("share", F.round("share", 9))


_EDGES = """, prs AS (SELECT a.term_id AS src, b.term_id AS dst, COUNT(*) AS j FROM low a JOIN low b ON a.doc_id = b.doc_id AND a.term_id < b.term_id GROUP BY 1, 2),
    nn AS (SELECT CAST(COUNT(DISTINCT doc_id) AS DOUBLE) AS n FROM low),
    raw AS (SELECT src, dst, LEAST(GREATEST(LN((j / n) / ((x.df / n) * (y.df / n))) / -LN(j / n), 0), 1) * POW(j / n, 1.25) AS w FROM prs JOIN head x ON x.term_id = src JOIN head y ON y.term_id = dst CROSS JOIN nn WHERE x.df >= 2 AND y.df >= 2 AND j < n),
    edges AS (SELECT src, dst, w / (SELECT MAX(w) FROM raw) AS w FROM raw WHERE w > 0)"""
_WAYS = ", ways AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"


@query(f"WITH {GRAPH}{_EDGES} SELECT src, dst, ROUND(w, 9) AS w FROM edges")
def npmi_graph(spark, sf):
    return G.npmi_graph(fit_cells(spark, sf)).withColumn("w", F.round("w", 9))


@query(f"WITH {GRAPH}{_EDGES}{_WAYS} SELECT src AS term_id, ROUND(SUM(w), 8) AS degree FROM ways GROUP BY 1")
def graph_degree(spark, sf):
    return G.degree(G.npmi_graph(fit_cells(spark, sf))).withColumn("degree", F.round("degree", 8))


@query(f"WITH {GRAPH}{_EDGES}, rd AS (SELECT src, dst, ROUND(w, 9) AS w FROM edges), ways AS (SELECT src, dst, w FROM rd UNION ALL SELECT dst, src, w FROM rd), k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY src ORDER BY w DESC, dst) AS INT) AS rank FROM ways) SELECT src, rank, dst, w FROM k WHERE rank <= 5")
def top_edges(spark, sf):
    return G.strongest_edges(npmi_graph(spark, sf), 5)


@query(f"WITH {FIT}, x AS (SELECT doc_id, list_sort(flatten(list(list_transform(range(cnt), lambda i: term_id)))) AS t FROM fit GROUP BY doc_id), p AS (SELECT doc_id, UNNEST(range(1, len(t) + 1)) AS i, t FROM x), y AS (SELECT t[i] AS a, UNNEST(t[i + 1 : i + 14]) AS b FROM p) SELECT LEAST(a, b) AS a, GREATEST(a, b) AS b, COUNT(*) AS n FROM y WHERE a <> b GROUP BY 1, 2")
def biterm_counts(spark, sf):
    return C.biterms(C.expand_tokens(fit_cells(spark, sf)), 15)


@query("WITH e AS (SELECT src, dst FROM npmi_edges), v AS (SELECT DISTINCT term_id FROM vocabulary) SELECT 'src_known' AS \"check\", COUNT(*) FILTER (src NOT IN (SELECT term_id FROM v)) AS observed, CASE WHEN COUNT(*) FILTER (src NOT IN (SELECT term_id FROM v)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM e UNION ALL SELECT 'ordered', COUNT(*) FILTER (src >= dst), CASE WHEN COUNT(*) FILTER (src >= dst) = 0 THEN 'PASS' ELSE 'FAIL' END FROM e")
def edge_checks(spark, sf):
    e = table(spark, sf, "npmi_edges").join(table(spark, sf, "vocabulary").select(F.col("term_id").alias("src"), F.lit(True).alias("known")).distinct(), "src", "left")
    return C.check_table(e, {"src_known": F.col("known"), "ordered": F.col("src") < F.col("dst")})


@query("""WITH c AS (SELECT COUNT(*) FILTER (NOT COALESCE(cnt >= 1, FALSE)) AS a, COUNT(*) FILTER (term_id IS NULL) AS b, COUNT(*) FILTER (term_id IS NOT NULL AND term_id NOT IN (SELECT term_id FROM vocabulary)) AS c, COUNT(*) FILTER (split NOT IN ('train', 'validation', 'test')) AS d FROM counts)
    SELECT "check", observed, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 'positive_counts' AS "check", a AS observed FROM c UNION ALL SELECT 'term_present', b FROM c UNION ALL SELECT 'term_known', c FROM c UNION ALL SELECT 'split_known', d FROM c)""")
def count_checks(spark, sf):
    known = table(spark, sf, "vocabulary").select("term_id", F.lit(True).alias("known")).distinct()
    rows = table(spark, sf, "counts").join(known, "term_id", "left")
    return C.check_table(rows, {"positive_counts": F.col("cnt") >= 1, "term_present": F.col("term_id").isNotNull(), "term_known": F.col("term_id").isNull() | F.col("known"), "split_known": F.col("split").isin("train", "validation", "test")})


@query(f"""WITH {DOCS}, d AS (SELECT doc_id, city, split FROM docs), t AS (SELECT * FROM d WHERE split = 'test'), c AS (SELECT doc_id, COUNT(*) AS cells, COUNT(*) FILTER (NOT COALESCE(cnt >= 1, FALSE)) AS bad FROM counts WHERE split = 'test' GROUP BY 1),
    n AS (SELECT (SELECT COUNT(*) FROM t WHERE city NOT IN ('Luoxi', 'Qinglan', 'Yunmo')) AS s, (SELECT COUNT(*) FROM t WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE doc_id IS NOT NULL)) AS e, (SELECT COUNT(*) FROM t JOIN d x ON x.doc_id = t.doc_id AND x.split <> 'test') AS v, (SELECT CAST(SUM(bad) AS BIGINT) FROM c) AS b, (SELECT COUNT(*) FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM t)) AS o)
    SELECT "check", observed, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT UNNEST(['id_present', 'id_unique', 'stratum_expected', 'not_empty', 'not_in_development', 'count_whole', 'cell_has_document']) AS "check", UNNEST([0, 0, s, e, v, b, o]) AS observed FROM n)""")
def partition_contract(spark, sf):
    """The test posts and all their counts as delivered, with three cities expected."""
    d = C.documents_of(spark, sf)
    test = d.where("split = 'test'").select("doc_id", F.col("city").alias("stratum"))
    cells = table(spark, sf, "counts").where("split = 'test'").select("doc_id", "term_id", "cnt")
    return C.partition_contract(test, cells, ["Luoxi", "Qinglan", "Yunmo"], d.where("split <> 'test'").select("doc_id"))


@query("""WITH i AS (SELECT doc_id, lang, source FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'changed' ELSE lang END AS lang, source FROM i WHERE doc_id % 100 <> 3)
    SELECT COALESCE(r.doc_id, i.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN i.doc_id IS NULL THEN 'added' ELSE 'changed' END AS problem FROM r FULL JOIN i ON r.doc_id = i.doc_id
    WHERE r.doc_id IS NULL OR i.doc_id IS NULL OR COALESCE(r.lang, '') <> COALESCE(i.lang, '') OR COALESCE(r.source, '') <> COALESCE(i.source, '')""")
def locked_columns(spark, sf):
    """An issued form against a returned one in which some rows are gone and some changed."""
    issued = table(spark, sf, "documents").select("doc_id", "lang", "source")
    returned = issued.where("doc_id % 100 <> 3").withColumn("lang", F.when(F.col("doc_id") % 50 == 7, "changed").otherwise(F.col("lang")))
    return C.locked_differences(returned, issued, "doc_id", ["lang", "source"])


@query("""WITH m AS (SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
    SELECT f.flag, s.status, t.month FROM (SELECT DISTINCT flag FROM m) f CROSS JOIN (SELECT DISTINCT status FROM m) s CROSS JOIN (SELECT DISTINCT month FROM m) t ANTI JOIN m ON m.flag = f.flag AND m.status = s.status AND m.month = t.month""")
def grid_complete(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return C.grid_gaps(m.distinct(), ["flag", "status", "month"])


@query("SELECT label, ROUND(MAX(ABS(SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1)), 6) AS off FROM embeddings GROUP BY 1")
def unit_norm(spark, sf):
    e = table(spark, sf, "embeddings")
    off = C.unit_norm(e, "vec_id", "embedding")
    return e.select("vec_id", "label").join(off, "vec_id").groupBy("label").agg(F.round(F.max("off"), 6).alias("off"))


@query("""WITH t AS (SELECT term_id, MIN(term) AS term FROM term_emb GROUP BY 1), v AS (SELECT term_id, MIN(term) AS term FROM vocabulary GROUP BY 1)
    SELECT COUNT(*) AS terms, COUNT(t.term_id) AS embedded, COUNT(*) FILTER (t.term <> v.term) AS renamed FROM v LEFT JOIN t USING (term_id)""")
def embedding_alignment(spark, sf):
    t = table(spark, sf, "term_emb").groupBy("term_id").agg(F.min("term").alias("t"))
    v = table(spark, sf, "vocabulary").groupBy("term_id").agg(F.min("term").alias("v"))
    return v.join(t, "term_id", "left").agg(F.count("*").alias("terms"), F.count("t").alias("embedded"), F.count_if(F.col("t") != F.col("v")).alias("renamed"))


@query("SELECT doc_id, rater, CASE WHEN level = 4 THEN 'yes' WHEN level IS NOT NULL THEN 'no' END AS specialist, CASE WHEN level BETWEEN 1 AND 5 THEN level END AS rating FROM reading_labels")
def rating_cast(spark, sf):
    level = F.col("level").cast("string")
    return table(spark, sf, "reading_labels").select("doc_id", "rater", T.yes_no(F.when(level == "4", "Y ").when(level.isNotNull(), " No")).alias("specialist"), T.rating(level).alias("rating"))


@query("SELECT l_returnflag, printf('%.4f', AVG(l_discount)) || ' ± ' || printf('%.4f', stddev_samp(l_discount)) AS shown FROM lineitem GROUP BY 1")
def display_format(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))
    return r.select("l_returnflag", F.concat(T.display_number(F.col("m")), F.lit(" ± "), T.display_number(F.col("s"))).alias("shown"))


@query("SELECT COALESCE(source, '—') AS source, '| ' || COALESCE(source, '—') || ' | ' || COUNT(*) || ' | ' || COUNT(DISTINCT doc_id) || ' |' AS line FROM (SELECT lower(trim(source, ' ')) AS source, doc_id FROM documents) GROUP BY source")
def markdown_rows(spark, sf):
    from railcorpus.sources.reports import markdown_lines

    r = table(spark, sf, "documents").groupBy(F.lower(F.trim("source")).alias("s")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"))
    r = r.select(F.coalesce("s", F.lit("—")).alias("source"), "n", "d")
    return r.select("source", markdown_lines("source", "n", "d").alias("line"))


@query("SELECT COUNT(*) AS dropped FROM posts WHERE user_id IS NULL AND city IS NULL AND source IS NULL AND model_token_count IS NULL")
def all_null_rows(spark, sf):
    rows = table(spark, sf, "posts").select("user_id", "city", "source", "model_token_count")
    return rows.agg(F.count("*").alias("n")).crossJoin(rows.dropna(how="all").agg(F.count("*").alias("kept"))).select((F.col("n") - F.col("kept")).alias("dropped"))


@query(f"WITH {CELLS}, {DOCS} SELECT cells.split, COUNT(DISTINCT cells.doc_id) AS documents, COUNT(*) AS cells, CAST(SUM(cnt) AS BIGINT) AS tokens, COUNT(DISTINCT cells.doc_id) FILTER (docs.doc_id IS NULL) AS unknown, COUNT(*) FILTER (docs.split <> cells.split) AS misplaced FROM cells LEFT JOIN docs ON docs.doc_id = cells.doc_id GROUP BY 1")
def frozen_loader(spark, sf):
    d = C.documents_of(spark, sf).select("doc_id", F.col("split").alias("own"))
    rows = C.cells_of(spark, sf).join(d, "doc_id", "left")
    missing = F.when(F.col("own").isNull(), F.col("doc_id"))
    return rows.groupBy("split").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("cells"), F.sum("cnt").alias("tokens"), F.count_distinct(missing).alias("unknown"), F.count_if(F.col("own") != F.col("split")).alias("misplaced"))


_GROUPS = "g AS (SELECT city AS stratum, group_sha256, COUNT(*) AS size FROM split_assignments WHERE city IS NOT NULL AND group_sha256 IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_GROUPS} SELECT stratum, COUNT(*) AS groups, CAST(SUM(size) AS BIGINT) AS rows, 0::BIGINT AS split_groups, TRUE AS balanced FROM g GROUP BY 1")
def group_folds(spark, sf):
    """Folds of each city: its groups and rows, groups that are in more than one fold, and whether the folds differ by a group at most."""
    rows = table(spark, sf, "split_assignments").select(F.col("city").alias("stratum"), F.col("group_sha256").alias("group_key"))
    f = P.group_folds(rows)
    load = f.groupBy("stratum", "fold").agg(F.sum("size").alias("load"), F.count("*").alias("groups"), F.max("size").alias("largest"))
    even = load.groupBy("stratum").agg(F.sum("groups").alias("groups"), F.sum("load").alias("rows"), (F.max("load") - F.when(F.count("*") < 5, 0).otherwise(F.min("load")) <= 2 * F.max("largest")).alias("balanced"))
    split = f.groupBy("stratum", "group_key").agg(F.count_distinct("fold").alias("n")).groupBy("stratum").agg(F.count_if(F.col("n") > 1).alias("split_groups"))
    return even.join(split, "stratum").select("stratum", "groups", "rows", "split_groups", "balanced")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings posts counts vocabulary term_emb centroids split_assignments leakage_report npmi_edges reading_labels mix_targets known_names".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS rows, TRUE AS whole FROM {t}" for t in TABLES))
def table_fingerprints(spark, sf):
    """Identity of each table's content: the rows, and whether it is the same with the columns in another order."""
    out = None
    for name in TABLES:
        t = table(spark, sf, name)
        f = C.table_fingerprint(t).join(C.table_fingerprint(t.select(*reversed(t.columns))).withColumnRenamed("rows", "again"), "fingerprint", "left")
        f = f.select(F.lit(name).alias("table"), "rows", (F.col("rows") == F.col("again")).alias("whole"))
        out = f if out is None else out.unionByName(f)
    return out


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS path, 64::INT AS digits, COUNT(*) > 0 AS holds FROM {t}" for t in TABLES))
def artifact_manifest(spark, sf):
    """Every table's file with the length of its SHA-256; a table of several files counts as one."""
    from railcorpus.sources.files import manifest

    m = manifest(spark, sf, [f"{t}.parquet" for t in TABLES])
    return m.groupBy(F.regexp_extract("path", r"^[^/]+", 0).alias("path")).agg(F.min(F.length("sha256")).alias("digits"), (F.sum("bytes") > 0).alias("holds"))
