"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions import dates, readability
from callscope.functions import text as T
from callscope.operators import batches, compare, decompose, exposure, match, reports, sections, sentiment, vault
from callscope.streaming.ingest import windowed

SETS = {"alpha": ["the", "of", "And", "and", "avec"], "beta": ["to", "in", "que", "der", "zzz"]}
POSITIVE, NEGATIVE = ["the", "and", "le", "der"], ["of", "to", "la", "que"]
HIV4 = ["et", "and", "y"], ["und", "or", "que"]
QUERIES: dict = {}
SQL: dict = {}

WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SENTS = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)), lambda x: trim(x, " + BLANKS + ")), lambda x: x <> '')"
KEYS = "(VALUES " + ", ".join(f"('{s}', {i}, '{k}')" for s, ks in SETS.items() for i, k in enumerate(ks)) + ") AS k0(keyword_set, ord, keyword)"
LISTS = {n: "[" + ", ".join(f"'{x}'" for x in w) + "]" for n, w in (("p", POSITIVE), ("n", NEGATIVE))}


def near4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


CTE = f"""
WITH kw AS (SELECT keyword_set, keyword, ord, lower(keyword) AS kw_lc FROM {KEYS} QUALIFY row_number() OVER (PARTITION BY keyword_set, lower(keyword) ORDER BY ord) = 1),
d AS (SELECT doc_id, {SENTS.format("text")} AS s FROM documents),
st AS (SELECT doc_id, generate_subscripts(s, 1) AS si, unnest(s) AS context FROM d),
tk AS (SELECT doc_id, si, context, generate_subscripts(w, 1) AS wi, unnest(w) AS token FROM (SELECT *, {WORDS.format("context")} AS w FROM st)),
ps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY si, wi) - 1 AS pos FROM tk),
m AS (SELECT doc_id, keyword_set, ord, keyword, CAST(pos AS INTEGER) AS position, token AS matched_text, context FROM ps JOIN kw ON lower(token) = kw_lc)
"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i, k) for s, ks in SETS.items() for i, k in enumerate(ks)], "keyword_set string, ord bigint, keyword string")


def _shared(spark, sf_dir):
    """Sentences of both sets, and their numbers."""
    return compare.shared_in(table(spark, sf_dir, "documents").select("doc_id", "text"), keyword_table(spark), list(SETS))


def _matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kw = keyword_table(spark)
    return docs, kw, match.direct(docs, kw)


@register("tokens_top", f"SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('lower(text)')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def tokens_top(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.lower("text"))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


@register("bigrams_top", f"SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM (SELECT {WORDS.format('text')} AS w FROM documents)) GROUP BY bigram ORDER BY n DESC, bigram LIMIT 50")
def bigrams_top(spark, sf_dir):
    return decompose.bigrams(table(spark, sf_dir, "documents")).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(50)


@register(
    "document_shape",
    f"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {BLANKS}) <> '')) AS BIGINT) AS num_paragraphs, CAST(len({SENTS.format('text')}) AS BIGINT) AS num_sentences, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS num_words FROM documents",
)
def document_shape(spark, sf_dir):
    return decompose.shape(table(spark, sf_dir, "documents"), mark="\n")


@register("sentence_places", CTE + f"SELECT doc_id, CAST(si - 1 AS INTEGER) AS sent_id, context AS text, CAST(len({WORDS.format('context')}) AS INTEGER) AS n_tokens, CAST(coalesce(sum(len({WORDS.format('context')})) OVER (PARTITION BY doc_id ORDER BY si ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS first_pos FROM st")
def sentence_places(spark, sf_dir):
    return decompose.sentences(table(spark, sf_dir, "documents"))


@register("direct_match", CTE + "SELECT * FROM m")
def direct_match(spark, sf_dir):
    return _matches(spark, sf_dir)[2]


@register("match_context", CTE + ", c AS (SELECT doc_id, si, string_agg(context, ' ') OVER (PARTITION BY doc_id ORDER BY si ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ctx FROM st) SELECT p.doc_id, kw.keyword_set, CAST(pos AS INTEGER) AS position, ctx AS context FROM ps p JOIN kw ON lower(token) = kw_lc JOIN c ON c.doc_id = p.doc_id AND c.si = p.si")
def match_context(spark, sf_dir):
    docs, kw, _ = _matches(spark, sf_dir)
    return match.direct(docs, kw, context=1).select("doc_id", "keyword_set", "position", "context")


@register(
    "exposure_summary",
    CTE
    + """, n AS (SELECT keyword_set, count(*) AS total_keywords_searched FROM kw GROUP BY 1),
g AS (SELECT doc_id, keyword_set, count(DISTINCT keyword) AS k, count(*) AS c, count(DISTINCT context) AS s FROM m GROUP BY 1, 2)
SELECT d.doc_id, n.keyword_set, CAST(len(d.s) AS BIGINT) AS total_sentences_in_document, total_keywords_searched, coalesce(g.k, 0) AS total_keywords_with_matches, coalesce(g.c, 0) AS total_direct_matches,
CAST(0 AS BIGINT) AS total_cosine_matches, coalesce(g.s, 0) AS total_sentences_with_match, CASE WHEN len(d.s) > 0 THEN 100.0::DOUBLE * coalesce(g.s, 0) / len(d.s) ELSE 0.0 END AS percent_sentences_with_match
FROM d CROSS JOIN n LEFT JOIN g ON g.doc_id = d.doc_id AND g.keyword_set = n.keyword_set""",
)
def exposure_summary(spark, sf_dir):
    return exposure.direct_summary(table(spark, sf_dir, "documents").select("doc_id", "text"), keyword_table(spark))


@register("exposure_by_keyword", CTE + "SELECT d.doc_id, kw.keyword_set, kw.keyword, count(m.position) AS n FROM d CROSS JOIN kw LEFT JOIN m ON m.doc_id = d.doc_id AND m.keyword_set = kw.keyword_set AND m.keyword = kw.keyword GROUP BY ALL")
def exposure_by_keyword(spark, sf_dir):
    return exposure.by_keyword(*_matches(spark, sf_dir))


@register("exposure_unique", CTE + "SELECT doc_id, keyword_set, string_agg(DISTINCT lower(matched_text), '|' ORDER BY lower(matched_text)) AS texts FROM m GROUP BY ALL")
def exposure_unique(spark, sf_dir):
    return exposure.unique_matches(_matches(spark, sf_dir)[2]).withColumn("texts", F.array_join("texts", "|"))


@register("matches_by_sentence", CTE + "SELECT doc_id, keyword_set, context, count(*) AS n, string_agg(keyword, '|' ORDER BY position) AS keywords FROM m GROUP BY ALL")
def matches_by_sentence(spark, sf_dir):
    e = exposure.sentence_form(_matches(spark, sf_dir)[2]).select("doc_id", "keyword_set", F.explode("matches_by_sentence").alias("context", "v"))
    return e.select("doc_id", "keyword_set", "context", F.size("v.matches").cast("bigint").alias("n"), F.array_join(F.transform("v.matches", lambda x: x["keyword"]), "|").alias("keywords"))


@register("matches_by_word", CTE + "SELECT doc_id, keyword_set, keyword, count(*) AS n_direct, string_agg(position, ',' ORDER BY position) AS places FROM m GROUP BY ALL")
def matches_by_word(spark, sf_dir):
    e = exposure.word_form(_matches(spark, sf_dir)[2]).select("doc_id", "keyword_set", F.explode("matches").alias("keyword", "v"))
    return e.select("doc_id", "keyword_set", "keyword", F.size("v.direct_matches").cast("bigint").alias("n_direct"), F.array_join(F.transform("v.direct_matches", lambda x: x["position"].cast("string")), ",").alias("places"))


@register("keyword_dedup", "SELECT p_type AS keyword_set, p_partkey AS ord, p_name AS keyword, lower(p_name) AS kw_lc FROM part QUALIFY row_number() OVER (PARTITION BY p_type, lower(p_name) ORDER BY p_partkey) = 1")
def keyword_dedup(spark, sf_dir):
    return match.distinct_keywords(table(spark, sf_dir, "part").select(F.col("p_type").alias("keyword_set"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("keyword")))


_HEADS = "SELECT label AS ord, 'label' || label AS keyword, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL GROUP BY label"
_COS = f"WITH h AS ({_HEADS}), x AS (SELECT e.vec_id, CAST(h.ord AS BIGINT) AS ord, h.keyword, list_cosine_similarity(e.embedding::DOUBLE[], h.v) AS s FROM embeddings e CROSS JOIN h), c AS (SELECT vec_id, ord, keyword, CASE WHEN s > 0.99 THEN 'direct' ELSE 'cosine' END AS match_type, CASE WHEN s > 0.99 THEN 1.0 ELSE s END AS score FROM x WHERE s >= 0.3)"


def _close(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    heads = e.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return match.close(e, heads.select(F.col("label").alias("ord"), F.concat(F.lit("label"), F.col("label")).alias("keyword"), "vector"), 0.3)


@register("cosine_match", _COS + f" SELECT vec_id, ord, keyword, match_type, {near4('score')} AS score FROM c")
def cosine_match(spark, sf_dir):
    return _close(spark, sf_dir).withColumn("score", T.near4(F.col("score")))


@register("cosine_best", _COS + f" SELECT vec_id, ord, keyword, match_type, {near4('score')} AS score FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ord) = 1")
def cosine_best(spark, sf_dir):
    return match.best(_close(spark, sf_dir), "vec_id").withColumn("score", T.near4(F.col("score")))


@register(
    "bigram_range_anti",
    CTE + ", b AS (SELECT doc_id, pos, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS bigram, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM ps), m1 AS (SELECT DISTINCT doc_id, position FROM m WHERE keyword_set = 'alpha'), b2 AS (SELECT doc_id, CAST(pos AS INTEGER) AS position, bigram FROM b WHERE nx IS NOT NULL) SELECT * FROM b2 WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.doc_id = b2.doc_id AND abs(m1.position - b2.position) <= 1)",
)
def bigram_range_anti(spark, sf_dir):
    return match.pairs_apart(table(spark, sf_dir, "documents").select("doc_id", "text"), keyword_table(spark).where("keyword_set = 'alpha'"))


_PCT = "coalesce(floor(1e6 * {0} / nullif({1}, 0)::DOUBLE + 0.5) / 1e4, 0)"


@register(
    "sentence_overlap",
    CTE + f""", s AS (SELECT doc_id, context, max((keyword_set = 'alpha')::INT) AS a, max((keyword_set = 'beta')::INT) AS b FROM m GROUP BY 1, 2),
c AS (SELECT doc_id, CAST(sum(a) AS BIGINT) AS n_first, CAST(sum(b) AS BIGINT) AS n_second, count(*) AS n_union, CAST(sum(a * b) AS BIGINT) AS n_common FROM s GROUP BY 1)
SELECT *, {_PCT.format("n_common", "n_union")} AS pct_union, {_PCT.format("n_common", "n_first")} AS pct_first, {_PCT.format("n_common", "n_second")} AS pct_second FROM c""",
)
def sentence_overlap(spark, sf_dir):
    return compare.compare(_matches(spark, sf_dir)[2], "alpha", "beta")


_SHARED = ", s AS (SELECT doc_id, context AS sentence FROM m GROUP BY 1, 2 HAVING count(DISTINCT keyword_set) = 2), v AS (SELECT doc_id FROM m GROUP BY 1 HAVING count(DISTINCT keyword_set) = 2)"


@register("shared_sentences", CTE + _SHARED + " SELECT s.* FROM s JOIN v USING (doc_id)")
def shared_sentences(spark, sf_dir):
    return _shared(spark, sf_dir)[0]


@register("shared_counts", CTE + _SHARED + " SELECT v.doc_id, count(s.sentence) AS shared_sentences_count FROM v LEFT JOIN s USING (doc_id) GROUP BY 1")
def shared_counts(spark, sf_dir):
    return _shared(spark, sf_dir)[1]


_DAY = f"WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean_value FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, {near4('mean_value')} AS mean_value, {near4('avg(mean_value) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS rolling FROM d"


@register("shared_timeseries", _DAY)
def shared_timeseries(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "value")
    return compare.daily(e, "day", "value").withColumns({c: T.near4(F.col(c)) for c in ("mean_value", "rolling")}).withColumn("day", F.col("day").cast("string"))


@register("describe_stats", "SELECT count(value) AS n, " + ", ".join(f"{near4(x)} AS {n}" for x, n in (("avg(value)", "mean"), ("stddev_samp(value)", "std"), ("min(value)", "least"), ("quantile_cont(value, 0.25)", "q25"), ("quantile_cont(value, 0.5)", "q50"), ("quantile_cont(value, 0.75)", "q75"), ("max(value)", "most"))) + " FROM events")
def describe_stats(spark, sf_dir):
    d = compare.describe(table(spark, sf_dir, "events"), "value")
    return d.withColumns({c: T.near4(F.col(c)) for c in d.columns if c != "n"})


@register("date_range", "SELECT CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day FROM events")
def date_range(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"))


@register("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", "event_type")


@register("integrity_missing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def integrity_missing(spark, sf_dir):
    return batches.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@register("integrity_issues", "SELECT page_id AS doc_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def integrity_issues(spark, sf_dir):
    return batches.missing(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), table(spark, sf_dir, "labels"), "doc_id")


@register(
    "integrity_counts",
    "WITH e AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM e JOIN r USING (doc_id)) AS present, (SELECT count(*) FROM e ANTI JOIN r USING (doc_id)) AS missing, (SELECT count(*) FROM r ANTI JOIN e USING (doc_id)) AS issues, (SELECT count(*) FROM e) AS total_transcripts, (SELECT count(*) FROM labels) AS total_metadata_files",
)
def integrity_counts(spark, sf_dir):
    return batches.integrity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_pending(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "risk").alias("keyword_name"), F.lit("direct").alias("matching_method"))
    return batches.pending(table(spark, sf_dir, "documents").select("doc_id"), runs, "risk", "direct", "doc_id")


@register("batch_union", "SELECT s_acctbal AS acctbal, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_acctbal, c_name, c_mktsegment FROM customer")
def batch_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return batches.merged(s, table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal")))


_DIM = "WITH dim AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, CAST(NULL AS VARCHAR) AS ticker FROM nation), fresh AS (SELECT DISTINCT c_name AS name, c_mktsegment AS ticker FROM customer) SELECT * FROM dim UNION ALL SELECT (SELECT max(id) FROM dim) + row_number() OVER (ORDER BY name, ticker), name, ticker FROM fresh"


@register("company_dim", _DIM)
def company_dim(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("ticker"))
    return batches.with_ids(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("ticker")), dim, ["name", "ticker"])


@register("document_upsert", "WITH n AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey AS k, NULL::TIMESTAMP AS at, NULL::BIGINT AS orderkey, c_acctbal AS amount FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM n")
def document_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("amount"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("bigint").alias("orderkey"), F.col("c_acctbal").alias("amount"))
    return batches.upsert(c, o, ["k"])


@register("flatten_json", "SELECT event_id, event_type, TRY_CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT) AS k_int, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_float, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events")
def flatten_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", "event_type", T.safe_int(k).alias("k_int"), T.safe_float(k).alias("k_float"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


@register("meta_regex", "SELECT o_orderkey, nullif(regexp_extract(t, '(Q[1-4])\\s+(\\d{4})', 1), '') AS quarter, nullif(regexp_extract(t, '(Q[1-4])\\s+(\\d{4})', 2), '') AS year FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'no date' ELSE 'Call Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) END AS t FROM orders)")
def meta_regex(spark, sf_dir):
    t = F.when(F.col("o_orderstatus") == "F", "no date").otherwise(F.concat(F.lit("Call Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate")))
    q, y = dates.quarter_and_year(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", q.alias("quarter"), y.alias("year"))


@register("date_split", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '13:00:00' AS time, strftime(o_orderdate, '%-d-%b-%y') AS cut_day, '1:00pm GMT' AS cut_time, strftime(o_orderdate, '%d-%b-%y') || ' 01:00PM GMT' AS gmt FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3653 DAY AS o_orderdate FROM orders)")
def date_split(spark, sf_dir):
    s = F.concat(F.date_format(F.date_add("o_orderdate", 3653), "d-MMM-yy"), F.lit(" 1:00pm GMT"))
    (day, time), (cut, rest) = dates.day_and_time(F.col("s")), dates.cut_day_and_time(F.col("s"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", day.alias("day"), time.alias("time"), cut.alias("cut_day"), rest.alias("cut_time"), dates.gmt(F.col("s")).alias("gmt"))


_LEX = f"len(list_filter({{0}}, lambda x: list_contains({LISTS['p']}, lower(x))))", f"len(list_filter({{0}}, lambda x: list_contains({LISTS['n']}, lower(x))))"
_W = WORDS.format("text")
_HIV = " - ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(h) for h in own)}], lower(x))))" for own in HIV4)


@register("lexicon_score", f"SELECT doc_id, CAST({_LEX[0].format('w')} AS BIGINT) AS positive, CAST({_LEX[1].format('w')} AS BIGINT) AS negative, CAST({_LEX[0].format('w')} - {_LEX[1].format('w')} AS BIGINT) AS lm FROM (SELECT doc_id, coalesce({_W}, []) AS w FROM documents)")
def lexicon_score(spark, sf_dir):
    p, n = sentiment.lexicon(T.words(F.col("text")), POSITIVE, NEGATIVE)
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("positive"), n.alias("negative")).withColumn("lm", F.col("positive") - F.col("negative"))


_SIGN = f"CASE WHEN list_contains({LISTS['p']}, lower(token)) THEN 1 WHEN list_contains({LISTS['n']}, lower(token)) THEN -1 ELSE 0 END"


@register("ml_pairs", CTE + f", g AS (SELECT doc_id, si, wi, {_SIGN} AS a FROM tk), p AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id, si ORDER BY wi) AS b FROM g) SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN a = b THEN a ELSE 0 END), 0) AS BIGINT) AS ml FROM d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1")
def ml_pairs(spark, sf_dir):
    s = F.transform(T.sentences(F.col("text")), lambda x: sentiment.pair_score(T.words(x), POSITIVE, NEGATIVE))
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ml"))


@register(
    "sentiment_rollup",
    f"""WITH p AS (SELECT doc_id, par, unnest(list_filter([trim(q, {BLANKS})], lambda x: x <> '')) AS t FROM (SELECT doc_id, generate_subscripts(l, 1) AS par, unnest(l) AS q FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
s AS (SELECT doc_id, par, unnest({SENTS.format("t")}) AS text FROM p),
x AS (SELECT doc_id, par, coalesce(({_LEX[0].format("w")} - {_LEX[1].format("w")})::DOUBLE / nullif({_LEX[0].format("w")} + {_LEX[1].format("w")}, 0), 0) AS v, {_LEX[0].format("w")} - {_LEX[1].format("w")} AS lm, {_HIV} AS hv,
list_sum(list_transform(range(1, len(w)), lambda i: CASE WHEN list_contains({LISTS["p"]}, lower(w[i])) AND list_contains({LISTS["p"]}, lower(w[i + 1])) THEN 1 WHEN list_contains({LISTS["n"]}, lower(w[i])) AND list_contains({LISTS["n"]}, lower(w[i + 1])) THEN -1 ELSE 0 END)) AS ml FROM (SELECT doc_id, par, {_W} AS w FROM s)),
g AS (SELECT doc_id, par, avg(v) AS v, sum(lm) AS lm, sum(hv) AS hv, sum(ml) AS ml FROM x GROUP BY 1, 2)
SELECT d.doc_id, {near4("coalesce(avg(v), 0)")} AS sentiment, CAST(coalesce(sum(ml), 0) AS BIGINT) AS ml, CAST(coalesce(sum(lm), 0) AS BIGINT) AS lm, CAST(coalesce(sum(hv), 0) AS BIGINT) AS hiv4 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY 1""",
)
def sentiment_rollup(spark, sf_dir):
    r = sentiment.rolled_up(table(spark, sf_dir, "documents"), POSITIVE, NEGATIVE, mark="\n", hiv4=HIV4)
    return r.withColumn("sentiment", T.near4(F.col("sentiment")))


_COUNTS = f"SELECT doc_id, coalesce({_W}, []) AS w, len({SENTS.format('text')}) AS s, length(regexp_replace(text, '\\s', '', 'g')) AS c, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS l FROM documents"
_SYL = f"list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '{readability.VOWELS}')), 1))"
_READ = f"WITH a AS ({_COUNTS}), b AS (SELECT *, len(w)::DOUBLE AS n, {_SYL} AS y FROM a), c2 AS (SELECT *, coalesce(list_sum(y), 0)::DOUBLE AS sy, len(list_filter(y, lambda v: v >= 3))::DOUBLE AS px FROM b)"


@register(
    "readability",
    _READ + " SELECT doc_id, " + ", ".join(f"CASE WHEN n > 0 AND s > 0 THEN {near4(e)} ELSE 0 END AS {k}" for k, e in {"coleman_liau_index": "0.0588 * (100 * l / n) - 0.296 * (100 * s / n) - 15.8", "automated_readability_index": "4.71 * c / n + 0.5 * n / s - 21.43", "flesch_reading_ease": "206.835 - 1.015 * n / s - 84.6 * sy / n", "flesch_kincaid_grade": "0.39 * n / s + 11.8 * sy / n - 15.59", "gunning_fog": "0.4 * (n / s + 100 * px / n)", "smog_index": "CASE WHEN s >= 3 THEN 1.043 * sqrt(30 * px / s) + 3.1291 ELSE 0 END"}.items()) + " FROM c2",
)
def readability_indices(spark, sf_dir):
    r = readability.indices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", *[T.near4(F.col(c)).alias(c) for c in ("coleman_liau_index", "automated_readability_index", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index")])


_HARD = f"len(list_filter(list_distinct(list_transform(w, lambda x: lower(x))), lambda x: greatest(len(regexp_extract_all(x, '{readability.VOWELS}')), 1) >= 2))"
_ALL = {
    "flesch_reading_ease": "206.835 - 1.015 * n / s - 84.6 * sy / n",
    "flesch_kincaid_grade": "0.39 * n / s + 11.8 * sy / n - 15.59",
    "smog_index": "CASE WHEN s >= 3 THEN 1.043 * sqrt(30 * px / s) + 3.1291 ELSE 0 END",
    "coleman_liau_index": "0.0588 * (100 * l / n) - 0.296 * (100 * s / n) - 15.8",
    "automated_readability_index": "4.71 * c / n + 0.5 * n / s - 21.43",
    "dale_chall_readability_score": "0.1579 * (hd / n * 100) + 0.0496 * n / s + CASE WHEN hd / n * 100 > 5 THEN 3.6365 ELSE 0 END",
    "linsear_write_formula": "CASE WHEN li / s > 20 THEN li / s / 2 ELSE (li / s - 2) / 2 END",
    "gunning_fog": "0.4 * (n / s + 100 * px / n)",
}
_GRADES = ", ".join(f"CAST(round({g}) AS INTEGER)" for g in readability.GRADES)


@register(
    "readability_all",
    _READ + f""", h AS (SELECT *, {_HARD}::DOUBLE AS hd, coalesce(list_sum(list_transform(y[1:100], lambda v: CASE WHEN v >= 3 THEN 3 ELSE 1 END)), 0)::DOUBLE AS li FROM c2),
e AS (SELECT doc_id, n, s, c, l, sy, px, hd, {", ".join(f"CASE WHEN n > 0 AND s > 0 THEN {e} ELSE 0 END AS {k}" for k, e in _ALL.items())} FROM h),
q AS (SELECT doc_id, list_sort([{_GRADES}]) AS gs FROM e),
m AS (SELECT doc_id, list_sort(list_transform(list_distinct(gs), lambda g: {{'n': -len(list_filter(gs, lambda x: x = g)), 'g': g}}))[1].g AS g FROM q)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(s AS BIGINT) AS n_sentences, CAST(coalesce(c, 0) AS BIGINT) AS n_chars, CAST(coalesce(l, 0) AS BIGINT) AS n_letters, CAST(sy AS BIGINT) AS n_syllables, CAST(px AS BIGINT) AS n_complex, CAST(hd AS BIGINT) AS difficult_words,
{", ".join(f"{near4(k)} AS {k}" for k in _ALL)}, (g - 1) || 'th and ' || g || 'th grade' AS text_standard FROM e JOIN m USING (doc_id)""",
)
def readability_all(spark, sf_dir):
    r = readability.indices(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return r.withColumns({c: T.near4(F.col(c)) for c in _ALL})


def _calls(spark, sf_dir):
    """Conversations as transcript bodies."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.concat(F.lit("--------\n"), F.col("role"), F.lit("\n--------\n"), F.col("text")).alias("t"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "\n").alias("turns"))
    return g.select("conv_id", F.concat(F.lit("title\n========\nPresentation\n--------\n"), F.col("turns"), F.lit("\n========\nQuestions and Answers\n--------\n"), F.col("turns")).alias("body"))


_CALLS = """
WITH RECURSIVE tx AS (SELECT conv_id, string_agg('--------' || chr(10) || role || chr(10) || '--------' || chr(10) || text, chr(10) ORDER BY turn) AS turns FROM conversations GROUP BY 1),
bd AS (SELECT conv_id, 'title' || chr(10) || '========' || chr(10) || 'Presentation' || chr(10) || '--------' || chr(10) || turns || chr(10) || '========' || chr(10) || 'Questions and Answers' || chr(10) || '--------' || chr(10) || turns AS body FROM tx),
ln AS (SELECT conv_id, string_split_regex(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]') AS a FROM bd),
st AS (SELECT conv_id, a, list_transform(a, lambda x: trim(x, @blanks)) AS z FROM ln),
pt AS (SELECT conv_id, a, list_position(z, 'Presentation') AS p, list_position(list_transform(z, lambda x: regexp_full_match(lower(x), 'questions and answers|q&a')), true) AS q, list_position(list_transform(z, lambda x: regexp_full_match(lower(x), 'questions and answers|q&a|operator')), true) AS e FROM st),
se AS (SELECT conv_id, CASE WHEN p > 0 AND (coalesce(e, 0) = 0 OR e > p) THEN trim(array_to_string(a[p + 1:(CASE WHEN e > 0 THEN e - 1 ELSE len(a) END)], chr(10)), @blanks) ELSE '' END AS pres, CASE WHEN q > 0 THEN trim(array_to_string(a[q + 1:], chr(10)), @blanks) ELSE '' END AS qa FROM pt),
tl AS (SELECT conv_id, string_split(pres || chr(10) || chr(10) || qa, chr(10)) AS a FROM se),
sp AS (SELECT conv_id, i FROM (SELECT conv_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM tl) WHERE regexp_full_match(trim(x, @blanks), '[-=]{5,}')),
tk AS (SELECT conv_id, min(i) AS i FROM sp GROUP BY 1 UNION ALL SELECT tk.conv_id, (SELECT min(sp.i) FROM sp WHERE sp.conv_id = tk.conv_id AND sp.i > tk.i + 2) FROM tk WHERE tk.i IS NOT NULL),
tg AS (SELECT conv_id, list(i) AS g FROM tk WHERE i IS NOT NULL GROUP BY 1)
""".replace("@blanks", BLANKS)


@register("section_clean", _CALLS + f"SELECT tl.conv_id, trim(array_to_string(list_filter(a, lambda x, i: NOT (list_contains(coalesce(g, []), i) OR list_contains(coalesce(g, []), i - 1) OR list_contains(coalesce(g, []), i - 2))), chr(10)), {BLANKS}) AS text FROM tl LEFT JOIN tg ON tg.conv_id = tl.conv_id")
def section_clean(spark, sf_dir):
    return _calls(spark, sf_dir).select("conv_id", sections.match_text(F.col("body")).alias("text"))


_FEAT = f"SELECT conv_id, role, {_W} AS w, {SENTS.format('text')} AS s, text FROM conversations"


@register(
    "section_features",
    f"WITH f AS ({_FEAT}), g AS (SELECT conv_id, role, sum(len(w)) AS n, sum(len(s)) AS s, sum(len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')))) AS d, sum(len(list_filter(w, lambda x: list_contains(['we','us','our','ours','ourselves'], lower(x))))) AS we, sum(length(text) - length(replace(text, '?', ''))) AS q, sum({_LEX[0].format('w')}) AS p, sum({_LEX[1].format('w')}) AS ng FROM f GROUP BY 1, 2) SELECT conv_id, role, CAST(n AS BIGINT) AS word_count, CAST(s AS BIGINT) AS sentence_count, {near4('coalesce(d / nullif(n, 0)::DOUBLE, 0)')} AS numeric_ratio, {near4('coalesce(we / nullif(n, 0)::DOUBLE, 0)')} AS plural_pronouns, CAST(q AS BIGINT) AS question_marks, CAST(p AS BIGINT) AS lm_positive, CAST(ng AS BIGINT) AS lm_negative, CAST(p - ng AS BIGINT) AS lm_net_sentiment, {near4('(p - ng)::DOUBLE / (p + ng + 1e-6)')} AS lm_polarity, {near4('coalesce((p + ng)::DOUBLE / nullif(n, 0), 0)')} AS lm_subjectivity FROM g",
)
def section_features(spark, sf_dir):
    f = vault.features(table(spark, sf_dir, "conversations"), ["conv_id", "role"], POSITIVE, NEGATIVE)
    return f.withColumns({c: T.near4(F.col(c)) for c in ("numeric_ratio", "plural_pronouns", "lm_polarity", "lm_subjectivity")})


@register("vault_pivot", f"SELECT conv_id, " + ", ".join(f"CAST(coalesce(sum(len(s)) FILTER (role = '{r}'), 0) AS BIGINT) AS {r}_sentence_count, CAST(coalesce(sum(len(w)) FILTER (role = '{r}'), 0) AS BIGINT) AS {r}_word_count" for r in ("system", "user", "assistant")) + f" FROM ({_FEAT}) GROUP BY 1")
def vault_pivot(spark, sf_dir):
    f = vault.features(table(spark, sf_dir, "conversations"), ["conv_id", "role"], POSITIVE, NEGATIVE)
    return vault.wide(f, "conv_id", "role", ["system", "user", "assistant"], ["sentence_count", "word_count"]).fillna(0)


@register("label_shares", f"SELECT event_type, count(*) FILTER (x = 'positive') AS positive_count, count(*) FILTER (x = 'neutral') AS neutral_count, count(*) FILTER (x = 'negative') AS negative_count, " + ", ".join(f"{_PCT.format(f'''count(*) FILTER (x = '{n}')''', 'count(x)')} AS {n}_percentage" for n in ("positive", "neutral", "negative")) + " FROM (SELECT event_type, CASE WHEN value > 20 THEN 'positive' WHEN value > 5 THEN 'neutral' ELSE 'negative' END AS x FROM events) GROUP BY 1")
def label_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 20, "positive").when(F.col("value") > 5, "neutral").otherwise("negative").alias("label"))
    return vault.label_shares(e, ["event_type"])


@register("word_set_stats", "WITH a AS (SELECT DISTINCT p_name AS w FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_name AS w FROM part WHERE p_size > 10) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a SEMI JOIN b USING (w)) AS n_common, (SELECT count(*) FROM a ANTI JOIN b USING (w)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (w)) AS only_b, (SELECT count(*) FROM a ANTI JOIN b USING (w)) = 0 AS a_in_b")
def word_set_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), "p_size")
    return compare.word_sets(p.where("p_size <= 25").select("word"), p.where("p_size > 10").select("word"))


@register("bigram_shape", "SELECT p_partkey, regexp_full_match(p_name, '\\s*[\\p{L}\\p{N}]+\\s+[\\p{L}\\p{N}]+\\s*') AS pair, regexp_full_match(p_name || ' x', '\\s*[\\p{L}\\p{N}]+\\s+[\\p{L}\\p{N}]+\\s*') AS longer FROM part")
def bigram_shape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.is_bigram(F.col("p_name")).alias("pair"), T.is_bigram(F.concat("p_name", F.lit(" x"))).alias("longer"))


_SUM = SQL["exposure_summary"]


def _exposures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    x = exposure.direct_summary(docs.select("doc_id", "text"), keyword_table(spark))
    meta = docs.select("doc_id", F.col("source").alias("company_name"), F.lit(None).cast("string").alias("company_ticker"), F.concat("lang", F.lit(" 1:00pm GMT")).alias("start_date"))
    return reports.exposure_rows(x, meta, "doc_id")


@register("exposure_rows", f"SELECT e.doc_id, keyword_set AS keyword_name, total_keywords_searched, total_keywords_with_matches, total_direct_matches, total_cosine_matches, total_direct_matches + total_cosine_matches AS total_matches, source AS company_name, NULL::VARCHAR AS company_ticker, lang AS date, CASE WHEN lang IS NOT NULL THEN '1:00pm GMT' ELSE '' END AS time, NULL::VARCHAR AS match_id, 'direct' AS matching_method FROM ({_SUM}) e JOIN documents USING (doc_id)")
def exposure_rows(spark, sf_dir):
    return _exposures(spark, sf_dir)


@register("corpus_totals", f"SELECT count(*) AS total_calls, count(*) FILTER (shared_sentences_count > 0) AS calls_with_shared, CAST(coalesce(sum(shared_sentences_count), 0) AS BIGINT) AS total_shared FROM ({SQL['shared_counts']})")
def corpus_totals(spark, sf_dir):
    return reports.corpus_totals(_shared(spark, sf_dir)[1])


@register("shared_summary", f"SELECT d.doc_id, d.source, shared_sentences_count FROM documents d JOIN ({SQL['shared_counts']}) c USING (doc_id)")
def shared_summary(spark, sf_dir):
    return reports.with_shared_counts(table(spark, sf_dir, "documents").select("doc_id", "source"), _shared(spark, sf_dir)[1], "doc_id")


@register(
    "shared_series",
    f"WITH j AS (SELECT DATE '2016-01-01' + CAST(d.doc_id % 365 AS INTEGER) AS day, shared_sentences_count AS v FROM documents d JOIN ({SQL['shared_counts']}) c USING (doc_id)), g AS (SELECT day, avg(v) AS m FROM j GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, {near4('m')} AS mean_value, {near4('avg(m) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS rolling FROM g",
)
def shared_series(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.date_add(F.lit("2016-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("day"))
    r = compare.daily(reports.with_shared_counts(d, _shared(spark, sf_dir)[1], "doc_id"), "day", "shared_sentences_count")
    return r.select(F.col("day").cast("string").alias("day"), *[T.near4(F.col(c)).alias(c) for c in ("mean_value", "rolling")])


@register("stored_or_named", "SELECT o_orderkey AS file_name, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN 'p' || o_custkey WHEN o_orderkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN 'p' || o_orderkey END AS transcript_path FROM orders")
def stored_or_named(spark, sf_dir):
    files = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 > 0).select(F.col("c_custkey").alias("name"), F.concat(F.lit("p"), "c_custkey").alias("path"))
    return reports.stored_or_named(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_name"), F.concat(F.lit("p"), "o_custkey").alias("file_path")), files)


@register("upload_outcomes", "SELECT CASE WHEN coalesce(source, '') = '' THEN 'skipped' WHEN lang <> 'en' THEN 'error' WHEN doc_id % 7 = 0 THEN 'skipped' ELSE 'success' END AS status, CASE WHEN coalesce(source, '') = '' THEN 'No company name' WHEN lang <> 'en' THEN 'Could not create company' WHEN doc_id % 7 = 0 THEN 'No source file' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def upload_outcomes(spark, sf_dir):
    status, reason = reports.upload_outcome(F.col("source"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")), F.col("lang") == "en")
    return reports.outcomes(table(spark, sf_dir, "documents").select(status.alias("status"), reason.alias("reason")))


@register("upload_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%dT13:05:00+00:00') END AS event_date FROM orders")
def upload_dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "dd-MMM-yy")
    s = F.when(F.col("o_orderstatus") == "F", F.concat(d, F.lit(" 01:05PM EST"))).when(F.col("o_orderstatus") == "P", F.concat(d, F.lit(" 13:05 GMT"))).otherwise(F.concat(F.lit("on "), d))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.upload_date(s).alias("event_date"))


@register("risk_share", CTE + f", s AS (SELECT doc_id, context, max((keyword_set = 'alpha')::INT) AS e, max((keyword_set = 'beta')::INT) AS r FROM m GROUP BY 1, 2), g AS (SELECT doc_id, count(*) AS exposure_count, sum(r) AS r FROM s WHERE e = 1 GROUP BY 1) SELECT doc_id, exposure_count, {_PCT.format('r', 'exposure_count')} AS risk_percentage FROM g")
def risk_share(spark, sf_dir):
    return vault.risk_share(_matches(spark, sf_dir)[2], ["doc_id"], "alpha", "beta")


_SECTION = SQL["readability_all"].replace("FROM documents", "FROM (SELECT conv_id || '/' || role AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id, role)")


@register("section_readability", f"SELECT doc_id, {', '.join(vault.VAULT_INDICES)} FROM ({_SECTION})")
def section_readability(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    r = vault.section_readability(g.select(F.concat("conv_id", F.lit("/"), "role").alias("doc_id"), "text"), ["doc_id"])
    return r.withColumns({k: T.near4(F.col(k)) for k in vault.VAULT_INDICES if k != "text_standard"})


@register("word_forms", "WITH k AS (SELECT keyword_set, ord, keyword FROM " + KEYS + "), f AS (SELECT n_name AS word, n_name || 's' AS form FROM nation UNION ALL SELECT keyword, keyword || 'like' FROM k UNION ALL SELECT keyword, upper(keyword) FROM k), x AS (SELECT DISTINCT k.keyword_set, 5 + k.ord AS ord, f.form AS keyword FROM k JOIN f ON lower(f.word) = lower(k.keyword) WHERE lower(f.form) <> lower(k.keyword)), u AS (SELECT * FROM k UNION ALL SELECT * FROM x) SELECT keyword_set, CAST(ord AS BIGINT) AS ord, keyword FROM u QUALIFY row_number() OVER (PARTITION BY keyword_set, lower(keyword) ORDER BY ord, keyword) = 1")
def word_forms(spark, sf_dir):
    k = keyword_table(spark)
    f = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.concat("n_name", F.lit("s")).alias("form")).union(k.select("keyword", F.concat("keyword", F.lit("like")))).union(k.select("keyword", F.upper("keyword")))
    return match.with_variations(k, f)


@register("comparison_json", CTE + ", s AS (SELECT doc_id, context, max((keyword_set = 'alpha')::INT) AS a, max((keyword_set = 'beta')::INT) AS b FROM m GROUP BY 1, 2) SELECT doc_id, CAST(sum(a * b) AS BIGINT) AS n_common, string_agg(context, '|' ORDER BY context) FILTER (a * b = 1) AS sentences FROM s GROUP BY 1")
def comparison_json(spark, sf_dir):
    m = _matches(spark, sf_dir)[2]
    j = reports.comparison_document(compare.sentence_map(m), compare.compare(m, "alpha", "beta"), "alpha", "beta")
    x = F.from_json("json", "metadata struct<common_sentences_with_matches: bigint>, by_sentence map<string, struct<file1: struct<keywords: array<string>>>>")
    names = F.array_sort(F.map_keys("x.by_sentence"))
    return j.select("doc_id", x.alias("x")).select("doc_id", F.col("x.metadata.common_sentences_with_matches").alias("n_common"), F.when(F.size(names) > 0, F.array_join(names, "|")).alias("sentences"))


@register("metadata_issues", "SELECT 'm' || o_orderkey AS path, CASE WHEN o_orderstatus = 'O' THEN 'c' || o_custkey END AS file_name, CASE WHEN o_orderstatus = 'F' THEN 'TOML error: bad' WHEN o_orderstatus = 'P' THEN 'Missing document.file_name' ELSE 'File not found in earnings_calls_dir' END AS reason FROM orders WHERE o_orderstatus <> 'O' OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def metadata_issues(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("c"), "o_custkey")).alias("file_name"), F.when(F.col("o_orderstatus") == "F", "bad").alias("error"))
    there = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0).select(F.concat(F.lit("c"), "c_custkey").alias("file_name"))
    return reports.metadata_issues(meta, there)
