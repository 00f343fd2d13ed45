"""Registered queries, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Ingest, Llm, Stats
from tidemark.functions import dates as D
from tidemark.functions import statistics as S
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import embed, extract, findings, ingest, predict, themes
from tidemark.plans.views import CLEANED, LONG, RECORDS, documents, records, sql_canon, sql_display, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


SETTINGS = Ingest(min_tokens=5)
STATS = Stats(min_theme_count_for_test=30)


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_records(records(spark, d), SETTINGS, F.col("_raw_date"))


# Ingest.


@query(f"WITH {CLEANED} SELECT strftime(date, '%Y-%m') AS year_month, category, count(*) AS n FROM nr GROUP BY ALL")
def clean_records_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).groupBy("year_month", "category").agg(F.count("*").alias("n"))


@query(f"WITH {CLEANED} SELECT record_id, text, text_clean, category, source, _ord, doc_id, date, strftime(date, '%Y-%m') AS year_month, strftime(date, '%G-W%V') AS week FROM nr")
def canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("record_id", "text", "text_clean", "category", "source", "_ord", "doc_id", "date", "year_month", "week")


@query(f"WITH {RECORDS} SELECT record_id, sha256(text) AS display_sha, sha256(text_clean) AS clean_sha, sha256({sql_canon('text')}) AS canonical_sha, length(text) AS n_chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INTEGER AS n_tokens FROM rec")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.select("record_id", F.sha2("text", 256).alias("display_sha"), F.sha2("text_clean", 256).alias("clean_sha"), F.lower(F.hex(T.canonical_digest(F.col("text")))).alias("canonical_sha"), F.length("text").cast("long").alias("n_chars"), T.count_words(F.col("text")).alias("n_tokens"))


@query(f"WITH {RECORDS} SELECT record_id, category FROM rec WHERE {LONG.replace('>= 5', '>= 60')}")
def min_tokens_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.filter_min_tokens(records(spark, d), 60).select("record_id", "category")


@query(f"""WITH {CLEANED}, f AS (SELECT 1 AS step, 'min tokens' AS label, (SELECT count(*) FROM rec) AS before, (SELECT count(*) FROM long) AS after
UNION ALL SELECT 2, 'exact duplicates', (SELECT count(*) FROM long), (SELECT count(*) FROM ex) UNION ALL SELECT 3, 'near duplicates', (SELECT count(*) FROM ex), (SELECT count(*) FROM nr)
UNION ALL SELECT 4, 'invalid dates', (SELECT count(*) FROM nr), (SELECT count(*) FROM nr WHERE doc_id % 50 <> 7))
SELECT step::INTEGER AS step, label, before, after, before - after AS dropped, round((before - after) * 100.0::DOUBLE / before, 6) AS pct_dropped FROM f""")
def quality_funnel(spark: SparkSession, d: str) -> DataFrame:
    return ingest.quality_funnel(records(spark, d), SETTINGS, F.col("doc_id") % 50 != 7)


@query("""SELECT 'toxic' AS "column", round(avg((toxic IS NULL)::INTEGER), 9) AS null_rate FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', round(avg((lang IS NULL)::INTEGER), 9) FROM documents LEFT JOIN labels USING (doc_id)""")
def null_rates(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return ingest.null_rates(joined, ["toxic", "lang"])


@query("SELECT lang AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ingest.distribution(table(spark, d, "documents"), "lang")


@query("SELECT min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_months FROM orders")
def date_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ingest.coverage(table(spark, d, "orders").withColumnRenamed("o_orderdate", "date"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def year_month_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", D.year_month(F.col("o_orderdate")).alias("year_month"), D.iso_week(F.col("o_orderdate")).alias("week"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('day', ts) END AS parsed FROM events""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "not a date").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "MM/dd/yyyy"))
    return table(spark, d, "events").select("event_id", D.parse_date(raw).cast("timestamp_ntz").alias("parsed"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(concat(source, ' Bank of ', lang, ' National', doc_id % 7, ' Inc.')), '[a-z0-9]+'),
 lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in T.COMPANY_STOP_WORDS)})))), ',') AS tokens,
 trim(regexp_replace(regexp_replace('a ' || source || ' fee, ' || upper(source) || ' and ' || source || 'x', '\b' || source || '\b', ' ', 'g'), ' +', ' ', 'g')) AS stripped FROM documents""")
def strip_company(spark: SparkSession, d: str) -> DataFrame:
    company = F.concat("source", F.lit(" Bank of "), "lang", F.lit(" National"), (F.col("doc_id") % 7).cast("string"), F.lit(" Inc."))
    sentence = F.concat(F.lit("a "), "source", F.lit(" fee, "), F.upper("source"), F.lit(" and "), "source", F.lit("x"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.company_tokens(company)), ",").alias("tokens"), T.strip_company(sentence, F.col("source")).alias("stripped"))


# Samples.


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_records(spark: SparkSession, d: str) -> DataFrame:
    return extract.sample_records(table(spark, d, "documents").select("doc_id"), 100, 42, "doc_id")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents) WHERE r <= round_even(0.1 * c, 0)""")
def stratified_slice(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.samples import stratified

    return stratified(table(spark, d, "documents").select("doc_id", "lang"), "lang", 0.1, 42, "doc_id")


# Themes.

_ORDERS = "t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE -1 END AS theme_id, strftime(o_orderdate, '%Y-%m') AS year_month, o_orderdate, o_totalprice FROM orders)"
_PREVALENCE = f"{_ORDERS}, pc AS (SELECT year_month, theme_id, count(*) AS n_docs FROM t WHERE theme_id <> -1 GROUP BY year_month, theme_id), p AS (SELECT *, round(n_docs / sum(n_docs) OVER (PARTITION BY year_month), 9) AS share FROM pc)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as themed records: four priorities are themes, the fifth the outliers."""
    p = F.col("o_orderpriority")
    theme = F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).when(p == "4-NOT SPECIFIED", 3).otherwise(-1)
    return table(spark, d, "orders").select("o_orderkey", theme.alias("theme_id"), D.year_month(F.col("o_orderdate")).alias("year_month"), "o_orderdate", "o_totalprice")


@query(f"WITH {_PREVALENCE} SELECT year_month, theme_id::INTEGER AS theme_id, n_docs, share FROM p")
def prevalence_over_time(spark: SparkSession, d: str) -> DataFrame:
    return themes.prevalence(_orders(spark, d))


_TERMS = r"""tok AS (SELECT lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE lang <> 'de'),
c AS (SELECT lang, term, count(*) AS tc FROM tok GROUP BY ALL), w AS (SELECT lang, sum(tc) AS wc FROM c GROUP BY lang), ft AS (SELECT term, sum(tc) AS ft FROM c GROUP BY term),
s AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS theme_id, term, round(tc / wc * ln(1 + (SELECT sum(wc) / count(*) FROM w) / ft), 9) AS score FROM c JOIN w USING (lang) JOIN ft USING (term)),
k AS (SELECT theme_id, term, score, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, term) AS rank FROM s WHERE score > 0)"""


def _language_theme() -> Column:
    return F.when(F.col("lang") == "de", -1).when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)


@query(f"WITH {_TERMS} SELECT theme_id::INTEGER AS theme_id, term, score, rank::INTEGER AS rank FROM k WHERE rank <= 10")
def ctfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    return themes.ctfidf(table(spark, d, "documents"), _language_theme(), F.col("text"), 10)


@query(f"""WITH {_TERMS}, n AS (SELECT CASE lang WHEN 'de' THEN -1 WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS theme_id, count(*) AS n_docs FROM documents GROUP BY 1),
j AS (SELECT theme_id, string_agg(term, ', ' ORDER BY rank) AS kw, string_agg(CASE WHEN rank <= 4 THEN term END, ', ' ORDER BY rank) AS l FROM k WHERE rank <= 10 GROUP BY theme_id)
SELECT n.theme_id::INTEGER AS theme_id, CASE WHEN n.theme_id = -1 THEN 'Outliers / unclustered' ELSE l END AS label, coalesce(kw, '') AS keywords, n_docs, round(n_docs / (SELECT sum(n_docs) FROM n), 9) AS share, n.theme_id = -1 AS is_outlier FROM n LEFT JOIN j USING (theme_id)""")
def theme_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = themes.ctfidf(docs, _language_theme(), F.col("text"), 10)
    return themes.summary(docs.select(_language_theme().alias("theme_id")), words).withColumn("keywords", F.array_join("keywords", ", "))


_CENTROIDS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 9), m AS (SELECT label, i, avg(v[i]) AS x FROM e, generate_series(1, 64) g(i) GROUP BY label, i), cen AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("theme_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))


@query(f"WITH {_CENTROIDS} SELECT label::INTEGER AS theme_id, (i - 1)::INTEGER AS pos, round(x, 6) AS x FROM m")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return themes.centroids(_vectors(spark, d)).select("theme_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_CENTROIDS}, x AS (SELECT e.label AS theme_id, vec_id, round(sqrt(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance FROM e JOIN cen ON e.label = cen.label)
SELECT theme_id::INTEGER AS theme_id, vec_id, distance, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY distance, vec_id) AS r FROM x) WHERE r <= 5""")
def representative_docs(spark: SparkSession, d: str) -> DataFrame:
    return themes.representatives(_vectors(spark, d), 5, "vec_id")


@query("""WITH x AS (SELECT vec_id, label, round(embedding[1]::DOUBLE * embedding[1]::DOUBLE, 9) AS distance FROM embeddings), q AS (SELECT quantile_cont(distance, 0.95) AS cut, max(distance) AS far FROM x)
SELECT vec_id, (CASE WHEN distance > cut THEN -1 ELSE label END)::INTEGER AS theme_id, round(1 - distance / far, 6) AS probability FROM x, q""")
def outlier_rule(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("embedding", F.lit(0)).cast("double")
    x = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("theme_id"), F.round(first * first, 9).alias("distance"))
    return themes.outliers(x, 0.05).select("vec_id", "theme_id", F.round("probability", 6).alias("probability"))


@query()
def kmeans_themes(spark: SparkSession, d: str) -> DataFrame:
    placed = themes.kmeans(table(spark, d, "embeddings"), 8)
    return themes.outliers(placed, 0.05).select("vec_id", "theme_id", "probability")


@query()
def density_themes(spark: SparkSession, d: str) -> DataFrame:
    return themes.density(table(spark, d, "embeddings"), 15, 10, "vec_id")


# Embeddings.


@query("SELECT doc_id, sha1('hashing-256' || chr(0) || text) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.content_hash("hashing-256", F.col("text")).alias("hash"))


@query("""WITH h AS (SELECT DISTINCT sha1('hashing-256' || chr(0) || text) AS hash, text FROM documents) SELECT hash, length(text) AS n_chars FROM h WHERE hash NOT IN (SELECT sha1('hashing-256' || chr(0) || text) FROM documents WHERE doc_id % 3 = 0)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select(V.content_hash("hashing-256", F.col("text")).alias("hash"), F.lit("hashing-256").alias("tag")).distinct()
    return embed.misses(docs, cache, "hashing-256").select("hash", F.length("text").cast("long").alias("n_chars"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || '_' || z[2]) ELSE [] END)) AS tok FROM w)
SELECT doc_id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*) AS n FROM t GROUP BY ALL""")
def hash_embed_md5(spark: SparkSession, d: str) -> DataFrame:
    return V.hashed_counts(table(spark, d, "documents"), "doc_id", "text", 256)


@query()
def hashing_embedder(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    made = embed.embed_records(spark, docs, embed.HashingEmbedder(256))
    return made.select("record_id", F.posexplode("embedding").alias("pos", "x")).where("x <> 0").withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, greatest(round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6), 0) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "embeddings")
    target = index.where("vec_id = 0").first()["embedding"]
    return embed.nearest(index, target, 10, "vec_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT query_id, vec_id, greatest(round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6), 0) AS distance FROM embeddings, q)
SELECT query_id, vec_id, distance, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM x) WHERE r <= 5""")
def semantic_search_many(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return embed.nearest_many(index, asked, 5, "vec_id")


# Extraction.

_KEYWORDS = [("german", ("der", "und")), ("licence", ("license",)), ("french", ("les", "eau")), ("english", ("with", "the"))]
_VOCABULARY = ["german", "licence", "english", "other"]
_ESCALATION = ("scum", "trash", "urgent")


def _like(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


_CLASSIFIED = f"""cl AS (SELECT doc_id, text, lang, 'negative' AS sentiment_label, CASE WHEN {_like(_ESCALATION)} THEN -0.9 ELSE -0.6 END::DOUBLE AS sentiment_score,
 CASE {' '.join(f"WHEN {_like(w)} THEN '{c}'" for c, w in _KEYWORDS if c in _VOCABULARY)} ELSE 'other' END AS issue_category, CASE WHEN {_like(_ESCALATION)} THEN 'high' ELSE 'medium' END AS severity, true AS is_actionable FROM documents)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    c = extract.classify(F.col("text"), _VOCABULARY, _KEYWORDS, _ESCALATION)
    return table(spark, d, "documents").select("doc_id", "text", "lang", c.alias("c")).select("doc_id", "text", "lang", "c.*")


@query(f"WITH {_CLASSIFIED} SELECT * EXCLUDE (text, lang) FROM cl")
def mock_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).drop("text", "lang")


@query()
def mock_variants(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return extract.mock_variants(docs, Llm().controlled_vocab, ["v1", "v2", "v3"]).groupBy("variant", "issue_category").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, length(text) // 4 AS i, length(source) // 4 AS o FROM documents) SELECT doc_id, i AS input_tokens, o AS output_tokens, round(i / 1000.0::DOUBLE * 0.001::DOUBLE + o / 1000.0::DOUBLE * 0.005::DOUBLE, 9) AS cost_usd FROM c""")
def response_cost(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", extract.token_count(F.col("text")).alias("input_tokens"), extract.token_count(F.col("source")).alias("output_tokens"))
    return t.withColumn("cost_usd", F.round(extract.response_cost(F.col("input_tokens"), F.col("output_tokens"), Llm()), 9))


@query("""WITH f AS (SELECT avg(length(text) / 4::DOUBLE) AS a FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 50)) SELECT round(a, 6) AS avg_input_tokens, round(2000 * (a / 1000 * 0.001::DOUBLE + 80 / 1000.0::DOUBLE * 0.005::DOUBLE), 6) AS estimate_usd FROM f""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    e = extract.estimate_cost(table(spark, d, "documents"), 2000, Llm(), "text", "doc_id")
    return e.select(F.round("avg_input_tokens", 6).alias("avg_input_tokens"), F.round("estimate_usd", 6).alias("estimate_usd"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.lit(True).alias("ok"))
    return extract.remaining(table(spark, d, "documents").select("doc_id", "lang"), done, "doc_id")


@query("""WITH c AS (SELECT doc_id, (length(text) // 4) / 1000.0::DOUBLE * 0.001::DOUBLE AS cost FROM documents), s AS (SELECT doc_id, round(coalesce(sum(cost) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS spent_before FROM c) SELECT doc_id, spent_before FROM s WHERE spent_before < 0.05""")
def spend_cap(spark: SparkSession, d: str) -> DataFrame:
    planned = table(spark, d, "documents").select("doc_id", (extract.token_count(F.col("text")) / 1000.0 * 0.001).alias("cost"))
    return extract.within_cap(planned, "cost", "doc_id", 0.05).select("doc_id", "spent_before")


_RAW = """CASE doc_id % 6 WHEN 0 THEN '```json' || chr(10) || '{"sentiment_label": " NEGATIVE", "sentiment_score": -' || doc_id || ', "issue_category": "x", "severity": "High", "is_actionable": true}' || chr(10) || '```'
WHEN 1 THEN 'Sure: {"sentiment_label": "neutral", "sentiment_score": "0.5", "issue_category": "other", "severity": "low", "is_actionable": "false"} done' WHEN 2 THEN '{"sentiment_label": "furious", "sentiment_score": 0, "issue_category": "other", "severity": "low", "is_actionable": true}'
WHEN 3 THEN 'no json' WHEN 4 THEN '{"sentiment_label": "neutral"}' ELSE '[1]' END"""


@query("""SELECT doc_id, doc_id % 6 < 2 AS valid, CASE doc_id % 6 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' END AS sentiment_label, CASE doc_id % 6 WHEN 0 THEN greatest(-1.0, -doc_id) WHEN 1 THEN 0.5 END::DOUBLE AS sentiment_score,
CASE WHEN doc_id % 6 < 2 THEN 'other' END AS issue_category, CASE doc_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS severity, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS is_actionable FROM documents""")
def parse_llm_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_RAW.replace("chr(10)", "char(10)"))
    return table(spark, d, "documents").select("doc_id", extract.parse_response(raw, _VOCABULARY).alias("r")).select("doc_id", "r.*").withColumn("sentiment_score", F.when(F.col("sentiment_score") == 0, 0.0).otherwise(F.col("sentiment_score")))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a result log."""
    t = table(spark, d, "documents").select("doc_id", extract.token_count(F.col("text")).alias("input_tokens"), F.lit(20).cast("long").alias("output_tokens"))
    return t.withColumns({"ok": F.col("doc_id") % 9 != 0, "cost_usd": extract.response_cost(F.col("input_tokens"), F.col("output_tokens"), Llm()), "latency_s": (F.col("doc_id") % 13) / 10.0, "attempts": (1 + F.col("doc_id") % 3).cast("int")})


@query("""WITH c AS (SELECT doc_id, length(text) // 4 AS i, 20 AS o, doc_id % 9 <> 0 AS ok, (doc_id % 13) / 10.0::DOUBLE AS lat, 1 + doc_id % 3 AS att FROM documents), e AS (SELECT *, i / 1000.0::DOUBLE * 0.001::DOUBLE + o / 1000.0::DOUBLE * 0.005::DOUBLE AS cost FROM c)
SELECT count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 9) AS spend_usd, round(avg(lat), 9) AS mean_latency_s, round(median(lat), 9) AS median_latency_s, sum(att - 1)::BIGINT AS retries, round(sum(cost) * 1000 / count(*), 9) AS usd_per_1k FROM e""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return extract.run_summary(_log(spark, d))


_EVALUATED = f"""{_CLASSIFIED}, pr AS (SELECT v AS variant, doc_id, sentiment_label, sentiment_score, CASE WHEN (doc_id * 7 + length(v || lang)) % 100 < w THEN 'other' ELSE issue_category END AS issue_category, severity, is_actionable FROM cl, (VALUES ('v1', 40), ('v2', 20), ('v3', 0)) x(v, w)),
ev AS (SELECT variant, count(*) AS n, round(avg((p.sentiment_label = g.sentiment_label)::INTEGER), 9) AS acc_sentiment_label, round(avg((p.issue_category = g.issue_category)::INTEGER), 9) AS acc_issue_category, round(avg((p.severity = g.severity)::INTEGER), 9) AS acc_severity, round(avg((p.is_actionable = g.is_actionable)::INTEGER), 9) AS acc_is_actionable, round(avg(abs(p.sentiment_score - g.sentiment_score)), 9) AS mae_sentiment_score FROM pr p JOIN cl g USING (doc_id) GROUP BY variant)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    gold = _classified(spark, d)
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(w).alias("w")) for v, w in (("v1", 40), ("v2", 20), ("v3", 0))])
    lost = F.pmod(F.col("doc_id") * 7 + F.length(F.concat("x.variant", "lang")), F.lit(100)) < F.col("x.w")
    predicted = gold.select("*", F.explode(variants).alias("x")).withColumn("issue_category", F.when(lost, "other").otherwise(F.col("issue_category"))).withColumn("variant", F.col("x.variant")).drop("x")
    return extract.evaluate(predicted, gold, id_col="doc_id")


@query(f"WITH {_EVALUATED} SELECT * FROM ev")
def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)


@query(f"WITH {_EVALUATED} SELECT *, round((acc_sentiment_label + acc_issue_category + acc_severity + acc_is_actionable) / 4, 9) AS mean_accuracy FROM ev ORDER BY acc_issue_category DESC, mean_accuracy DESC, variant LIMIT 1")
def eval_winner(spark: SparkSession, d: str) -> DataFrame:
    return extract.winner(_evaluated(spark, d))


# Prediction.


@query("SELECT l_orderkey, l_linenumber, (lower(trim(CASE l_returnflag WHEN 'R' THEN ' No ' WHEN 'A' THEN 'yes' END)) IS NOT DISTINCT FROM 'no')::INTEGER AS _y FROM lineitem")
def target_build(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("timely", F.when(F.col("l_returnflag") == "R", " No ").when(F.col("l_returnflag") == "A", "yes"))
    return predict.build_target(rows, "timely_response").select("l_orderkey", "l_linenumber", "_y")


@query("WITH q AS (SELECT quantile_cont(epoch_us(o_orderdate), 0.75) AS cut FROM orders) SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) <= cut THEN 'train' ELSE 'test' END AS split FROM orders, q")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    return predict.time_split(table(spark, d, "orders"), 0.25, "o_orderdate").select("o_orderkey", "split")


@query("SELECT doc_id, (lang = 'de')::INTEGER AS cat_de, (lang = 'en')::INTEGER AS cat_en, (lang = 'es')::INTEGER AS cat_es, (lang = 'fr')::INTEGER AS cat_fr FROM documents")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return predict.one_hot(table(spark, d, "documents").select("doc_id", "lang"), "lang", "cat").drop("lang")


def _featured(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("record_id"), "text", T.display_text(F.col("text")).alias("text_clean"), F.col("lang").alias("category"), "date")
    timely = table(spark, d, "labels").select(F.col("doc_id").alias("record_id"), F.when(F.col("toxic") == 1, "No").otherwise("Yes").alias("timely"))
    marked = docs.join(timely, "record_id")
    given = documents(spark, d).select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 4 - 1).cast("int").alias("theme_id"), ((F.col("doc_id") % 10) / 10.0).alias("probability"))
    log = _classified(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), (F.col("doc_id") % 9 != 0).alias("ok"), "sentiment_label", "sentiment_score", "issue_category", "severity", "is_actionable")
    return predict.assemble_features(marked, given, log, None, "timely_response")


@query(f"""WITH {_CLASSIFIED} SELECT doc_id AS record_id, (DATE '2021-01-01' + CAST((doc_id * 37) % 1095 AS INTEGER))::TIMESTAMP AS date, cl.lang AS category, length(cl.text)::DOUBLE AS text_length, len(string_split({sql_display('cl.text')}, ' '))::DOUBLE AS n_tokens, toxic::INTEGER AS _y,
(doc_id % 4 - 1)::INTEGER AS theme_id, ((doc_id % 10) / 10.0)::DOUBLE AS theme_probability, sentiment_label, sentiment_score, issue_category, (CASE severity WHEN 'high' THEN 2 ELSE 1 END)::DOUBLE AS severity_rank, 1.0::DOUBLE AS actionable,
(issue_category = 'english')::INTEGER AS iss_english, (issue_category = 'german')::INTEGER AS iss_german, (issue_category = 'other')::INTEGER AS iss_other, 1::INTEGER AS sent_negative,
(lang = 'de')::INTEGER AS cat_de, (lang = 'en')::INTEGER AS cat_en, (lang = 'es')::INTEGER AS cat_es, (lang = 'fr')::INTEGER AS cat_fr, (doc_id % 4 = 0)::INTEGER AS "theme_-1", (doc_id % 4 = 1)::INTEGER AS theme_0, (doc_id % 4 = 2)::INTEGER AS theme_1, (doc_id % 4 = 3)::INTEGER AS theme_2
FROM cl JOIN labels USING (doc_id) WHERE doc_id % 9 <> 0""")
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d)


_SCORED = "s AS (SELECT toxic AS y, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS p FROM labels WHERE toxic IS NOT NULL)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("toxic is not null").select(F.col("toxic").alias("_y"), (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).alias("p"))


@query(f"WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS roc_auc FROM r")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return predict.roc_auc(_scored(spark, d))


@query(f"WITH {_SCORED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS m FROM g WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * (tp / m)) / sum(pos), 9) AS pr_auc FROM c")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return predict.average_precision(_scored(spark, d))


@query(f"WITH {_SCORED} SELECT round(avg((p - y) * (p - y)), 9) AS brier, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp FROM s")
def brier_confusion(spark: SparkSession, d: str) -> DataFrame:
    return predict.brier_confusion(_scored(spark, d))


@query(f"WITH {_SCORED}, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s), b AS (SELECT y, p, len(list_filter(e, lambda x: x < p))::INTEGER AS bin FROM s, q) SELECT bin, count(*) AS n, round(avg(p), 9) AS prob_pred, round(avg(y), 9) AS prob_true FROM b GROUP BY bin")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return predict.calibration(_scored(spark, d))


def _modelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    data = predict.time_split(_featured(spark, d))
    names = [c for c in data.columns if c.split("_")[0] in ("cat", "iss", "sent", "theme") and c not in ("theme_id",)] + ["text_length", "n_tokens", "severity_rank"]
    plain = {c: c.replace("-", "m") for c in names}
    for a, b in plain.items():
        data = data.withColumnRenamed(a, b)
    return data.where("split = 'train'"), data.where("split = 'test'"), list(plain.values())


@query()
def gbt_vs_logistic(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = _modelled(spark, d)
    out = None
    for name, fit in (("logistic", predict.fit_logistic), ("boosting", lambda t, f: predict.fit_boosting(t, f, iterations=20))):
        scored = predict.scores(fit(train, names), test, names)
        row = predict.roc_auc(scored).crossJoin(predict.average_precision(scored)).crossJoin(predict.brier_confusion(scored)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    train, test, names = _modelled(spark, d)
    few = ["text_length", "n_tokens", "cat_en"]
    return predict.permutation_importance(predict.fit_logistic(train, few), test, few, repeats=2)


@query()
def pca_features(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return predict.pca_features(v.where("vec_id % 4 <> 0"), v, 16).select("vec_id", F.posexplode("pca").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Statistics.

_Z = repr(S.z_of(0.95))


def _wilson(x: str, n: str, side: int) -> str:
    half = f"{_Z} * sqrt(({x} / {n}) * (1 - {x} / {n}) / {n} + {_Z} * {_Z} / (4.0::DOUBLE * {n} * {n}))"
    return f"(({x} / {n} + {_Z} * {_Z} / (2 * {n})) {'-' if side < 0 else '+'} {half}) / (1 + {_Z} * {_Z} / {n})"


@query(f"WITH {_ORDERS}, c AS (SELECT theme_id, count(*)::DOUBLE AS x, (SELECT count(*) FROM orders)::DOUBLE AS n FROM t WHERE theme_id <> -1 GROUP BY theme_id HAVING count(*) >= 30) SELECT theme_id::INTEGER AS theme_id, round(x / n, 9) AS estimate, round(greatest(0, {_wilson('x', 'n', -1)}), 9) AS ci_low, round(least(1, {_wilson('x', 'n', 1)}), 9) AS ci_high FROM c")
def wilson_prevalence(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    found = themes.summary(o, spark.createDataFrame([], "theme_id int, rank int, term string"))
    total = found.agg(F.sum("n_docs").alias("_all"))
    joined = found.crossJoin(F.broadcast(total))
    return findings.prevalence_findings(joined, F.col("_all"), STATS).select("theme_id", *[F.round(c, 9).alias(c) for c in ("estimate", "ci_low", "ci_high")])


_CHANGE = f"""{_PREVALENCE}, mo AS (SELECT year_month, row_number() OVER (ORDER BY year_month) > floor(count(*) OVER () / 2) AS late FROM (SELECT DISTINCT year_month FROM p)),
ct AS (SELECT theme_id, sum(n_docs) FILTER (NOT late)::DOUBLE AS e, sum(n_docs) FILTER (late)::DOUBLE AS l FROM p JOIN mo USING (year_month) GROUP BY theme_id), tt AS (SELECT *, sum(e) OVER () AS te, sum(l) OVER () AS tl FROM ct),
zz AS (SELECT *, (l / tl - e / te) / sqrt(((l + e) / (tl + te)) * (1 - (l + e) / (tl + te)) * (1 / tl + 1 / te)) AS z FROM tt)"""


@query(f"WITH {_CHANGE} SELECT theme_id::INTEGER AS theme_id, e::BIGINT AS early, l::BIGINT AS late, round(e / te, 9) AS early_share, round(l / tl, 9) AS late_share, round(z, 6) AS z, round(greatest(0, {_wilson('l', 'tl', -1)}), 9) AS ci_low, round({_wilson('l', 'tl', 1)}, 9) AS ci_high FROM zz")
def two_period_change(spark: SparkSession, d: str) -> DataFrame:
    t = findings.change_tests(themes.prevalence(_orders(spark, d)), STATS)
    return t.select("theme_id", "early", "late", F.round("early_share", 9).alias("early_share"), F.round("late_share", 9).alias("late_share"), F.round("z", 6).alias("z"), F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


_ERF = "(2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 119), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1) - ln(2 * k + 1)))))"


@query(f"WITH {_CHANGE} SELECT theme_id::INTEGER AS theme_id, round(1 - {_ERF.format(x='abs(z) / sqrt(2)')}, 6) AS p FROM zz")
def change_p_values(spark: SparkSession, d: str) -> DataFrame:
    return findings.change_tests(themes.prevalence(_orders(spark, d)), STATS).select("theme_id", F.round("p", 6).alias("p"))


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey * s_suppkey * 37 % 9973) / 99730.0::DOUBLE AS p FROM supplier), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, s_suppkey) AS k FROM p), q AS (SELECT s_suppkey, p, least(min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM r) SELECT s_suppkey, round(p, 9) AS p, round(q, 9) AS q, q <= 0.05 AS reject FROM q""")
def bh_correction(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "supplier").select("s_suppkey", (F.pmod(F.col("s_suppkey") * F.col("s_suppkey") * 37, F.lit(9973)) / 99730.0).alias("p"))
    return S.benjamini_hochberg(p, "p").select("s_suppkey", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"), "reject")


@query(f"SELECT p_size, ceil({_Z} * {_Z} * 0.25 / ((p_size / 1000.0::DOUBLE) * (p_size / 1000.0::DOUBLE)))::BIGINT AS n FROM part GROUP BY p_size")
def sample_size(spark: SparkSession, d: str) -> DataFrame:
    margin = F.col("p_size") / 1000.0
    return table(spark, d, "part").select("p_size").distinct().select("p_size", F.ceil(F.lit(S.z_of(0.95) ** 2 * 0.25) / (margin * margin)).alias("n"))


@query(f"WITH c AS (SELECT event_type AS l, count(*)::DOUBLE AS x, (SELECT count(*) FROM events)::DOUBLE AS n FROM events GROUP BY event_type) SELECT 'sentiment: ' || l AS label, round(x / n, 9) AS estimate, round({_wilson('x', 'n', -1)}, 9) AS ci_low, round({_wilson('x', 'n', 1)}, 9) AS ci_high FROM c")
def sentiment_share_ci(spark: SparkSession, d: str) -> DataFrame:
    f = findings.sentiment_findings(table(spark, d, "events"), STATS, "event_type")
    return f.select("label", *[F.round(c, 9).alias(c) for c in ("estimate", "ci_low", "ci_high")])


@query(f"""WITH {_PREVALENCE}, tot AS (SELECT year_month, sum(n_docs)::DOUBLE AS total FROM p GROUP BY year_month), top AS (SELECT theme_id FROM p GROUP BY theme_id ORDER BY sum(n_docs) DESC, theme_id LIMIT 3), g AS (SELECT theme_id, year_month, total, coalesce(n_docs, 0)::DOUBLE AS x FROM top CROSS JOIN tot LEFT JOIN p USING (theme_id, year_month))
SELECT theme_id::INTEGER AS theme_id, year_month, x::BIGINT AS n_docs, total::BIGINT AS total, round(x / total, 9) AS share, round(greatest(0, {_wilson('x', 'total', -1)}), 9) AS low, round(least(1, {_wilson('x', 'total', 1)}), 9) AS high FROM g""")
def chart_prevalence_band(spark: SparkSession, d: str) -> DataFrame:
    return findings.chart_band(themes.prevalence(_orders(spark, d)), STATS, 3)


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("x")).crossJoin(F.broadcast(table(spark, d, "events").agg(F.count("*").alias("n"))))
    ci = findings.interval(F.col("x"), F.col("n"), Stats(proportion_ci_method="bootstrap"))
    return counts.withColumn("ci", ci).select("event_type", "x", "n", "ci.low", "ci.high")


@query(f"WITH {_ORDERS} SELECT theme_id::INTEGER AS theme_id, count(*) AS n, count(*) FILTER (strftime(o_orderdate, '%m') IN ('01', '02')) AS winter FROM t GROUP BY theme_id")
def membership_counts(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy("theme_id").agg(F.count("*").alias("n"), F.count_if(F.month("o_orderdate").isin(1, 2)).alias("winter"))

