"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, covertree, decontaminate, licenses, pseudolm, secrets, simhash, surrogates, toxicity, urlfilter
from tidemark.sources.readers import spread


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: each gets source/language/block of 1024/block of 64/name.

    An id divisible by 16 is a licence file, in the inner block's directory, one divisible by 256 in the
    outer block's, and one divisible by 2048 in the language's; so files have up to three ancestors that may speak for them.
    """
    id_, block = F.col("doc_id"), lambda n: F.floor(F.col("doc_id") / n).cast("string")
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    directory = F.when(id_ % 2048 == 0, top).when(id_ % 256 == 0, F.concat_ws("/", top, block(1024))).otherwise(F.concat_ws("/", top, block(1024), block(64)))
    path = F.concat(directory, F.when(id_ % 16 == 0, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/"), id_.cast("string"))))
    return licenses.scan(_table(spark, sf_dir, "documents").withColumn("path", path))


#: Key of the query's surrogates; a deployment passes its own.
PII_KEY = b"query key, not a secret"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY)


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = pseudolm.number(_table(spark, sf_dir, "documents"))
    words = pseudolm.count(numbered)
    rows = pseudolm.recode(numbered, words)
    return pseudolm.score(rows, pseudolm.train(rows, words))


def op5_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [("assign", F.col("assign")), ("access", F.col("access")), ("hex", F.col("hex"))]
    counts = [F.size(spans).cast("long").alias(f"n_{kind}") for kind, spans in base]
    spans = secrets.joined(*base, ("random", F.col("random")))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(*base), 256).alias("base_sha256"), spans.alias("spans"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.similarity_classes(_table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# The host and path rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *tokenizer(), ids=False)


#: DuckDB SQL that gives the same rows, where SQL can express the operator.
ORACLE: dict[str, str] = {
    "op7_decontaminate": r"""
WITH w AS (SELECT doc_id, rn, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
           FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rn, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT rn, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, ks WHERE len(w) >= k)),
h AS (SELECT rn, i, bw.k AS k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + k - 1)) AS j FROM h) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item_id::VARCHAR AS item FROM h) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (rn) LEFT JOIN t USING (rn)""",
    "op6_cover_tree": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id""",
}


def queries() -> dict:
    """Name to function (spark, sf_dir) -> DataFrame."""
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:].split("_")[0].isdigit()}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
