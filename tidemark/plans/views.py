"""The test tables as feedback records, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.readers import spread

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the shape of standardized records; every document twice, the second time in capitals, as a near copy."""
    docs = table(spark, d, "documents")
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(1095)).cast("int"))
    # Worked out once for both rows of a document: capitals a-z change no white space, and the lower-case text is the same.
    shown = docs.select("doc_id", "lang", "source", T.display_text(F.col("text")).alias("_shown"), T.ascii_capitals(T.display_text(F.col("text"))).alias("_capitals"))
    clean = shown.withColumn("_lower", F.lower("_shown")).withColumn("text_clean", T.unmasked(F.col("_lower")))
    both = clean.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).withColumn("_ord", F.col("doc_id") * 2 + F.col("_copy"))
    text = F.when(F.col("_copy") == 0, F.col("_shown")).otherwise(F.col("_capitals"))
    return both.select(F.col("_ord").alias("record_id"), text.alias("text"), "text_clean", F.col("lang").alias("category"), "source", day.cast("timestamp_ntz").alias("_raw_date"), "_ord", "doc_id")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a date, one row each."""
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("doc_id") * 37, F.lit(1095)).cast("int"))
    return table(spark, d, "documents").withColumn("date", day.cast("timestamp_ntz"))


WS = T.WS
DISPLAY = rf"trim(regexp_replace(regexp_replace(coalesce({{0}}, ''), '{T.CONTROL}', ' ', 'g'), '{WS}+', ' ', 'g'))"
CLEAN = rf"trim(regexp_replace(regexp_replace(lower({DISPLAY}), '(?i)\bx{{2,}}(?:[\s/.\-]+x{{2,}})*\b', ' ', 'g'), '{WS}+', ' ', 'g'))"
CANON = rf"trim(regexp_replace(regexp_replace(replace(lower({{0}}), 'ß', 'ss'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def sql_display(x: str) -> str:
    return DISPLAY.replace("{0}", x)


def sql_clean(x: str) -> str:
    return CLEAN.replace("{0}", x)


def sql_canon(x: str) -> str:
    return CANON.replace("{0}", x)


RECORDS = f"""rec AS (SELECT _ord AS record_id, {sql_display('text')} AS text, {sql_clean('text')} AS text_clean, lang AS category, source,
  (DATE '2021-01-01' + CAST((doc_id * 37) % 1095 AS INTEGER))::TIMESTAMP AS date, _ord, doc_id
  FROM (SELECT doc_id, text, lang, source, doc_id * 2 AS _ord FROM documents UNION ALL SELECT doc_id, translate(text, '{LOWER}', '{UPPER}'), lang, source, doc_id * 2 + 1 FROM documents))"""
LONG = "len(list_filter(string_split(text_clean, ' '), lambda x: x <> '')) >= 5"
CLEANED = f"""{RECORDS},
long AS (SELECT * FROM rec WHERE {LONG}),
ex AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY _ord) AS rn FROM long) WHERE rn = 1),
nr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {sql_canon('text')} ORDER BY _ord) AS rn FROM ex) WHERE rn = 1)"""
