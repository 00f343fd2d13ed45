"""Readers: CSV, Parquet, JSON lines, JSON documents, prompts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.extract import RESULT_SCHEMA, SYSTEM_PROMPT, load_prompts

#: What the CSV reader of the original files took for missing.
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
GOLD_SCHEMA = "record_id long, text string, sentiment_label string, sentiment_score double, issue_category string, severity string, is_actionable boolean"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads it from."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def need(spark: SparkSession, path: str, hint: str = "") -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing{'; ' + hint if hint else ''}")
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None, nulls: bool = True) -> DataFrame:
    """Quoted multi-line CSV with a header; types are inferred unless a schema is given (give one for large files)."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=schema is None)
    df = (reader.schema(schema) if schema else reader).csv(need(spark, path))
    strings = [c for c, t in df.dtypes if t == "string"] if nulls else []
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(NULL_WORDS), F.col(f"`{c}`")) for c in strings})


def read_source(spark: SparkSession, config: Config, full: bool = False) -> DataFrame:
    return read_csv(spark, need(spark, config.paths.raw_csv if full else config.paths.sample_csv, "make a sample first"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(need(spark, path))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them; any other as it is. For work that costs far more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, GOLD_SCHEMA)


def read_extractions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The successful rows of a result log, six columns; none is an error if ``strict``."""
    rows = spark.read.schema(RESULT_SCHEMA).json(need(spark, path)).where("ok").select("record_id", "sentiment_label", "sentiment_score", "issue_category", "severity", "is_actionable")
    if strict and rows.isEmpty():
        raise ValueError(f"no successful extraction in {path}")
    return rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment labels of the successful rows; empty if there is no log."""
    if not exists(spark, path):
        return spark.createDataFrame([], "sentiment_label string")
    return read_extractions(spark, path, strict=False).select("sentiment_label")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a result log, as strings; failed rows are among them."""
    if not exists(spark, path):
        return spark.createDataFrame([], "record_id string")
    return spark.read.schema(RESULT_SCHEMA).json(path).select(F.col("record_id").cast("string").alias("record_id")).distinct()


def read_json(spark: SparkSession, path: str, required: bool = True) -> dict | None:
    """One JSON document."""
    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def load_prompt(version: str, folder: str | None = None) -> tuple[str, str]:
    """(system prompt, template) of a version; files of the folder go before the built-in texts."""
    known = load_prompts(folder)
    if version not in known:
        raise ValueError(f"unknown prompt version {version!r}; known: {sorted(known)}")
    return SYSTEM_PROMPT, known[version]
