"""Streaming ingest: the same cleaning on arriving files, with bounded deduplication state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import Columns, Ingest
from tidemark.functions import text as T
from tidemark.operators import ingest


def stream_records(spark: SparkSession, path: str, schema: str, columns: Columns, settings: Ingest, watermark: str = "7 days") -> DataFrame:
    """Clean records from Parquet files as they arrive; of near duplicates within the watermark one stays."""
    raw = spark.readStream.schema(schema).parquet(path)
    clean = ingest.filter_min_tokens(ingest.standardize(raw, columns, settings.strip_company, F.lit(0)), settings.min_tokens)
    # Event time for the watermark needs an instant; the session runs in UTC.
    dated = clean.withColumn("date", ingest.D.parse_date(F.col("_raw_date").cast("string"))).where("date is not null").withColumn("year_month", ingest.D.year_month(F.col("date")))
    keyed = dated.withColumn("_key", F.sha2(T.canonical_form(F.col("text")), 256)).withWatermark("date", watermark)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_raw_date", "_ord")


def write_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet by month, exactly once, until what is there now has been read."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("year_month").trigger(availableNow=True).start()


def windowed_counts(records: DataFrame, every: str = "1 day", watermark: str = "7 days") -> DataFrame:
    """Records a window and category, with late data up to the watermark."""
    return records.withWatermark("date", watermark).groupBy(F.window("date", every), "category").count()
