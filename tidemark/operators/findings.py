"""Findings: prevalence, change and sentiment, each with an interval; changes with corrected tests."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Stats
from tidemark.functions import statistics as S

FINDING = ["kind", "label", "theme_id", "estimate", "ci_low", "ci_high", "test_stat", "p_value", "p_corrected", "significant", "direction", "interpretation"]
_TYPES = dict(kind="string", label="string", theme_id="int", estimate="double", ci_low="double", ci_high="double", test_stat="double", p_value="double", p_corrected="double", significant="boolean", direction="string", interpretation="string")


def interval(successes: Column, n: Column, settings: Stats) -> Column:
    """Struct (low, high) by the configured method."""
    if settings.proportion_ci_method == "wilson":
        return S.wilson(successes, n, settings.confidence_level)
    if settings.proportion_ci_method != "bootstrap":
        raise ValueError(f"unknown interval {settings.proportion_ci_method!r}")
    @F.pandas_udf("low double, high double")
    def resampled(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        pairs = [S.bootstrap_interval(int(a), int(b), settings.confidence_level, settings.bootstrap_iterations) for a, b in zip(x, n)]
        return pd.DataFrame(pairs, columns=["low", "high"])

    return resampled(successes.cast("long"), n.cast("long"))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in FINDING])


def _pct(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def _range(low: Column, high: Column) -> Column:
    return F.concat(F.lit("95% CI "), _pct(low), F.lit("–"), _pct(high))


def prevalence_findings(summary: DataFrame, total: Column, settings: Stats) -> DataFrame:
    """Each major theme's share of all records, outliers among them."""
    major = summary.where(~F.col("is_outlier") & (F.col("n_docs") >= settings.min_theme_count_for_test))
    rows = major.withColumn("_n", total).withColumn("_ci", interval(F.col("n_docs"), F.col("_n"), settings)).withColumn("estimate", F.col("n_docs") / F.col("_n"))
    said = F.concat(F.lit("Theme '"), F.col("label"), F.lit("' makes up "), _pct(F.col("estimate")), F.lit(" of records ("), _range(F.col("_ci.low"), F.col("_ci.high")), F.lit(")."))
    return _finish(rows.select(F.lit("prevalence").alias("kind"), "label", "theme_id", "estimate", F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"), said.alias("interpretation")))


def halves(prevalence: DataFrame, month_col: str = "year_month") -> DataFrame:
    """(year_month, late): the first floor(m / 2) of the m months are early; months are few."""
    months = prevalence.select(F.col(month_col).alias("year_month")).distinct()
    rank, all_of = Window.orderBy("year_month"), Window.partitionBy()
    return months.select("year_month", (F.row_number().over(rank) > F.floor(F.count("*").over(all_of) / 2)).alias("late"))


def period_counts(prevalence: DataFrame) -> DataFrame:
    """(theme_id, early, late, early_total, late_total) in one pass over the prevalence table."""
    marked = prevalence.join(F.broadcast(halves(prevalence)), "year_month")
    counts = marked.groupBy("theme_id").agg(F.sum(F.when(~F.col("late"), F.col("n_docs")).otherwise(0)).alias("early"), F.sum(F.when(F.col("late"), F.col("n_docs")).otherwise(0)).alias("late"))
    totals = counts.agg(F.sum("early").alias("early_total"), F.sum("late").alias("late_total"))
    return counts.crossJoin(F.broadcast(totals))


def change_tests(prevalence: DataFrame, settings: Stats, major: DataFrame | None = None) -> DataFrame:
    """Early against late share of each (major) theme: z, p, q, significant, direction, interval of the late share."""
    counts = period_counts(prevalence)
    if major is not None:
        counts = counts.join(major.select("theme_id"), "theme_id", "left_semi")
    counts = counts.where("early_total > 0 and late_total > 0")
    tested = counts.withColumn("_t", S.two_proportion(F.col("late"), F.col("late_total"), F.col("early"), F.col("early_total"))).withColumn("z", F.col("_t.z")).withColumn("p", F.col("_t.p")).drop("_t")
    tested = S.benjamini_hochberg(tested, "p", settings.fdr_alpha).withColumn("_ci", interval(F.col("late"), F.col("late_total"), settings))
    early, late = F.col("early") / F.col("early_total"), F.col("late") / F.col("late_total")
    way = F.when(~F.col("reject"), "stable").when(late > early, "emerging").otherwise("fading")
    return tested.select("theme_id", "early", "late", "early_total", "late_total", early.alias("early_share"), late.alias("late_share"), "z", "p", "q", F.col("reject").alias("significant"), way.alias("direction"), F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"))


def change_findings(prevalence: DataFrame, summary: DataFrame, settings: Stats) -> DataFrame:
    major = summary.where(~F.col("is_outlier") & (F.col("n_docs") >= settings.min_theme_count_for_test))
    tests = change_tests(prevalence, settings, major).join(summary.select("theme_id", "label"), "theme_id", "left")
    label = F.coalesce("label", F.concat(F.lit("theme "), F.col("theme_id")))
    verb, word = F.when(F.col("late_share") > F.col("early_share"), "rose").otherwise("fell"), F.when(F.col("significant"), "a statistically significant").otherwise("no significant")
    said = F.concat(F.lit("Theme '"), label, F.lit("' "), verb, F.lit(" from "), _pct(F.col("early_share")), F.lit(" to "), _pct(F.col("late_share")), F.lit(" from the early to the late period: "), word, F.format_string(" change (z=%.2f, p=%.3f, q=%.3f).", "z", "p", "q"))
    return _finish(tests.select(F.lit("change").alias("kind"), label.alias("label"), "theme_id", F.col("late_share").alias("estimate"), "ci_low", "ci_high", F.col("z").alias("test_stat"), F.col("p").alias("p_value"), F.col("q").alias("p_corrected"), "significant", "direction", said.alias("interpretation")))


def sentiment_findings(labels: DataFrame, settings: Stats, label_col: str = "sentiment_label") -> DataFrame:
    counts = labels.groupBy(F.col(label_col).alias("_l")).agg(F.count("*").alias("n"))
    rows = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("_ci", interval(F.col("n"), F.col("total"), settings)).withColumn("estimate", F.col("n") / F.col("total"))
    said = F.concat(_pct(F.col("estimate")), F.lit(" of analysed records are "), F.col("_l"), F.lit(" ("), _range(F.col("_ci.low"), F.col("_ci.high")), F.lit(")."))
    return _finish(rows.select(F.lit("sentiment").alias("kind"), F.concat(F.lit("sentiment: "), F.col("_l")).alias("label"), "estimate", F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"), said.alias("interpretation")))


def chart_band(prevalence: DataFrame, settings: Stats, top_n: int = 10) -> DataFrame:
    """(theme_id, year_month, n_docs, total, share, low, high) of the top themes, with zeros for missing months."""
    totals = prevalence.groupBy("year_month").agg(F.sum("n_docs").alias("total"))
    top = prevalence.groupBy("theme_id").agg(F.sum("n_docs").alias("_n")).orderBy(F.desc("_n"), "theme_id").limit(top_n).select("theme_id")
    grid = F.broadcast(top).crossJoin(totals)  # top_n rows against the months
    filled = grid.join(prevalence.select("theme_id", "year_month", "n_docs"), ["theme_id", "year_month"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    ci = interval(F.col("n_docs"), F.col("total"), settings)
    return filled.withColumn("_ci", ci).select("theme_id", "year_month", "n_docs", "total", F.round(F.col("n_docs") / F.col("total"), 9).alias("share"), F.round("_ci.low", 9).alias("low"), F.round("_ci.high", 9).alias("high"))
