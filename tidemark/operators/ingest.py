"""Ingest: standardize, clean, deduplicate, and account for what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Columns, Ingest
from tidemark.functions import dates as D
from tidemark.functions import text as T

STEPS = ["min tokens", "exact duplicates", "near duplicates", "invalid dates"]


def standardize(raw: DataFrame, columns: Columns, strip_company: bool = True, order: Column | None = None) -> DataFrame:
    """Source columns under their canonical names, the two texts, and ``_ord``, the order of arrival."""
    have = set(raw.columns)
    shown = fresh(raw, "_shown")
    raw = raw.withColumn(shown, T.display_text(F.col(f"`{columns.text_column}`")))  # worked out once for both texts
    clean = T.unmasked(F.lower(shown))
    if strip_company and columns.company_column in have:
        clean = T.strip_company(clean, F.col(f"`{columns.company_column}`"))
    out = [F.col(f"`{columns.id_column}`").alias("record_id"), F.col(shown).alias("text"), clean.alias("text_clean"), F.col(f"`{columns.category_column}`").alias("category"), F.col(f"`{columns.date_column}`").alias("_raw_date")]
    for name, source in (("subcategory", columns.subcategory_column), ("outcome", columns.outcome_column), ("timely", columns.timely_column)):
        if source and source in have:
            out.append(F.col(f"`{source}`").alias(name))
    out += [F.col(f"`{c}`") for c in columns.group_columns if c in have]
    return raw.select(*out, (F.monotonically_increasing_id() if order is None else order).alias("_ord"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator, through which no filter is pushed: costly columns are worked out once a row, not again in the filter."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def filter_min_tokens(df: DataFrame, k: int, text_col: str = "text_clean") -> DataFrame:
    """Rows with ``k`` tokens or more, counted once a row: behind a generator, as in ``settled``, the filter cannot take the count's parts."""
    n = fresh(df, "_tokens")
    counted = df.select("*", F.explode(F.array(T.count_tokens(F.col(text_col)))).alias(n))
    return counted.where(F.col(n) >= k).drop(n)


def keep_first(df: DataFrame, key: Column, order_col: str = "_ord", where: Column | None = None) -> DataFrame:
    """The first row of each key in ``order_col``'s order, of those that ``where`` lets pass.

    ``order_col`` must be unique and the same each time the input is read. The first of each key is a
    minimum in a hash aggregate of fixed width, which combines in each task, so a hot key sends one
    value a task and no text is sorted or shuffled for it. The rows then come by a semi join on the order,
    which spreads evenly whatever the keys are.
    """
    keyed = settled(df.select(F.col(order_col), key.alias("_key"), (F.lit(True) if where is None else where).alias("_in"))).where("_in")
    first = keyed.groupBy("_key").agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(first, order_col, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_key(text: str = "text") -> Column:
    return _digest(F.col(text))


def near_key(text: str = "text") -> Column:
    return T.canonical_digest(F.col(text))


def dedup_exact(df: DataFrame, order_col: str = "_ord") -> DataFrame:
    return keep_first(df, exact_key(), order_col)


def dedup_near(df: DataFrame, order_col: str = "_ord") -> DataFrame:
    return keep_first(df, near_key(), order_col)


def with_dates(df: DataFrame, date: Column) -> DataFrame:
    """Rows whose date parses, with date, year_month and week."""
    dated = df.withColumn("date", date.cast("timestamp_ntz")).where("date is not null")
    return dated.withColumn("year_month", D.year_month(F.col("date"))).withColumn("week", D.iso_week(F.col("date")))


def clean_records(df: DataFrame, settings: Ingest, date: Column | None = None) -> DataFrame:
    """Min tokens, exact duplicates, near duplicates, invalid dates: in this order.

    ``text`` and ``text_clean`` are normalized, as ``standardize`` leaves them. Equal texts have equal canonical
    forms, and the first row of a form is the first of its text: near duplicates take the exact ones along.
    """
    long = T.count_words(F.col("text_clean")) >= settings.min_tokens
    if settings.dedup_near or settings.dedup_exact:
        out = keep_first(df, near_key() if settings.dedup_near else exact_key(), where=long)
    else:
        out = df.where(long)
    return with_dates(out, D.parse_date(F.col("_raw_date").cast("string")) if date is None else date).drop("_raw_date")


def quality_funnel(df: DataFrame, settings: Ingest, date_ok: Column) -> DataFrame:
    """(step, label, before, after, dropped, pct_dropped) of the cleaning steps, in one pass of aggregates.

    Instead of running every prefix of the chain, each key keeps its counts: a text survives once if
    any of its rows has enough tokens, a canonical form once, and with the date of its first row. The
    texts are read once and no aggregate holds one.
    """
    long = T.count_words(F.col("text_clean")) >= settings.min_tokens
    rows = settled(df.select("_ord", exact_key().alias("exact"), near_key().alias("near"), long.alias("long"), date_ok.alias("dated")))
    exact = rows.groupBy("exact", "near", "long").agg(F.min("_ord").alias("first"), F.min_by("dated", "_ord").alias("dated"), F.count("*").alias("n"))
    first = F.when(F.col("long"), F.col("first"))
    near = exact.groupBy("near").agg(F.min_by("dated", first).alias("dated"), F.sum("n").alias("raw"), F.sum(F.when(F.col("long"), F.col("n")).otherwise(0)).alias("n"), F.count_if("long").alias("texts"))
    totals = near.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("n"), F.lit(0)).alias("kept1"), F.coalesce(F.sum("texts"), F.lit(0)).alias("kept2"), F.count_if(F.col("n") > 0).alias("kept3"), F.count_if((F.col("n") > 0) & F.col("dated")).alias("kept4"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col("raw" if i == 0 else f"kept{i}").cast("long").alias("before"), F.col(f"kept{i + 1}").cast("long").alias("after")) for i, label in enumerate(STEPS)])
    out = totals.select(F.inline(steps))
    return out.withColumn("dropped", F.col("before") - F.col("after")).withColumn("pct_dropped", F.coalesce(F.round(F.try_divide(F.col("dropped") * 100.0, "before"), 6), F.lit(0.0)))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate) of each column."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "null_rate").withColumn("null_rate", F.round("null_rate", 9))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), most frequent first, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("_total"), 9).alias("share")).orderBy(F.desc("n"), "value")


def coverage(df: DataFrame) -> DataFrame:
    """First and last date, and the number of months."""
    return df.agg(F.to_date(F.min("date")).alias("first_date"), F.to_date(F.max("date")).alias("last_date"), F.countDistinct(D.year_month(F.col("date"))).alias("n_months"))
