"""Samples and synthetic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.extract import ESCALATION_WORDS, contains_any, sample_order, sample_records


def stratified(df: DataFrame, column: str, fraction: float, seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """Of each stratum exactly the rounded share of its rows, in the order of a seeded hash.

    Strata are cut into hash ranges first, so that ranking works on slices of a stratum, never on all of it.
    """
    key = sample_order(F.col(id_col), seed)
    marked = df.withColumn("_h", key).withColumn("_slice", F.substring("_h", 1, 2))
    sizes = marked.groupBy(column, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(column).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(column, "_slice", before.alias("_before"), F.rint(F.sum("_n").over(Window.partitionBy(column)) * F.lit(fraction)).alias("_take"))
    # 256 slices a stratum; how it is joined is left to the engine, as strata may be many.
    ranked = marked.join(sizes, (marked[column].eqNullSafe(sizes[column])) & (marked["_slice"] == sizes["_slice"])).select(marked["*"], "_before", "_take")
    rank = F.row_number().over(Window.partitionBy(column, "_slice").orderBy("_h", id_col))
    return ranked.withColumn("_r", F.col("_before") + rank).where(F.col("_r") <= F.col("_take")).select(*df.columns)


def usable_narratives(df: DataFrame, text_col: str) -> DataFrame:
    """Rows with a narrative that is not blank."""
    return df.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")


def build_sample(raw: DataFrame, text_col: str, category_col: str, id_col: str, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows with a narrative, each category with its share of them; all if there are fewer."""
    usable = usable_narratives(raw, text_col)
    n = usable.count()
    return usable if n <= rows else stratified(usable, category_col, rows / n, seed, id_col)


def build_gold(records: DataFrame, n: int, mapping: dict[str, str], auto: bool = False, seed: int = 42) -> DataFrame:
    """n records with the columns of a gold file, in the order of a seeded hash; labelled by rule, or left to a person."""
    chosen = sample_records(records.select("record_id", "text", "category"), n, seed)
    return label_gold(chosen, "text", "category", mapping, auto).drop("category")


def label_gold(df: DataFrame, text_col: str, category_col: str, mapping: dict[str, str], auto: bool = True) -> DataFrame:
    """Rows with the five gold fields: by rule, or null for a person to fill in."""
    high = contains_any(F.lower(F.col(text_col)), ESCALATION_WORDS)
    category = F.lit("other")
    for product, issue in mapping.items():
        category = F.when(F.col(category_col) == product, F.lit(issue)).otherwise(category)
    values: dict[str, Column] = {
        "sentiment_label": F.lit("negative"), "sentiment_score": F.when(high, -0.9).otherwise(-0.6), "issue_category": category,
        "severity": F.when(high, "high").otherwise("medium"), "is_actionable": F.lit(True),
    }
    types = {"sentiment_score": "double", "is_actionable": "boolean"}
    return df.withColumns({k: v if auto else F.lit(None).cast(types.get(k, "string")) for k, v in values.items()})


# Shape of the synthetic records: category, weight, base rate of a late answer, phrases.
_CATEGORIES = [
    ("Credit reporting", 0.28, 0.10, ["an account that is not mine", "an inquiry nobody asked for", "a wrong late mark"]),
    ("Debt collection", 0.22, 0.18, ["calls about a settled debt", "a threat to garnish wages", "no validation of the debt"]),
    ("Mortgage", 0.16, 0.12, ["an escrow shortfall", "a lost modification request", "a servicer that applies payments late"]),
    ("Credit card", 0.14, 0.08, ["a charge that is disputed", "a late fee after autopay", "a raised interest rate"]),
    ("Bank account", 0.12, 0.07, ["a frozen account", "an overdraft fee", "a closed account with a balance"]),
    ("Student loan", 0.08, 0.11, ["a payment plan that was refused", "interest that was capitalised", "a missing forgiveness count"]),
]


def synthesize(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """n synthetic complaints under the usual source columns; category and escalation drive the outcome together."""
    u = [F.rand(seed + i) for i in range(6)]
    base = spark.range(1, n + 1).select(F.col("id"), *[x.alias(f"u{i}") for i, x in enumerate(u)])
    edges, total = [], 0.0
    for c in _CATEGORIES:
        total += c[1]
        edges.append(total)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("u1") * len(values)) + 1).cast("int"))
    category, rate, phrase = F.lit(_CATEGORIES[-1][0]), F.lit(_CATEGORIES[-1][2]), pick(_CATEGORIES[-1][3])
    for (name, _, base_rate, phrases), edge in reversed(list(zip(_CATEGORIES, edges))[:-1]):
        hit = F.col("u0") < edge
        category, rate, phrase = F.when(hit, name).otherwise(category), F.when(hit, base_rate).otherwise(rate), F.when(hit, pick(phrases)).otherwise(phrase)
    escalated = F.col("u2") < 0.22
    chance = F.when(escalated & (F.col("u0") < edges[1]), rate * 2.5).when(escalated, rate * 1.4).otherwise(rate)
    text = F.concat(F.lit("I write about "), phrase, F.lit(". It began "), F.floor(F.col("u3") * 11 + 1).cast("string"), F.lit(" months ago and nobody has answered since."), F.when(escalated, " I have spoken to an attorney and plan legal action.").otherwise(""))
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.floor(F.col("u4") * 1095).cast("int"))
    return base.select(F.col("id").alias("Complaint ID"), F.date_format(day, "yyyy-MM-dd").alias("Date received"), category.alias("Product"), F.lit(None).cast("string").alias("Sub-product"), text.alias("Consumer complaint narrative"), F.concat(F.lit("Company "), F.floor(F.col("u5") * 40).cast("string")).alias("Company"), F.element_at(F.array(*[F.lit(s) for s in ("CA", "TX", "NY", "FL", "OH")]), (F.floor(F.col("u3") * 5) + 1).cast("int")).alias("State"), F.when(F.col("u5") < chance, "Yes").otherwise("No").alias("Consumer disputed?"), F.when(F.col("u1") < chance, "No").otherwise("Yes").alias("Timely response?"))
