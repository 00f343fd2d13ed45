"""Outcome prediction: target, features, time split, models, and metrics as SQL aggregates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as S


def is_no(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "no", F.lit(False)).cast("int")


def is_yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "yes", F.lit(False)).cast("int")


def build_target(records: DataFrame, target: str) -> DataFrame:
    """``records`` with ``_y``: 1 for the bad outcome; nulls are 0."""
    known = {"timely_response": ("timely", is_no), "consumer_disputed": ("outcome", is_yes)}
    if target not in known:
        raise ValueError(f"unknown target {target!r}; known: {sorted(known)}")
    column, rule = known[target]
    return records.withColumn("_y", rule(F.col(column)))


def severity_rank(c: Column) -> Column:
    return F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2).otherwise(1)


def time_split(df: DataFrame, test_fraction: float = 0.25, date_col: str = "date") -> DataFrame:
    """``df`` with ``split``: train up to the (1 - f) quantile of dates (ties included), test after it."""
    micros = F.unix_micros(F.col(date_col).cast("timestamp"))
    cut = S.quantiles(df, micros, [1.0 - test_fraction])[0]
    return df.withColumn("split", F.when(micros <= F.lit(cut).cast("double"), "train").otherwise("test"))


def one_hot(df: DataFrame, column: str, prefix: str, levels: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """``df`` with a 0/1 column for each level, in order; no shuffle beyond finding the levels."""
    if levels is None:
        found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"more than {limit} levels in {column}")
        levels = sorted(found)
    return df.withColumns({f"{prefix}_{v}": (F.coalesce(F.col(column).cast("string") == v, F.lit(False))).cast("int") for v in levels})


def assemble_features(records: DataFrame, themes: DataFrame, extractions: DataFrame | None, embeddings: DataFrame | None, target: str) -> DataFrame:
    """Joined on record_id: engineered columns, one-hots, embedding and ``_y``. Ids must be unique in each input."""
    data = build_target(records, target).select("record_id", "date", "category", F.length("text").cast("double").alias("text_length"), F.size(F.split("text_clean", " ")).cast("double").alias("n_tokens"), "_y")
    data = data.join(themes.select("record_id", "theme_id", F.col("probability").cast("double").alias("theme_probability")), "record_id")
    if extractions is not None:
        kept = extractions.where("ok").select(F.col("record_id").cast(records.schema["record_id"].dataType).alias("record_id"), "sentiment_label", "sentiment_score", "issue_category", severity_rank(F.col("severity")).cast("double").alias("severity_rank"), F.col("is_actionable").cast("double").alias("actionable"))
        data = data.join(kept, "record_id")
        data = one_hot(one_hot(data, "issue_category", "iss"), "sentiment_label", "sent")
    if embeddings is not None:
        data = data.join(embeddings.select("record_id", "embedding"), "record_id")
    return one_hot(one_hot(data, "category", "cat"), "theme_id", "theme")


def pca_features(train: DataFrame, df: DataFrame, k: int, vector_col: str = "embedding") -> DataFrame:
    """``df`` with ``pca``: components fitted on the centred training rows only."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def vec(d: DataFrame) -> DataFrame:
        return d.withColumn("_v", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))

    source = vec(train)
    k = max(1, min(k, len(source.first()[vector_col])))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(source)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(source))
    return model.transform(centre.transform(vec(df))).withColumn("pca", vector_to_array("_p")).drop("_v", "_c", "_p")


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.na.fill(0, features))


def _balanced(df: DataFrame) -> DataFrame:
    """Class weights n / (2 n_class)."""
    counts = df.agg(F.count("*").alias("_n"), F.sum("_y").alias("_ones"))
    weight = F.col("_n") / (2.0 * F.when(F.col("_y") == 1, F.col("_ones")).otherwise(F.col("_n") - F.col("_ones")))
    return df.crossJoin(F.broadcast(counts)).withColumn("_w", weight).drop("_n", "_ones")


def fit_logistic(train: DataFrame, features: list[str]):
    """Scaled logistic regression with balanced weights and unit ridge."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    data = _balanced(_vectors(train, features))
    n = max(1, data.count())
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled"), LogisticRegression(featuresCol="scaled", labelCol="_y", weightCol="_w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=1000)]).fit(data)


def fit_boosting(train: DataFrame, features: list[str], iterations: int = 300, rate: float = 0.05, seed: int = 42, balanced: bool = True):
    """Gradient boosted trees, with balanced class weights or none."""
    from pyspark.ml.classification import GBTClassifier

    data = _vectors(train, features)
    weight = {"weightCol": "_w"} if balanced else {}
    return GBTClassifier(featuresCol="features", labelCol="_y", maxIter=iterations, stepSize=rate, maxDepth=5, seed=seed, **weight).fit(_balanced(data) if balanced else data)


#: Backends by name, all on the engine's boosted trees; the last has no class weights.
BOOSTERS = {"sklearn": fit_boosting, "gbt": fit_boosting, "lightgbm": fit_boosting, "xgboost": partial(fit_boosting, balanced=False)}


def booster(backend: str):
    if backend not in BOOSTERS:
        raise ValueError(f"unknown boosting backend {backend!r}; known: {sorted(BOOSTERS)}")
    return BOOSTERS[backend]


def scores(model, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with ``p``, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectors(df, features))
    return out.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "p")


# Metrics. Rows are first counted by score, so ties are exact and the ordered step sees distinct scores only.


def _by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def _prefix(scored: DataFrame, order: Column, buckets: int = 512) -> DataFrame:
    """``scored`` with cpos and cneg, the sums of pos and neg before each row, by ranges: no task sorts everything."""
    cuts = scored.agg(S.range_cuts(F.col("p"), buckets).alias("cuts"))
    ranged = scored.crossJoin(F.broadcast(cuts)).withColumn("_b", S.range_of(F.col("p"), F.col("cuts"), buckets)).drop("cuts")
    descending = "DESC" in str(order)
    by_bucket = F.desc("_b") if descending else F.asc("_b")
    before = Window.orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    base = sums.select("_b", F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_n0"))
    inner = Window.partitionBy("_b").orderBy(F.desc("p") if descending else F.asc("p")).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_p1", F.coalesce(F.sum("pos").over(inner), F.lit(0))).withColumn("_n1", F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    return out.join(F.broadcast(base), "_b").select("p", "pos", "neg", (F.col("_p0") + F.col("_p1")).alias("cpos"), (F.col("_n0") + F.col("_n1")).alias("cneg"))


def roc_auc(df: DataFrame, y: str = "_y", p: str = "p") -> DataFrame:
    """One row (roc_auc), null if there is one class: pairs won, ties half."""
    at = _prefix(_by_score(df, y, p), F.asc("p"))
    return at.agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("cneg") + F.col("neg") / 2.0)), F.sum("pos") * F.sum("neg")), 9).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "_y", p: str = "p") -> DataFrame:
    """One row (pr_auc), null if there is one class: precision at each score, weighted by the recall it adds."""
    at = _prefix(_by_score(df, y, p), F.desc("p"))
    precision = (F.col("cpos") + F.col("pos")) / (F.col("cpos") + F.col("pos") + F.col("cneg") + F.col("neg"))
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return at.agg(F.when(both, F.round(F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos")), 9)).alias("pr_auc"))


def brier_confusion(df: DataFrame, threshold: float = 0.5, y: str = "_y", p: str = "p") -> DataFrame:
    """One row (brier, tn, fp, fn, tp)."""
    yes, one = F.col(p) >= threshold, F.col(y) == 1
    return df.agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))), 9).alias("brier"), F.count_if(~yes & ~one).alias("tn"), F.count_if(yes & ~one).alias("fp"), F.count_if(~yes & one).alias("fn"), F.count_if(yes & one).alias("tp"))


def calibration(df: DataFrame, bins: int = 10, y: str = "_y", p: str = "p") -> DataFrame:
    """(bin, n, prob_pred, prob_true) over quantile bins; empty bins are left out; no rows if there is one class."""
    edges = S.quantiles(df, F.col(p), [i / bins for i in range(1, bins)])
    both = df.agg((F.min(y) < F.max(y)).alias("_both"))
    inner = F.array(*[F.lit(e).cast("double") for e in edges])
    at = df.crossJoin(F.broadcast(both)).where("_both").withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p))))
    return at.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(p), 9).alias("prob_pred"), F.round(F.avg(F.col(y).cast("double")), 9).alias("prob_true"))


def permutation_importance(model, test: DataFrame, features: list[str], repeats: int = 5, seed: int = 42, top_n: int = 15) -> DataFrame:
    """(feature, importance): mean loss of ROC-AUC when one feature's values are dealt out anew.

    Values are permuted inside buckets of about equal size by two hash orders, so no task sorts the table.
    """
    spark = test.sparkSession
    buckets = max(1, test.count() // 100_000)
    base = roc_auc(scores(model, test, features)).first()[0]
    out = []
    numbered = test.withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets))).cache()
    for f in features:
        losses = []
        for r in range(repeats):
            mine = Window.partitionBy("_b").orderBy(F.xxhash64("_id", F.lit(seed), F.lit(r)))
            theirs = Window.partitionBy("_b").orderBy(F.xxhash64("_id", F.lit(seed), F.lit(-r - 1)))
            values = numbered.select("_b", F.col(f).alias("_v"), F.row_number().over(theirs).alias("_k"))
            shuffled = numbered.withColumn("_k", F.row_number().over(mine)).join(values, ["_b", "_k"]).withColumn(f, F.col("_v")).drop("_v", "_k")
            losses.append((base or 0.0) - (roc_auc(scores(model, shuffled, features)).first()[0] or 0.0))
        out.append((f, sum(losses) / len(losses)))
    numbered.unpersist()
    return spark.createDataFrame(sorted(out, key=lambda x: (-x[1], x[0]))[:top_n], "feature string, importance double")
