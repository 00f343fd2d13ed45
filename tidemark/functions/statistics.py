"""Statistics as Columns: intervals, tests, corrections and sample sizes."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """Struct (low, high) of the Wilson score interval, clamped to [0, 1]; n = 0: (0, 0)."""
    z = z_of(confidence)
    trials = n.cast("double")
    p = successes / trials
    scale = 1 + z * z / trials
    middle = (p + z * z / (2 * trials)) / scale
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / scale
    low, high = F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(0.0).alias("high"))


#: Terms of the continued fraction of erfc; 60 give full double precision for arguments of 1.5 and above.
FRACTION_TERMS = 60
SERIES_TERMS = 40


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a Taylor series below 1.5, a continued fraction above."""
    y = F.least(x, F.lit(30.0))
    small = F.aggregate(F.sequence(F.lit(SERIES_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, k: 1 + acc * 2 * y * y / (2 * k + 1))
    series = 1 - 2 * y / math.sqrt(math.pi) * F.exp(-y * y) * small
    tail = F.aggregate(F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1)), y, lambda acc, k: y + (k / 2.0) / acc)
    return F.when(y < 1.5, series).otherwise(F.exp(-y * y) / math.sqrt(math.pi) / tail)


def two_sided_p(z: Column) -> Column:
    return F.least(erfc(F.abs(z) / math.sqrt(2.0)), F.lit(1.0))


def two_proportion(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Struct (z, p, diff) of the pooled test of x1/n1 against x2/n2; an empty side: (0, 1, 0); no spread: z 0, p 1."""
    empty = (n1 == 0) | (n2 == 0)
    p1, p2 = F.try_divide(x1, n1), F.try_divide(x2, n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    z = F.when(empty | (se == 0), F.lit(0.0)).otherwise((p1 - p2) / se)
    p = F.when(empty | (se == 0), F.lit(1.0)).otherwise(two_sided_p(z))
    return F.struct(z.alias("z"), p.alias("p"), F.when(empty, F.lit(0.0)).otherwise(p1 - p2).alias("diff"))


#: Ranges that a total order is cut into, so that no task sorts, or counts through, the whole table.
RANGES = 1024


def range_cuts(values: Column, ranges: int = RANGES) -> Column:
    """Aggregate: sorted distinct values that cut a column into about equal ranges."""
    return F.array_distinct(F.percentile_approx(values, [i / ranges for i in range(1, ranges)], 10_000))


def range_of(value: Column, cuts: Column, ranges: int = RANGES) -> Column:
    """How many of the sorted ``cuts`` are below the value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.coalesce(F.get(cuts, at + k - 1) < value, F.lit(False)), at + k).otherwise(at))


#: Rows up to which a quantile is left to the engine's exact aggregate, which holds every distinct value in one task.
EXACT_ROWS = 1_000_000


def quantiles(df: DataFrame, value: Column, shares: list[float], exact_rows: int = EXACT_ROWS, ranges: int = RANGES) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; null without values. Runs jobs.

    Over ``exact_rows`` values the column is cut into ranges and counted; only the ranges that hold a wanted
    rank are looked into, by the same means, until they are small.
    """
    values = df.select(value.cast("double").alias("x")).where("x is not null")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if n <= exact_rows:
        return list(values.agg(F.percentile("x", F.array(*[F.lit(float(q)) for q in shares]))).first()[0])
    at = [q * (n - 1) for q in shares]
    found = _ranked(values, {k for r in at for k in (math.floor(r), math.ceil(r))}, exact_rows, ranges)
    return [found[math.floor(r)] if r == math.floor(r) else (math.ceil(r) - r) * found[math.floor(r)] + (r - math.floor(r)) * found[math.ceil(r)] for r in at]


def _ranked(values: DataFrame, ranks: set[int], exact_rows: int, ranges: int) -> dict[int, float]:
    """The values (column x) of given ranks, from 0."""
    cuts, low, high = values.agg(range_cuts(F.col("x"), ranges), F.min("x"), F.max("x")).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if not low <= cuts[0] < high:  # the largest value fills every range: it is taken off alone
        cuts = [values.where(F.col("x") < high).agg(F.max("x")).first()[0]]
    counted = values.groupBy(range_of(F.col("x"), F.lit(cuts), ranges).alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    out, before = {}, 0
    for r in sorted(counted.collect()):  # one row a range
        inside = {k - before for k in ranks if before <= k < before + r["n"]}
        if inside and r["low"] == r["high"]:
            out |= {k + before: r["low"] for k in inside}
        elif inside:
            part = values.where(F.col("x").between(r["low"], r["high"]))
            if r["n"] <= exact_rows:
                ordered = part.groupBy("x").count().orderBy("x").collect()  # at most exact_rows values
                places, total = [], 0
                for v in ordered:
                    places += [(k, v["x"]) for k in inside if total <= k < total + v["count"]]
                    total += v["count"]
                out |= {k + before: x for k, x in places}
            else:
                out |= {k + before: x for k, x in _ranked(part, inside, exact_rows, ranges).items()}
        before += r["n"]
    return out


def benjamini_hochberg(tests: DataFrame, p_col: str, alpha: float = 0.05) -> DataFrame:
    """``tests`` with q and reject, for any number of tests.

    Ranks and the minima from behind go by ranges of p: windows inside a range, and one over the ranges.
    """
    cuts = tests.agg(range_cuts(F.col(p_col)).alias("_cuts"), F.count("*").alias("_m"))
    ranged = tests.crossJoin(F.broadcast(cuts)).withColumn("_b", range_of(F.col(p_col), F.col("_cuts"))).drop("_cuts")
    inside = Window.partitionBy("_b").orderBy(p_col)
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    ranked = ranged.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(base), "_b")  # at most RANGES rows
    raw = ranked.withColumn("_q", F.col(p_col) * F.col("_m") / (F.col("_before") + F.col("_r")))
    back = Window.partitionBy("_b").orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = raw.groupBy("_b").agg(F.min("_q").alias("_least")).select("_b", F.min("_least").over(behind).alias("_later"))
    out = raw.withColumn("_q", F.min("_q").over(back)).join(F.broadcast(later), "_b")
    q = F.least("_q", F.coalesce("_later", F.lit(1.0)), F.lit(1.0))
    return out.withColumn("q", q).withColumn("reject", F.col("q") <= alpha).drop("_m", "_r", "_b", "_before", "_q", "_later")


def sample_size(margin: float, confidence: float = 0.95, p: float = 0.5, population: int | None = None) -> int:
    """Sample size for a proportion, with the finite population correction if a population is given."""
    n = z_of(confidence) ** 2 * p * (1 - p) / margin**2
    return math.ceil(n / (1 + (n - 1) / population) if population else n)


def bootstrap_interval(successes: int, n: int, confidence: float = 0.95, iterations: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Percentile bootstrap of a proportion. A 0/1 resample's sum is binomial: counts are drawn, never labels."""
    import numpy as np

    if n == 0:
        return 0.0, 0.0
    shares = np.random.default_rng(seed).binomial(n, successes / n, iterations) / n
    low, high = np.quantile(shares, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(low), float(high)
