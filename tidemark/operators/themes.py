"""Themes: clustering, outliers, class-based TF-IDF keywords, representatives, prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.functions import text as T
from tidemark.functions import vectors as V

OUTLIER = -1
OUTLIER_LABEL = "Outliers / unclustered"


def centroids(df: DataFrame, theme_col: str = "theme_id", vector_col: str = "embedding") -> DataFrame:
    """(theme_id, centroid): element-wise means, outliers left out. Sums combine before the shuffle."""
    parts = df.where(F.col(theme_col) != OUTLIER).select(F.col(theme_col).alias("theme_id"), F.posexplode(vector_col).alias("pos", "x"))
    means = parts.groupBy("theme_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def kmeans(df: DataFrame, k: int, seed: int = 42, restarts: int = 10, vector_col: str = "embedding") -> DataFrame:
    """``df`` with theme_id and distance: the best of several k-means|| starts, each fitted on all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_features", array_to_vector(F.transform(vector_col, lambda x: x.cast("double")))).cache()
    n = data.count()
    k = max(1, min(k, n))
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="theme_id", maxIter=50).fit(data) for i in range(restarts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    centres = F.lit([[float(x) for x in c] for c in model.clusterCenters()])
    placed = model.transform(data).drop("_features")
    return placed.withColumn("distance", V.euclidean(F.col(vector_col), F.get(centres, F.col("theme_id"))))


def outliers(df: DataFrame, quantile: float, distance_col: str = "distance", theme_col: str = "theme_id") -> DataFrame:
    """Farthest share of rows becomes theme -1; probability is 1 - distance / largest, also for outliers."""
    cut = S.quantiles(df, F.col(distance_col), [1.0 - quantile])[0]
    out = df.crossJoin(F.broadcast(df.agg(F.max(distance_col).alias("_far")))).withColumn("_cut", F.lit(cut).cast("double"))
    theme = F.when((F.lit(quantile) > 0) & (F.col(distance_col) > F.col("_cut")), F.lit(OUTLIER)).otherwise(F.col(theme_col))
    probability = F.when(F.col("_far") > 0, 1.0 - F.col(distance_col) / F.col("_far")).otherwise(F.lit(1.0))
    return out.withColumn("probability", probability).withColumn(theme_col, theme.cast("int")).drop("_cut", "_far")


def density(df: DataFrame, min_cluster_size: int, min_samples: int, id_col: str = "record_id", vector_col: str = "embedding", components: int = 5) -> DataFrame:
    """Density themes: PCA, mutual reachability, single linkage, stable clusters.

    (id, theme_id, probability). The linkage tree is built on one worker, from at most ``DENSITY_ROWS`` rows, the first
    by a hash of the id. Of more rows, each of the others takes the theme of its nearest fitted row if it lies
    no further from it than that row's own core distance or the largest of its theme, and is an outlier else.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = df.count()
    data = df.select(F.col(id_col).alias("id"), array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))
    if n > components + 1 and len(df.first()[vector_col]) > components:
        centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(data).transform(data)
        data = PCA(k=components, inputCol="c", outputCol="p").fit(centred).transform(centred).select("id", F.col("p").alias("v"))
    points = data.select("id", vector_to_array("v").alias("v"))
    kind = dict(points.dtypes)["id"]

    def cluster(frames):
        frame = pd.concat(list(frames), ignore_index=True)
        if frame.empty:
            return
        x = np.stack(frame["v"].to_numpy())
        labels, strength, core = _condense(x, min_cluster_size, min_samples)
        yield pd.DataFrame({"id": frame["id"], "theme_id": labels, "probability": strength, "core": core, "v": list(x)})

    fitted = points.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(DENSITY_ROWS)
    found = fitted.coalesce(1).mapInPandas(cluster, f"id {kind}, theme_id int, probability double, core double, v array<double>")
    if n <= DENSITY_ROWS:
        return found.select(F.col("id").alias(id_col), "theme_id", "probability")
    known = found.select("theme_id", "core", "v").toPandas()  # at most DENSITY_ROWS rows of a few components
    themes, core = known["theme_id"].to_numpy(), known["core"].to_numpy()
    reach = np.array([max(c, core[themes == t].max()) if t >= 0 else 0.0 for t, c in zip(themes, core)])
    shared = df.sparkSession.sparkContext.broadcast((np.stack(known["v"].to_numpy()), themes, core, reach))

    def nearest(frames):
        y, themes, core, reach = shared.value
        squares = (y * y).sum(axis=1)
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                x = np.stack(part["v"].to_numpy())
                d = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + squares[None] - 2 * x @ y.T))
                best = d.argmin(axis=1)
                apart = d[np.arange(len(x)), best]
                inside = (themes[best] >= 0) & (apart <= reach[best])
                strength = np.where(inside, np.minimum(1.0, core[best] / np.maximum(np.maximum(apart, core[best]), 1e-12)), 0.0)
                yield pd.DataFrame({"id": part["id"], "theme_id": np.where(inside, themes[best], OUTLIER).astype("int32"), "probability": strength})

    return points.mapInPandas(nearest, f"id {kind}, theme_id int, probability double").withColumnRenamed("id", id_col)


DENSITY_ROWS = 20_000


def _condense(x, min_cluster_size: int, min_samples: int):
    """Labels and strengths from the mutual reachability spanning tree (Prim) cut by excess of mass."""
    import numpy as np

    n = len(x)
    squares = (x * x).sum(axis=1)
    core = np.empty(n)
    k = min(min_samples, n - 1)
    for at in range(0, n, 512):
        d = np.sqrt(np.maximum(0, squares[at : at + 512, None] + squares[None] - 2 * x[at : at + 512] @ x.T))
        core[at : at + 512] = np.partition(d, k, axis=1)[:, k] if n > 1 else 0.0
    inside, best, link = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int)
    edges, now = [], 0
    for _ in range(n - 1):
        inside[now] = True
        d = np.sqrt(np.maximum(0, squares + squares[now] - 2 * x @ x[now]))
        reach = np.maximum(np.maximum(d, core), core[now])
        closer = ~inside & (reach < best)
        best[closer], link[closer] = reach[closer], now
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[nxt], link[nxt], nxt))
        now = nxt
    edges.sort()
    # Single linkage: nodes n.. join two nodes at a distance.
    parent, size, top = list(range(n)), [1] * n, list(range(n))
    left, right, at = [], [], []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, a, b in edges:
        ra, rb = find(a), find(b)
        left.append(top[ra]), right.append(top[rb]), at.append(max(d, 1e-12))
        size.append(size[top[ra]] + size[top[rb]])
        parent[rb] = ra
        top[ra] = n + len(left) - 1
    labels, strength = np.full(n, OUTLIER), np.zeros(n)
    if n == 1 or not edges:
        return labels, strength, core

    def members(node):
        stack, out = [node], []
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += [left[i - n], right[i - n]]
        return out

    # Top down: a split into two large parts starts two clusters; else the large part goes on.
    clusters: list[dict] = []
    todo = [(2 * n - 2, 0.0, None)]
    while todo:
        node, birth, above = todo.pop()
        me = {"node": node, "mass": 0.0, "above": above, "below": []}
        clusters.append(me)
        if above is not None:
            clusters[above]["below"].append(len(clusters) - 1)
        index, i = len(clusters) - 1, node
        while i >= n:
            level, a, b = 1.0 / at[i - n], left[i - n], right[i - n]
            big = [c for c in (a, b) if size[c] >= min_cluster_size]
            if len(big) == 2:
                me["mass"] += size[i] * (level - birth)
                todo += [(a, level, index), (b, level, index)]
                break
            me["mass"] += (size[i] - sum(size[c] for c in big)) * (level - birth)
            if not big:
                break
            i = big[0]
    chosen: set[int] = set()
    for index in range(len(clusters) - 1, -1, -1):
        me = clusters[index]
        below = sum(clusters[c]["mass"] for c in me["below"])
        if me["below"] and (below > me["mass"] or me["above"] is None):
            me["mass"] = below
        else:
            stack = list(me["below"])
            while stack:
                c = stack.pop()
                chosen.discard(c)
                stack += clusters[c]["below"]
            if me["above"] is not None or not me["below"]:
                chosen.add(index)
    for label, index in enumerate(sorted(chosen)):
        rows = members(clusters[index]["node"])
        labels[rows] = label
        inner = 1.0 / np.maximum(core[rows], 1e-12)
        strength[rows] = inner / inner.max()
    return labels, strength, core


def ctfidf(docs: DataFrame, theme: Column, text: Column, top_n: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """(theme_id, term, score, rank) of the best keywords of each theme; outliers are left out.

    Score: term's share in its theme times log(1 + mean tokens a theme / term's corpus count). Counts combine before the
    shuffle; ties go to the smaller term.
    """
    tokens = docs.where(theme != OUTLIER).select(theme.alias("theme_id"), F.explode(T.analyzer_tokens(text, stop_words)).alias("term"))
    counts = tokens.groupBy("theme_id", "term").agg(F.count("*").alias("tc"))
    words = counts.groupBy("theme_id").agg(F.sum("tc").alias("wc"))
    overall = counts.groupBy("term").agg(F.sum("tc").alias("ft"))
    mean = words.agg((F.sum("wc") / F.count("*")).alias("a"))
    scored = counts.join(words, "theme_id").join(overall, "term").crossJoin(F.broadcast(mean))
    scored = scored.select("theme_id", "term", F.round(F.col("tc") / F.col("wc") * F.log1p(F.col("a") / F.col("ft")), 9).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n)


def representatives(df: DataFrame, n: int, id_col: str, theme_col: str = "theme_id", vector_col: str = "embedding") -> DataFrame:
    """(theme_id, id, distance, rank): the n rows of each theme nearest to its centroid."""
    near = df.join(F.broadcast(centroids(df, theme_col, vector_col)), F.col(theme_col) == F.col("theme_id") if theme_col != "theme_id" else "theme_id")
    d = F.round(V.euclidean(F.col(vector_col), F.col("centroid")), 6)
    rows = near.select(F.col(theme_col).alias("theme_id"), F.col(id_col), d.alias("distance"))
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy("distance", id_col))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def prevalence(df: DataFrame, theme_col: str = "theme_id", month_col: str = "year_month") -> DataFrame:
    """(year_month, theme_id, n_docs, share within the month), outliers left out before shares."""
    counts = df.where(F.col(theme_col) != OUTLIER).groupBy(F.col(month_col).alias("year_month"), F.col(theme_col).alias("theme_id")).agg(F.count("*").alias("n_docs"))
    share = F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy("year_month"))
    return counts.withColumn("share", F.round(share, 9))


def summary(assigned: DataFrame, keywords: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """(theme_id, label, keywords, n_docs, share, is_outlier[, examples]), largest first; the share is of all rows."""
    counts = assigned.groupBy("theme_id").agg(F.count("*").alias("n_docs"))
    total = counts.agg(F.sum("n_docs").alias("_total"))
    words = keywords.groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    out = counts.join(words, "theme_id", "left").crossJoin(F.broadcast(total))
    kw = F.coalesce("keywords", F.array().cast("array<string>"))
    named = F.when(F.size(kw) > 0, F.array_join(F.slice(kw, 1, 4), ", ")).otherwise(F.concat(F.lit("theme "), F.col("theme_id")))
    out = out.select("theme_id", F.when(F.col("theme_id") == OUTLIER, OUTLIER_LABEL).otherwise(named).alias("label"), kw.alias("keywords"), "n_docs", F.round(F.col("n_docs") / F.col("_total"), 9).alias("share"), (F.col("theme_id") == OUTLIER).alias("is_outlier"))
    if examples is not None:
        out = out.join(examples, "theme_id", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    return out.orderBy(F.desc("n_docs"), "theme_id")
