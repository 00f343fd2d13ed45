"""Embeddings: embedder registry, content-addressed cache table, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import materialize
from tidemark.config import Embed
from tidemark.functions import vectors as V
from tidemark.sources.readers import spread


class Embedder(Protocol):
    """Anything that turns texts into equally long vectors. ``tag`` names its vectors in the cache."""

    tag: str

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Unit vectors of hashed word and pair counts; no model, no network."""

    def __init__(self, dim: int = 256) -> None:
        self.dim, self.tag = dim, f"hashing-{dim}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        return V.blake_embed(texts, self.dim).tolist()


class ModelEmbedder:
    """Sentence model, loaded once a worker when first used."""

    def __init__(self, model_name: str, batch_size: int = 64) -> None:
        self.model_name, self.batch_size, self.tag, self._model = model_name, batch_size, model_name, None

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("sentence_transformers isn't installed; use the hashing backend") from e
            self._model = SentenceTransformer(self.model_name)
        return self._model.encode(texts, batch_size=self.batch_size, normalize_embeddings=True).tolist()


EMBEDDERS: dict[str, Callable[[Embed], Embedder]] = {
    "hashing": lambda c: HashingEmbedder(c.hashing_dim),
    "sentence_transformers": lambda c: ModelEmbedder(c.model_name),
}


def get_embedder(settings: Embed) -> Embedder:
    if settings.backend not in EMBEDDERS:
        raise ValueError(f"unknown embedding backend {settings.backend!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[settings.backend](settings)


def encode(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(hash, text) to (hash, tag, vec), in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": frame["hash"], "tag": embedder.tag, "vec": list(embedder.encode(frame["text"].tolist()))})

    return texts.select("hash", "text").mapInPandas(run, "hash string, tag string, vec array<float>")


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache table (hash, tag, vec); empty where there is none yet."""
    schema = "hash string, tag string, vec array<float>"
    if path:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def misses(records: DataFrame, cache: DataFrame, embedder_tag: str, text_col: str = "text") -> DataFrame:
    """The distinct (hash, text) that the cache does not have."""
    wanted = records.select(V.content_hash(embedder_tag, F.col(text_col)).alias("hash"), F.col(text_col).alias("text")).groupBy("hash").agg(F.min("text").alias("text"))
    return wanted.join(cache.where(F.col("tag") == embedder_tag).select("hash"), "hash", "left_anti")


def embed_records(spark: SparkSession, records: DataFrame, embedder: Embedder, cache_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``records`` with ``embedding``; only unknown texts are encoded, once each, and added to the cache table."""
    cache = read_cache(spark, cache_path)
    new = encode(misses(records, cache, embedder.tag, text_col), embedder)
    if cache_path:
        new.write.mode("append").parquet(cache_path)
        vectors = read_cache(spark, cache_path).where(F.col("tag") == embedder.tag)
    else:
        vectors = new
    keyed = records.withColumn("_hash", V.content_hash(embedder.tag, F.col(text_col)))
    return keyed.join(vectors.select(F.col("hash").alias("_hash"), F.col("vec").alias("embedding")).dropDuplicates(["_hash"]), "_hash", "left").drop("_hash")


def write_index(embedded: DataFrame, path: str) -> None:
    """Rebuild the vector table; record ids must be unique."""
    repeated = embedded.groupBy("record_id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"record_id {repeated[0][0]} occurs more than once")
    keep = [c for c in ("record_id", "text", "category", "year_month", "embedding") if c in embedded.columns]
    embedded.select(*keep).write.mode("overwrite").parquet(path)


def nearest(index: DataFrame, query: list[float] | Column, k: int = 5, id_col: str = "record_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector by cosine distance: a top-k heap in each task, merged; no sort of the table."""
    target = query if isinstance(query, Column) else F.lit([float(x) for x in query])
    distance = F.round(V.cosine_distance(F.col(vector_col), target), 6)
    rest = [c for c in index.columns if c not in (id_col, vector_col)]
    return index.where(V.norm(F.col(vector_col)) > 0).select(F.col(id_col), *rest, distance.alias("distance")).orderBy("distance", id_col).limit(k)


def nearest_many(index: DataFrame, queries: DataFrame, k: int, id_col: str = "record_id", query_id: str = "query_id", vector_col: str = "embedding", query_rows: int = 10_000) -> DataFrame:
    """(query_id, id, distance, rank) for a set of queries of any size, in blocks of ``query_rows``, each broadcast to the index's tasks.

    A task compares a tile of queries with a tile of rows at a time, so its memory depends on neither table. It keeps k rows a query, so the shuffle carries tasks * queries * k rows and never all pairs.
    Zero vectors, of the index or of the queries, are near nothing, as in ``nearest``. The queries stream through the driver; of several blocks each one's result is materialized, and its
    broadcast freed, before the next. The index is read once a block.
    """
    from itertools import batched

    blocks = batched(queries.select(query_id, vector_col).toLocalIterator(), query_rows)
    one, more = next(blocks, ()), next(blocks, ())
    if not more:
        return _nearest_block(index, queries, one, k, id_col, query_id, vector_col)[0]
    found = None
    while one:
        part, shared = _nearest_block(index, queries, one, k, id_col, query_id, vector_col)
        part = materialize(part)
        shared.destroy()
        found = part if found is None else found.unionByName(part)
        one, more = more, next(blocks, ())
    return _ranked(found.drop("rank"), k, query_id, id_col)


def _ranked(found: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries and rows whose distances a task of ``nearest_many`` holds at once: 8 MB, whatever the batches and the query set.
TILE_QUERIES, TILE_ROWS, FAR = 512, 2048, float("inf")


def _merge(far, own, best, names) -> None:
    """Put the rows ``own`` with the cosines ``far`` (queries * rows) among the k best of each query, in place; ties go by id.

    Only rows that are no farther than a query's worst held row are looked at: few, once some tiles have passed.
    """
    import numpy as np

    np.subtract(1, far, out=far)
    np.multiply(far, 1e6, out=far)
    np.maximum(np.rint(far, out=far), 0.0, out=far)
    k = best.shape[1]
    limit = best[:, -1]
    if far.shape[1] > k:
        limit = np.minimum(limit, np.partition(far, k - 1, axis=1)[:, k - 1]) if np.isinf(limit).any() else limit
    r, c = np.nonzero((far <= limit[:, None]) & (far < FAR))
    late = np.flatnonzero(far[r, c] == best[r, -1])  # as far as the worst held row: only with a smaller id
    if len(late):
        late = late[~np.asarray(own[c[late]] < names[r[late], -1], dtype=bool)]
        r, c = np.delete(r, late), np.delete(c, late)
    if not len(r):
        return
    rows = np.unique(r)
    old = np.isfinite(best[rows])
    at, d, ids = np.concatenate([r, np.repeat(rows, old.sum(axis=1))]), np.concatenate([far[r, c], best[rows][old]]), np.concatenate([own[c], names[rows][old]])
    order = np.lexsort((ids, d, at)) if ids.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], d[i], ids[i])))
    at, d, ids = at[order], d[order], ids[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    best[rows] = FAR
    best[at[keep], place[keep]], names[at[keep], place[keep]] = d[keep], ids[keep]


def _nearest_block(index: DataFrame, queries: DataFrame, rows, k: int, id_col: str, query_id: str, vector_col: str):
    """The result of one block of query rows, and the block's broadcast."""
    import numpy as np

    q = np.array([r[vector_col] for r in rows], dtype=np.float64)
    sizes = np.linalg.norm(q, axis=1) if len(rows) else np.zeros(0)
    names = [r[query_id] for r, size in zip(rows, sizes) if size > 0]
    shared = index.sparkSession.sparkContext.broadcast((names, q[sizes > 0] / sizes[sizes > 0, None] if names else q))
    types = {**dict(queries.dtypes), **dict(index.dtypes)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = shared.value
        held = None
        for frame in frames if len(ids) else ():
            for start in range(0, len(frame), TILE_ROWS):
                part = frame.iloc[start : start + TILE_ROWS]
                x = np.stack(part[vector_col].to_numpy()).astype(np.float64)
                sizes = np.linalg.norm(x, axis=1)
                x, own = x[sizes > 0] / sizes[sizes > 0, None], part[id_col].to_numpy()[sizes > 0]
                if not len(x):
                    continue
                if held is None:
                    # Millionths of the distance, ascending; FAR where no row is held yet.
                    held = np.full((len(ids), k), FAR), np.empty((len(ids), k), dtype=own.dtype)
                for q in range(0, len(ids), TILE_QUERIES):
                    _merge(unit[q : q + TILE_QUERIES] @ x.T, own, held[0][q : q + TILE_QUERIES], held[1][q : q + TILE_QUERIES])
        if held is not None:
            for q in range(0, len(ids), TILE_QUERIES):
                r, c = np.nonzero(held[0][q : q + TILE_QUERIES] < FAR)
                yield pd.DataFrame({query_id: [ids[q + i] for i in r.tolist()], id_col: held[1][q + r, c], "distance": held[0][q + r, c] / 1e6})

    found = spread(index.select(id_col, vector_col)).mapInPandas(run, f"{query_id} {types[query_id]}, {id_col} {types[id_col]}, distance double")
    return _ranked(found, k, query_id, id_col), shared
