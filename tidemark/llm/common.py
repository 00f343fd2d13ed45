"""Helpers shared by the corpus operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import ensure_checkpoint_dir, materialize  # noqa: F401

#: Bytes of one Arrow batch sent to a Python worker; bounds a worker's memory however long the texts are.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as a batch of 10,000 very long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, row_fn_factory, schema: str) -> DataFrame:
    """Apply a row function to ``df`` in Arrow batches.

    ``row_fn_factory()`` runs once in each task and returns ``f(*values) -> tuple`` over the
    columns of ``df``, so that models and caches are built once a task, not once a row. An attribute
    ``close`` of f is called at the task's end, since the worker lives on.
    """
    bound_batches(df.sparkSession)
    names = [part.strip().split()[0] for part in split_schema(schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = row_fn_factory()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_pylist() for c in batch.columns]
            rows = [fn(*values) for values in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)
            del columns, rows
        getattr(fn, "close", lambda: None)()

    types = arrow_types(schema)
    return df.mapInArrow(run, schema)


class Memory(dict):
    """Values by key, worked out when first asked for; at most two generations of ``limit`` keys.

    A full generation becomes the old one, of which only what is asked for again stays. Keys longer
    than ``longest`` are not remembered, so the memory has a bound in bytes.
    """

    def __init__(self, work, limit: int, longest: int) -> None:
        super().__init__()
        self.work, self.limit, self.longest, self.old = work, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def split_schema(schema: str) -> list[str]:
    """Split a DDL schema at its top-level commas."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]


def arrow_types(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)).types)


#: Distinct edges up to which one task joins them all in memory; more go by rounds.
LOCAL_EDGES = 100_000


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Label the vertices of an edge list (``src``, ``dst`` long) with the smallest vertex each can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a
    pre-aggregated minimum and an equi-join on the vertex, so a hub is split by the engine's skew
    join, and nothing but two counters a round reaches the driver. Returns (node, root) for the
    vertices that are not their own root. Loops and repeated edges are harmless; no edges: no rows.
    Up to ``local_edges`` edges, counted first, are joined by one task: rounds would cost more than the edges.
    """
    e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    if e.count() <= local_edges:
        return materialize(e.coalesce(1).mapInArrow(_joined, "node long, root long"))
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (u, v) of one task, by union and find; a root is its component's smallest vertex."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    found = [(x, root) for x in list(parent) if (root := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["node", "root"])


def forest(n: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of ``pairs`` over 0..n-1: at most n - 1 edges whatever the number of pairs."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def fresh(name: str) -> str:
    """A column name that cannot clash with a caller's."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"
