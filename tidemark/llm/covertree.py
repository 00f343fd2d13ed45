"""Exact cosine-threshold pairs by dual traversal of cover trees.

Unit vectors with cosine >= c lie within Euclidean distance sqrt(2 - 2c). Vectors are compared
only inside their group (label and length). Equal vectors are collapsed first.

The upper levels of a group's tree are distributed. A cell (at first the group) over ``BLOCK_ROWS``
vectors takes some of its vectors, the first by hash, as centres, about as many as it holds blocks; every vector goes to the nearest, the
centres' cells get their true covering radii, and cells still too large are split again. Rows of a large
cell are dealt by hash, the centres going along to each part. The dual traversal starts at the pair
(group, group) and goes down level by level: a pair of cells stays only if d(p, q) <= r_p + r_q + reach, and
only pairs that stay have their children paired.

For each pair of the smallest cells left, a task builds a cover tree on each side: nested levels of
centres whose radii halve, every node with its true covering radius, by distances to the centres only. Node
pairs are pruned by the same bound; where d(p, q) + r_p + r_q is within the reach all pairs link
without being compared; what remains is tested by its cosine. A task returns the number of links of
each vector and a spanning forest, so a group of near copies never leaves a task as pairs, and a
dense one costs what its nodes cost.

In unclustered data of many dimensions few pairs can be pruned and the work stays quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, connected_components, forest, materialize

THRESHOLD = 0.93
BLOCK_ROWS = 2048
#: Centres of a cell that is split: as many as it holds blocks, within these limits.
LEAST_PIVOTS, MOST_PIVOTS = 4, 64
#: Rows of a cell that one task compares with the centres.
PART_ROWS = 16_384
#: Leaves are compared directly below this many members of a node.
LEAF_ROWS = 32
#: Rows that are looked at together as the next centres of a node's children.
CENTRES = 64
#: Node pairs looked at together, which bounds a traversal's memory.
FRONTIER = 1 << 15
#: Distances of centres worked out at a time.
MATRIX = 1 << 21
#: Slack that keeps rounding of distances from pruning, or taking in, a pair at the threshold itself.
SLACK = 1e-7


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest part first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y)))


class CoverTree:
    """A cover tree over the rows of a matrix of unit vectors.

    Node i: its centre (a row), its true covering radius, its children and its member rows. A node's
    children are centred within its members, its own centre first (nesting), and each child's
    members lie within half the level's radius of the child's centre (covering).
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(x):
            rows = np.arange(len(x))
            self._build(rows, _distance(x, x[0]))

    def _add(self, members: np.ndarray, centre: int, distances: np.ndarray) -> int:
        self.centre.append(int(centre))
        self.radius.append(float(distances.max()))
        self.children.append([])
        self.members.append(members)
        return len(self.centre) - 1

    def _build(self, members: np.ndarray, distances: np.ndarray) -> None:
        stack = [(self._add(members, 0, distances), distances, 2.0)]
        while stack:
            node, distances, level = stack.pop()
            rows, centre = self.members[node], self.centre[node]
            if len(rows) <= LEAF_ROWS or self.radius[node] <= SLACK:
                continue
            while level / 2 >= self.radius[node]:
                level /= 2
            half = level / 2
            near = (distances <= half) | (rows == centre)
            self._child(node, rows[near], centre, distances[near], half, stack)
            rest = rows[~near]
            while len(rest):
                # Distances to the next few that may become centres, at once; then one after the other.
                apart = _distance(self.x[rest], self.x[rest[:CENTRES]].T)
                free = np.ones(len(rest), dtype=bool)
                for i in range(apart.shape[1]):
                    if free[i]:
                        near = free & (apart[:, i] <= half)
                        near[i] = True
                        self._child(node, rest[near], int(rest[i]), apart[near, i], half, stack)
                        free &= ~near
                rest = rest[free]

    def _child(self, node: int, members: np.ndarray, centre: int, distances: np.ndarray, half: float, stack: list) -> None:
        child = self._add(members, centre, distances)
        self.children[node].append(child)
        stack.append((child, distances, half))

    def __len__(self) -> int:
        return len(self.centre)


def dual(a: CoverTree, b: CoverTree, threshold: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("all", node of a, node of b): all pairs of their members link; ("some", rows of a, rows of b): pairs that do.

    If ``a`` is ``b``, each pair of different nodes comes in one order, and a node's pair with itself holds its pairs of rows.
    """
    if not len(a) or not len(b):
        return
    reach = math.sqrt(2.0 - 2.0 * threshold)
    same = a is b
    ca, cb, ra, rb = np.array(a.centre), np.array(b.centre), np.array(a.radius), np.array(b.radius)
    na, nb = np.array([len(c) for c in a.children]), np.array([len(c) for c in b.children])

    def grown(p: np.ndarray, q: np.ndarray, upper: bool = False):
        """The pairs of nodes p of a with nodes q of b that the bound leaves, with their centres' distances."""
        found = []
        for at in range(0, len(q), width := max(1, MATRIX // len(p))):
            some = q[at : at + width]
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[ca[p]] @ b.x[cb[some]].T)))
            near = d <= ra[p][:, None] + rb[some][None, :] + reach + SLACK
            i, j = np.nonzero(np.triu(near, -at) if upper else near)
            found.append((p[i], some[j], d[i, j]))
        return found

    def groups(key: np.ndarray, other: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, other = key[order], other[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        return zip(key[cuts].tolist(), np.split(other, cuts[1:])) if len(key) else ()

    todo = grown(np.array([0]), np.array([0]))
    while todo:
        p, q, d = todo.pop()
        whole = d + ra[p] + rb[q] <= reach - SLACK
        if same:  # rows of one node are apart by twice its radius at most
            whole = np.where(p == q, 2 * ra[p] <= reach - SLACK, whole)
        for i, j in zip(p[whole].tolist(), q[whole].tolist()):
            yield "all", i, j
        p, q = p[~whole], q[~whole]
        leaves = (na[p] == 0) & (nb[q] == 0)
        yield from _leaves(a, b, p[leaves], q[leaves], threshold)
        p, q = p[~leaves], q[~leaves]
        itself = (p == q) if same else np.zeros(len(p), dtype=bool)
        left = ~itself & (na[p] > 0) & ((nb[q] == 0) | (ra[p] >= rb[q]))
        right = ~itself & ~left
        new = []
        for node, others in groups(p[left], q[left]):
            new += grown(np.array(a.children[node]), others)
        for node, others in groups(q[right], p[right]):
            new += grown(others, np.array(b.children[node]))
        for node in p[itself].tolist():
            kids = np.array(a.children[node])
            new += grown(kids, kids, upper=True)
        if new:
            p, q, d = (np.concatenate(x) for x in zip(*new))
            todo += [(p[at : at + FRONTIER], q[at : at + FRONTIER], d[at : at + FRONTIER]) for at in range(0, len(p), FRONTIER)]


def _leaves(a: CoverTree, b: CoverTree, p: np.ndarray, q: np.ndarray, threshold: float):
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1) if len(p) else []:
        rows, cols = a.members[p[at[0]]], np.concatenate([b.members[k] for k in q[at]])
        owner = np.repeat(q[at], [len(b.members[k]) for k in q[at]])
        x, y = np.nonzero(a.x[rows] @ b.x[cols].T >= threshold)
        if a is b:
            inner = owner[y] == p[at[0]]
            keep = ~inner | (rows[x] < cols[y])
            x, y = x[keep], y[keep]
        if len(x):
            yield "some", rows[x], cols[y]


def block_links(left: np.ndarray, right: np.ndarray | None, threshold: float, w_left: np.ndarray, w_right: np.ndarray | None):
    """Links within one block, or between two: link counts of both sides and a spanning forest.

    ``w``: how many vectors each row stands for. Rows of the right side follow the left's in the forest.
    """
    a = CoverTree(left)
    b = a if right is None else CoverTree(right)
    counts_a = np.zeros(len(left), dtype=np.int64)
    counts_b = counts_a if right is None else np.zeros(len(right), dtype=np.int64)
    wb = w_left if right is None else w_right
    shift, n = (0, len(left)) if right is None else (len(left), len(left) + len(right))
    kept: list[tuple[int, int]] = []
    for kind, x, y in dual(a, b, threshold):
        if kind == "all":
            rows, cols = a.members[x], b.members[y]
            if right is None and x == y:
                counts_a[rows] += w_left[rows].sum() - w_left[rows]
            else:
                counts_a[rows] += wb[cols].sum()
                counts_b[cols] += w_left[rows].sum()
            kept += [(a.centre[x], c) for c in (cols + shift).tolist()]
            kept += [(r, b.centre[y] + shift) for r in rows.tolist()]
        else:
            np.add.at(counts_a, x, wb[y])
            np.add.at(counts_b, y, w_left[x])
            kept += zip(x.tolist(), (y + shift).tolist())
        if len(kept) > 8 * n:
            kept = forest(n, kept)
    return counts_a, counts_b, forest(n, kept)


def _matrix(column) -> np.ndarray:
    """The rows of a column of arrays of equal length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _split(work: DataFrame, sizes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the cells in ``sizes`` (cell, n) in their cells' children; (cell, parent, centre, r, n) of the children.

    ``work``: cell, node, weight, v.
    """
    vector = dict(work.dtypes)["v"]
    big = work.join(sizes, "cell")
    first = Window.partitionBy("cell").orderBy(F.xxhash64("cell", "v"), "node")
    pivots = materialize(big.select("cell", "n", "v", "node").withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= MOST_PIVOTS).where(F.col("rank") <= F.greatest(F.ceil(F.col("n") / block_rows), F.lit(LEAST_PIVOTS))))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("long")
    rows = big.select("cell", F.pmod(F.xxhash64("node"), parts).alias("part"), F.lit(0).cast("long").alias("rank"), "node", "weight", "v")
    centres = pivots.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "rank", "node", F.lit(0).cast("long").alias("weight"), "v")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, found = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, rank, node = (np.asarray(batch.column(i)) for i in range(4))
            x = units(_matrix(batch.column(5)))
            child, apart = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]).tolist()
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                if (cell[start], part[start]) != now:
                    now, names, found = (cell[start], part[start]), [], []
                inner = slice(start + int((rank[start:end] > 0).sum()), end)  # the centres come first
                names += rank[start : inner.start].tolist()
                found += list(x[start : inner.start])
                if inner.start < end:
                    cosines = x[inner] @ np.stack(found).T
                    best = cosines.argmax(axis=1)
                    # Of centres equally near, as those of parallel vectors are, each takes its share.
                    tied = cosines >= cosines.max(axis=1, keepdims=True) - 1e-12
                    for i in np.flatnonzero(tied.sum(axis=1) > 1).tolist():
                        best[i] = (equal := np.flatnonzero(tied[i]))[hash(int(node[inner.start + i])) % len(equal)]
                    child[inner] = np.array(names)[best]
                    apart[inner] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines[np.arange(len(best)), best]))
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(child), pa.array(apart), *(batch.column(i) for i in (3, 4, 5))], names=["parent", "child", "apart", "node", "weight", "v"])
            yield made.filter(pa.array(rank == 0))

    dealt = rows.unionByName(centres).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("rank") == 0, "rank")
    placed = dealt.mapInArrow(place, f"parent long, child long, apart double, node long, weight long, v {vector}")
    placed = materialize(placed.select(F.xxhash64("parent", "child").alias("cell"), "parent", "child", "apart", "node", "weight", "v"))
    balls = placed.groupBy("cell", "parent", "child").agg(F.max("apart").alias("r"), F.count("*").alias("n"))
    named = pivots.select(F.col("cell").alias("parent"), F.col("rank").alias("child"), F.col("v").alias("centre"))
    return placed.select("cell", "node", "weight", "v"), materialize(balls.join(named, ["parent", "child"]).select("cell", "parent", "centre", "r", "n"))


def _cells(nodes: DataFrame, block_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (cell, node, weight, v) in their smallest cells, and the balls of each level of cells."""
    work = nodes.select(F.xxhash64("label", "dim").alias("cell"), "node", "weight", "v")
    vector = dict(work.dtypes)["v"]
    roots = work.groupBy("cell").agg(F.count("*").alias("n"))
    levels, done = [materialize(roots.select("cell", F.lit(None).cast("long").alias("parent"), F.lit(None).cast(vector).alias("centre"), F.lit(2.0).alias("r"), "n"))], None
    while True:
        sizes = materialize(levels[-1].where(F.col("n") > block_rows).select("cell", "n"))
        if sizes.isEmpty():
            break
        ready = work.join(sizes.select("cell"), "cell", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        work, balls = _split(work, sizes, block_rows)
        levels.append(balls)
    return (work if done is None else done.unionByName(work)), levels


def _pairs(levels: list[DataFrame], threshold: float) -> DataFrame:
    """(one, two) of the smallest cells that may hold links, each pair once: the dual traversal of the upper levels."""
    reach = math.sqrt(2.0 - 2.0 * threshold) + SLACK

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = units(_matrix(batch.column("c1"))), units(_matrix(batch.column("c2")))
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, y)))
                stays = d <= np.asarray(batch.column("r1")) + np.asarray(batch.column("r2")) + reach
                yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("two")], names=["one", "two"]).filter(pa.array(stays))

    pairs = levels[0].select(F.col("cell").alias("one"), F.col("cell").alias("two"))
    known = levels[0].limit(0)
    for level in levels[1:]:
        # A cell that was split gives way to its children; others stay as they are.
        split = level.select("parent", "cell", "centre", "r")
        known = known.unionByName(level)
        balls = known.select("cell", "centre", "r")
        children = split.select(F.col("parent").alias("of"), F.col("cell").alias("to"))
        one = pairs.join(children.withColumnRenamed("of", "one"), "one", "left").select(F.coalesce("to", "one").alias("one"), "two")
        both = one.join(children.withColumnRenamed("of", "two"), "two", "left").select("one", F.coalesce("to", "two").alias("two"))
        # A pair of siblings comes in both orders from (parent, parent); other pairs keep one order.
        both = both.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
        roots = levels[0].where(F.col("cell").isNotNull()).select(F.col("cell").alias("one"), F.col("cell").alias("two"))
        unsplit = both.join(roots, ["one", "two"], "left_semi")  # groups of one cell
        left = balls.select(F.col("cell").alias("one"), F.col("centre").alias("c1"), F.col("r").alias("r1"))
        right = balls.select(F.col("cell").alias("two"), F.col("centre").alias("c2"), F.col("r").alias("r2"))
        measured = both.join(left, "one").join(right, "two").select("one", "two", "c1", "c2", "r1", "r2")
        pairs = materialize(measured.mapInArrow(near, "one long, two long").unionByName(unsplit))
    return pairs


def similarity_classes(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine
    is at least ``threshold``. A null or zero vector, or one with a null or non-finite part, links with
    nothing and is its own component. n_links: the other vectors linked directly. component_id: the
    smallest id reachable. kept: the id is the component's. A null id is kept in its row (its
    component is the smallest non-null id reachable, else null). Repeated rows are vectors of their own
    and link with each other. An empty table gives no rows. No other column is read.
    """
    bound_batches(vectors.sparkSession)
    v = F.col("v")
    ok = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    # A vector is known by its label, length and two hashes; the vector itself is shuffled and written once.
    key = ["label", "dim", "h1", "h2"]
    rows = rows.withColumns({"ok": F.coalesce(ok, F.lit(False)), "dim": F.size(v), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    grouped = rows.where("ok").groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
    blocks, levels = _cells(nodes, block_rows)
    near = _pairs(levels, threshold)
    sides = near.select(F.col("one").alias("cell"), "one", "two").unionByName(near.where("one <> two").select(F.col("two").alias("cell"), "one", "two"))
    sent = blocks.join(sides, "cell").select("one", "two", (F.col("cell") != F.col("one")).alias("second"), "node", "weight", "v")

    def compare(table):
        second = np.array(table["second"].to_pylist(), dtype=bool)
        order = np.lexsort((np.asarray(table["node"]), second))
        x = units(_matrix(table["v"]))[order]
        node, weight = np.asarray(table["node"])[order], np.asarray(table["weight"])[order]
        n = int((~second).sum())
        both = n < len(second)
        ca, cb, edges = block_links(x[:n], x[n:] if both else None, threshold, weight[:n], weight[n:] if both else None)
        counts = np.concatenate([ca, cb]) if both else ca
        linked = np.flatnonzero(counts)
        at = np.array(edges, dtype=np.int64).reshape(-1, 2)
        # Rows of two kinds: counts (dst null) and edges (links 0).
        return pa.table({
            "src": np.concatenate([node[linked], node[at[:, 0]]]),
            "dst": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(node[at[:, 1]], pa.int64())]),
            "links": np.concatenate([counts[linked], np.zeros(len(at), dtype=np.int64)]),
        })

    found = materialize(sent.groupBy("one", "two").applyInArrow(compare, "src long, dst long, links long"))
    counts = found.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("dst is not null").select("src", "dst")).withColumnRenamed("root", "of")
    classes = nodes.select(*key, "first", "weight", "node").join(counts, "node", "left").join(roots, "node", "left").withColumn("of", F.coalesce("of", "node"))
    least = classes.groupBy("of").agg(F.min("first").alias("least"))
    classes = classes.join(least, "of").select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least")
    joined = rows.select("id", "ok", *key).join(classes.withColumn("ok", F.lit(True)), ["ok", *key], "left")
    component = F.when(F.col("ok"), F.col("least")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
