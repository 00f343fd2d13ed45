"""SimHash near-duplicate groups by BK-trees over shards of fingerprints.

1. A text becomes words, 3-word shingles and a 64-bit SimHash of their XXH64 hashes (one Arrow pass).
2. Equal fingerprints are collapsed first, so a group of exact copies costs one row.
3. Two fingerprints within ``RADIUS`` = 2 bits agree on at least two of four 16-bit blocks. Each
   distinct fingerprint is sent to the six shards named by its pairs of blocks; a shard holds the
   fingerprints that share 32 bits. A shard over ``SHARD_ROWS`` is dealt again by a third block
   (48 bits shared in six ways), before its rows are gathered, and inside a task a shard is cut
   further by the same argument, so no tree is over ``TREE_NODES`` unless no bits are left to cut.
4. Every shard's BK-tree has children keyed by the Hamming distance to their parent; a query follows
   only the edges within the radius. A task emits a spanning forest, never the pairs of a group.
5. Components over the distinct fingerprints, then a join back to the rows.

The trees go to the executors that hold their shards instead of through a driver broadcast: a
broadcast tree over the whole corpus has no size bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_types, connected_components, forest, fresh, map_rows, materialize, split_schema

RADIUS = 2
SHINGLE_WORDS = 3
#: Rows of a shard above which it is dealt by more bits.
SHARD_ROWS = 200_000
#: Nodes of one BK-tree above which the shard is cut inside its task.
TREE_NODES = 2048
#: Hashes of one text handled at a time, which bounds memory for very long texts.
HASH_BLOCK = 1 << 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for null or wordless texts.

    bytes.split() separates at 0x09-0x0D and 0x20, the separators of the word rule.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest, join, k = xxhash.xxh64_intdigest, b" ".join, shingle_words
    n = max(1, len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASH_BLOCK):
        block = range(at, min(n, at + HASH_BLOCK))
        hashes = np.fromiter((digest(join(words[i : i + k]), 42) for i in block), dtype="<u8", count=len(block))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long)."""
    types = dict(docs.select(*keep).dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp long"

    def factory():
        def one(*row):
            value = fingerprint(row[-1])
            return (*row[:-1], value - (1 << 64) if value >> 63 else value)

        return one

    return map_rows(docs.select(*keep, F.col(text_col).cast("string").alias("text")), factory, schema)


class BKTree:
    """A Burkhard-Keller tree under Hamming distance over distinct 64-bit integers."""

    __slots__ = ("values", "children")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        new = len(values)
        if new:
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                nxt = children[at].get(d)
                if nxt is None:
                    children[at][d] = new
                    break
                at = nxt
        values.append(value)
        children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the values within ``radius``, following only edges whose key can lead there."""
        if not self.values:
            return []
        found, stack, values, children = [], [0], self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = children[at]
            if kids:
                for key in range(d - radius, d + radius + 1):
                    nxt = kids.get(key)
                    if nxt is not None:
                        stack.append(nxt)
        return found


def shard_links(values: np.ndarray, free: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of values, of the links within one shard.

    ``free``: the bits in which members may differ. A shard over TREE_NODES is cut into
    ``radius + 1`` ranges of free bits: linked members agree on one of them.
    """
    n = len(values)
    if n < 2:
        return []
    if n <= TREE_NODES or len(free) <= radius + 1:
        tree, pairs = BKTree(), []
        items = values.tolist()
        for i, value in enumerate(items):
            pairs += ((j, i) for j in tree.within(value, radius))
            tree.add(value)
            if len(pairs) > 8 * n:
                pairs = forest(n, pairs)
        return [(items[a], items[b]) for a, b in forest(n, pairs)]
    links: list[tuple[int, int]] = []
    for part in np.array_split(np.array(free, dtype=np.uint64), radius + 1):
        mask = np.uint64(0)
        for bit in part:
            mask |= np.uint64(1) << bit
        key = values & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rest = [b for b in free if b not in set(part.tolist())]
        for group in np.split(order, cuts):
            links += shard_links(values[group], rest, radius)
    if len(links) > n:
        index = {v: i for i, v in enumerate(values.tolist())}
        links = [(int(values[a]), int(values[b])) for a, b in forest(n, ((index[a], index[b]) for a, b in links))]
    return links


def _mask(blocks: Iterable[int]) -> int:
    return sum(0xFFFF << (16 * b) for b in blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: For each pair of blocks: the mask of the bits a shard shares, and the bits left free.
PAIRS = [(m := _mask(c), [bit for bit in range(64) if not (m >> bit) & 1]) for c in combinations(range(4), 2)]


def _finer(mask: int, free: list[int]) -> list[tuple[int, list[int]]]:
    """Cut the free bits into RADIUS + 1 ranges; linked members of a shard agree on at least one."""
    parts = [part.tolist() for part in np.array_split(np.array(free), RADIUS + 1)]
    return [(mask | sum(1 << b for b in part), [b for b in free if b not in part]) for part in parts]


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once for each mask: (cut, shard, fp)."""
    options = F.array(*[F.struct(F.lit(i).alias("cut"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(options).alias("o")).select("o.cut", "o.shard", "fp")


def _forests(dealt: DataFrame, frees: list[list[int]]) -> DataFrame:
    """Search every shard's tree; shards stream through a task one after another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, []

        def close() -> list[tuple[int, int]]:
            if len(members) < 2:
                return []
            values = np.array(members, dtype=np.int64).view(np.uint64)
            return shard_links(np.unique(values), frees[current[0]])

        def table(found):
            signed = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["src", "dst"])

        for batch in batches:
            found = []
            for cut, shard, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (cut, shard) != current:
                    found += close()
                    current, members = (cut, shard), []
                members.append(fp)
            if found:
                yield table(found)
        if found := close():
            yield table(found)

    return dealt.repartition("cut", "shard").sortWithinPartitions("cut", "shard").mapInArrow(run, "src long, dst long")


def links(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (src, dst) between the distinct ``fp`` whose components are those of all pairs within RADIUS bits."""
    masks, frees = [m for m, _ in PAIRS], [f for _, f in PAIRS]
    dealt = _dealt(fps, masks)
    hot = materialize(dealt.groupBy("cut", "shard").count().where(F.col("count") > shard_rows).select("cut", "shard"))
    if hot.isEmpty():
        return _forests(dealt, frees)
    calm = _forests(dealt.join(hot, ["cut", "shard"], "left_anti"), frees)
    finer = [(i, m, f) for i, (mask, free) in enumerate(PAIRS) for m, f in _finer(mask, free)]
    full = dealt.join(hot, ["cut", "shard"], "left_semi").withColumnRenamed("cut", "pair")
    options = F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(i).alias("of"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for n, (i, m, _) in enumerate(finer)])
    again = full.select("fp", F.explode(F.filter(options, lambda o: o["of"] == F.col("pair"))).alias("o")).select("o.cut", "o.shard", "fp")
    return calm.unionByName(_forests(again, [f for _, _, f in finer]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id, n_copies.

    component_id is the smallest id reachable through links of at most RADIUS bits, the row's own
    included. n_copies counts the rows with the same fingerprint. Nulls: a null text is a wordless
    text (fingerprint zero, linked like any other); a null id is kept in its row, and never chosen
    as component_id unless the component has no other. Repeated rows stay repeated. An empty table
    gives no rows. Columns other than the two named are not read.
    """
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ("id",)))
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n_copies")))
    roots = connected_components(links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n_copies", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id", "n_copies")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


#: The rule of keep_one: texts are near copies whose sets of five-word shingles have at least this Jaccard similarity.
KEEP_WORDS = 5
SIMILARITY = 0.8
#: Bits by which the SimHashes of two such sets differ at most: at SIMILARITY 9.7 of 64 are expected, with a
#: deviation of 2.9, so that about one pair in two thousand at the very threshold differs in more.
KEEP_RADIUS = 20
#: MinHash bands, which deal the sets into shards: a pair at SIMILARITY shares no shard with probability (1 - 0.8^4)^16 = 0.0002.
BANDS, BAND_ROWS = 16, 4
#: Bands that the first round looks at; the others' shards then hold fewer components.
FIRST_BANDS = 4
#: Of the BANDS * BAND_ROWS MinHashes so many must agree before a candidate is judged by the whole sets: at SIMILARITY
#: 51 are expected, with a deviation of 3.2, so that less than one pair in a thousand is lost.
AGREE = 41
#: Buckets of the filter that keeps texts no pair asks for from the shuffle: a broadcast of so many rows at most.
FILTER_BUCKETS = 1 << 18
#: Sets of one tree above which a shard is dealt by hash into several, anew in each round.
CELL_ROWS = 256
#: Shingles of one side of a block of the last pass, which bounds its bytes.
BLOCK_SHINGLES = 1 << 20
_MIX = np.random.default_rng(1).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle_words: int = KEEP_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's shingles, lower-cased; none for a wordless text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(words) - shingle_words + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), 42) for i in range(n)), dtype=np.uint64, count=n))


def set_hash(values: np.ndarray) -> int:
    """Signed hash of a set of shingles; 0 for the empty one."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(values.tobytes())) if len(values) else 0


def sketch(values: np.ndarray) -> tuple[int, list[int], bytes]:
    """(SimHash of the set, a hash for each band, the last byte of each MinHash), integers signed. A wordless text has no bands."""
    import xxhash

    least, ones = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 12):
        block = values[at : at + (1 << 12)]
        least = np.minimum(least, (block[:, None] * _MIX[0] + _MIX[1]).min(axis=0))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])
    bands = [_signed(xxhash.xxh64_intdigest(b.tobytes())) for b in least.reshape(BANDS, BAND_ROWS)] if len(values) else []
    return _signed(bits), bands, (least >> np.uint64(24)).astype(np.uint8).tobytes()


def cell_pairs(members: list[tuple[int, int, int, int, bytes]], radius: int = KEEP_RADIUS) -> tuple[list[tuple[int, int]], bool]:
    """Candidate pairs of one cell that join its components, and whether others were left out.

    ``members``: (set hash, size of the set, SimHash, component, MinHash bytes). A BK-tree over the SimHashes gives
    the pairs within the radius; those whose sizes or MinHashes rule SIMILARITY out, or that are inside a
    component, are none. Of the rest a spanning forest over the components is taken, those whose MinHashes agree
    most first: however many pairs a cell has, what leaves it is linear in its members.
    """
    members = sorted(members)
    roots = {m[3]: m[3] for m in members}
    if len(roots) < 2:
        return [], False

    def find(x: int) -> int:
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    marks = np.frombuffer(b"".join(m[4] for m in members), dtype=np.uint8).reshape(len(members), -1)
    sizes, comps = np.array([m[1] for m in members]), np.array([m[3] for m in members])
    tree, at, same = BKTree(), [], {}
    taken: list[tuple[int, int]] = []
    more = False
    for i, (fp, n, sim, comp, _) in enumerate(members):
        sim &= (1 << 64) - 1
        near = np.array(sorted(j for node in tree.within(sim, radius) for j in at[node]), dtype=np.int64)
        if len(near):
            near = near[(comps[near] != comp) & (np.minimum(sizes[near], n) >= SIMILARITY * np.maximum(sizes[near], n))]
            agree = (marks[near] == marks[i]).sum(axis=1)
            near = near[np.argsort(-agree, kind="stable")[: int((agree >= AGREE).sum())]]  # the likeliest links first
        for j in near.tolist():
            a, b = find(comp), find(members[j][3])
            if a == b:
                more = True
                continue
            roots[max(a, b)] = min(a, b)
            taken.append((members[j][0], fp))
        if sim in same:
            at[same[sim]].append(i)
        else:
            same[sim] = len(at)
            tree.add(sim)
            at.append([i])
    return taken, more


def alike(one: bytes, two: bytes) -> bool:
    """Whether two whole sets are near copies."""
    x, y = np.frombuffer(one, dtype=np.uint32), np.frombuffer(two, dtype=np.uint32)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= SIMILARITY * (len(x) + len(y) - shared)


def block_links(members: list[tuple[int, int, int, int, int, bytes, bytes]], radius: int = KEEP_RADIUS) -> list[tuple[int, int]]:
    """Links of one block that join its components, none left out: every candidate pair between two components is judged.

    ``members``: (side, set hash, size of the set, SimHash, component, MinHash bytes, set). Of two sides only pairs across
    count. A pair is passed over only where links already found join it, so what leaves is a forest.
    """
    members = sorted(members)
    sides = np.array([m[0] for m in members])
    sizes = np.array([m[2] for m in members])
    sims = np.array([m[3] for m in members], dtype=np.int64).view(np.uint64)
    comps = np.array([m[4] for m in members], dtype=np.int64)
    marks = np.frombuffer(b"".join(m[5] for m in members), dtype=np.uint8).reshape(len(members), -1)
    first = int((sides == sides[0]).sum())  # where the other side begins
    found = []
    for i in range(first if first < len(members) else 1, len(members)):
        end = min(i, first)
        likely = (comps[:end] != comps[i]) & (np.minimum(sizes[:end], sizes[i]) >= SIMILARITY * np.maximum(sizes[:end], sizes[i]))
        near = np.flatnonzero(likely & (np.bitwise_count(sims[:end] ^ sims[i]) <= radius))
        agree = (marks[near] == marks[i]).sum(axis=1)
        for j in near[np.argsort(-agree, kind="stable")[: int((agree >= AGREE).sum())]].tolist():
            if comps[j] != comps[i] and alike(members[j][6], members[i][6]):
                comps[comps == max(comps[i], comps[j])] = min(comps[i], comps[j])
                found.append((members[j][1], members[i][1]))
    return found


def _by_cell(cells: DataFrame, made, schema: str) -> DataFrame:
    """``made(table)`` gives the rows of ``schema`` for each value of the column cell, one cell after another in a task."""
    columns = [c for c in cells.columns if c != "cell"]
    names, types = [part.strip().split()[0] for part in split_schema(schema)], arrow_types(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the cell that is not yet at its end

        def found(parts: list[pa.RecordBatch]) -> list[tuple]:
            table = pa.Table.from_batches(parts)
            return made(list(zip(*(table.column(c).to_pylist() for c in columns)))) if table.num_rows > 1 else []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist(), len(cell)]
            out = []
            for start, end in zip(cuts[:-1], cuts[1:]):
                if rest and rest[0].column("cell")[0].as_py() != cell[start]:
                    out += found(rest)
                    rest = []
                rest.append(batch.slice(start, end - start))
            yield table(out)
        if rest:
            yield table(found(rest))

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a cell costs work, not bytes: not to be coalesced by size
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "fp").mapInArrow(run, schema)


def _candidates(cells: DataFrame) -> DataFrame:
    """(bucket, a, b, more) of every cell's pairs. ``cells``: cell, bucket, fp, n, sim, comp, marks."""

    def made(rows: list[tuple]) -> list[tuple]:
        pairs, more = cell_pairs([r[1:] for r in rows])
        return [(rows[0][0], a, b, more) for a, b in pairs]

    return _by_cell(cells.select("cell", "bucket", "fp", "n", "sim", "comp", "marks"), made, "bucket long, a long, b long, more boolean")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) by the whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [alike(one.as_py(), two.as_py()) for one, two in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("v").alias("va")), "a").join(sets.select(F.col("fp").alias("b"), F.col("v").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, linked boolean")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (bucket, fp, n, comp) with cell and side: blocks in which every two members of a shard from two components meet.

    A shard's largest component is dealt into parts of BLOCK_SHINGLES by hash, and so are its other members. Each
    part of the others meets every part of the largest component and every part of the others; a shard of one component has no block.
    """
    each = materialize(members.groupBy("bucket", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("size")))
    shard = each.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    parts = lambda size: F.greatest(F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    shard = shard.select("bucket", F.col("main.comp").alias("main"), parts(F.col("main.size")).alias("mains"), parts(F.col("size") - F.col("main.size")).alias("others"))
    rows = members.join(shard, "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "bucket"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    block = lambda kind, one, two, side: F.struct(F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.cast("int").alias("side"))
    own, all_others = F.col("own"), F.sequence(F.lit(0), F.col("others") - 1)
    of_main = F.transform(all_others, lambda k: block(0, own, k, F.lit(0)))
    of_other = F.concat(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: block(0, k, own, F.lit(1))), F.transform(all_others, lambda k: block(1, F.least(own, k), F.greatest(own, k), own > k)))
    rows = rows.select("bucket", "fp", "comp", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)).alias("block"))
    return rows.select(F.xxhash64("bucket", "block.kind", "block.one", "block.two").alias("cell"), "block.side", "fp", "comp")


def near_copies(distinct: DataFrame, sets_of) -> DataFrame:
    """(node, root) for the sets of ``distinct`` (fp, n, sim, marks, bands) that are not their component's smallest.

    Two rounds, in the shards of a few bands and then in all: every shard's tree proposes a spanning forest of its
    candidate pairs, the whole sets judge them and components merge. Shards over CELL_ROWS are dealt into cells by
    hash, anew in each round and each shard. A last pass judges all that the rounds left out: in the shards whose pairs
    were refuted while others had been left out, and in those dealt into cells, every candidate pair between
    two components, with the whole sets at hand (``block_links``). ``sets_of(fps)`` gives (fp, v): the sets.
    """
    dealt = distinct.select("fp", F.posexplode("bands").alias("band", "key")).select("band", F.xxhash64("band", "key").alias("bucket"), "fp")
    shards = dealt.groupBy("band", "bucket").count().where("count > 1")
    shards = materialize(shards.select("band", "bucket", F.ceil(F.col("count") / CELL_ROWS).alias("cells")))
    members = materialize(dealt.drop("band").join(shards.select("bucket", "cells"), "bucket"))
    sets, links, judged, roots, left_out = None, None, None, None, shards.where("cells > 1").select("bucket")

    def labelled(active: DataFrame) -> DataFrame:
        found = members.join(active, "bucket", "left_semi").join(distinct.select("fp", "n"), "fp")
        return found.withColumn("comp", F.col("fp")) if roots is None else found.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")

    def read(wanted: DataFrame) -> None:
        nonlocal sets
        found = materialize(sets_of(wanted if sets is None else wanted.join(sets, "fp", "left_anti")))
        sets = found if sets is None else sets.unionByName(found)

    for turn, active in enumerate((shards.where(F.col("band") < FIRST_BANDS), shards)):
        cell = F.when(F.col("cells") > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("fp", "bucket", F.lit(turn)), F.col("cells")))).otherwise(F.col("bucket"))
        cells = labelled(active.select("bucket")).join(distinct.select("fp", "sim", "marks"), "fp").withColumn("cell", cell)
        proposed = materialize(_candidates(cells))
        pairs = proposed.select("a", "b").distinct()
        pairs = materialize(pairs if judged is None else pairs.join(judged, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            read(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
            now = materialize(_judged(pairs, sets))
            judged = now if judged is None else judged.unionByName(now)
            linked = now.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
            links = linked if links is None else links.unionByName(linked)
            roots = connected_components(links)
    if judged is not None:
        left_out = left_out.unionByName(proposed.where("more").join(judged.where("not linked"), ["a", "b"], "left_semi").select("bucket")).distinct()
    blocks = materialize(_blocks(labelled(left_out)))
    if not blocks.isEmpty():
        read(blocks.select("fp").distinct())
        whole = blocks.join(distinct.select("fp", "n", "sim", "marks"), "fp").join(sets, "fp").select("cell", "side", "fp", "n", "sim", "comp", "marks", "v")
        rest = materialize(_by_cell(whole, block_links, "src long, dst long"))
        roots = connected_components(rest if links is None else links.unionByName(rest))
    return distinct.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0) if roots is None else roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one row of each near-duplicate group stays.

    A group is a component of texts linked by SIMILARITY of their five-word shingles. The texts' SimHashes
    are searched by BK-trees, one for each shard that MinHash bands make, within KEEP_RADIUS; the whole
    sets (as 32-bit hashes of shingles) decide. Wordless and null texts are one group. The row kept has
    the smallest id, nulls last, then the smallest row hash. Rows that share an id, or have none, but not a
    text all stay. A row is known by two hashes of its columns, so copies of one text are dealt by row and no
    id or text is a hot key; rows equal in all columns are collapsed before they are shuffled. An empty
    table stays empty; columns may have any name.
    """
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    nulls = [F.col(f"`{c}`").isNull() for c in (id_col, text_col)]
    one, two = fresh("hash"), fresh("hash")
    keyed = docs.withColumns({one: F.xxhash64(*plain, *nulls), two: F.xxhash64(F.lit(1), *plain, *nulls)})
    keys = keyed.select(F.col(id_col).alias("id"), F.col(one).alias("h1"), F.col(two).alias("h2"), F.col(text_col).cast("string").alias("text"))

    def sketched():
        def run(no_id, id_, h1, h2, text):
            values = shingles(text)
            sim, bands, marks = sketch(values)
            return no_id, id_, h1, h2, set_hash(values), len(values), sim, bands, marks

        return run

    kind = dict(keys.dtypes)["id"]
    rows = map_rows(keys.select(F.col("id").isNull().alias("no_id"), "id", "h1", "h2", "text"), sketched, f"no_id boolean, id {kind}, h1 long, h2 long, fp long, n int, sim long, bands array<long>, marks binary")
    distinct = materialize(rows.groupBy("fp").agg(F.min(F.struct("no_id", "id", "h1", "h2")).alias("first"), *[F.first(c).alias(c) for c in ("n", "sim", "bands", "marks")]))

    def sets_of(fps: DataFrame) -> DataFrame:
        def whole_set():
            def run(text):
                values = shingles(text)
                return set_hash(values), np.unique(values.astype(np.uint32)).tobytes()

            return run

        firsts = materialize(fps.join(distinct, "fp").select("first.h1", "first.h2"))
        place = F.pmod("h1", F.lit(FILTER_BUCKETS)).alias("place")
        asked = F.broadcast(firsts.select(place).distinct())  # FILTER_BUCKETS rows at most
        texts = keys.withColumn("place", place).join(asked, "place", "left_semi").join(firsts, ["h1", "h2"], "left_semi").select("text")
        return map_rows(texts, whole_set, "fp long, v binary").groupBy("fp").agg(F.first("v").alias("v"))

    roots = near_copies(distinct.select("fp", "n", "sim", "marks", "bands"), sets_of)
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    keep = labelled.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.h1").alias(one), F.col("first.h2").alias(two))
    whole = keyed.groupBy(one, two).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return whole.join(keep, [one, two], "left_semi").select("row.*")
