"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy.

Every token is predicted from the two tokens on either side of it, itself masked: their embeddings go
through one tanh layer, and a hierarchical softmax over the vocabulary gives the token's conditional
log-probability. A document's score is the sum over its tokens.

* Vocabulary: the most frequent words, ``VOCABULARY`` at most, counted over all documents; any other word is
  one of ``BUCKETS`` tokens by its hash, so that different rare words are different events.
* Hierarchical softmax: a Huffman tree by the corpus's counts. A token's probability is the product of
  the binary decisions on its path, so all tokens' probabilities add up to one without a sum over the
  vocabulary, in training as in scoring. The decisions' biases start at the corpus's counts: an untrained
  network is the unigram model of the corpus, never random.
* Training: every token of every document is an example once, in one of ``ROUNDS`` rounds, set by its place and a
  hash of the row; a caller's ``every`` takes one token in so many (at least one a document). The examples of a round are
  dealt into shards by hash, each of about ``SHARD_EXAMPLES``; every shard starts from the shared
  parameters and descends over its examples in the order of their hashes. A row of parameters moves by
  the mean over the shards that touched it, weighted by how often they did. Sums are of whole multiples
  of a quantum. So neither partitions nor their order change the model.

Texts are parted into tokens once, and written to the checkpoint folder as numbers by each task's own list of
words; the vocabulary comes from those lists. Token ids, two bytes a token, are dealt to the shards once and
read there by every round. Half of all decisions are at the tree's top, where all of a batch's examples and
all nodes go through matrix products. The driver reads the vocabulary, and one set of parameters a round, whatever the corpus.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_types, bound_batches, materialize

VOCABULARY = 1 << 14
BUCKETS = 1 << 12
DIM = 16
HIDDEN = 16
SIDE = 2
ROUNDS = 3
EVERY = 1
#: A shard hands on one set of parameters, so larger shards exchange less for the same examples.
SHARD_EXAMPLES = 1 << 20
BATCH = 1024
RATE = 0.1
#: Start of Adagrad's sums of squares.
SQUARES = 1.0
#: Distinct words a group of texts has before it ends, and its tokens, where a text is as many as its objects take memory.
COUNTER_WORDS = 400_000
COUNTER_TOKENS = 1 << 23
TEXT_TOKENS = 1 << 5
#: Texts in one Arrow batch of a group.
GROUP_TEXTS = 500
#: Words over this length are counted under their bucket at once.
LONGEST = 40
#: Tokens scored at a time, which bounds memory for very long texts.
BLOCK = 1 << 12
#: Nodes at the tree's top, through which about half of all decisions go: theirs are one matrix product a block.
TOP_NODES = 64
#: Rows of parameters in one record of the exchange.
RECORD_ROWS = 1 << 8
#: Parameters' moves are summed as whole multiples of this.
QUANTUM = 2.0**-16
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
#: Places of an example's target and contexts in a padded text.
WINDOW = SIDE + np.array([0, *OFFSETS])

#: With the whitespace before it and without steps back; as no text ends in whitespace, every search finds at its start.
_TOKEN = re.compile(r"\s*+(\w++|[^\w\s]++)")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower().rstrip())


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


@dataclass
class Vocabulary:
    """The words in order, and the counts of the words and then of the buckets."""

    words: list[str]
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + BUCKETS

    def ids(self) -> Ids:
        """Token ids by word."""
        return Ids(self.words)


class Ids(dict):
    """Token ids of the vocabulary's words; other words go to a bucket by their hash."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.first = len(words)

    def __missing__(self, word: str) -> int:
        return self.first + bucket(word)


class Numbers(dict):
    """Words' numbers, given in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def number(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as numbers of their words, written once: the only pass that parts texts into tokens.

    A task's texts go by groups, each with its own numbers. A group is a row with its words, one a line, their
    counts and their buckets, and then a row (id, x) for each of its texts; rows stay in this order.
    """
    bound_batches(docs.sparkSession)
    schema = f"id {dict(docs.dtypes)[id_col]}, x binary, words string, n binary, bucket binary"
    types = arrow_types(schema)

    def table(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "x", "words", "n", "bucket"])

    def group(numbers, keys, found):
        kind, counts = _width(len(numbers)), np.zeros(len(numbers), dtype=np.int64)
        for at in range(0, len(found), GROUP_TEXTS):
            counts += np.bincount(np.concatenate(found[at : at + GROUP_TEXTS]), minlength=len(numbers))
        yield table([None], [None], ["\n".join(numbers)], [counts.tobytes()], [np.fromiter(map(bucket, numbers), dtype="<u2", count=len(numbers)).tobytes()])
        for at in range(0, len(keys), GROUP_TEXTS):
            none = [None] * len(keys[at : at + GROUP_TEXTS])
            yield table(keys[at : at + GROUP_TEXTS], [x.astype(kind).tobytes() for x in found[at : at + GROUP_TEXTS]], none, none, none)

    def run(batches):
        numbers, keys, found, held = Numbers(), [], [], 0
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(text)
                keys.append(key)
                found.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                held += len(words) + TEXT_TOKENS
                if len(numbers) > COUNTER_WORDS or held > COUNTER_TOKENS:
                    yield from group(numbers, keys, found)
                    numbers, keys, found, held = Numbers(), [], [], 0
        if keys:
            yield from group(numbers, keys, found)

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema))


def _width(words: int) -> str:
    """Type of the numbers of so many words."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _lines(words: str) -> list[str]:
    return words.split("\n") if words else []


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> Vocabulary:
    """``count`` of texts that are used for nothing else."""
    return count(number(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"), size)


def encode(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``recode`` of texts that were not numbered for the vocabulary."""
    return recode(number(docs, id_col, text_col), words, id_col)


def count(numbered: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """The most frequent words of all texts of ``number``, ``size`` at most, and all counts: its groups' lists, merged by bucket."""
    bound_batches(numbered.sparkSession)

    def handed(batches):
        for batch in batches:
            for words, n, buckets in zip(*(c.to_pylist() for c in batch.columns)):
                words, n, buckets = _lines(words), np.frombuffer(n, dtype=np.int64), np.frombuffer(buckets, dtype="<u2")
                totals = np.bincount(buckets, n, BUCKETS).astype(np.int64)
                order = np.argsort(buckets, kind="stable")
                order = order[np.fromiter(map(len, words), dtype=np.int64, count=len(words))[order] <= LONGEST]
                words, n, buckets = [words[k] for k in order.tolist()], n[order], buckets[order]
                used = np.flatnonzero(totals)
                starts, ends = (np.searchsorted(buckets, used, side).tolist() for side in ("left", "right"))
                yield table([(b, t, "\n".join(words[i:j]), n[i:j].tobytes()) for b, t, i, j in zip(used.tolist(), totals[used].tolist(), starts, ends)])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["bucket", "total", "words", "n"])

    def add(batches):
        now, total, known = None, 0, {}

        def added():
            return table([(now, total, "\n".join(known), np.fromiter(known.values(), dtype=np.int64, count=len(known)).tobytes())])

        for batch in batches:
            for at, n_all, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    if now is not None:
                        yield added()
                    now, total, known = at, 0, {}
                total += n_all
                for word, k in zip(_lines(words), np.frombuffer(n, dtype=np.int64).tolist()):
                    known[word] = known.get(word, 0) + k
        if now is not None:
            yield added()

    def steps(n):
        return np.floor(np.log2(np.frombuffer(n, dtype=np.int64)) * 64).astype(np.int64)

    def bins(batches):
        for batch in batches:
            step, words = np.unique(steps(b"".join(batch.column(0).to_pylist())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), pa.array(words, pa.int64())], names=["step", "words"])

    def most(batches):
        for batch in batches:
            found = []
            for at, words, n in zip(*(c.to_pylist() for c in batch.columns)):
                if len(keep := np.flatnonzero(steps(n) >= least)):
                    words, n = words.split("\n"), np.frombuffer(n, dtype=np.int64)
                    found += [(words[k], at, int(n[k])) for k in keep.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 3, (pa.string(), pa.int32(), pa.int64()))], names=["word", "bucket", "n"])

    schema = "bucket int, total long, words string, n binary"
    types = arrow_types(schema)
    # A bucket's words are one row a group, and their sums one row in all: a task holds one bucket's words.
    each = numbered.where("words is not null").select("words", "n", "bucket").mapInArrow(handed, schema)
    counts = materialize(each.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, schema))
    # The words of the highest bins of frequency that fit: no task, nor the driver, sorts the words.
    least, room = 0, size
    for r in sorted(counts.select("n").mapInArrow(bins, "step long, words long").groupBy("step").agg(F.sum("words").alias("count")).collect(), reverse=True):  # at most 64 a power of two
        room -= r["count"]
        if room < 0:
            least = r["step"] + 1
            break
    top = sorted(counts.select("bucket", "words", "n").mapInArrow(most, "word string, bucket int, n long").collect(), key=lambda r: (-r["n"], r["word"]))  # ``size`` rows at most
    words = [r["word"] for r in top]
    rest = np.zeros(BUCKETS, dtype=np.int64)
    for r in counts.select("bucket", "total").collect():  # one row a bucket
        rest[r["bucket"]] = r["total"]
    np.subtract.at(rest, [r["bucket"] for r in top], [r["n"] for r in top])
    return Vocabulary(words, np.concatenate([np.array([r["n"] for r in top], dtype=np.int64), rest]))


def recode(numbered: DataFrame, words: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """One row per text of ``number``: ``id_col`` and x, its token ids as little-endian 16-bit integers."""
    bound_batches(numbered.sparkSession)
    shared = numbered.sparkSession.sparkContext.broadcast(words)
    key_type = dict(numbered.dtypes)["id"]

    def run(batches):
        ids, table = shared.value.ids(), np.zeros(0, dtype="<u2")
        for batch in batches:
            keep, made = [], []
            for at, (x, known, buckets) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if known is None:
                    keep.append(at)
                    made.append(np.take(table, np.frombuffer(x, dtype=_width(len(table)))).tobytes())
                else:
                    found = np.fromiter(map(ids.get, _lines(known), repeat(-1)), dtype=np.int32)
                    table = np.where(found < 0, ids.first + np.frombuffer(buckets, dtype="<u2").astype(np.int32), found).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(made, pa.binary())], names=[id_col, "x"])

    return numbered.select("id", "x", "words", "bucket").mapInArrow(run, f"`{id_col}` {key_type}, x binary")


class Tree:
    """A Huffman tree over token counts (each and one): the path of every token as decisions at inner nodes."""

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        weight = [int(c) + 1 for c in counts] + [0] * (n - 1)
        parent, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.int8)
        heap = [(w, i) for i, w in enumerate(weight[:n])]
        heapq.heapify(heap)
        bias = np.zeros(n - 1)
        for new in range(n, 2 * n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right], side[left], side[right] = new, new, -1, 1
            weight[new], bias[new - n] = a + b, np.log(b / a)
            heapq.heappush(heap, (a + b, new))
        paths, signs = [], []
        for leaf in range(n):
            at = leaf
            while at != 2 * n - 2:
                signs.append(side[at])
                at = int(parent[at])
                paths.append(at - n)
            paths.append(-1)
            signs.append(0)
        flat, ends = np.array(paths, dtype=np.int64), np.flatnonzero(np.array(paths) < 0)
        self.starts = np.r_[0, ends[:-1] + 1].astype(np.int32)
        self.lengths = (ends - self.starts).astype(np.int32)
        self.nodes, self.signs = flat.astype(np.int32), np.array(signs, dtype=np.float32)
        self.bias = bias.astype(np.float32)
        # The last nodes made are the tree's top, where a path ends: its signs in a matrix. The decisions below it,
        # from a leaf upwards, as one array a level, of the node's number from 1 with the decision's sign.
        self.first = max(n - 1 - TOP_NODES, 0)
        leaves, high = np.repeat(np.arange(n), self.lengths + 1), flat >= self.first
        self.top = np.zeros((n, n - 1 - self.first), dtype=np.int8)
        self.top[leaves[high], flat[high] - self.first] = self.signs[high]
        self.low = (self.lengths - np.bincount(leaves[high], minlength=n)).astype(np.uint16)
        self.levels = []
        for k in range(int(self.low.max())):
            at = self.starts + np.minimum(k, self.lengths)  # past the top a level isn't read
            self.levels.append(((self.nodes[at] + 1) * self.signs[at]).astype(np.int32))

    def order(self, targets: np.ndarray) -> np.ndarray:
        """Places of targets, those with most decisions below the top first."""
        return np.argsort(np.take(self.low, targets), kind="stable")[::-1]

    def below(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For targets in ``order``: how many have a decision at each level, and those decisions' nodes and signs, level by level."""
        sizes = len(targets) - np.cumsum(np.bincount(np.take(self.low, targets)))[:-1]
        signed = np.concatenate([np.take(level, targets[:k]) for level, k in zip(self.levels, sizes)] or [np.zeros(0, dtype=np.int32)])
        return sizes, np.abs(signed) - 1, np.sign(signed).astype(np.float32)


def _levels(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows of each level's decisions, level by level."""
    return np.concatenate([rows[:0], *(rows[:k] for k in sizes)])


def _add_levels(sums: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Add the values of each level's decisions to their rows."""
    at = 0
    for k in sizes:
        sums[:k] += values[at : at + k]
        at += k


def _by_row(ids: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their gradients' sums."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    found = np.take(ids, order)
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), dtype=bool), found[1:] != found[:-1]]))
    # As complex numbers, two columns are added at once.
    return np.take(found, starts), np.add.reduceat(np.take(grads, order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)


def _slopes(z: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Gradients of log(sigmoid(sign * z)) by z, in the place of z; 0 where the sign is 0."""
    z *= signs
    np.exp(np.minimum(z, 60, out=z), out=z)
    z += 1
    return np.divide(signs, z, out=z)


def _step(part: np.ndarray, square: np.ndarray, grad: np.ndarray, ids: np.ndarray | slice) -> None:
    """One step of Adagrad upwards on the rows ``ids``, each once."""
    sliced = isinstance(ids, slice)
    squares = square[ids] if sliced else np.take(square, ids, axis=0)
    squares += grad * grad
    move = np.sqrt(squares)
    np.divide(grad, move, out=move)
    move *= RATE
    if sliced:
        part[ids] += move
        return
    move += np.take(part, ids, axis=0)
    row = np.dtype((np.void, part.strides[0]))  # whole rows are put, not their numbers
    np.put(square.view(row), ids, squares.view(row))
    np.put(part.view(row), ids, move.view(row))


def _losses(z: np.ndarray) -> np.ndarray:
    """-log(sigmoid(-z)), in the place of z."""
    np.exp(np.minimum(z, 60, out=z), out=z)
    z += 1
    return np.log(z, out=z)


class Network:
    """Embeddings, window layer, and the tree's decisions (weights, and bias as the last column)."""

    def __init__(self, tree: Tree, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.tree, self.pad = tree, len(tree.starts)
        self.e = rng.normal(0, 0.5, (self.pad + 1, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.25, (2 * SIDE * DIM + 1, HIDDEN)).astype(np.float32)  # the last row is the layer's bias
        self.u = np.concatenate([np.zeros((self.pad - 1, HIDDEN), dtype=np.float32), tree.bias[:, None]], axis=1)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.e, self.w, self.u

    def log_probabilities(self, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Conditional log-probabilities of the tokens at ``places`` given both sides.

        Embeddings and layer are folded into one table a neighbour, so a hidden vector is a sum of gathered rows.
        """
        tree = self.tree
        tables = [self.e @ self.w[k * DIM : (k + 1) * DIM] for k in range(2 * SIDE)]
        weights, bias = -self.u[:, :-1], -self.u[:, -1]
        top = np.ascontiguousarray(weights[tree.first :].T)
        out = np.empty(len(places), dtype=np.float64)
        for at in range(0, len(places), BLOCK):
            here = places[at : at + BLOCK]
            order = tree.order(padded[here])
            here = here[order]
            targets = padded[here]
            h = np.tanh(sum((np.take(t, padded[here + k], axis=0) for t, k in zip(tables, OFFSETS)), self.w[-1]))
            signs = np.take(tree.top, targets, axis=0).astype(np.float32)
            z = h @ top
            z += bias[tree.first :]
            z *= signs
            found = np.einsum("ij,ij->i", _losses(z), np.abs(signs, out=signs)).astype(np.float64)
            sizes, nodes, signs = tree.below(targets)
            z = np.einsum("ij,ij->i", np.take(weights, nodes, axis=0), _levels(h, sizes)) + np.take(bias, nodes)
            z *= signs
            _add_levels(found, _losses(z), sizes)
            out[at + order] = -found
        return out


class Learner:
    """A shard's own parameters, which descend over its examples, and how often it used them."""

    def __init__(self, network: Network) -> None:
        self.network, self.tree = network, network.tree
        self.e, self.w = network.e.copy(), network.w.copy()
        self.u = np.pad(network.u, ((0, 0), (0, 1)))  # a column of zeros, as sums need an even width
        self.squares = [np.full_like(p, SQUARES) for p in (self.e, self.w, self.u)]
        self.contexts, self.targets = (np.zeros(n, dtype=np.int64) for n in (len(self.e), network.pad))

    def learn(self, found: np.ndarray) -> None:
        """Batch by batch, over rows of ``examples``."""
        self.targets += np.bincount(found[:, 0], minlength=len(self.targets))
        self.contexts += np.bincount(found[:, 1:].reshape(-1), minlength=len(self.contexts))
        for at in range(0, len(found), BATCH):
            batch = found[at : at + BATCH].astype(np.int64)
            batch = np.take(batch, self.tree.order(batch[:, 0]), axis=0)
            self.descend(batch[:, 0], batch[:, 1:])

    def descend(self, targets: np.ndarray, contexts: np.ndarray) -> None:
        """One step on the rows that a batch of examples, in the tree's order, touches."""
        tree, first = self.tree, self.tree.first
        x = np.take(self.e, contexts, axis=0).reshape(len(targets), -1)
        h = np.tanh(x @ self.w[:-1] + self.w[-1])
        h1 = np.zeros((len(targets), HIDDEN + 2), dtype=np.float32)
        h1[:, :HIDDEN], h1[:, HIDDEN] = h, 1
        # Every row with every node of the top, as matrices.
        top = self.u[first:]
        g = _slopes(h1 @ top.T, np.take(tree.top, targets, axis=0).astype(np.float32))
        dh, dtop = g @ top, g.T @ h1
        # The decisions below it, one by one.
        sizes, nodes, signs = tree.below(targets)
        u, hr = np.take(self.u, nodes, axis=0), _levels(h1, sizes)
        g = _slopes(np.einsum("ij,ij->i", u, hr), signs)[:, None]
        _add_levels(dh, np.multiply(u, g, out=u), sizes)
        dh = dh[:, :HIDDEN] * (1 - h * h)
        embedded = _by_row(contexts.reshape(-1), (dh @ self.w[:-1].T).reshape(-1, DIM))
        below = _by_row(nodes, np.multiply(hr, g, out=hr))
        layer = slice(None), np.concatenate([x.T @ dh, np.ones((1, len(dh)), dtype=np.float32) @ dh])
        for part, square, (ids, grad) in zip((self.e, self.w, self.u, self.u), (*self.squares, self.squares[-1]), (embedded, layer, below, (slice(first, None), dtop))):
            _step(part, square, grad, ids)

    def moved(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the network's parts, its rows' moves and how often each row was used."""
        order = self.tree.order(np.arange(len(self.targets)))
        sizes, nodes, _ = self.tree.below(order)
        used = np.bincount(nodes, _levels(self.targets[order], sizes), len(self.u)).astype(np.int64)
        used[self.tree.first :] += self.targets @ np.abs(self.tree.top).astype(np.int64)
        counts = self.contexts, np.full(len(self.w), self.targets.sum()), used
        return [(part - old, n) for part, old, n in zip((self.e, self.w, self.u[:, :-1]), self.network.parts(), counts)]


def examples(x: np.ndarray, key: int, turn: int, pad: int, rounds: int, every: int) -> np.ndarray:
    """Rows (target, contexts) of one text's examples of a round, at places set by its key."""
    n, step = len(x), every * rounds
    if n < step and every > 1:  # at every = 1 the rounds share out all places
        places = np.array([key % n] if n and (key >> 20) % rounds == turn else [], dtype=np.int64)
    else:
        places = np.arange((key + turn * every) % step, n, step)
    padded = np.full(n + 2 * SIDE, pad, dtype=np.uint16)
    padded[SIDE : SIDE + n] = x
    return np.take(padded, places[:, None] + WINDOW)


def train(rows: DataFrame, words: Vocabulary, id_col: str = "doc_id", rounds: int = ROUNDS, every: int = EVERY) -> Network:
    """Fit the network to the rows of ``encode``. Without any token the network stays the unigram model."""
    spark = rows.sparkSession
    bound_batches(spark)
    network = Network(Tree(words.counts))
    pad = network.pad
    shards = max(1, -(-int(words.counts.sum()) // (every * rounds * SHARD_EXAMPLES)))
    keyed = rows.where(F.length("x") > 0).select(F.shiftrightunsigned(F.xxhash64(F.col(id_col), "x"), 1).alias("key"), "x")
    # A text is in the same shard in every round, so the token ids are dealt once, two bytes a token.
    dealt = materialize(keyed.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "x").repartition("shard").sortWithinPartitions("shard", "key"))

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def descend(batches, shared=shared, turn=turn):
            now, local, waiting, held = None, None, [], 0

            def steps(least: int):
                nonlocal waiting, held
                if held < least:
                    return
                found = np.concatenate(waiting)
                last = held - held % BATCH if least > 1 else held
                local.learn(found[:last])
                waiting, held = [found[last:]], held - last

            def moved():
                steps(1)
                for number, (moves, used) in enumerate(local.moved()):
                    for at in range(0, len(moves), RECORD_ROWS):
                        n = used[at : at + RECORD_ROWS]
                        if n.any():
                            yield number, at // RECORD_ROWS, n.tobytes(), moves[at : at + RECORD_ROWS].tobytes()

            def table(found):
                columns = list(zip(*found)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "at", "n", "d"])

            for batch in batches:
                for shard, key, x in zip(*(c.to_pylist() for c in batch.columns)):
                    if shard != now:
                        if now is not None:
                            yield table(moved())
                        now, local, waiting, held = shard, Learner(shared.value), [], 0
                    made = examples(np.frombuffer(x, dtype="<u2"), key, turn, pad, rounds, every)
                    if len(made):
                        waiting.append(made)
                        held += len(made)
                        steps(64 * BATCH)
            if now is not None:
                yield table(moved())

        def add(batches):
            sums: dict = {}
            for batch in batches:
                for part, at, n, d in zip(*(c.to_pylist() for c in batch.columns)):
                    n = np.frombuffer(n, dtype=np.int64)
                    d = np.rint(np.frombuffer(d, dtype=np.float32).reshape(len(n), -1).astype(np.float64) * n[:, None] / QUANTUM).astype(np.int64)
                    known = sums.get((part, at))
                    sums[part, at] = (n, d) if known is None else (known[0] + n, known[1] + d)
            for (part, at), (n, d) in sums.items():
                mean = d * QUANTUM / np.maximum(n, 1)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["part", "at", "d"])

        moves = dealt.mapInArrow(descend, "part int, at int, n binary, d binary")
        network = _copy(network)
        for r in moves.repartition("part", "at").mapInArrow(add, "part int, at int, d binary").collect():  # one set of parameters
            part = network.parts()[r["part"]][r["at"] * RECORD_ROWS : (r["at"] + 1) * RECORD_ROWS]
            part += np.frombuffer(r["d"], dtype=np.float32).reshape(part.shape)
    return network


def _copy(network: Network) -> Network:
    made = object.__new__(Network)
    made.tree, made.pad = network.tree, network.pad
    made.e, made.w, made.u = (p.copy() for p in network.parts())
    return made


def score(rows: DataFrame, network: Network, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encode``: ``id_col``, n_tokens, pll (sum of log-probabilities), mean_pll.

    Every token of the whole text counts. A null text, or one without tokens, has pll 0 and a null mean.
    Repeated rows are scored alike; an empty table gives no rows; other columns aren't read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network)
    bound_batches(rows.sparkSession)
    key_type = dict(rows.dtypes)[id_col]

    def run(batches):
        model = shared.value
        gap = np.full(SIDE, model.pad, dtype=np.int64)
        for batch in batches:
            found = [np.frombuffer(x, dtype="<u2") for x in batch.column(1).to_pylist()]
            # Texts follow each other with pads between, so that short ones share a block.
            padded = np.concatenate([gap, *(y for x in found for y in (x, gap))])
            n = np.array([len(x) for x in found], dtype=np.int64)
            ends = np.cumsum(n + SIDE)
            places = np.arange(n.sum()) + np.repeat(ends - np.cumsum(n), n)
            p = model.log_probabilities(padded, places)
            full, totals = np.flatnonzero(n), np.zeros(len(n))
            if len(full):
                totals[full] = np.add.reduceat(p, (np.cumsum(n) - n)[full])
            mean = [round(t / k, 6) if k else None for t, k in zip(totals.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.round(totals, 3)), pa.array(mean, pa.float64())], names=[id_col, "n_tokens", "pll", "mean_pll"])

    return rows.select(id_col, "x").mapInArrow(run, f"`{id_col}` {key_type}, n_tokens long, pll double, mean_pll double")
