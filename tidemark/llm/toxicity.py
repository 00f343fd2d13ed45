"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A text is a bag of words; a word's vector is the mean of the vectors of its hashed features (the
word itself and its character 3- to 5-grams with boundary marks), the text's vector the mean of
its words' vectors, and a linear softmax over it gives the classes. Embeddings and softmax are
fitted together by a damped Adam on a bounded sample of the labelled rows. An unseen misspelling shares most
n-grams, hence most of its vector, with the word it comes from.

For scoring, a word's share in the difference of the two logits is one number; a worker keeps
those of the words it has met.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, bound_batches, map_rows, materialize

#: Toxic rows that training reads at most (by hash of the id); of clean rows it reads twice as many.
SAMPLE_ROWS = 2000
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 60
LEARNING_RATE = 0.05
#: Share of the largest root mean square gradient that damps all rates.
DAMPING = 0.05
#: Training texts that a word, or a feature, must occur in to be fitted; what is rarer only carries noise.
MIN_TEXTS = 5
#: Group lasso on the features' embeddings, as a share of the largest gradient of any feature.
SPARSITY = 0.01
#: Weight of a toxic text in the last calibration: a missed one costs more than a clean one looked at again.
TOXIC_WEIGHT = 2.0
#: Sharpness of the mean: a text's vector is scaled by it before the softmax.
SCALE = 50.0
#: Words with a zero vector that every average takes in, so that no single word decides over a short text.
EMPTY_WORDS = 20
#: Words, and n-grams, that each of two generations of a task's memory holds, and the longest word remembered.
CACHE_WORDS = 150_000
CACHE_CHARS = 40
#: Characters of a word whose n-grams are made at a time, which bounds memory for scripts without spaces.
GRAM_BLOCK = 1 << 12

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> Iterator[list[str]]:
    """The whole word and all its 3- to 5-grams with boundary marks, with repeats, in blocks."""
    yield [f"={word}"]
    marked = f"<{word}>"
    for at in range(0, len(marked), GRAM_BLOCK):
        part = marked[at : at + GRAM_BLOCK + 4]
        yield [part[i : i + size] for size in (3, 4, 5) for i in range(min(GRAM_BLOCK, len(part) - size + 1))]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    return [bucket(g) for block in grams(word) for g in block]


@dataclass
class Model:
    """Per feature, its share in the logit difference (embedding times softmax weights), and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, shares: list[float]) -> float:
        z = self.bias + SCALE * sum(shares) / (len(shares) + EMPTY_WORDS)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


#: Entries of a sparse matrix that a product works on at a time, which bounds the driver's memory.
ENTRIES = 1 << 17


class _Rows:
    """A sparse matrix by rows (their lengths, columns and values), for the two averages and their gradients."""

    def __init__(self, n: np.ndarray, cols: np.ndarray, data: np.ndarray, columns: int) -> None:
        self.n, self.cols, self.data, self.columns = n.astype(np.int64), cols.astype(np.int32), data.astype(np.float32), columns
        by_col = np.argsort(self.cols, kind="stable")
        self.rows = np.repeat(np.arange(len(n), dtype=np.int32), self.n)[by_col]
        self.by_col, counts = self.data[by_col], np.bincount(self.cols, minlength=columns)
        self.col_ids = np.flatnonzero(counts)
        self.row_parts, self.col_parts = self._parts(self.n, np.flatnonzero(self.n)), self._parts(counts, self.col_ids)

    @staticmethod
    def _parts(lengths: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
        """Runs of non-empty rows (or columns) of about ENTRIES entries: ids, where each begins within the run, and the run's range."""
        ends = np.cumsum(lengths)[ids]
        parts, first = [], 0
        while first < len(ids):
            start = int(ends[first] - lengths[ids[first]])
            last = max(first + 1, int(np.searchsorted(ends, start + ENTRIES, side="right")))
            some = ids[first:last]
            parts.append((some, (ends[first:last] - lengths[some] - start).astype(np.int64), start, int(ends[last - 1])))
            first = last
        return parts

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.n), m.shape[1]), dtype=np.float32)
        for ids, begins, start, end in self.row_parts:
            out[ids] = np.add.reduceat(m[self.cols[start:end]] * self.data[start:end, None], begins, axis=0)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.columns, g.shape[1]), dtype=np.float32)
        for ids, begins, start, end in self.col_parts:
            out[ids] = np.add.reduceat(g[self.rows[start:end]] * self.by_col[start:end, None], begins, axis=0)
        return out


def train(texts: list[str], labels: list[int], min_texts: int = MIN_TEXTS, **settings) -> Model:
    """Fit to texts in memory: those of ``words`` in ``min_texts`` texts or more count."""
    counted = [Counter(words(text)) for text in texts]
    texts_with = Counter(w for c in counted for w in c)
    vocabulary = sorted(w for w, n in texts_with.items() if n >= min_texts)
    at = {w: i for i, w in enumerate(vocabulary)}
    bags = [[(at[w], n / (c.total() + EMPTY_WORDS)) for w, n in c.items() if w in at] for c in counted]
    flat = np.array([x for bag in bags for x in bag], dtype=np.float64).reshape(-1, 2)
    return train_bags(vocabulary, np.array([len(b) for b in bags]), flat[:, 0], flat[:, 1], labels, **settings)


def train_bags(vocabulary: list[str], sizes: np.ndarray, words: np.ndarray, shares: np.ndarray, labels: list[int], epochs: int = EPOCHS, dim: int = DIM, sparsity: float = SPARSITY, seed: int = 7) -> Model:
    """Fit embeddings and softmax together. One class, or none: every text gets that class's smoothed share.

    Text by text, ``sizes`` words of the vocabulary each: their places in it, and their shares in the text's average.
    """
    y = np.array(labels, dtype=np.int64)
    ones = int(y.sum())
    prior = float(np.log((ones + 1) / (len(y) - ones + 1)))
    if not len(y) or ones in (0, len(y)):
        return Model(np.zeros(BUCKETS, dtype=np.float32), prior)
    found = [np.array(features(w), dtype=np.int32) for w in vocabulary]
    many = np.array([len(f) for f in found], dtype=np.int64)
    by_word = _Rows(many, np.concatenate([*found, np.empty(0, dtype=np.int32)]), np.repeat(1.0 / np.maximum(many, 1), many), BUCKETS)
    by_text = _Rows(sizes, words, shares, len(vocabulary))
    return Model(*_descend(by_word, by_text, y, prior, dim, epochs, sparsity, DAMPING, seed))


def _descend(by_word: _Rows, by_text: _Rows, y: np.ndarray, prior: float, dim: int, epochs: int, sparsity: float, damping: float, seed: int):
    """Fit embeddings and softmax together; each feature's share in the logit difference, and the bias."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (dim, 2)).astype(np.float32), np.array([-prior / 2, prior / 2], dtype=np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    onehot = np.eye(2, dtype=np.float32)[y]
    used, lasso = by_word.col_ids, 0.0
    for step in range(epochs):
        mean = SCALE * by_text.times(by_word.times(e))
        z = mean @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - onehot) / len(y)
        ge = by_word.back(by_text.back(SCALE * (dz @ w.T)))
        if step < 10:
            lasso = max(lasso, sparsity * float(np.sqrt((ge * ge).sum(axis=1)).max()))
        for param, g, (m, v) in zip((e, w, b), (ge, mean.T @ dz, dz.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            root = np.sqrt(v)
            rate = LEARNING_RATE / (root + damping * root.max() + 1e-12)
            param -= rate * m
            if param is e and sparsity and step >= 10:  # group lasso: a feature whose gradient stays small ends at exactly zero
                rows = e[used]
                norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True)) + 1e-12
                e[used] = rows * np.maximum(0.0, 1.0 - 0.1 * lasso * rate[used].mean(axis=1, keepdims=True) / norm)
    fitted = np.zeros(BUCKETS, dtype=np.float32)
    fitted[used] = e[used] @ (w[:, 1] - w[:, 0])  # a feature that training never met says nothing
    # The softmax's scale and bias converge last: a few Newton steps on these two.
    x = np.stack([(mean @ (w[:, 1] - w[:, 0])).astype(np.float64), np.ones(len(y))], axis=1)
    theta = np.array([1.0, float(b[1] - b[0])])
    heavy = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    for _ in range(12):
        p1 = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (heavy * p1 * (1 - p1))[:, None]).T @ x / len(y) + 1e-4 * np.eye(2)
        theta -= np.linalg.solve(hessian, x.T @ (heavy * (p1 - y)) / len(y) + 1e-4 * (theta - [1.0, 0.0]))
    return fitted * np.float32(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``sample_rows`` toxic and twice as many clean labelled texts, taken in the order of a hash of the id.

    Texts of any length are taken, whole: executors count their words, and the driver reads only the counts
    of words in MIN_TEXTS texts or more. Rows with a null id, text or label, empty texts, and ids with
    contradicting labels, teach nothing; of rows that share an id one text counts, that of the smallest hash.
    """
    votes = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = votes.agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high").select("id", F.col("low").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    # The ids are chosen first, by a bounded top-k for each class; only their texts are then read out.
    known = texts.select("id").join(one, "id").select("id", "y", F.xxhash64(F.col("id").cast("string"), F.lit("sample")).alias("h"))
    chosen = None
    for y in (0, 1):
        top = known.where(F.col("y") == y).orderBy("h", "id").limit(sample_rows * (2 - y))
        chosen = top if chosen is None else chosen.unionByName(top)
    chosen = F.broadcast(chosen.select("id", "y").distinct())
    picked = texts.join(chosen, "id").groupBy("id", "y").agg(F.min(F.xxhash64("text")).alias("t"))
    sample = texts.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["id", "t"]).select(F.xxhash64("id").alias("h"), "t", "y", "text")

    def factory():
        def one(h, t, y, text):
            counted = Counter(words(text))
            return h, t, y, counted.total(), list(counted), list(counted.values())

        return one

    each = map_rows(sample, factory, "h long, t long, y int, total long, words array<string>, counts array<int>")
    rows = materialize(each.groupBy("h", "t").agg(*[F.first(c).alias(c) for c in ("y", "total", "words", "counts")]))
    vocabulary = sorted(r["w"] for r in rows.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= MIN_TEXTS).select("w").collect())
    places = rows.sparkSession.createDataFrame(list(zip(vocabulary, range(len(vocabulary)))), "w string, at int")
    pairs = rows.select("h", "t", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("h", "t", F.col("p.words").alias("w"), F.col("p.counts").alias("n"))
    known = pairs.join(F.broadcast(places), "w").groupBy("h", "t").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("known"))
    bags = rows.join(known, ["h", "t"], "left").select("h", "t", "y", "total", F.coalesce("known.at", F.array().cast("array<int>")).alias("at"), F.coalesce("known.n", F.array().cast("array<int>")).alias("n")).toArrow()
    bags = bags.sort_by([("h", "ascending"), ("t", "ascending")]).combine_chunks()
    sizes = np.asarray(pc.list_value_length(bags["at"]))
    places_of, counts = (np.asarray(bags[c].combine_chunks().flatten()) for c in ("at", "n"))
    shares = counts / (np.repeat(np.asarray(bags["total"]), sizes) + EMPTY_WORDS)
    return train_bags(vocabulary, sizes, places_of, shares, bags["y"].to_pylist())


def held_out(id_col: str = "doc_id"):
    """Whether crc32(id as text) mod 3 is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``id_col``, score (0 to 1), predicted (score >= threshold).

    The whole text is scored. A null or empty text, or one without words, gets the bias's score.
    Repeated rows are scored alike; an empty table gives no rows; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = dict(docs.dtypes)[id_col]

    def factory():
        model = shared.value
        shares = _shares(model)

        def one(key, text):
            value = model.score(list(map(shares.__getitem__, words(text))))
            return key, value, int(value >= threshold)

        return one

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), factory, f"`{id_col}` {key_type}, score double, predicted int")


def _shares(model: Model) -> Memory:
    """A word's share: the mean weight of its features. N-grams are far fewer than words, so a new word costs lookups and no hashing."""
    weights = Memory(lambda gram: float(model.weight[bucket(gram)]), CACHE_WORDS, 5)

    def share(word: str) -> float:
        total, n = 0.0, 0
        for block in grams(word):
            total += sum(map(weights.__getitem__, block))
            n += len(block)
        return total / n

    return Memory(share, CACHE_WORDS, CACHE_CHARS)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold. Only the text goes to Python."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        shares = _shares(model)
        for texts in batches:
            yield pd.Series([model.score(list(map(shares.__getitem__, words(t)))) for t in texts], dtype="float64")

    return docs.where(scored(F.col(text_col).cast("string")) < threshold)
