"""Vector functions over arrays, and hashing embeddings."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

_TOKEN = re.compile("[a-z0-9]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1.0) - dot(a, b) / (norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def content_hash(tag: str, text: Column) -> Column:
    """sha1(tag, zero byte, text): equal to hashlib's over the same bytes."""
    return F.sha1(F.concat(F.lit(tag.encode()), F.lit(b"\x00"), F.encode(text, "UTF-8")))


def md5_bucket(token: Column, dim: int) -> Column:
    """Bucket from the first 8 hex digits of md5, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashed_counts(docs: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, bucket, n) of the text's tokens and pairs."""
    words = docs.select(id_col, T.embed_words(F.col(text_col)).alias("words"))
    exploded = words.select(id_col, F.explode(T.with_pairs(F.col("words"))).alias("token"))
    return exploded.groupBy(id_col, md5_bucket(F.col("token"), dim).alias("bucket")).agg(F.count("*").alias("n"))


#: Tokens whose BLAKE2b bucket a worker remembers.
CACHE_TOKENS = 200_000
_buckets: dict[str, int] = {}


def _blake(token: str) -> int:
    """The first 8 bytes of a token's BLAKE2b, remembered."""
    known = _buckets.get(token)
    if known is None:
        known = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        if len(_buckets) >= CACHE_TOKENS:
            _buckets.clear()
        if len(token) <= 64:
            _buckets[token] = known
    return known


def blake_embed(texts: list[str], dim: int):
    """Hashing embedder by BLAKE2b (8 bytes, little endian) in numpy, for parity with stored vectors."""
    import numpy as np

    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in enumerate(texts):
        words = _TOKEN.findall((text or "").lower())
        found = [_blake(t) % dim for t in words]
        found += [_blake(f"{a}_{b}") % dim for a, b in zip(words, words[1:])]
        out[row] = np.bincount(found, minlength=dim) if found else 0
    sizes = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(sizes == 0, 1, sizes)
