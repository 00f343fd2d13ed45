"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the pre-tokenizer's pattern) that is itself a token is that token, as in the
public library. Otherwise its halves are encoded on their own, recursively, and neighbours are
joined: the tokens around the seam are re-encoded in a window that grows, on either side, until
the window's outer tokens are compatible with the tokens beside them. Two neighbours are compatible
if merging their joint bytes gives the two of them back. Since a token sequence is the encoding
of its bytes if and only if all its neighbours are compatible, tokens outside such a window can
not change, and the join is associative; decoding concatenates the tokens' bytes up the tree.

A vocabulary with tokens that merging their own bytes does not give back is outside that theorem;
such tokens are found when the vocabulary is loaded, and a seam beside one grows over it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, bound_batches, map_rows

#: Bytes up to which a half is merged directly; short enough that most leaves are remembered.
LEAF_BYTES = 8
#: Bytes up to which the plain merge is used for a window; a heap takes longer ones.
PLAIN_BYTES = 64
#: Pieces, leaves and pairs of tokens that each generation of a task's memory holds; there are two generations of each.
CACHE_PIECES = 150_000
#: Pieces over this length are not remembered, so what a task remembers has a bound in bytes (about 80 MB).
CACHE_BYTES = 64
#: Ids whose bytes make one leaf of the tree that decodes.
LEAF_IDS = 1 << 12


class Encoder:
    """Encoder and decoder for one vocabulary of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.cache = Memory(self.piece, CACHE_PIECES, CACHE_BYTES)
        self.parts = Memory(self._merged, CACHE_PIECES, CACHE_BYTES)
        self.pairs = Memory(self._settles, CACHE_PIECES, CACHE_BYTES)
        #: Tokens that the merges do not make from their own bytes.
        self.unreachable = self._find_unreachable()

    def _find_unreachable(self) -> frozenset[int]:
        """A token is reachable if some split of it into two tokens of lower rank is its last merge.

        Only tokens without any such split are surely unreachable without merging; those with one
        are merged. The result is kept per vocabulary file by ``encoder``.
        """
        return frozenset(rank for token, rank in self.ranks.items() if len(token) > 1 and self.merge(token) != [rank])

    def merge(self, piece: bytes) -> list[int]:
        """Merge by rank, the lowest first and the leftmost of equals: the definition, for short pieces."""
        get, none = self.ranks.get, 1 << 62
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]  # rank of part i joined with part i + 1
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[piece[x:y]] for x, y in zip(cuts, cuts[1:])]

    def forget(self) -> None:
        """Give up what was remembered, as at the end of a task; the vocabulary stays."""
        for memory in (self.cache, self.parts, self.pairs):
            memory.forget()

    def _settles(self, pair: tuple[int, int]) -> bool:
        """Whether merging the joint bytes of two neighbours gives both back."""
        left, right = pair
        if left in self.unreachable or right in self.unreachable:
            return False
        return self.parts[self.tokens[left] + self.tokens[right]] == [left, right]

    def _merged(self, data: bytes) -> list[int]:
        """The definition applied to a leaf or a window. Callers don't change the list."""
        return self.merge(data) if len(data) <= PLAIN_BYTES else self._heap_merge(data)

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The monoid's operation: the encoding of two byte strings' concatenation from their encodings."""
        if not a or not b:
            return a or b
        if self.pairs[a[-1], b[0]]:
            return a + b
        i, j = 1, 1
        while True:
            window = self.parts[b"".join(map(self.tokens.__getitem__, a[len(a) - i :] + b[:j]))]
            left = i < len(a) and not self.pairs[a[-i - 1], window[0]]
            right = j < len(b) and not self.pairs[window[-1], b[j]]
            if not left and not right:
                return a[: len(a) - i] + window + b[j:]
            i, j = min(len(a), i + left * i), min(len(b), j + right * j)

    def _heap_merge(self, data: bytes) -> list[int]:
        """The definition again, by a heap, for the rare long windows."""
        import heapq

        ranks, n = self.ranks, len(data)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, length = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] - i != length:
                continue
            end[i], alive[j] = end[j], False
            if end[i] < n:
                prev[end[i]] = i
                if (r := ranks.get(data[i : end[end[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[end[i]] - i))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i] - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def tree(self, data: bytes) -> list[int]:
        """Encode halves, then join them."""
        if len(data) <= LEAF_BYTES:
            return self.parts[data]
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, packed."""
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return struct.pack("<I", whole) if whole is not None else np.array(self.tree(data), dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Ids stay packed from the pieces to the text, so that no id becomes an object."""
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.findall(text))), dtype="<u4")

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The tokens' bytes, concatenated up a tree: leaves of LEAF_IDS ids, then neighbours in pairs."""
        ids = np.asarray(ids, dtype=np.int64)
        try:
            parts = [b"".join(map(self.tokens.__getitem__, ids[at : at + LEAF_IDS].tolist())) for at in range(0, len(ids), LEAF_IDS)]
        except KeyError as e:
            raise ValueError("an id outside the vocabulary") from e
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """Read a vocabulary of base64 tokens and ranks once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Encoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    The ids of a null or empty text are empty; decoded_sha256 is over the bytes the ids decode to. A text is
    encoded whole however long. Repeated rows stay; an empty table gives no rows; other columns are not
    read. ``path`` must be readable on every worker, as installed vocabulary files are.
    """
    bound_batches(docs.sparkSession)
    key_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        one_encoder = encoder(path, pattern)
        for batch in batches:
            # Ids stay packed until they are a column: no id becomes an object.
            made = [one_encoder.encode(text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in made], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in made]), pa.array([hashlib.sha256(one_encoder.decode(x)).hexdigest() for x in made])]
            if ids:
                offsets = np.cumsum([0, *(len(x) for x in made)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*made, np.empty(0, dtype="<u4")]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
        one_encoder.forget()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text, from arrays of ids (null: null). Bytes that are not UTF-8 are replaced."""
    key_type = dict(rows.dtypes)[id_col]

    def factory():
        one_encoder = encoder(path, pattern)
        return lambda key, ids: (key, None if ids is None else one_encoder.decode(ids).decode("utf-8", "replace"))

    return map_rows(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), factory, f"`{id_col}` {key_type}, text string")
