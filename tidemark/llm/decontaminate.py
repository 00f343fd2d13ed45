"""Benchmark decontamination by one Aho-Corasick automaton over the items' word windows.

Text is normalised once, as bytes: A-Z lower-cased, every other ASCII character but digits and
letters made a space, bytes of non-ASCII characters kept as parts of words. The automaton holds
each item's windows of ``window`` words (an item with fewer words is one window), with a space on
either side, and reads a document's normalised text once. A match's end gives its words, and the
k-th word of the normalised text is the k-th word of the original, which maps offsets back.
"""

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_types, bound_batches

WINDOW_WORDS = 10
#: Normalised characters of all windows that one automaton may hold (about 32 bytes a node): a
#: larger benchmark is read in several groups of items, each with an automaton of this size.
AUTOMATON_CHARS = 8_000_000
#: Bytes of benchmark text that the driver reads; above this the operator refuses to run.
BENCHMARK_BYTES = 256 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ORIGINAL = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normalise(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[int, str | None]], size: int = WINDOW_WORDS):
    """Automaton over the windows of (index, text) items; a window's value is (its words, its items)."""
    import ahocorasick

    owners: dict[bytes, set[int]] = {}
    for index, text in items:
        for window in windows(normalise(text), size):
            owners.setdefault(window, set()).add(index)
    built = ahocorasick.Automaton()
    for window, indices in owners.items():
        built.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(indices))))
    if owners:
        built.make_automaton()
    return built if owners else None


def joined(words: list[bytes]) -> str:
    """The normalised text, a space around every word, a character a byte."""
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def scan(built, text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges [start, end) of a ``joined`` text inside occurrences, and the indices of the items that occur."""
    if built is None or not text:
        return [], set()
    ranges: list[list[int]] = []
    items: set[int] = set()
    at = seen = 0
    for end, (length, indices) in built.iter(text):
        seen += text.count(" ", at, end)  # spaces before the match's last one: words that have ended
        at = end
        items.update(indices)
        start = seen - length
        while ranges and ranges[-1][1] >= start:
            start = min(start, ranges.pop()[0])
        ranges.append([start, seen])
    return [(a, b) for a, b in ranges], items


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code point offsets, in the original text, of word ranges."""
    if not ranges:
        return []
    offsets = [m.span() for m in _ORIGINAL.finditer(text)]
    return [(offsets[a][0], offsets[b - 1][1]) for a, b in ranges]


def _groups(items: list[tuple[int, str | None]], size: int, chars: int) -> list[list[tuple[int, str | None]]]:
    groups, room = [[]], 0
    for item in items:
        cost = sum(len(w) + 2 for w in windows(normalise(item[1]), size))
        if groups[-1] and room + cost > chars:
            groups.append([])
            room = 0
        groups[-1].append(item)
        room += cost
    return groups


def _scanner(spark, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, automaton_chars: int):
    """The sorted names of the items, and f(texts) -> (ranges, indices of items) for each text of a batch."""
    wanted = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    weight = wanted.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    if weight > BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {weight} bytes; at most {BENCHMARK_BYTES} are broadcast")
    rows = sorted((r["item"], r["text"] or "") for r in wanted.collect())
    names = sorted({name for name, _ in rows})
    index = {name: i for i, name in enumerate(names)}
    shared = spark.sparkContext.broadcast(_groups([(index[name], text) for name, text in rows], window, automaton_chars))
    token = uuid.uuid4().hex

    def find(texts: list[str]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Ranges and items of each text of a batch; of several automata each reads the whole batch before the next is built."""
        found = [([], set()) for _ in texts]
        for i in range(len(shared.value)):
            built = _kept_automaton(token, shared.value, i, window)
            for (ranges, items), text in zip(found, texts):
                more, which = scan(built, text)
                ranges += more
                items |= which
        return [(_merge(ranges) if len(shared.value) > 1 else ranges, items) for ranges, items in found]

    return names, find


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of a window is hit. items_sha256 is over the item ids (as strings,
    sorted, comma-joined). spans: start:end code points of the merged hits. A null text has no words;
    an item without words has no window; an item with a null id counts under the empty string. Items
    that share an id count once. Repeated documents repeat their rows; an empty benchmark hits nothing.
    The benchmark is read on the driver, behind a check of its size, and broadcast. Other columns aren't read.
    """
    names, find = _scanner(docs.sparkSession, benchmark, item_col, item_text_col, window, automaton_chars)
    bound_batches(docs.sparkSession)
    key_type = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {key_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            normal = [joined(normalise(text)) for text in texts]
            out = []
            for text, plain, (ranges, items) in zip(texts, normal, find(normal)):
                digest = hashlib.sha256(",".join(names[i] for i in sorted(items)).encode()).hexdigest()
                places = ",".join(f"{a}:{b}" for a, b in spans(text, ranges)) if ranges else ""
                hit = sum(b - a for a, b in ranges)
                out.append((max(plain.count(" ") - 1, 0), hit, len(items), digest, hit > 0, places))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, without an occurrence of any window. Only the text goes to Python.

    Null and wordless texts stay, repeated rows are judged alike, an empty table stays empty, and an empty
    benchmark drops nothing. Columns may have any name.
    """
    bound_batches(docs.sparkSession)
    _, find = _scanner(docs.sparkSession, benchmark, item_col, item_text_col, window, automaton_chars)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not ranges for ranges, _ in find([joined(normalise(t)) for t in texts])], dtype=bool)

    return docs.where(clean(F.col(text_col).cast("string")))


_kept: dict = {}


def _kept_automaton(token: str, groups, i: int, window: int):
    """The automaton of group i; a worker keeps one at a time, from task to task, so that memory holds one whatever the benchmark."""
    if (token, i) not in _kept:
        _kept.clear()
        _kept[token, i] = automaton(groups[i], window)
    return _kept[token, i]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
