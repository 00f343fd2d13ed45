"""Secret scan with DataFrame and SQL functions only: three base patterns and a randomness test battery.

Base kinds are found by regular expressions, leftmost and non-overlapping: the pieces between a
pattern's matches (split) and the matches (regexp_extract_all) add up to the matches' offsets.

The battery takes every maximal run of key characters (``CANDIDATE``) and the pieces between its
separators as candidates, infers each one's encoding (the smallest alphabet among ENCODINGS that holds all its characters) and asks how
likely ordinary text, written in that alphabet, would look as random as it does:

* chi-squared: the characters' frequencies against uniformity over the alphabet. Text repeats its
  favourite letters, so its statistic exceeds that of random characters by ``TEXT_EXCESS`` times the length.
* runs: the number of runs of character classes (lower, upper, digit, other); in text a class
  seldom changes.
* serial correlation of neighbouring characters' places in the alphabet, which counters and
  sequences have and random strings don't.

Each test gives a p-value under "this is text" from a normal approximation to its statistic; Fisher's
method combines the three, unless one of them sides with text outright: a counter is uniform and rich in
classes, yet no secret. The false discovery rate over all candidates of the corpus is held at
``FDR`` by the Benjamini-Hochberg rule with weights that grow with length (longer strings carry more
evidence; weights average one). The rule needs only counts by p-value bin: a table of at most
``BINS`` rows, whatever the corpus, and never a ranking of all candidates in one task. A run and its
pieces share characters, so their p-values go together, which the rule allows. What is reported is the
union of a run's significant spans: a path is reported along with its key if both together are significant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

# The patterns of the base kinds.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ASSIGN_CHARS = 6
#: Candidates of the battery: maximal runs of key characters with a digit, of this many characters or more. '=' is
#: in a run only as padding at its end; else it parts a name from its value.
CANDIDATE_CHARS = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
#: A run is tested whole and by the pieces between the separators of each set: a path or a prefix may stand before a key.
SEPARATORS = ("[/]", "[_-]", "[/_-]")
#: The whole string must look like an encoding of random bytes: pattern, alphabet size, in this order.
ENCODINGS = [
    ("decimal", "^[0-9]+$", 10), ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16), ("base32", "^[A-Z2-7]+=*$", 32),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", 36), ("base62", "^[0-9A-Za-z]+$", 62), ("base64", "^(?:[0-9A-Za-z+/]+|[0-9A-Za-z_-]+)={0,2}$", 64),
]
#: Excess of chi-squared a character that text shows over random characters, by alphabet size: size * IC - 1, for
#: text whose index of coincidence IC is 0.066, and at least the excess of repetitive digits.
TEXT_COINCIDENCE = 0.066
LEAST_EXCESS = 0.7
#: Share of neighbours in text that change the class of character.
TEXT_CHANGES = 0.15
#: Size of the serial correlation that stands for structure.
TEXT_CORRELATION = 0.45
#: Candidates longer than this are cut into windows of this length, each tested by itself; finds that meet become one.
WINDOW_CHARS = 512
FDR = 0.01
#: A test whose p-value is over this sides with text; then the others can't outvote it.
VETO = 0.5
#: p-value bins: steps of a hundredth in -log10(p / weight), up to BINS steps.
BINS = 4000
STEPS = 100
#: Decimal strings are numbers as a rule; they are tested for the correction but never reported.
SILENT = ("decimal",)


def _with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``df`` with an array of (start, end) for each named pattern: its leftmost non-overlapping matches, in code points.

    Three projections, since an expression inside a higher-order function is worked out again wherever it
    is named: the matches first, then the gaps between them for texts that have any, then the offsets.
    """
    col = F.col(text)
    df = df.withColumns({f"_{k}": F.when(col.rlike(p), F.regexp_extract_all(col, F.lit(p), F.lit(0))) for k, p in patterns.items()})
    sizes = {f"_{k}_m": F.transform(f"_{k}", lambda s: F.length(s)) for k in patterns}
    gaps = {f"_{k}_g": F.when(F.col(f"_{k}").isNotNull(), F.transform(F.split(col, p, -1), lambda s: F.length(s))) for k, p in patterns.items()}
    df = df.drop(*patterns).withColumns(sizes | gaps)

    def spans(k: str) -> Column:
        # One step a match: its start is the end before it plus the gap, its end the start plus its length.
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = F.zip_with(F.slice(f"_{k}_g", F.lit(1), F.size(f"_{k}_m")), F.col(f"_{k}_m"), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        few = F.aggregate(step, start, lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")), lambda acc: acc["out"])
        return F.coalesce(few, F.array().cast("array<struct<start:int,end:int>>"))

    return df.withColumns({k: spans(k) for k in patterns}).drop(*sizes, *gaps, *(f"_{k}" for k in patterns))


def _phi(z: Column) -> Column:
    """Normal distribution function by the logistic form with a cubic term (absolute error under 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z)))


def _p_value(z: Column) -> Column:
    """P(Z >= z), kept above 1e-12."""
    return _let(-F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0)), lambda x: F.greatest(_phi(x), F.lit(1e-12)))


def _classes(s: Column) -> Column:
    """Each run of one class of character as one mark."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001-\u0003]+", "\u0004")
    return F.length(marked)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once and named, not written out wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def battery(s: Column) -> Column:
    """Struct (encoding, p) of one string: the inferred encoding and Fisher's combined p-value under "text".

    Step by step, each named once: written out, the expression grows with the product of its uses, and the driver's memory with it.
    """
    return _let(F.struct(s.alias("s"), F.split(s, "").alias("chars")), _measured)


def _measured(t: Column) -> Column:
    s = t["s"]
    encoding = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        encoding = F.when(s.rlike(pattern), F.lit(i)).otherwise(encoding)
    codes = F.transform(t["chars"], lambda c: F.ascii(c).cast("double"))
    counts = F.transform(F.array_distinct(t["chars"]), lambda c: F.length(F.regexp_replace(s, F.concat(F.lit("[^\\Q"), c, F.lit("\\E]")), F.lit(""))).cast("double"))
    return _let(F.struct(
        F.length(s).cast("double").alias("n"), encoding.alias("fits"), codes.alias("codes"), (_classes(s) - 1).cast("double").alias("changes"),
        F.length(F.regexp_replace(s, "[^_-]", "")).cast("double").alias("separators"), F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x).alias("squares"),
    ), _averaged)


def _averaged(t: Column) -> Column:
    n, codes = t["n"], t["codes"]
    # An encoding of random bytes has few hyphens and underscores; a string with more is words and separators.
    fits = F.when(t["separators"] <= n / 32 + 3 * F.sqrt(n / 32), t["fits"])
    names, sizes = F.array(*[F.lit(name) for name, _, _ in ENCODINGS]), F.array(*[F.lit(float(k)) for _, _, k in ENCODINGS])
    size = F.get(sizes, t["fits"])
    less = F.greatest(F.size(codes) - 1, F.lit(0))
    products = F.zip_with(F.slice(codes, 1, less), F.slice(codes, 2, less), lambda x, y: x * y)
    return _let(F.struct(
        n.alias("n"), F.get(names, fits).alias("encoding"), size.alias("size"), t["changes"].alias("changes"), F.greatest(n - 1, F.lit(1.0)).alias("pairs"),
        (t["squares"] * size / n - n).alias("chi"), (F.greatest(size * F.lit(TEXT_COINCIDENCE) - 1, F.lit(LEAST_EXCESS)) * n).alias("excess"),
        (F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n).alias("mean"), F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x * x).alias("sum"), F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x).alias("lagged"),
    ), _judgements)


def _judgements(t: Column) -> Column:
    n, size, pairs, mean, excess = t["n"], t["size"], t["pairs"], t["mean"], t["excess"]
    spread, lagged = t["sum"] / n - mean * mean, t["lagged"] / pairs - mean * mean
    correlation = F.when(spread > 0, F.abs(lagged / spread)).otherwise(F.lit(1.0))
    z = F.array(
        ((size - 1) + excess - t["chi"]) / F.sqrt(2 * (size - 1) + 4 * excess),
        (t["changes"] - pairs * TEXT_CHANGES - 0.5) / F.sqrt(pairs * (TEXT_CHANGES * (1 - TEXT_CHANGES))),
        (F.lit(TEXT_CORRELATION) - correlation) * F.sqrt(n),
    )
    return _let(F.struct(t["encoding"].alias("encoding"), F.transform(z, _p_value).alias("ps")), _combined)


def _combined(t: Column) -> Column:
    ps = [F.get(t["ps"], F.lit(i)) for i in range(3)]
    text_like = (ps[0] > VETO) | (ps[1] > VETO) | (ps[2] > VETO)
    half = -(F.log(ps[0]) + F.log(ps[1]) + F.log(ps[2]))  # half of Fisher's statistic; survival of chi-squared with 6 degrees
    p = _let(half, lambda x: F.least(F.exp(-x) * (1 + x + x * x / 2), F.lit(1.0)))
    return F.struct(t["encoding"].alias("encoding"), F.when(t["encoding"].isNotNull(), F.when(text_like, F.lit(1.0)).otherwise(p)).alias("p"))


def _with_tested(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``df`` with ``tested``: (start, end, encoding, p) of the candidates that have a digit, long ones by windows.

    Windows lie half over each other, and the last one takes the rest of the run, so none is short.
    """
    piece = lambda s: F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"])

    def parts(s: Column, separators: str) -> Column:
        # One step a piece: its start is the end before it plus the separator.
        sizes = F.transform(F.split(piece(s), separators, -1), lambda x: F.length(x))
        start = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        long = lambda acc, n: F.when(n >= CANDIDATE_CHARS, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))))).otherwise(acc["out"])
        return F.aggregate(sizes, start, lambda acc, n: F.struct((acc["at"] + n + 1).alias("at"), long(acc, n).alias("out")), lambda acc: acc["out"])

    runs = F.filter(spans, lambda s: piece(s).rlike("[0-9]"))
    df = df.withColumn("_runs", F.array_distinct(F.flatten(F.transform(runs, lambda s: F.concat(F.array(s), *[parts(s, x) for x in SEPARATORS])))))
    digits = F.filter("_runs", lambda s: piece(s).rlike("[0-9]"))

    def cut(s: Column) -> Column:
        step = WINDOW_CHARS // 2
        last = F.greatest(F.floor((s["end"] - s["start"] - WINDOW_CHARS) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((s["start"] + i * step).alias("start"), F.when(i == last, s["end"]).otherwise(s["start"] + i * step + WINDOW_CHARS).alias("end")))

    windows = F.flatten(F.transform(digits, cut))
    df = df.withColumn("_windows", F.transform(windows, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), piece(s).alias("s"))))
    tested = F.transform("_windows", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["s"]).alias("t")))
    df = df.withColumn("_tested", tested)
    kept = F.filter("_tested", lambda s: s["t"]["p"].isNotNull())
    return df.withColumn("tested", F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["t"]["encoding"].alias("encoding"), s["t"]["p"].alias("p")))).drop("_runs", "_windows", "_tested")


def _merged(spans: Column) -> Column:
    """Spans sorted, those that overlap made one."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )


def _bin(p: Column, length: Column, mean_length: Column) -> Column:
    """The bin of the weighted p-value, rounded towards the larger p-value: the rule stays on the safe side."""
    weighted = p * mean_length / F.greatest(length.cast("double"), F.lit(1.0))
    return F.greatest(F.least(F.floor(-F.log10(weighted) * STEPS), F.lit(BINS)), F.lit(0)).cast("int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: ``id_col`` and arrays of (start, end) assign, access, hex and random.

    A null text is taken as empty. ``random`` holds the battery's finds that touch no base span.
    Repeated rows stay; an empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = materialize(_found(rows).drop("text"))  # spans only; the corpus is scanned once
    kinds = ("assign", "access", "hex", "random")
    return _judged(found, _limit(found, fdr)).select(F.col("row").alias(id_col), *kinds)


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) with the spans assign, access, hex and the tested candidates. The caller's columns are inside ``row``."""
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    found = _with_spans(rows, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE})
    value = lambda s: F.regexp_extract(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]), ASSIGN, 2)
    found = found.withColumn("assign", F.filter("assign", lambda s: F.length(value(s)) >= ASSIGN_CHARS))
    return _with_tested(found, "text", "candidates").select("row", "text", "assign", "access", "hex", "tested")


def _limit(found: DataFrame, fdr: float) -> DataFrame:
    """One row: the least bin that the false discovery rule lets pass, and the mean length. Counts by bin, never a ranking."""
    each = materialize(found.select(F.explode("tested").alias("t")).select("t.p", (F.col("t.end") - F.col("t.start")).alias("length")))
    mean = each.agg(F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"))
    bins = each.crossJoin(F.broadcast(mean)).groupBy(_bin(F.col("p"), F.col("length"), F.col("mean")).alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    ranked = bins.withColumn("m", F.sum("n").over(total)).withColumn("r", F.sum("n").over(Window.orderBy(F.desc("bin"))))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / STEPS) <= F.col("r") * fdr / F.col("m"))
    return passing.agg(F.coalesce(F.min("bin"), F.lit(BINS + 1)).alias("limit")).crossJoin(mean)


def _judged(found: DataFrame, limit: DataFrame) -> DataFrame:
    """``found`` with ``random``: the significant candidates that touch no base span."""
    base = F.concat("assign", "access", "hex")
    significant = F.filter("tested", lambda t: (_bin(t["p"], t["end"] - t["start"], F.col("mean")) >= F.col("limit")) & ~t["encoding"].isin(*SILENT))
    clear = F.filter(significant, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.crossJoin(F.broadcast(limit)).withColumn("random", _merged(F.transform(clear, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))))


def joined(*kinds: tuple[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind in the given order, comma-joined."""
    def tag(order: int, name: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(order).alias("order"), s["end"], F.lit(name).alias("kind")))

    tagged = [tag(i, name, spans) for i, (name, spans) in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with each secret of ``text_col`` replaced by ``mark``; all columns kept, in order.

    Two passes over the texts, neither of which writes one: the first yields the p-values that the false
    discovery rule needs, the second scans again and redacts. Of an assignment the value is replaced and
    the name stays. Overlapping spans become one mark. Rows are carried along in one struct, not joined,
    so repeated rows, null ids and columns of any name do no harm. A null text stays null; an empty table
    stays empty.
    """
    text = F.col("text")
    limit = materialize(_limit(_found(docs.select(F.lit(0).alias("row"), F.col(text_col).cast("string").alias("text"))), fdr))
    rest = [c for c in docs.columns if c != text_col]
    packed = F.struct(F.col(text_col).isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    found = _judged(_found(docs.select(packed.alias("row"), F.col(text_col).cast("string").alias("text"))), limit)
    value = F.transform("assign", lambda s: F.struct((s["start"] + F.length(F.regexp_extract(F.substr(text, s["start"] + 1, s["end"] - s["start"]), ASSIGN, 1))).alias("start"), s["end"].alias("end")))
    marked = found.select("row", "text", _merged(F.concat(value, "access", "hex", "random")).alias("spans"))
    begins = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substr(text, a + 1, b - a))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.array_join(pieces, mark))
    made = marked.select("row", F.when(~F.col("row.none"), clean).alias("text"))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns])
