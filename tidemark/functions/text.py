"""Text functions as Columns.

Most stay in the JVM. What goes over every character of every text (white space, canonical forms) works on UTF-8 bytes
in Arrow batches: the engine's ``translate`` and character classes take some 100 ns a character, and classes of several
ranges far more when the cores of one JVM share them.
"""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: What Python's str.split and \s treat as white space, for Java's and RE2's regular expressions alike.
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: The same characters one by one, but for the plain space.
SPACES = "".join(map(chr, [*range(0x20), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Fixed value: masks such as XX/XX/XXXX.
REDACTION = r"(?iU)\bx{2,}(?:[\s/.\-]+x{2,})*\b"

# Words of company names that say nothing about the brand.
COMPANY_STOP_WORDS = [
    "bank", "of", "the", "and", "card", "credit", "financial", "services", "service",
    "company", "co", "na", "llc", "inc", "usa", "national", "corp", "corporation",
    "holdings", "group", "systems", "mortgage", "loans", "loan", "trust", "fund",
]

#: Full case foldings that differ from lower case (the common ones).
FOLDINGS = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ς": "σ", "ŉ": "ʼn"}


def normalize_whitespace(text: Column) -> Column:
    """Control characters and white space runs become one space; ends are trimmed.

    Exotic spaces are translated first: a pattern for them all would be tried at every character. For short texts, and
    inside lambdas and branches; ``display_text`` does the same faster.
    """
    return F.trim(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " "))


#: UTF-8: control characters become spaces; the other spaces; what is no a-z or 0-9 becomes a space, A-Z lower case.
_PLAIN = bytes(32 if c < 32 or c == 127 else c for c in range(256))
_EXOTIC = [c.encode() for c in SPACES if c > "\x7f"]
_CANONICAL = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Every character beyond ASCII whose lower case or folding has a letter a-z.
_FOLDED = [(k.encode(), v.encode()) for k, v in {**FOLDINGS, "ẞ": "ss", "\u212a": "k", "İ": "i\u0307"}.items() if any("a" <= c <= "z" for c in v)]


def _squeezed(text: bytes) -> bytes:
    """Runs of spaces become one; ends are trimmed."""
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


def shown_bytes(text: bytes) -> bytes:
    """A text's display form, in UTF-8."""
    if not text.isascii():
        for space in _EXOTIC:
            text = text.replace(space, b" ")
    return _squeezed(text.translate(_PLAIN))


def canonical_bytes(text: bytes) -> bytes:
    """A text's canonical form, in UTF-8."""
    if not text.isascii():
        for char, folded in _FOLDED:
            text = text.replace(char, folded)
    return _squeezed(text.translate(_CANONICAL))


def _each(texts: pa.Array, f, kind: pa.DataType) -> pa.Array:
    made = pa.array([f(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
    return made.cast(options=pc.CastOptions(kind, allow_invalid_utf8=True))


@F.arrow_udf(StringType())
def _shown(texts: pa.Array) -> pa.Array:
    return _each(texts, shown_bytes, pa.string())


@F.arrow_udf(StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return _each(texts, canonical_bytes, pa.string())


@F.arrow_udf(BinaryType())
def _canonical_digest(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: hashlib.sha256(canonical_bytes(t)).digest(), pa.binary())


@F.arrow_udf(StringType())
def ascii_capitals(texts: pa.Array) -> pa.Array:
    """a-z in capitals, all else as it is."""
    return pc.ascii_upper(texts)


def display_text(text: Column) -> Column:
    """Null becomes the empty string; white space is normalized, case kept."""
    return _shown(F.coalesce(text.cast("string"), F.lit("")))


def count_words(clean: Column) -> Column:
    """Tokens of a text whose white space is normalized already: its gaps and one."""
    return F.when(clean == "", F.lit(0)).otherwise(F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit(""))) + 1)


def count_tokens(text: Column) -> Column:
    """White space separated tokens; null and blank count 0."""
    return count_words(display_text(text))


def clustering_text(text: Column) -> Column:
    """Lower case without masked spans."""
    return unmasked(F.lower(display_text(text)))


def unmasked(lowered: Column) -> Column:
    """A lower-cased display text without masked spans; the pattern is tried only on texts that can hold one."""
    return F.when(F.contains(lowered, F.lit("xx")), normalize_whitespace(F.regexp_replace(lowered, REDACTION, " "))).otherwise(lowered)


def company_tokens(company: Column) -> Column:
    """Brand words of a company's name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(company, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COMPANY_STOP_WORDS))


def strip_company(text: Column, company: Column) -> Column:
    """The clustering text without its own company's brand words; unchanged if there are none."""
    tokens = company_tokens(company)
    pattern = F.concat(F.lit(r"(?U)\b(?:"), F.array_join(tokens, "|"), F.lit(r")\b"))
    return F.when(F.size(tokens) > 0, normalize_whitespace(F.regexp_replace(text, pattern, F.lit(" ")))).otherwise(text)


def casefold(text: Column) -> Column:
    out = F.lower(text)
    for char, folded in FOLDINGS.items():
        out = F.replace(out, F.lit(char), F.lit(folded))
    return out


def canonical_form(text: Column) -> Column:
    """Key of near duplicates: folded, a-z and 0-9 only, single spaces."""
    return _canonical(F.coalesce(text.cast("string"), F.lit("")))


def canonical_digest(text: Column) -> Column:
    """SHA-256 of the canonical form, as binary: the form itself never leaves the batch."""
    return _canonical_digest(F.coalesce(text.cast("string"), F.lit("")))


def embed_words(text: Column) -> Column:
    """Tokens [a-z0-9]+ of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def with_pairs(words: Column) -> Column:
    """Tokens, then neighbouring pairs joined by an underscore. ``words`` should be a column: it is named several times."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def analyzer_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words of two or more letters, digits or underscores of the lower-cased text, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def fill_prompt(template: Column | str, vocabulary: list[str], narrative: Column) -> Column:
    """Put the quoted vocabulary and the narrative into a template's {{CATEGORIES}} and {{NARRATIVE}}."""
    body = F.lit(template) if isinstance(template, str) else template
    quoted = ", ".join(f'"{c}"' for c in vocabulary)
    return F.replace(F.replace(body, F.lit("{{CATEGORIES}}"), F.lit(quoted)), F.lit("{{NARRATIVE}}"), narrative)


def narrative_of(prompt: Column) -> Column:
    """What follows the last RECORD: of a prompt."""
    return F.trim(F.substring_index(prompt, "RECORD:", -1), F.lit(BLANKS))


def strip_fences(text: Column) -> Column:
    """A response without code fences at line starts and ends."""
    return F.trim(F.regexp_replace(text, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def json_object(text: Column) -> Column:
    """From the first { to the last }; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)
