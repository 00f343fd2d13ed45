"""PII surrogates: keyed, type-consistent replacements that keep distinctness and coreference.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards, US social security numbers,
IBANs and titled names, and in the same text every further mention of a titled name's words. An
entity is brought to a canonical form (lower case, digits only), and a keyed permutation of all strings of its
form gives the surrogate. A permutation maps different entities of a form to different surrogates and
one entity to one surrogate everywhere, without a table of the corpus; the permutation
x -> D(E(x) + k), with E a Feistel cipher and k <> 0 modulo the form's size, has no fixed point.

Letters stay in their script and case, vowels of the scripts listed stay vowels, digits stay digits of their
script, cards keep their Luhn residue, valid IBANs stay valid, octets stay octets. A name is replaced word by word,
whatever stands before it: a first name of the lists by one of its gender and script, any other word
by a string of its form, so "Mr. Smith", "John Smith" and "Dr. John Smith" keep one surname.

``check`` holds the results against each other over the whole corpus, in a shuffle over distinct
entities: no surrogate may stand for two entities, no entity may have two surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, map_rows

#: Entities a task remembers, for speed; emptied when full.
MEMORY = 100_000

# First names by gender and script.
NAMES = {
    ("f", "latin"): ["anna", "maria", "emma", "laura", "julia", "sarah", "clara", "alice", "helen", "nina", "paula", "marta", "louise", "camille", "ines", "greta"],
    ("m", "latin"): ["john", "peter", "paul", "thomas", "daniel", "martin", "lucas", "david", "robert", "hugo", "jorge", "pierre", "karl", "james", "michael", "oscar"],
    ("f", "cyrillic"): ["анна", "мария", "ольга", "елена", "ирина", "наталья", "светлана", "татьяна"],
    ("m", "cyrillic"): ["иван", "пётр", "сергей", "дмитрий", "алексей", "николай", "андрей", "михаил"],
    ("f", "arabic"): ["فاطمة", "مريم", "عائشة", "ليلى", "زينب", "سارة"],
    ("m", "arabic"): ["محمد", "أحمد", "علي", "حسن", "عمر", "خالد"],
}
# Titles that stand before a name, and those after a Chinese one; frequent Chinese surnames.
TITLES = [
    "mr", "mrs", "ms", "miss", "herr", "frau", "monsieur", "madame", "señor", "señora", "dr", "prof",
    "г-н", "г-жа", "господин", "госпожа", "д-р", "проф", "κύριος", "κυρία", "السيد", "السيدة", "الدكتور", "الدكتورة",
]
TITLES_AFTER = ["先生", "女士", "小姐"]
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢"

_LISTED = {name: (f"name:{gender}:{script}", names) for (gender, script), names in NAMES.items() for name in names}
_ALPHABETS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "áéíóúàèìòùâêîôûäëïöü", "çñ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
_CLASS = {c: a for a in _ALPHABETS for c in a}

PATTERNS = [
    ("card", r"(?<![\w.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\w-])"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\w)"),
]
_NUMERIC = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"@(?:[\w-]{1,63}\.)+[A-Za-z]{2,24}(?!\w)")
_TITLE = re.compile(r"(?<!\w)(?:" + "|".join(TITLES) + r")\.?[ \u00a0](?=\w)", re.IGNORECASE)
_AFTER = re.compile(f"[{SURNAMES}][\u4e00-\u9fff]{{1,2}}(?=(?:{'|'.join(TITLES_AFTER)}))")
_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1)
def _name_word():
    """A word of a name: letters with their marks, parts joined by apostrophes and hyphens."""
    import regex

    return regex.compile(r"[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*")


def _capital(word: str) -> bool:
    """Whether a word can be a name: a capital first, or a script without case."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _names(text: str) -> list[tuple[int, int, str]]:
    """Spans of the words of titled names, wherever they stand in the text."""
    word, spans, known = _name_word(), [], set()
    for m in _TITLE.finditer(text):
        at = m.end()
        for _ in range(2):  # a first name and a surname, or one of them
            found = word.match(text, at)
            if not found or not _capital(found[0]):
                break
            spans.append((found.start(), found.end(), "name"))
            known.add(found[0].lower())
            at = found.end() + 1
            if text[found.end() : at] not in (" ", "\u00a0") or "\u4e00" <= found[0][0] <= "\u9fff":
                break
    if any(title in text for title in TITLES_AFTER):
        for m in _AFTER.finditer(text):
            spans.append((m.start(), m.end(), "name"))
            known.add(m[0])
    if known:
        spans += [(m.start(), m.end(), "name") for m in word.finditer(text) if m[0].lower() in known and _capital(m[0])]
    return spans


def detect(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in order; of overlapping finds the earlier, then the longer stays."""
    found = _names(text)
    at = text.find("@")
    while at >= 0:
        left, right = _BEFORE_AT.search(text, max(0, at - 64), at), _AFTER_AT.match(text, at)
        if left and right:
            found.append((left.start(), right.end(), "email"))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), m.lastgroup) for m in _NUMERIC.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], s[2])):
        if out and span[2] == out[-1][2] == "name" and span[0] > out[-1][1] and text[out[-1][1] : span[0]] in (" ", "\u00a0"):
            out[-1] = (out[-1][0], span[1], "name")  # a first name and a surname are one entity
        elif not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters that may stand for one: those of its class, or of its kind in its script's block; itself if it is no letter or digit."""
    if c in _CLASS:
        return _CLASS[c]
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.decimal(c) + i) for i in range(10))
    if not c.isalpha():
        return c
    if "\u4e00" <= c <= "\u9fa5":
        return "".join(map(chr, range(0x4E00, 0x9FA6)))
    block, kind = ord(c) & ~0x7F, unicodedata.category(c)
    near = [x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and x not in _CLASS and x.lower() == x]
    turns = lambda x: len(x.upper()) == 1 and x.upper().lower() == x
    return "".join(x for x in near if turns(x) == turns(c)) if c in near else c


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""

    def __init__(self, key: bytes, domain: str, n: int) -> None:
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.key = hmac.new(key, domain.encode(), hashlib.sha256).digest()
        self.step = 1 + int.from_bytes(self.key[:16], "big") % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        size = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big"), key=self.key, salt=bytes([i]), digest_size=min(64, size)).digest(), "big") & self.mask

    def _forward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in range(8):
                a, b = b, a ^ self._f(i, b)
            x = (a << self.half) | b
            if x < self.n:
                return x

    def _backward(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in reversed(range(8)):
                a, b = b ^ self._f(i, a), a
            x = (a << self.half) | b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self._backward((self._forward(x) + self.step) % self.n) if self.n > 1 else x


class Surrogates:
    """Replacements for entities under one key."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.known: dict[tuple[str, str], str] = {}
        self.permutations: dict[tuple[str, int], Permutation] = {}

    def _permute(self, domain: str, x: int, n: int) -> int:
        p = self.permutations.get((domain, n))
        if p is None:
            if len(self.permutations) >= MEMORY:
                self.permutations.clear()
            p = self.permutations[domain, n] = Permutation(self.key, domain, n)
        return p(x)

    def shape(self, kind: str, s: str, excluded=lambda made: False) -> str:
        """Permute a lower-case string within the strings of its form that are not excluded: each character within its alphabet."""
        classes = [alphabet(c) for c in s]
        n, x = 1, 0
        for c, letters in zip(s, classes):
            n, x = n * len(letters), x * len(letters) + letters.index(c)
        if n == 1:
            return s
        form = "|".join(letters[:32] for letters in classes)
        while True:
            x = self._permute(f"{kind}|{form}", x, n)
            out, rest = [], x
            for letters in reversed(classes):
                rest, i = divmod(rest, len(letters))
                out.append(letters[i])
            made = "".join(reversed(out))
            if not excluded(made):
                return made

    def canonical(self, kind: str, entity: str) -> str:
        if kind in ("card", "ssn", "phone"):
            return "".join(str(unicodedata.decimal(c)) for c in entity if c.isdecimal())
        return re.sub(r"\s+", "" if kind == "iban" else " ", entity).lower()

    def replace(self, kind: str, entity: str) -> str:
        """The surrogate of an entity, in the entity's format (case, separators, digits)."""
        if kind == "name":
            return "".join(part if part.isspace() else self._dress(kind, part, self.made(kind, part.lower())) for part in re.split(r"(\s)", entity) if part)
        return self._dress(kind, entity, self.made(kind, self.canonical(kind, entity)))

    def made(self, kind: str, form: str) -> str:
        """The surrogate of a canonical form."""
        made = self.known.get((kind, form))
        if made is None:
            made = self._make(kind, form)
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[kind, form] = made
        return made

    def _make(self, kind: str, s: str) -> str:
        if kind == "ip":
            x = 0
            for octet in s.split("."):
                x = x * 256 + int(octet)
            x = self._permute("ip", x, 1 << 32)
            return ".".join(str(x >> shift & 255) for shift in (24, 16, 8, 0))
        if kind == "card":
            body = s[0] + self.shape("card" + s[0], s[1:-1])
            residue = (_luhn(s) - _luhn(body + "0")) % 10
            return body + str(residue)
        if kind == "email":
            local, _, domain = s.partition("@")
            name, _, top = domain.rpartition(".")
            return self.shape("email:" + top, f"{local}@{name}") + "." + top
        if kind == "iban":
            if _iban(s) != 1:  # no valid one: any other string that is no valid one
                return s[:2] + self.shape("iban?" + s[:2], s[2:], lambda made: _iban(s[:2] + made) == 1)
            rest = self.shape("iban" + s[:2], s[4:])
            return f"{s[:2]}{98 - _iban(s[:2] + '00' + rest):02d}{rest}"
        if kind == "name":
            return self._name(s)
        return self.shape(kind, s)

    def _name(self, word: str) -> str:
        """One word of a name: a listed first name within its list, any other within its form."""
        listed = _LISTED.get(word)
        if listed:
            domain, names = listed
            return names[self._permute(domain, names.index(word), len(names))]
        if word[0] in SURNAMES and 2 <= len(word) <= 3 and all("\u4e00" <= c <= "\u9fa5" for c in word):
            return SURNAMES[self._permute("surname", SURNAMES.index(word[0]), len(SURNAMES))] + self.shape("given", word[1:])
        han = lambda made: made[0] in SURNAMES and 2 <= len(made) <= 3
        return self.shape("name", word, lambda made: made in _LISTED or han(made))

    @staticmethod
    def _dress(kind: str, entity: str, made: str) -> str:
        if kind in ("card", "ssn", "phone"):
            source = iter(made)
            return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(source))) if c.isdecimal() else c for c in entity)
        if kind == "iban":
            source = iter(made)
            return "".join(next(source).upper() if c.isalnum() else c for c in entity)
        if kind == "ip":
            return made
        if len(made) == len(entity):
            return "".join(m.upper() if e.isupper() else m for e, m in zip(entity, made))
        return made.upper() if entity.isupper() and len(entity) > 1 else made.capitalize() if entity[:1].isupper() else made


def _iban(s: str) -> int:
    """The remainder by 97 that is 1 for a valid IBAN (lower case, no spaces)."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10


def _key(key: bytes, df: DataFrame):
    if not key:
        raise ValueError("a key is needed")
    return df.sparkSession.sparkContext.broadcast(bytes(key))


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", checked: bool = True) -> DataFrame:
    """One row per document: ``id_col``, text with surrogates, n_entities, kinds (kind:start:end in the original).

    ``checked``: ``check`` runs first, and what it finds is an error. A null text stays null; a text without entities is returned as it is. Repeated rows stay, and equal
    entities get equal surrogates wherever they stand. An empty table gives no rows; other columns aren't read.
    """
    shared = _key(key, docs)
    key_type = dict(docs.dtypes)[id_col]
    if checked and (found := check(docs, key, text_col).head(3)):
        raise RuntimeError(f"surrogates of two entities, or two of one: {[r['kind'] for r in found]}")

    def factory():
        made = Surrogates(shared.value)

        def one(doc, text):
            if not text:
                return doc, text, 0, ""
            spans = detect(text)
            if not spans:
                return doc, text, 0, ""
            out, at = [], 0
            for start, end, kind in spans:
                out += [text[at:start], made.replace(kind, text[start:end])]
                at = end
            kinds = ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
            return doc, "".join([*out, text[at:]]), len(spans), kinds

        return one

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), factory, f"`{id_col}` {key_type}, text string, n_entities int, kinds string")


def check(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, entity, surrogate) of every entity of the corpus that shares its surrogate, or has several: no rows if all is well.

    A task hands on each entity once (up to MEMORY, then again), as canonical forms; the comparison is a shuffle over
    distinct entities, with nothing on the driver.
    """
    shared = _key(key, docs)
    bound_batches(docs.sparkSession)

    def pairs(batches):
        made, met = Surrogates(shared.value), set()
        for batch in batches:
            new = []
            for text in batch.column(0).to_pylist():
                for start, end, kind in detect(text or ""):
                    forms = [w.lower() for w in text[start:end].split()] if kind == "name" else [made.canonical(kind, text[start:end])]
                    for form in forms:
                        if (kind, form) not in met:
                            met.add((kind, form))
                            new.append((kind, form, made.made(kind, form)))
            if len(met) >= MEMORY:
                met.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in new], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(pairs, "kind string, entity string, surrogate string").distinct()
    shared_by = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind", "surrogate")
    several = found.groupBy("kind", "entity").agg(F.count("*").alias("n")).where("n > 1").select("kind", "entity")
    return found.join(shared_by, ["kind", "surrogate"], "left_semi").unionByName(found.join(several, ["kind", "entity"], "left_semi")).distinct()
