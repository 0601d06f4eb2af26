"""Replacement of personal data by keyed surrogates of the same kind.

Entities are found by their form: mail addresses, telephone, card and social security numbers, network
addresses, access tokens and passwords behind their name, and persons named with a title or a known given
name. A surrogate is a keyed permutation of all values of the same format: digits stay digits, letters
keep their script and case, separators stay where they are, card numbers stay valid or invalid, private
network addresses stay private, given names keep gender and script. Being a permutation, it gives equal
surrogates to equal entities (coreference) and different ones to different entities (distinctness), on
any machine and without a table of what was seen. ``collisions`` checks that on the data.

Short formats have few values, so that one of them can stand for itself with a chance of one in as many.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagecensus.llm.common import arrow_map

# Letters of the scripts that surrogates stay in; other characters are kept as they are.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "àáâäæçèéêëíîïñóôöœùúûüÿ",
    "ÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÙÚÛÜŸ",
)
_ALPHABET_OF = {c: a for a in ALPHABETS for c in a}

# Given names by gender and script; a name is replaced by another one of its group.
GIVEN_NAMES = {
    ("female", "latin"): "Anna Barbara Carla Diana Elena Emma Julia Karen Laura Linda Maria Nina Olivia Sandra Sophie Susan",
    ("male", "latin"): "Adam Boris Carlos Daniel David Frank George Henry James John Marco Martin Michael Paul Peter Robert",
    ("female", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга",
    ("male", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Николай Сергей",
    ("female", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία",
    ("male", "greek"): "Αντώνης Γιάννης Δημήτρης Κώστας Νίκος Πέτρος",
}
_GIVEN = {name: tuple(names.split()) for names in GIVEN_NAMES.values() for name in names.split()}
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora")

_DIGITS_FORM = re.compile(r"(?<![\w.+-])[+(]?\d[\d ().-]{5,30}\d(?![\w-]|\.\d)")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
_SECRET = re.compile(
    r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|passw(?:or)?d)\b[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_.=-]{8,})"
)
# A longer secret is replaced in parts of so many characters.
SECRET_PART = 512
_SECRET_HINT = re.compile(r"(?i)key|token|secret|passw")
_GIVEN_FORM = re.compile(rf"\b({'|'.join(_GIVEN)})((?: [^\W\d_a-zà-ÿа-яα-ω][^\W\d_]{{1,30}})+)")
_TITLE_FORM = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.? ([^\W\d_]{{2,30}}(?: [^\W\d_a-zà-ÿа-яα-ω][^\W\d_]{{1,30}})?)")


# ---- keyed permutations ----------------------------------------------------------------------


def _round(key: bytes, label: str, number: int, half: int, bits: int) -> int:
    message = f"{label}|{number}|{half}".encode()
    out = int.from_bytes(hmac.digest(key, message, "sha256"), "big")
    while bits > 256:
        message = hashlib.sha256(message).digest()
        out = out << 256 | int.from_bytes(hmac.digest(key, message, "sha256"), "big")
        bits -= 256
    return out


def permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of the numbers below ``size``: a Feistel network, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for number in range(8):
            left, right = right, left ^ (_round(key, label, number, right, half) & mask)
        value = left << half | right
        if value < size:
            return value


def _walk(
    key: bytes, label: str, text: str, alike: Callable[[str], object], of: dict[str, str] = _ALPHABET_OF
) -> str:
    """Permute the letters and digits of ``text`` within its format until ``alike`` is as before."""
    digits = [(i, of[c]) for i, c in enumerate(text) if c in of]
    size, value = 1, 0
    for i, alphabet in digits:
        value += size * alphabet.index(text[i])
        size *= len(alphabet)
    form = label + "|" + "".join(f"<{of[c][:2]}{len(of[c])}>" if c in of else c for c in text)
    wanted = alike(text)
    while True:
        value = permute(key, form, value, size)
        out, rest = list(text), value
        for i, alphabet in digits:
            rest, place = divmod(rest, len(alphabet))
            out[i] = alphabet[place]
        made = "".join(out)
        if alike(made) == wanted:
            return made


def _luhn(text: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([c for c in text if c.isdigit()])):
        doubled = int(c) * (1 + i % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _is_private(parts: tuple[int, ...]) -> bool:
    return parts[0] in (10, 127) or parts[:2] == (192, 168) or (parts[0] == 172 and 16 <= parts[1] < 32)


def _address(key: bytes, text: str) -> str:
    parts = tuple(map(int, text.split(".")))
    value = int.from_bytes(bytes(parts), "big")
    while True:
        value = permute(key, "ip", value, 1 << 32)
        made = tuple(value.to_bytes(4, "big"))
        if _is_private(made) == _is_private(parts):
            return ".".join(map(str, made))


def _mail(key: bytes, text: str) -> str:
    """Local part and domain apart, so that a domain has one surrogate; the last label is kept."""
    local, _, domain = text.rpartition("@")
    host, dot, last = domain.rpartition(".")
    edge = lambda s: (s[:1] + s[-1:]).count(".") + s.count("..")
    return f"{_walk(key, 'local', local, edge)}@{_walk(key, 'domain', host, edge)}{dot}{last}"


def _person(key: bytes, text: str) -> str:
    words = text.split(" ")
    made = []
    for word in words:
        group = _GIVEN.get(word)
        if group:
            made.append(group[permute(key, "given|" + group[0], group.index(word), len(group))])
        else:
            made.append(_walk(key, "surname", word, lambda s: s in _GIVEN))
    return " ".join(made)


_LOWER_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_UPPER_HEX = {c: "0123456789ABCDEF" for c in "0123456789ABCDEF"}


def _hex(text: str) -> dict[str, str] | None:
    return next((of for of in (_LOWER_HEX, _UPPER_HEX) if all(c in of for c in text)), None)


def _secret(key: bytes, text: str) -> str:
    """Hexadecimal strings stay so, and others do not become so."""
    return _walk(key, "secret", text, lambda s: _hex(s) is not None, _hex(text) or _ALPHABET_OF)


def _phone(key: bytes, text: str) -> str:
    """The country's number is kept."""
    country = re.match(r"\+\d{1,3}(?=\D)|", text).group()
    return country + _walk(key, f"phone {country}", text[len(country) :], lambda s: None)


_MAKERS: dict[str, Callable[[bytes, str], str]] = {
    "mail": _mail,
    "ip": _address,
    "card": lambda key, text: _walk(key, "card", text, _luhn),
    "phone": _phone,
    "ssn": lambda key, text: _walk(key, "ssn", text, lambda s: None),
    "secret": _secret,
    "person": _person,
}


@lru_cache(maxsize=20_000)
def surrogate(key: bytes, kind: str, text: str) -> str:
    return _MAKERS[kind](key, text)


# ---- detection --------------------------------------------------------------------------------


def _kind_of_digits(text: str) -> str | None:
    digits = sum(c.isdigit() for c in text)
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", text):
        return "ip" if all(int(p) < 256 for p in text.split(".")) else None
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return "ssn"
    if re.fullmatch(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}", text):
        return "card"
    if 7 <= digits <= 15 and (
        text[0] in "+(" or re.fullmatch(r"\d{10,11}|\d{2,5}(?:[ .-]\d{2,5}){2,5}|\d{3}[ .-]\d{4}", text)
    ):
        return "phone" if not re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{2}[.-]\d{2}[.-]\d{4}", text) else None
    return None


def _digit_entities(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _DIGITS_FORM.finditer(text):
        start, end, found = m.start(), m.end(), m.group()
        kind = _kind_of_digits(found)
        if kind:
            yield start, end, kind
            continue
        # Several numbers beside each other: look at the parts between blanks, joined as far as they fit.
        words = [(w.start() + start, w.end() + start) for w in re.finditer(r"[^ ]+", found)]
        i = 0
        while i < len(words):
            for j in range(min(len(words), i + 6), i, -1):
                kind = _kind_of_digits(text[words[i][0] : words[j - 1][1]])
                if kind:
                    yield words[i][0], words[j - 1][1], kind
                    break
            i = j if kind else i + 1


def _mail_entities(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text, max(0, at - 64), at)
        domain = _DOMAIN.match(text, at + 1)
        if local and domain:
            yield local.start(), domain.end(), "mail"
        at = text.find("@", at + 1)


def _secret_entities(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SECRET.finditer(text):
        start, end = m.span(1)
        if end - start < 32 or re.search(r"\d", m.group(1)):
            for part in range(start, end, SECRET_PART):
                yield part, min(part + SECRET_PART, end), "secret"


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the entities of a text, in order; of two that overlap the first found."""
    if not text:
        return []
    found = list(_mail_entities(text)) if "@" in text else []
    if _SECRET_HINT.search(text):
        found += _secret_entities(text)
    found += _digit_entities(text)
    found += [(*m.span(), "person") for m in _GIVEN_FORM.finditer(text)]
    found += [(*m.span(1), "person") for m in _TITLE_FORM.finditer(text)]
    taken: list[tuple[int, int, str]] = []  # in order and apart, so only the neighbours can overlap
    for entity in found:
        at = bisect(taken, entity)
        if (not at or taken[at - 1][1] <= entity[0]) and (at == len(taken) or entity[1] <= taken[at][0]):
            taken.insert(at, entity)
    return taken


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and ``(kind, start, entity, surrogate)`` of each replaced entity."""
    found, parts, at = [], [], 0
    for start, end, kind in entities(text):
        made = surrogate(key, kind, text[start:end])
        parts += [text[at:start], made]
        found.append((kind, start, text[start:end], made))
        at = end
    return ("".join([*parts, text[at:]]) if found else text), found


_ENTITY = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", IntegerType()),
        StructField("entity", StringType()),
        StructField("surrogate", StringType()),
    ]
)
_ENTITY_KIND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("entity", pa.string()), ("surrogate", pa.string())])
)


def _replaced(key: bytes):
    names = ("kind", "start", "entity", "surrogate")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace(t, key) for t in batch.column(0).to_pylist()]
            lists = [[dict(zip(names, e, strict=True)) for e in found] for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([t for t, _ in done], pa.string()), pa.array(lists, _ENTITY_KIND)],
                ["_row", "_replaced", "_entities"],
            )

    return apply


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with surrogates in their text, and ``_entities``: what was replaced, where and by what.

    A null text stays null, an empty one empty, a text without entities as it is. Other columns, null or
    not, are unchanged; one that is called ``_entities`` is replaced. Rows repeat as given; equal texts
    get equal replacements. An empty table gives no rows. Keep the key secret: it undoes the replacement.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "_entities"]
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), F.struct(*own).alias("_row"))
    schema = StructType(
        [rows.schema["_row"], StructField("_replaced", StringType()), StructField("_entities", ArrayType(_ENTITY))]
    )
    done = arrow_map(rows, _replaced(key.encode()), schema)
    columns = [
        (F.col("_replaced") if c == text_col else F.col(f"_row.`{c}`")).alias(c)
        for c in docs.columns
        if c != "_entities"
    ]
    return done.select(*columns, "_entities")


def key_of(spark: SparkSession) -> str:
    """The session's secret; without one, a known key that protects nothing and serves tests."""
    return spark.conf.get("spark.pagecensus.surrogateKey", "not a secret")


def collisions(replaced: DataFrame) -> DataFrame:
    """``kind, surrogate, n``: surrogates that stand for several entities. It has no rows."""
    each = replaced.select(F.explode("_entities").alias("e")).select("e.kind", "e.entity", "e.surrogate").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")
