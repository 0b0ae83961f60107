"""Normalization of raw message records, column by column: every field arrives as text.

All of it stays in the JVM: Spark has no function for Unicode normalization, so `canonical_body` calls the one of the
ICU library that Spark's collations come with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes of exported messages and addresses, the verbs of reactions sent as text.
SMS_DIRECTIONS = {1: "incoming", 2: "outgoing", 3: "draft"}
MMS_DIRECTIONS = {1: "incoming", 2: "outgoing", 3: "incoming", 4: "outgoing"}
MMS_TYPES = {128: "outgoing", 132: "incoming"}
ADDRESS_ROLES = {137: "from", 151: "to", 130: "cc", 129: "bcc"}
REACTIONS = {"Liked": "liked", "Loved": "loved", "Emphasized": "emphasized", "Laughed at": "laughed", "Disliked": "disliked", "Questioned": "questioned", "Reacted to": "other"}

#: Frequent short words by language; a small stand-in for a language model.
FREQUENT = {
    "en": "the of and to in is you that it for was on are with not have this but my your",
    "fr": "le la les des et est une dans pour que qui pas vous nous sur avec je tu ce mais",
    "de": "der die das und ist nicht ich du ein eine mit auf zu den von sie wir auch aber dem",
    "es": "el los las una que es por con para no del se lo como pero su yo muy mi al",
}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[key]


def present(c: Column) -> Column:
    """Null for the texts "null" and ""."""
    return F.when(~c.isin("null", ""), c)


def whole(c: Column) -> Column:
    """The number in a text, cut to a long; null for anything else."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double").try_cast("long"))


def sent_ms(c: Column) -> Column:
    """Epoch milliseconds; a bare ten-digit value counts seconds, no number gives 0."""
    n = F.coalesce(whole(c), F.lit(0))
    return F.when(F.trim(c).rlike(r"^\d{10}$"), n * 1000).otherwise(n)


def is_read(c: Column) -> Column:
    return c == "1"


def sms_direction(kind: Column) -> Column:
    return F.coalesce(_lookup(SMS_DIRECTIONS, kind.cast("int")), F.lit("other"))


def mms_direction(box: Column, kind: Column) -> Column:
    """By folder; by message type where the folder says nothing."""
    return F.coalesce(_lookup(MMS_DIRECTIONS, box.cast("int")), _lookup(MMS_TYPES, kind.cast("int")), F.lit("other"))


def address_role(kind: Column) -> Column:
    """An unknown kind is a recipient, so that nobody is dropped."""
    return F.coalesce(_lookup(ADDRESS_ROLES, kind.cast("int")), F.lit("to"))


def address_kind(raw: Column) -> Column:
    """email, alias (no number), shortcode (at most six digits) or mobile."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    digits = F.length(value) - F.length(F.translate(value, "0123456789", ""))
    return F.when(value.contains("@"), "email").when(value.rlike("[A-Za-z]") | (digits == 0), "alias").when(digits <= 6, "shortcode").otherwise("mobile")


def e164(raw: Column, country: str = "1", national: int = 10) -> Column:
    """+ and digits, where a number has a country code or the home country's length; else null. No numbering plans are consulted."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(value, r"\D", "")
    home = (F.length(digits) == national + len(country)) & digits.startswith(country)
    form = F.when(value.startswith("+") & (F.length(digits) >= 7) & (F.length(digits) <= 15) | home, F.concat(F.lit("+"), digits)).when(F.length(digits) == national, F.concat(F.lit("+" + country), digits))
    return F.when(address_kind(raw) == "mobile", form)


def address_key(raw: Column) -> Column:
    return F.coalesce(e164(raw), F.trim(raw))


def reaction_kind(body: Column) -> Column:
    """What a reaction sent as text says ("Liked “…”"); null for other texts. The verb is case-sensitive, the quotation may span lines."""
    verb = F.regexp_extract(F.coalesce(body, F.lit("")), rf'(?s)^({"|".join(REACTIONS)}) ["“].*["”]\z', 1)
    return _lookup(REACTIONS, F.when(verb != "", verb))


def language(body: Column) -> Column:
    """The language most of whose frequent words a text holds (ties: first in FREQUENT); null under four characters or without any."""
    words = F.split(F.lower(F.trim(body)), r"[^\p{L}]+")
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known.split())))
    counts = {code: count(known) for code, known in FREQUENT.items()}
    most = F.greatest(*counts.values())
    found = F.coalesce(*[F.when(n == most, code) for code, n in counts.items()])
    return F.when((F.length(F.trim(body)) >= 4) & (most > 0), found)


def _composed(text: Column) -> Column:
    """NFC; text isn't null. Characters below U+0300 are in that form already."""
    return F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))).otherwise(text)


def canonical_body(body: Column) -> Column:
    """NFC, white space runs as one space, ends trimmed; case stays, null becomes empty."""
    return F.trim(F.regexp_replace(_composed(F.coalesce(body, F.lit(""))), r"(?U)[\s\x{feff}]+", " "))


def minute_bucket(ms: Column) -> Column:
    return F.floor(ms / 60_000)


def manifest_digest(parts: Column) -> Column:
    """SHA-256 of an array of structs, whatever its order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(parts, F.to_json)), ","), 256)
