"""Text functions as column expressions, with small Arrow functions where Spark has none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of personal data, in order of priority.
SHAPES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^ \t\r\n]+",
    "DATE": r"\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "LONG_NUMBER": r"\b[0-9][0-9 -]{5,}[0-9]\b",
}


#: What a text must hold for a shape to be looked for; without it the pattern of an address tries each letter.
_SIGNS = {"EMAIL": "@", "URL": "://"}


def _may_hold(text: Column, shape: str) -> Column:
    return text.contains(_SIGNS[shape]) if shape in _SIGNS else text.rlike("[0-9]")


def shape_count(text: Column, shape: str) -> Column:
    return F.coalesce(F.when(_may_hold(text, shape), F.regexp_count(text, F.lit(SHAPES[shape]))), F.lit(0))


def mask(text: Column, shapes: Sequence[str] = tuple(SHAPES)) -> Column:
    """The text with every match replaced by <SHAPE>, earlier shapes first."""
    for s in shapes:
        text = F.when(_may_hold(text, s), F.regexp_replace(text, SHAPES[s], f"<{s}>")).otherwise(text)
    return text


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit_sum(text: Column, double_from_right: bool) -> Column:
    """Sum of the digits, every second one doubled and cast out by nines."""
    d = F.split(F.reverse(text) if double_from_right else text, "")
    worth = F.transform(
        F.filter(d, lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2) - F.when(c.cast("int") * (1 + i % 2) > 9, 9).otherwise(0)
    )
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def luhn_valid(text: Column) -> Column:
    """Whether the digits are a payment card's: 13 to 19 with Luhn's check."""
    d = digits(text)
    return F.length(d).between(13, 19) & (_digit_sum(d, True) % 10 == 0)


def national_id_valid(text: Column) -> Column:
    """Whether eight or nine digits, padded to nine, have the check digit of a national id."""
    d = digits(text)
    return F.length(d).between(8, 9) & (_digit_sum(F.lpad(d, 9, "0"), False) % 10 == 0)


def phone_shape(text: Column) -> Column:
    """Whether the digits are a phone's: ten of a mobile or virtual range, or nine with an area, also behind the country's code."""
    local = F.regexp_replace(digits(text), "^9720*", "0")
    return local.rlike("^(0[57][0-9]{8}|0[234689][0-9]{7})$")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def words_per_minute(words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, words / seconds * 60).otherwise(F.lit(0.0))


def question_count(text: Column, openers: Sequence[str]) -> Column:
    """Sentences that end in a question mark or whose first word is an opener, as it is written.

    A sentence ends at a full stop, question mark or exclamation mark with white space behind it.
    """
    parts = F.transform(F.split(text, r"(?U)(?<=[.?!])\s+"), lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
    first = lambda s: F.split_part(F.regexp_replace(s, r"(?U)^\W+", ""), F.lit(" "), F.lit(1))
    asks = F.filter(parts, lambda s: (s != "") & (s.endswith("?") | first(s).isin(*openers)))
    return F.coalesce(F.size(asks), F.lit(0))


#: What a word is made of.
WORD_SIGN = r"[\p{L}\p{N}\p{M}_]"


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How often the phrases occur in the lower-cased text, as wholes of words: of letters, numbers, marks and low lines."""
    found = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(f"(?<!{WORD_SIGN})(?:{found})(?!{WORD_SIGN})")), F.lit(0))


def keyed_pseudonym(value: Column, key: bytes, length: int = 12) -> Column:
    """The first hex digits of HMAC-SHA256, from two built-in hashes around the padded key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in block)) for p in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, length)


def file_id(value: Column) -> Column:
    """Whether an id is of letters, digits, dots, dashes and underscores, 64 at most, the first a letter or digit."""
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")


def safe_id(value: Column) -> Column:
    """Whether an id is of letters, digits, dots, dashes and underscores and no number of seven digits or more."""
    return file_id(value) & ~F.regexp_replace(value, r"[ ._/-]", "").rlike(r"[0-9]{7,}")


def account_parts(ref: Column) -> tuple[Column, Column]:
    """Branch and account of a reference, split at the first of slash, dash and space that it has."""
    ref = F.trim(ref)
    mark = F.when(ref.contains("/"), "/").when(ref.contains("-"), "-").when(ref.contains(" "), " ")
    at = F.locate("/", ref)
    at = F.when(mark == "/", at).when(mark == "-", F.locate("-", ref)).when(mark == " ", F.locate(" ", ref)).otherwise(F.lit(0))
    branch = F.when(at > 0, F.substr(ref, F.lit(1), at - 1)).otherwise(F.lit(""))
    return F.trim(branch), F.trim(F.substr(ref, at + 1))


def op_code(value: Column) -> Column:
    """A code without leading zeros, 0 if nothing is left."""
    bare = F.regexp_replace(F.trim(value), "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def fixed_number(value: Column, places: int = 2) -> Column:
    """Exactly so many decimals, rounded half up, thousands apart, with a true minus sign; a dash for no number."""
    v = F.round(value.cast(f"decimal(38,{places + 6})"), places)
    shown = F.format_number(F.abs(v), places)
    return F.when(v.isNull(), "—").when(v < 0, F.concat(F.lit("−"), shown)).otherwise(shown)


def shown_number(value: Column, digits: int = 1) -> Column:
    """At most so many decimals: 74.0 is 74, 74.25 is 74.3, -0.04 is 0."""
    shown = fixed_number(value, digits)
    short = F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    return F.when(short.isin("−0", "-0"), "0").otherwise(short)


def fenced_json(answer: Column) -> Column:
    """The JSON object in a model's answer, with or without fences around it."""
    inside = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    found = F.when(inside != "", inside).when(bare != "", bare)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def content_hash(parts: Column) -> Column:
    """SHA-256 of the sorted strings of an array, a line each."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)
