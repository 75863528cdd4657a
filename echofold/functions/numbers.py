"""Numbers and file names in the form that reports use."""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from pyspark import SparkContext

_FLOAT = re.compile(r"\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))")
_INTEGER = re.compile(r"\s*([+-]?[0-9]+)")


def two_places(value: float) -> str:
    """The exact binary value rounded to two places, halves up."""
    return str(Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP))


def plain(value: float) -> str:
    """The shortest decimal that reads back as value, whole numbers without a point."""
    return str(int(value)) if value == int(value) else repr(value)


def leading_float(text: str) -> float | None:
    """The number that a text begins with."""
    found = _FLOAT.match(text)
    return float(found[1].replace("Infinity", "inf")) if found else None


def leading_integer(text: str) -> int | None:
    found = _INTEGER.match(text)
    return int(found[1]) if found else None


#: Punctuation in collation order, before digits and letters.
_PUNCTUATION = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


#: Letters that sort as others do, though they have no decomposition.
_LETTERS = {"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ƀ": "b", "ɨ": "i", "ĳ": "ij"}


def collation_key(name: str) -> tuple:
    """Orders names as the engine's UNICODE collation does, by its own keys wherever a Spark context runs."""
    context = SparkContext._active_spark_context
    if context is None:
        return (1, *_approximate_key(name))
    util = context._jvm.org.apache.spark.sql.catalyst.util.CollationFactory
    text = context._jvm.org.apache.spark.unsafe.types.UTF8String.fromString(name)
    return 0, bytes(util.getCollationKeyBytes(text, util.collationNameToId("UNICODE"))), name.encode("utf-8", "surrogatepass")


def _approximate_key(name: str) -> tuple:
    """The same without Spark, for plain names: punctuation, digits, letters; accents and case only break ties."""
    base, accents, cases = [], [], []
    for letter in unicodedata.normalize("NFD", name):
        if plain := _LETTERS.get(letter.lower()):
            for ch in plain:
                base.append((3, 0, ch))
                cases.append((len(base), letter != letter.lower()))
            accents.append((len(base), ord(letter.lower())))
            continue
        ch = letter
        if unicodedata.combining(ch):
            accents.append((len(base), ord(ch)))
        elif ch.isspace():
            base.append((0, 0, ch))
        elif ch in _PUNCTUATION:
            base.append((1, _PUNCTUATION.index(ch), ""))
        elif ch.isdigit():
            base.append((2, 0, ch))
        else:
            base.append((3, 0, ch.casefold()))
            cases.append((len(base), ch != ch.lower()))
    return base, accents, cases, name
