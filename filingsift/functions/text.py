"""Column expressions on text, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class: white space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"\s\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x2000, 45, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The same characters one by one.
SPACES = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TOKEN = "[a-z0-9]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced(text: Column) -> Column:
    """Every white space character as a plain space: patterns on the result need no class of them, which is several times
    faster than one with it."""
    return F.translate(text, SPACES, " " * len(SPACES))


def squeezed(text: Column) -> Column:
    """White-space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(spaced(text), " +", " "))


def words(text: Column) -> Column:
    """The maximal runs of characters that are not white space; null for null, empty for blank texts."""
    return F.filter(F.split(spaced(text), " +"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(words(text)))


def tokens(text: Column) -> Column:
    """ASCII letter and digit runs of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white texts."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))
