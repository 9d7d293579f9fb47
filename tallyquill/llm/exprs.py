"""Column expressions that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between words: white space, or everything ASCII but digits and letters.
SPACE = r"[\x20\x09-\x0D]"
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column, between: str = SPACE) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def digest_bits(key: Column, digits: int, start: int = 1) -> Column:
    """Some hexadecimal digits of a key's MD5 as a number; a null key counts as "null"."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")
