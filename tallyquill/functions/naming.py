"""Names, identifiers and fingerprints derived from paths and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a collection name may hold, and its longest length.
UNSAFE_IN_NAME = "[^a-zA-Z0-9_-]"
NAME_LENGTH = 63


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?s)(.)\.[^.]*$", "$1")


def first_dot_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def suffix(path: Column) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s).\.([^.]*)$", 1))


def safe_name(name: Column, strip_edges: bool = True) -> Column:
    """A name the vector store accepts: unsafe characters to ``_``, cut to length. One
    character replaces one, so the cut comes first and long names cost no more."""
    cut = F.regexp_replace(F.substring(name, 1, NAME_LENGTH), UNSAFE_IN_NAME, "_")
    return F.regexp_replace(cut, "^_+|_+$", "") if strip_edges else cut


def positional_id(prefix: Column, index: Column, infix: str = "_chunk_") -> Column:
    return F.concat(prefix, F.lit(infix), index.cast("string"))


def content_id(text: Column) -> Column:
    return F.md5(text)


def seconds_text(mtime: Column) -> Column:
    """Seconds since the epoch with their fraction, as Python prints a float."""
    micros = F.unix_micros(mtime.cast("timestamp"))
    whole = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    fraction = F.lpad((micros - whole * 1_000_000).cast("string"), 6, "0")
    return F.concat(whole.cast("string"), F.lit("."), F.regexp_replace(fraction, "(?<=.)0+$", ""))


def fingerprint(content: Column, mtime: Column, mode: str) -> Column:
    """Change mark of a file: its time, its bytes, or both."""
    if mode == "mtime":
        return seconds_text(mtime)
    if mode == "content":
        return F.md5(content)
    if mode == "both":
        return F.md5(F.concat(content, F.encode(seconds_text(mtime), "UTF-8")))
    raise ValueError(f"unknown fingerprint mode: {mode}")
