"""Text expressions that follow Python's Unicode rules rather than Java's defaults."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the chunking strategies, Unicode-aware.
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
SECTION_HEADING = r"(?U)(Chapter \d+|Section \d+)"
WHITESPACE = r"(?U)\s+"
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
NON_WORD = r"[^\p{L}\p{N}]+"

# Named HTML entities with their semicolon, from the standard table.
HTML_ENTITIES = {name: text for name, text in html5.items() if name.endswith(";")}
# The names that are looked up first.
COMMON_ENTITIES = (
    "amp lt gt quot apos nbsp copy reg middot mdash ndash hellip laquo raquo lsquo rsquo ldquo rdquo euro"
).split()
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"
# What a number names that is no character, and the characters of Windows-1252
# that pages write by their byte.
NO_CHARACTER = "\ufffd"
WINDOWS_1252 = {0x80 + i: c for i, c in enumerate("€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ")}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_WHITESPACE, "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def words(text: Column) -> Column:
    """Whitespace-separated words without empties."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda t: t != "")


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_BREAK)


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by whitespace; blank pieces are dropped."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.length(strip(s)) > 0)


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments, doctype or tags."""
    text = html
    for hidden in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        text = F.regexp_replace(text, hidden, "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    return unescaped(text)


def _character(code: Column) -> Column:
    """The character of a code point."""
    known = F.create_map(*[x for k, v in WINDOWS_1252.items() for x in (F.lit(k), F.lit(v))])
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(known, code), F.when(valid, plain), F.lit(NO_CHARACTER))


def _table(entries: dict[str, str]) -> Column:
    """A constant map; one literal, which Spark turns into the map while planning."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def unescaped(text: Column) -> Column:
    """Entities with a semicolon to their characters, once: numbers of both bases and all
    standard names. What is no entity stays as it is."""
    common = _table({name: HTML_ENTITIES[name + ";"] for name in COMMON_ENTITIES})
    named = _table(HTML_ENTITIES)

    def decoded(entity: Column) -> Column:
        """Of the text between ``&`` and ``;``."""
        number = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, 3, 6), 16, 10)).otherwise(
            F.substring(entity, 2, 7)
        )
        other = F.coalesce(
            F.try_element_at(named, F.concat(entity, F.lit(";"))), F.concat(F.lit("&"), entity, F.lit(";"))
        )
        coded = F.when(entity.startswith("#"), _character(number.cast("int"))).otherwise(other)
        return F.coalesce(F.try_element_at(common, entity), coded)

    between = F.split(text, ENTITY)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), decoded)
    pairs = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pairs, "")).otherwise(text)


def image_sources(html: Column) -> Column:
    """Targets of all ``<img>`` tags, in page order."""
    return F.regexp_extract_all(html, F.lit(r'<img[^>]*src="([^"]*)"'), F.lit(1))


def snippet(text: Column, chars: int) -> Column:
    return F.concat(F.substring(text, 1, chars), F.lit("..."))


def table_cells(html: Column) -> Column:
    """All ``<table>`` elements of a page as arrays of rows of cell texts."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = F.transform(tables, lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
    cell = F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>")
    return F.transform(
        rows,
        lambda table: F.transform(
            table, lambda row: F.transform(F.regexp_extract_all(row, cell, F.lit(1)), html_text)
        ),
    )
