"""Fill-in-the-middle: texts cut into prefix, middle and suffix, with the middle moved to the end.

Cuts are made in words or code points, slices in UTF-8 bytes. Between the two stands a sparse index:
only characters of more than one byte are recorded, by position and excess bytes. A cut
is converted by one binary search in that index plus an addition, so that ASCII text, where the index
holds nothing, costs no more than the addition. All texts of a piece share one index.

A text that holds a sentinel stays plain, so an output can always be read back: no part can hold
a sentinel, nor can one arise where a part and a sentinel meet, as it begins with its only ``<``.

Defined results. A null text counts as an empty one, which is plain. A null id is drawn for as the word
"null". Rows with one id have one draw, taken on their own texts. Words are runs of other
characters with the white space before them; white space at the end is a word of its own. Equal rows give
equal results, an empty table an empty one. Columns besides id and text are not looked at. Texts
are cut whole, at any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.llm import tokens

SEED = 42
#: Of a hundred texts so many stay plain, and of a hundred others so many put the suffix first.
PLAIN = 50
SUFFIX_FIRST = 80
#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("words", "chars")


class Exceptions:
    """Characters of more than one byte: their byte positions, and the excess bytes up to each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before a byte position where a character begins or the data ends."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """The byte position of a code point, counted from the start of the data."""
        return char + self.excess[np.searchsorted(self.at - self.excess[:-1], char)]


def _cuts(texts: pa.Array, low: np.ndarray, high: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(n, where the text, the middle and the suffix begin and the text ends in bytes of the piece, characters of prefix and
    middle). ``low`` and ``high`` are drawn numbers, reduced here by n + 1."""
    words = tokens.words_of(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]
    index = Exceptions(words.data)
    if unit == "words":
        count = np.diff(words.first)
        last = np.where(count > 0, words.ends[words.first[1:] - 1] if len(words.ends) else 0, begin)
        n = count + (last < end)
    else:
        n = index.chars(end) - index.chars(begin)
    a, b = low % (n + 1), high % (n + 1)
    edges = []
    for cut in (np.minimum(a, b), np.maximum(a, b)):
        if unit == "words":
            at = np.where(cut > 0, words.ends[np.clip(words.first[:-1] + cut - 1, 0, len(words.ends) - 1)], begin) if len(words.ends) else begin
            edges.append(np.where((cut == n) & (n > 0), end, at))
        else:
            edges.append(index.bytes(index.chars(begin) + cut))
    chars = [index.chars(x) for x in (begin, *edges)]
    return n, begin, *edges, end, chars[1] - chars[0], chars[2] - chars[1], words.data


_OUT = "id {}, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


def _transformer(unit: str, plain: int, suffix_first: int) -> Callable:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tokens.pieces(batches, "text"):
            texts = pc.fill_null(piece.column("text").cast(pa.large_string()), "")
            drawn = [piece.column(h).to_numpy() for h in ("h1", "h2", "h3", "h4")]
            n, begin, first, second, end, prefix, middle, data = _cuts(texts, drawn[0], drawn[1], unit)
            held = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE))).to_numpy(zero_copy_only=False)
            stays = held | (begin == end) | (drawn[2] % 100 >= plain)
            turned = drawn[3] % 100 < suffix_first
            raw = data.tobytes()
            outputs = []
            for keep, swap, a, b, c, d in zip(*(x.tolist() for x in (stays, turned, begin, first, second, end)), strict=True):
                parts = (raw[a:b], raw[c:d], raw[b:c])
                if keep:
                    outputs.append(raw[a:d])
                elif swap:
                    outputs.append(marks[1] + parts[1] + marks[0] + parts[0] + marks[2] + parts[2])
                else:
                    outputs.append(marks[0] + parts[0] + marks[1] + parts[1] + marks[2] + parts[2])
            number = lambda x: pa.array(x.astype(np.int64), mask=stays)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array(n.astype(np.int64)),
                    pa.array(np.where(stays, "plain", np.where(turned, "spm", "psm")).tolist(), pa.string()),
                    number(prefix),
                    number(middle),
                    number(first - begin),
                    number(second - first),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"],
            )

    return transform


def transform(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    unit: str = "words",
    seed: int = SEED,
    plain: int = PLAIN,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per row of ``docs``: id, n (units of the text), form (plain, psm or spm), lengths of prefix and middle
    in code points and bytes (null if plain), output."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    kind = docs.schema[id].dataType.simpleString()
    named = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), named), 256)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), hashed.alias("hashed"))
    draws = [F.conv(F.substring("hashed", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    cut = rows.select("id", "text", *draws).mapInArrow(_transformer(unit, plain, suffix_first), _OUT.format(kind))
    return cut.withColumnRenamed("id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {name: F.concat(*[F.get(part, F.lit(i)) for i in places]) for name, places in order.items()}
    return F.when(form == "plain", output).when(form == "psm", joined["psm"]).otherwise(joined["spm"])


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it."""
    return transform(docs, id, text, **options).select(
        id,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
