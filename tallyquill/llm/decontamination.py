"""Benchmark decontamination: scan windows of training words against a set of test n-grams.

Benchmark texts are normalised (A-Z lowered, everything ASCII but digits and letters parts words)
and cut into windows of ten words; shorter items are one window. The set of windows is sent
to all tasks; a document's windows are hashed in bulk, looked up, and each hit is verified
word for word. A broadcast holds a bounded number of windows: a larger benchmark is cut into
blocks by the windows' hash, and the documents pass the blocks one after the other inside the same
tasks. Documents are never shuffled.

Defined results. A null or empty text has no words, on either side. A null item id counts as the
item "null"; items with equal id are one item. Texts of any length are read whole. Repeated
rows get equal results; an empty table on either side hits nothing. Columns besides id and text
are not looked at; ``drop`` and ``cut`` return the columns of ``docs`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm import tokens
from tallyquill.llm.exprs import MARKS, lower_ascii, split_words
from tallyquill.session import written

WINDOW = 10
#: Windows in one broadcast: about 100 bytes each.
BLOCK = 200_000
#: Blocks that a task holds at once; findings are written between groups of so many.
AT_ONCE = 4


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark: words (joined by spaces), n, items (sorted ids)."""
    words = split_words(lower_ascii(F.col(text)), MARKS)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return (
        items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("w"))
        .groupBy(F.array_join("w", " ").alias("words"), F.size("w").alias("n"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Block:
    """Some windows of the benchmark as a hash set, by window length. Its parts are plain lists and arrays: what
    is broadcast is read by workers that have no copy of this package."""

    def __init__(self, words: list[str], items: list[list[str]], by_size: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.words, self.items, self.by_size = words, items, by_size

    @property
    def parts(self) -> tuple:
        return self.words, self.items, self.by_size

    @classmethod
    def of(cls, rows: list) -> Block:
        block = cls([row["words"] for row in rows], [row["items"] for row in rows], {})
        sizes = np.array([row["n"] for row in rows], dtype=np.int64)
        for size in sorted(set(sizes.tolist())):
            chosen = np.flatnonzero(sizes == size)
            split = tokens.words_of(pa.array([block.words[i] for i in chosen], pa.large_string()), tokens.MARKS)
            hashed = tokens.window_hashes(split.hash, size)[split.first[:-1]]
            order = np.argsort(hashed, kind="stable")
            block.by_size[size] = hashed[order], chosen[order]
        return block

    def hits(self, words: tokens.Words) -> Iterator[tuple[int, int, int, list[str]]]:
        """Row, first word, window length and items of every verified hit."""
        for size, (hashed, numbers) in self.by_size.items():
            row, at, found = tokens.windows(words, size)
            bits = max(16, int(len(hashed)).bit_length() + 6)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[hashed >> np.uint64(64 - bits)] = True
            maybe = np.flatnonzero(seen[found >> np.uint64(64 - bits)])
            low = np.searchsorted(hashed, found[maybe], side="left")
            high = np.searchsorted(hashed, found[maybe], side="right")
            for m, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                text = words.joined(int(at[m]), int(at[m]) + size)
                for k in range(a, b):
                    if self.words[numbers[k]] == text:
                        yield int(row[m]), int(at[m]), size, self.items[numbers[k]]


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scanner(block, text: str, found: str):
    """A task's work on one block: adds the hits to those of earlier blocks."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Block(*block.value)
        for piece in tokens.pieces(batches, text):
            words = tokens.words_of(piece.column(text), tokens.MARKS, lower=True)
            earlier = piece.column(found).to_pylist() if found in piece.schema.names else [None] * piece.num_rows
            hits: dict[int, list] = {}
            for row, at, size, items in windows.hits(words):
                hits.setdefault(row, []).append((at, size, items))
            counts = np.diff(words.first)
            rows = []
            for i, before in enumerate(earlier):
                before = before or {"starts": [], "ends": [], "items": []}
                own = hits.get(i)
                if own:
                    begin = np.array([at for at, _, _ in own], dtype=np.int64) - words.first[i]
                    end = begin + np.array([size for _, size, _ in own], dtype=np.int64)
                    starts, ends = tokens.merged(
                        np.concatenate([begin, np.array(before["starts"], dtype=np.int64)]),
                        np.concatenate([end, np.array(before["ends"], dtype=np.int64)]),
                    )
                    items = sorted({*before["items"], *(x for _, _, listed in own for x in listed)})
                    before = {"starts": starts.tolist(), "ends": ends.tolist(), "items": items}
                rows.append({"n_words": int(counts[i]), **{k: before[k] for k in ("starts", "ends", "items")}})
            kind = pa.struct(
                [
                    ("n_words", pa.int64()),
                    ("starts", pa.list_(pa.int64())),
                    ("ends", pa.list_(pa.int64())),
                    ("items", pa.list_(pa.string())),
                ]
            )
            names = [name for name in piece.schema.names if name != found]
            columns = [piece.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*names, found])

    return scan


def _scanned(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, size: int, most: int) -> tuple[DataFrame, str]:
    """``docs`` under neutral names c0, c1, ... and a last column with the findings."""
    windows = item_windows(items, item_id, item_text, size)
    blocks = max(1, -(-windows.count() // most))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    schema = T.StructType([*rows.schema.fields, T.StructField("found", _FOUND)])
    context = docs.sparkSession.sparkContext
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()
        rows = rows.mapInArrow(_scanner(context.broadcast(Block.of(own).parts), names[text], "found"), schema)
        if (k + 1) % AT_ONCE == 0 and k + 1 < blocks:
            rows, _ = written(rows, "scanned")
    return rows, names


def scan(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (words from, until) that were hit, items."""
    rows, names = _scanned(docs.select(id, text), items, text, item_id, item_text, size, most)
    return rows.select(F.col(names[id]).alias(id), "found.n_words", _spans().alias("spans"), "found.items")


def _spans() -> Column:
    return F.transform(
        F.arrays_zip("found.starts", "found.ends"),
        lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end")),
    )


def drop(
    docs: DataFrame, items: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns."""
    rows, names = _scanned(docs, items, text, item_id, item_text, size, most)
    clean = rows.where(F.size("found.items") == 0)
    return clean.select([F.col(n).alias(c) for c, n in names.items()])


def cut(
    docs: DataFrame, items: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` with hit words taken out of the text: from the first character of
    a hit stretch to the last, all marks between included. Texts without a hit stay as they are."""
    rows, names = _scanned(docs, items, text, item_id, item_text, size, most)
    column = names[text]

    def cutter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tokens.pieces(batches, column):
            words = tokens.words_of(piece.column(column), tokens.MARKS)
            texts = piece.column(column).to_pylist()
            base = 0
            for i, found in enumerate(piece.column("found").to_pylist()):
                raw = (texts[i] or "").encode()
                if found["starts"]:
                    first, kept, at = int(words.first[i]), [], 0
                    for a, b in zip(found["starts"], found["ends"], strict=True):
                        kept.append(raw[at : words.starts[first + a] - base])
                        at = words.ends[first + b - 1] - base
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
                base += len(raw)
            place = piece.schema.names.index(column)
            yield piece.set_column(place, piece.schema.field(place), pa.array(texts, piece.schema.field(place).type))

    done = rows.mapInArrow(cutter, rows.schema)
    return done.select([F.col(n).alias(c) for c, n in names.items()])
