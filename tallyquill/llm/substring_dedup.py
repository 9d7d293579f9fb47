"""Removal of passages that an earlier document already holds, with repeated-phrase automata.

A window is 13 words in a row. A word goes if a window over it also starts in a
document with a smaller id.

1. Candidates. The least hash among a window's 6-word phrases depends on the window alone, so
   equal windows agree in it. Only these few hashes per document are shuffled; those of one
   document alone are out.
2. Stretches. Windows in a row with the same shared hash form a stretch of text. Stretches go to
   the shard of that hash, once for all of their copies in a batch.
3. Automata. Each shard confirms, word by word, which windows stand in more than one
   document, compiles them into an Aho-Corasick automaton of word numbers, and streams its
   stretches through it: every occurrence is found, with the first document that has it.
4. Occurrences go back to their documents, whose covered words are taken out.

A hash of very many stretches or windows would make a large shard: its windows are then dealt one by one,
by a hash of all their words, so that each of these shards holds the copies of one window. No
document meets an automaton that can hold nothing of it, and no automaton holds more than a shard.

Defined results. A null or empty text has no words. Texts below 13 words have no window and lose
nothing. A null id comes after all others, which may be any long. Rows with one id, or without one, do not remove
words from each other, and each row is cut by its own text. Equal rows get equal results, an empty table an empty
one. Columns besides id and text are not looked at. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.llm import tokens
from tallyquill.session import discard, written

SIZE = 13
PHRASE = 6
#: Stretches and windows of one hash beyond which its windows are dealt one by one.
HOT = 10_000
HOT_WINDOWS = 100_000
#: Words of stretches in one automaton.
SHARD_WORDS = 200_000
#: A text of a document. Rows without id have id 0 and ``anon``.
TEXT = ("id", "anon", "h")
#: In Python, where numbers have no end: after all ids.
LAST = 1 << 63


def least_hashes(words: tokens.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and least phrase hash of every window."""
    phrases = tokens.window_hashes(words.hash, PHRASE)
    reach, least = 1, phrases
    while reach < size - PHRASE + 1:
        step = min(reach, size - PHRASE + 1 - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    row = words.row
    if len(row) < size:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    return row[at], at, least[at]


def _runs(row: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a stretch of windows with the same row and hash begins."""
    if not len(row):
        return np.empty(0, dtype=np.int64)
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(fresh)


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, m, windows) of each stretch; of equal texts of one id, the first of a task."""
    for piece in tokens.pieces(_once(batches), "text"):
        row, at, least = least_hashes(tokens.words_of(piece.column("text")))
        runs = _runs(row, at, least)
        windows = np.diff(np.append(runs, len(row)))
        own = pa.array(row[runs])
        yield pa.RecordBatch.from_arrays(
            [*(piece.column(c).take(own) for c in TEXT), pa.array(least[runs].view(np.int64)), pa.array(windows)],
            [*TEXT, "m", "windows"],
        )


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal texts of one id, the first of a task."""
    seen = set()
    for batch in batches:
        fresh = []
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in TEXT), strict=True)):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


_STRETCH = "id long, anon boolean, h long, start long, key long, seg long, lo long, hi long, text string"


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch; the text, with the least and largest id that has it (null: no id), only once
    per key and text in a piece."""
    for piece in tokens.pieces(batches, "text"):
        words = tokens.words_of(piece.column("text"))
        row, at, least = least_hashes(words)
        shared = []
        for name in ("cold", "hot"):
            listed = piece.column(name)
            owner = pc.list_parent_indices(listed).to_numpy(zero_copy_only=False)
            value = pc.list_flatten(listed).to_numpy(zero_copy_only=False).view(np.uint64)
            # Row and hash together, as one number; what it lets through too much is harmless.
            shared.append(np.isin(_tag(row, least), _tag(owner, value)))
        cold, hot = (np.flatnonzero(x) for x in shared)
        runs = _runs(row[cold], at[cold], least[cold])
        last = np.concatenate([runs[1:], [len(cold)]]).astype(np.int64) - 1
        begin = np.concatenate([at[cold][runs], at[hot]])
        end = np.concatenate([at[cold][last] if len(runs) else runs, at[hot]]) + SIZE
        row = np.concatenate([row[cold][runs], row[hot]])
        with np.errstate(over="ignore"):
            whole = tokens.window_hashes(words.hash, SIZE)
            key = np.concatenate([least[cold][runs], whole[at[hot]]])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(words.hash) * _rising(len(words.hash)))])
            seg = tokens.mix((sums[end] - sums[begin]) * _falling(len(words.hash) + 1)[begin] + (end - begin).astype(np.uint64))
        if not len(row):
            continue
        ids, anon, h = (piece.column(c).to_numpy(zero_copy_only=False)[row] for c in TEXT)
        order = np.lexsort((ids, anon, seg, key))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1])
        heads = np.flatnonzero(fresh)
        tails = np.concatenate([heads[1:], [len(order)]]) - 1
        ends, text = [np.zeros(len(row), np.int64) for _ in range(2)], [None] * len(row)
        unnamed = [np.ones(len(row), bool) for _ in range(2)]
        chosen = order[heads]
        for value, none, edge in zip(ends, unnamed, (order[heads], order[tails]), strict=True):
            value[chosen], none[chosen] = ids[edge], anon[edge]
        for i in chosen.tolist():
            text[i] = words.joined(int(begin[i]), int(end[i]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                pa.array(anon),
                pa.array(h),
                pa.array(begin - words.first[row]),
                pa.array(key.view(np.int64)),
                pa.array(seg.view(np.int64)),
                *(pa.array(value, mask=none) for value, none in zip(ends, unnamed, strict=True)),
                pa.array(text, pa.string()),
            ],
            [*TEXT, "start", "key", "seg", "lo", "hi", "text"],
        )


def _tag(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return tokens.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_RISE = 0xD1342543DE82EF95  # any odd number


def _rising(n: int) -> np.ndarray:
    return tokens._powers(_RISE, n)


def _falling(n: int) -> np.ndarray:
    return tokens._powers(pow(_RISE, -1, 1 << 64), n)


def _located(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by key -> runs of words (begin, end) under windows that a document
    before the stretch's last one has. Automata hold whole keys, as many as fit. A stretch
    that is alone under its key is a passage by itself: no other text holds its windows."""
    held: list[tuple] = []
    alone: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal size
        if len(group) == 1:
            alone.extend(group)
        else:
            held.extend(group)
            size += sum(line[4].count(" ") + 1 for line in group)
        group.clear()

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("key", "seg", "lo", "hi", "text")]
        for edge in columns[2:4]:
            edge[:] = [LAST if id is None else id for id in edge]
        for line in zip(*columns, strict=True):
            if group and line[0] != group[0][0]:
                close()
                if size >= SHARD_WORDS or len(alone) >= SHARD_WORDS:
                    yield from (_occurrences(held), _passages(alone))
                    held, alone, size = [], [], 0
            group.append(line)
    close()
    yield from (_occurrences(held), _passages(alone))


_FOUND = pa.schema(
    [("key", pa.int64()), ("seg", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
     ("firsts", pa.list_(pa.int64()))]
)


def _passages(stretches: list[tuple]) -> pa.RecordBatch:
    """Whole stretches that more than one document holds."""
    rows = [(key, seg, [0], [text.count(" ") + 1], [lo]) for key, seg, lo, hi, text in stretches if lo < hi]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(_FOUND)], schema=_FOUND
    )


def _occurrences(stretches: list[tuple]) -> pa.RecordBatch:
    numbers: dict[str, int] = {}
    lines = [tuple([numbers.setdefault(w, len(numbers)) for w in s[4].split(" ")]) for s in stretches]
    first: dict[tuple, int] = {}
    last: dict[tuple, int] = {}
    for line, (_, _, lo, hi, _) in zip(lines, stretches, strict=True):
        for i in range(len(line) - SIZE + 1):
            window = line[i : i + SIZE]
            if lo < first.get(window, LAST + 1):
                first[window] = lo
            if hi > last.get(window, -LAST - 1):
                last[window] = hi
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, lo in first.items():
        if lo < last[window]:
            automaton.add_word(window, lo)
    out: dict[str, list] = {"key": [], "seg": [], "begins": [], "ends": [], "firsts": []}
    if len(automaton):
        automaton.make_automaton()
        for line, (key, seg, _, hi, _) in zip(lines, stretches, strict=True):
            begins, ends, firsts = [], [], []
            for last, lo in automaton.iter(line):
                if lo >= hi:
                    continue
                if ends and ends[-1] == last and firsts[-1] == lo:
                    ends[-1] = last + 1  # the next window of the same document
                else:
                    begins.append(last + 1 - SIZE)
                    ends.append(last + 1)
                    firsts.append(lo)
            if begins:
                for name, value in zip(out, (key, seg, begins, ends, firsts), strict=True):
                    out[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FOUND], schema=_FOUND)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and digest of texts as they are."""
    for batch in batches:
        texts = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
        digests = [hashlib.sha256(b" ".join(words)).hexdigest() for words in texts]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in TEXT), pa.array([len(w) for w in texts], pa.int64()), pa.array(digests, pa.string())],
            [*TEXT, "n_words", "sha256"],
        )


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept text of documents with covered words."""
    for batch in batches:
        removed, texts = [], []
        columns = [batch.column(c).to_pylist() for c in ("text", "begins", "ends")]
        for text, begins, ends in zip(*columns, strict=True):
            words = text.encode().split()
            kept, at, gone = [], 0, 0
            starts, stops = tokens.merged(np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64))
            for begin, end in zip(starts.tolist(), stops.tolist(), strict=True):
                kept += words[at:begin]
                at, gone = end, gone + end - begin
            removed.append(gone)
            texts.append(b" ".join(kept + words[at:]).decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in TEXT), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            [*TEXT, "n_removed", "kept"],
        )


_TEXT = "id long, anon boolean, h long"


def _key(id: Column, text: Column) -> list[Column]:
    """The columns ``TEXT``, none of them null."""
    key = id.cast("long")
    return [F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("anon"), F.xxhash64(text).alias("h")]


def _named(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(*_key(F.col(id), F.col(text)), F.col(text).alias("text"))


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, anon, h, n_removed, kept) of every text that loses words: ``kept`` is its other words,
    joined by one space; ``h`` is the text's hash, ``anon`` says that it has no id."""
    rows = _named(docs, id, text)
    hashes, hashes_path = written(rows.mapInArrow(_hashes, f"{_TEXT}, m long, windows long"), "hashes")
    named = F.when(~F.col("anon"), F.col("id"))
    later = (F.min(named) < F.max(named)) | (F.min(named).isNotNull() & F.max("anon"))
    hot = (F.count(F.lit(1)) > HOT) | (F.sum("windows") > HOT_WINDOWS)
    shared, shared_path = written(
        hashes.groupBy("m").agg(hot.alias("is_hot"), later.alias("later")).where("later").select("m", "is_hot"), "shared"
    )
    lists = (
        hashes.select(*TEXT, "m")
        .join(shared, "m")
        .groupBy(*TEXT)
        .agg(
            F.collect_set(F.when(~F.col("is_hot"), F.col("m"))).alias("cold"),
            F.collect_set(F.when(F.col("is_hot"), F.col("m"))).alias("hot"),
        )
    )
    kept = rows.join(lists, list(TEXT))
    candidates, _ = written(kept.select(*TEXT, "text", "cold", "hot").mapInArrow(_once, f"{_TEXT}, text string, cold array<long>, hot array<long>"), "candidates")
    discard(docs.sparkSession, shared_path)
    discard(docs.sparkSession, hashes_path)
    stretches, stretches_path = written(candidates.mapInArrow(_stretches, _STRETCH), "stretches")
    last = F.when(F.count("hi") == F.count(F.lit(1)), F.max("hi"))  # null, so without id, is the last
    found, found_path = written(
        stretches.where(F.col("text").isNotNull())
        .repartition("key")
        .groupBy("key", "seg", "text")
        .agg(F.min("lo").alias("lo"), last.alias("hi"))
        .sortWithinPartitions("key")
        .select("key", "seg", "lo", "hi", "text")
        .mapInArrow(_located, "key long, seg long, begins array<int>, ends array<int>, firsts array<long>"),
        "found",
    )
    earlier = F.filter(F.arrays_zip("begins", "ends", "firsts"), lambda x: F.col("anon") | (x["firsts"] < F.col("id")))
    moved = lambda side: F.transform("runs", lambda x: F.col("start") + x[side]).alias(side)
    runs, _ = written(
        stretches.select(*TEXT, "start", "key", "seg")
        .join(found, ["key", "seg"])
        .select(*TEXT, "start", earlier.alias("runs"))
        .where(F.size("runs") > 0)
        .select(*TEXT, moved("begins"), moved("ends"))
        .groupBy(*TEXT)
        .agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")]),
        "runs",
    )
    discard(docs.sparkSession, stretches_path)
    discard(docs.sparkSession, found_path)
    covered = candidates.select(*TEXT, "text").dropDuplicates(list(TEXT)).join(runs, list(TEXT))
    return covered.mapInArrow(_cut, f"{_TEXT}, n_removed long, kept string")


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of the text; texts that lose nothing stay as
    they are. Own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cut = repeats(docs, id, text).select(*TEXT, "kept")
    column = lambda c: F.col(f"row.`{c}`")
    rows = docs.select(whole.alias("row")).select("row", *_key(column(id), column(text))).join(cut, list(TEXT), "left")
    return rows.select(*((F.coalesce("kept", column(c)) if c == text else column(c)).alias(c) for c in docs.columns))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256."""
    whole = _named(docs, id, text).mapInArrow(_whole, f"{_TEXT}, n_words long, sha256 string")
    cut = repeats(docs, id, text).select(*TEXT, "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return whole.join(cut, list(TEXT), "left").select(
        F.when(~F.col("anon"), F.col("id")).alias(id),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
