"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. Each document becomes its set of word shingles. SuperMinHash draws, for each element, one
   value per level and a random order of the positions to fill, so that an element competes for
   every position with values spread evenly; a row is done as soon as all positions are filled.
   Equal sets are one class, told by a 128-bit digest of the set; copies cost nothing further.
2. Signatures are cut into bands. Classes with an equal band share a bucket, and are connected
   through the bucket's least class: candidate groups, without listing pairs.
3. Each candidate group is verified in one task on full sets. A group too large for that
   is dealt by its buckets, and a bucket too large by pairs of blocks, so that every pair with an
   equal band still meets somewhere. A task walks from linked class to linked class and counts
   common shingles through an index of its group; it puts out one link per class.
4. Links are joined to components.

With 32 bands of 4, a pair at a similarity of 0.85 shares no band with probability 6e-11, at
0.8 with 5e-8. Every link is confirmed on the full sets.

Defined results. A null or empty text has an empty set and is linked with nothing. A text with fewer
words than a shingle is one shingle. Rows with one id are one document, linked with whatever one of
their texts is linked with. Rows without id come after all ids, rows of equal text being one
document; a component of such rows alone has no id. Ties need no rule: links do not depend on an
order, and the least id names the component. An empty table gives an empty result. Ids may be any long.
Columns besides id and text are not looked at; ``keep`` returns the rows with their own columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm import tokens
from tallyquill.llm.components import components
from tallyquill.session import discard, written

BANDS = 32
ROWS = 4
#: Verified in one task at most: shingles and classes.
GROUP_SHINGLES = 1 << 20
GROUP_CLASSES = 4096
#: Elements whose orders of positions are kept in memory together.
ELEMENTS = 1 << 16
#: A document: rows without id, told by the hash of their text, come after all ids.
DOCUMENT = ("anon", "id", "h")


def shingles(words: tokens.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of every row, sorted by row and hash."""
    row, _, hashed = tokens.windows(words, size)
    parts = [(row, hashed)]
    counts = np.diff(words.first)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        whole = tokens.window_hashes(words.hash, short)[words.first[rows]] if len(rows) else np.empty(0, np.uint64)
        parts.append((rows, tokens.mix(whole ^ np.uint64(short))))
    row, hashed = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[fresh], hashed[fresh]


def signatures(row: np.ndarray, hashed: np.ndarray, rows: int, size: int) -> np.ndarray:
    """SuperMinHash signatures, one line per row. Elements of a row stand together."""
    empty = np.uint64((1 << 64) - 1)
    found = np.full((rows, size), empty, dtype=np.uint64)
    for begin in range(0, len(row), ELEMENTS):
        own, element = row[begin : begin + ELEMENTS], hashed[begin : begin + ELEMENTS]
        low, high = int(own[0]), int(own[-1]) + 1
        part = np.full((high - low, size), empty, dtype=np.uint64)
        _fill(part, own - low, element, size)
        # A row that goes on in the next stretch: the least value of both, position by position.
        np.minimum(found[low:high], part, out=found[low:high])
    return found


def _fill(part: np.ndarray, row: np.ndarray, element: np.ndarray, size: int) -> None:
    flat = part.reshape(-1)
    empty = part[0, 0]
    order = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(row), size)).copy()
    line = np.arange(len(row))
    for level in range(size):
        with np.errstate(over="ignore"):
            drawn = tokens.mix(element + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        swap = level + (((drawn >> np.uint64(32)) * np.uint64(size - level)) >> np.uint64(32)).astype(np.int64)
        position = order[line, swap].astype(np.int64)
        order[line, swap] = order[line, level]
        value = (np.uint64(level) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, row * size + position, value)
        # Rows whose positions are all filled cannot change at later levels.
        open_rows = (part == empty).any(axis=1)
        going = open_rows[row]
        if not going.any():
            return
        if going.mean() < 0.7:
            row, element, order = row[going], element[going], order[going]
            line = np.arange(len(row))


def _described(text: str, size: int, bands: int, rows_each: int, least: int):
    """Per document: number of shingles, digest of the set, band hashes of sets that can have
    a near copy at all."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tokens.pieces(batches, text):
            words = tokens.words_of(piece.column(text), tokens.SPACE, lower=True)
            row, hashed = shingles(words, size)
            first = np.searchsorted(row, np.arange(piece.num_rows + 1))
            counts = np.diff(first)
            digests = []
            for salt in (1, 2):
                with np.errstate(over="ignore"):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(hashed ^ np.uint64(salt)))])
                    digests.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
            usable = counts >= least
            keys = [None] * piece.num_rows
            chosen = usable[row]
            if chosen.any():
                number = np.cumsum(usable) - 1
                lines = signatures(number[row[chosen]], hashed[chosen], int(usable.sum()), bands * rows_each)
                with np.errstate(over="ignore"):
                    shaped = lines.reshape(len(lines), bands, rows_each)
                    key = np.arange(1, bands + 1, dtype=np.uint64) * np.ones((len(lines), 1), dtype=np.uint64)
                    for k in range(rows_each):
                        key = tokens.mix(key + shaped[:, :, k])
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(usable)]).astype(np.int32) * bands),
                    pa.array(key.view(np.int64).reshape(-1)),
                )
            else:
                listed = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in DOCUMENT), pa.array(counts), *map(pa.array, digests), listed],
                [*DOCUMENT, "n", "d1", "d2", "bands"],
            )

    return describe


def _linked(n: np.ndarray, element: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (member, first of its component) among sets given as (n per set, elements
    one set after the other)."""
    sets = len(n)
    first = np.concatenate([[0], np.cumsum(n)])
    if sets == 2:
        both = len(np.intersect1d(element[: n[0]], element[n[0] :], assume_unique=True))
        return [(1, 0)] if 100 * both >= percent * (n[0] + n[1] - both) else []
    _, token = np.unique(element, return_inverse=True)
    owner = np.repeat(np.arange(sets), n)
    fresh = np.ones(sets, dtype=bool)
    links = []

    def index() -> tuple[np.ndarray, np.ndarray]:
        """Sets not yet seen, by token."""
        use = np.flatnonzero(fresh[owner])
        use = use[np.argsort(token[use], kind="stable")]
        return np.searchsorted(token[use], np.arange(token.max() + 2)), owner[use]

    begins, listed = index()
    indexed = sets
    for seed in range(sets):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            own = token[first[x] : first[x + 1]]
            low, size = begins[own], begins[own + 1] - begins[own]
            total = int(size.sum())
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
            both = np.bincount(listed[at], minlength=sets)
            near = np.flatnonzero(fresh & (both > 0) & (100 * both >= percent * (n + n[x] - both)))
            fresh[near] = False
            queue.extend(near.tolist())
            links.extend((y, seed) for y in near.tolist())
        left = int(fresh.sum())
        if not left:
            break
        if left < indexed // 2:
            begins, listed = index()
            indexed = left
    return links


def _verifier(size: int, percent: int):
    """Links of whole groups; rows come sorted by group and class, a class perhaps several times, and a group
    may go on in the next batch."""

    def settle(ids: list, counts: list, elements: list) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        return [(ids[a], ids[b]) for a, b in _linked(np.array(counts), np.concatenate(elements), percent)]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, counts, elements = None, [], [], []
        for piece in tokens.pieces(batches, "text"):
            words = tokens.words_of(piece.column("text"), tokens.SPACE, lower=True)
            row, hashed = shingles(words, size)
            first = np.searchsorted(row, np.arange(piece.num_rows + 1)).tolist()
            links = []
            for i, (key, id) in enumerate(zip(piece.column("key").to_pylist(), piece.column("class").to_pylist(), strict=True)):
                if key != group:
                    links += settle(ids, counts, elements)
                    group, ids, counts, elements = key, [], [], []
                elif ids[-1] == id:
                    continue
                ids.append(id)
                counts.append(first[i + 1] - first[i])
                elements.append(hashed[first[i] : first[i + 1]].copy())
            yield _pairs(links)
        yield _pairs(settle(ids, counts, elements))

    return verify


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
    )


def _buckets(classes: DataFrame, *more: str) -> DataFrame:
    return classes.select("class", *more, F.explode("bands").alias("bucket"))


def _groups(classes: DataFrame) -> DataFrame:
    """(class, key): in which groups a class is verified."""
    buckets = _buckets(classes)
    shared = buckets.groupBy("bucket").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = buckets.join(shared.select("bucket", "least"), "bucket").where("class <> least")
    stars, stars_path = components(edges.select(F.col("class").alias("a"), F.col("least").alias("b")))
    sized = _members(stars).join(classes.select("class", "n"), "class")
    totals = sized.groupBy("group").agg(
        ((F.sum("n") > GROUP_SHINGLES) | (F.count(F.lit(1)) > GROUP_CLASSES)).alias("large")
    )
    marked, _ = written(sized.join(totals, "group").select("class", "n", "group", "large"), "groups")
    discard(classes.sparkSession, stars_path)
    small = marked.where("not large").select("class", F.struct(F.col("group").alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("key"))
    wide = _buckets(marked.where("large").select("class").distinct().join(classes, "class"), "n")
    blocks = wide.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.ceil(F.greatest(F.sum("n") * 2 / GROUP_SHINGLES, F.count(F.lit(1)) * 2 / GROUP_CLASSES)).alias("blocks"),
    )
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        wide.join(blocks.where("members > 1"), "bucket")
        .select("class", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
        .select(
            "class",
            F.struct(
                F.col("bucket").alias("k"), F.least("own", "other").alias("i"), (F.greatest("own", "other") + 1).alias("j")
            ).alias("key"),
        )
    )
    return small.unionAll(dealt)


def _members(stars: DataFrame) -> DataFrame:
    """(class, group) of links to the least class of a component, that class included."""
    own = stars.select(F.col("b").alias("class"), F.col("b").alias("group")).distinct()
    return stars.select(F.col("a").alias("class"), F.col("b").alias("group")).unionAll(own)


def _documents(id: str, text: str) -> list[Column]:
    """The columns ``DOCUMENT``, none of them null."""
    key = F.col(id).cast("long")
    return [key.isNull().alias("anon"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(F.col(text)).alias("h")]


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that name one class in one group, the first of a task."""
    seen = set()
    for batch in batches:
        keys = zip(batch.column("class").to_pylist(), map(str, batch.column("key").to_pylist()), strict=True)
        fresh = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                fresh.append(i)
        yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


def _grouped(docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: its document, n, and ``first``, the first document of its component."""
    narrow = docs.select(*_documents(id, text), F.col(text).alias("text"))
    # A set below this size has no near copy but equal sets.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    found = narrow.mapInArrow(
        _described("text", size, BANDS, ROWS, least),
        "anon boolean, id long, h long, n long, d1 long, d2 long, bands array<long>",
    )
    # Empty sets are equal in nothing: each document without words is a class of its own.
    own = lambda digest, key: F.when(F.col("n") > 0, F.col(digest)).otherwise(key).alias(digest)
    described, _ = written(
        found.select(
            *DOCUMENT,
            "n",
            own("d1", F.when(F.col("anon"), F.col("h")).otherwise(F.col("id"))),
            own("d2", F.col("anon").cast("long")),
            "bands",
        ),
        "sets",
    )
    alike = ["d1", "d2", "n"]
    # Numbers of classes stand in the written table, so that every reader finds the same.
    classes, _ = written(
        described.groupBy(*alike)
        .agg(F.min(F.struct(*DOCUMENT)).alias("rep"), F.any_value("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    usable = classes.where(F.col("bands").isNotNull())
    keys = _groups(usable.select("class", "n", "bands")).join(usable.select("class", "rep.*"), "class")
    texts = narrow.join(keys, list(DOCUMENT)).select("key", "class", "text")
    kind = texts.schema["key"].dataType.simpleString()
    links = (
        texts.mapInArrow(_once, f"key {kind}, class long, text string")
        .repartition("key")
        .sortWithinPartitions("key", "class")
        .mapInArrow(_verifier(size, percent), "a long, b long")
    )
    stars, _ = components(links.unionAll(_shared_ids(described, classes)))
    members = _members(stars)
    reps = classes.select("class", *alike, "rep")
    firsts = members.join(reps.select("class", "rep"), "class").groupBy("group").agg(F.min("rep").alias("first"))
    placed = reps.join(members.join(firsts, "group").select("class", "first"), "class", "left")
    return described.select(*DOCUMENT, *alike).join(
        placed.select(*alike, F.coalesce("first", "rep").alias("first")), alike
    )


def _is_first() -> Column:
    """Whether a row is its component's first document."""
    same = (F.col("id") == F.col("first.id")) & (~F.col("first.anon") | (F.col("h") == F.col("first.h")))
    return (F.col("anon") == F.col("first.anon")) & same


def group(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept. ``percent`` is the
    least similarity of a link in hundredths."""
    named = lambda anon, key: F.when(~F.col(anon), F.col(key))
    return _grouped(docs, id, text, size, percent).select(
        named("anon", "id").alias(id),
        F.col("n").alias("n_shingles"),
        named("first.anon", "first.id").alias("component_id"),
        _is_first().alias("kept"),
    )


def _shared_ids(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of ids that stand in several classes: each of these with the first of them."""
    rows = described.where("not anon").select("id", "d1", "d2", "n").distinct()
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("id")
    placed = rows.join(repeated, "id").join(classes.select("d1", "d2", "n", "class"), ["d1", "d2", "n"])
    first = placed.groupBy("id").agg(F.min("class").alias("b"))
    return placed.join(first, "id").select(F.col("class").alias("a"), "b")


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: the row with the least id, and of
    several such rows the one whose text, then whole row, has the least hash."""
    kept = (
        _grouped(docs, id, text, size, percent)
        .where(_is_first())
        .groupBy(*(F.col(c).alias(f"kept_{c}") for c in ("anon", "id")), "first")
        .agg(F.min("h").alias("kept_h"))
        .drop("first")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), *_documents(id, text))
    same = [F.col(c) == F.col(f"kept_{c}") for c in DOCUMENT]
    first = Window.partitionBy(*DOCUMENT).orderBy(F.xxhash64("row"))
    placed = rows.join(kept, same, "left_semi").withColumn("place", F.row_number().over(first))
    return placed.where("place = 1").select("row.*")
