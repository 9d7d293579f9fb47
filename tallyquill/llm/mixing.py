"""Mixing sources to target weights by systematic sampling.

A source's target divided by its size is the number of copies expected of each of its documents.
Expected copies are summed over the source's documents in a fixed order; with one random offset
added, a document is emitted once for each whole number that its stretch of the sum crosses.
Documents stand in order of size class, then of a digest of their id, so that the copies are
spread evenly over short and long documents and the words taken come near the target.

The sum before a document is its rank times the expected copies. Ranks come from counts of
blocks (source, size class, leading digits of the digest): no more than one block is
sorted in one task, so a source with most of the rows is spread over many.

Defined results. A null source is a source of its own, the last in order. A null or empty text
has size 0 and takes no words. A table without words has targets of 0. Rows with equal source, id
and size stand next to each other in the order, by a digest of the whole row in ``mix``, and each has
copies of its own. Whole texts are measured. Columns besides id, text and
source are not looked at by ``plan``; ``mix`` returns the rows with their own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm.exprs import digest_bits, split_words
from tallyquill.session import written

#: Weights of sources in their order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words; most copies of a source.
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
BLOCK_DIGITS = 3
#: Parts in which rows of equal source, id and size are numbered.
PARTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also target, rate (expected copies of a document) and offset.

    ``sizes`` has one row per source and is small: windows below order all of its rows. Sources
    whose share would exceed ``most`` times their size stop there; sorted by size over
    weight, they are the first ones, and one pass over running sums finds how many.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    named = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight"))
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level (target per weight) if all sources before this one stop at their limit.
    summed = named.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("stopped"),
        F.sum("weight").over(after).alias("open_weight"),
    ).select("*", ((share * F.col("total") - most * F.col("stopped")) / F.col("open_weight")).alias("level"))
    is_open = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min_by(F.when(is_open, F.col("level")), F.when(is_open, F.col("stopped"))).over(everything)
    limit = most * F.col("source_size")
    return summed.select("source", "source_size", "weight", limit.alias("limit"), level.alias("level")).select(
        "source",
        "source_size",
        F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def _size_class(size: Column) -> Column:
    """Grows with the size, by one for each eighth of a power of two."""
    bits = F.bin(size)
    return F.length(bits) * 8 + F.conv(F.rpad(F.substring(bits, 2, 3), 3, "0"), 2, 10).cast("int")


def _offset(seed: str, source: Column) -> Column:
    """The random offset of a source, from 0 to below 1."""
    return digest_bits(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("null"))), 12) / float(16**12)


def _before(count: str, keys: list[str], order: str) -> Column:
    """The sum of a count over the rows of the same keys that come earlier."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))


def _sized(docs: DataFrame, id: str, text: str, source: str, *more: Column) -> DataFrame:
    size = F.size(split_words(F.col(text))).cast("long")
    return docs.select(F.col(source).alias("source"), F.col(id).alias("id"), size.alias("size"), *more)


def _groups(counted: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """source, id, size, rows -> also source_size, target, rate, offset and the rank of the first of the rows."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    rows = counted.select("*", _size_class(F.col("size")).alias("class"), digest.alias("digest")).withColumn(
        "block", F.substring("digest", 1, BLOCK_DIGITS)
    )
    blocks = rows.groupBy("source", "class", "block").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("words")
    )
    # A source has few size classes, and a class 4,096 blocks at most: each is summed on its own.
    classes = blocks.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    shares = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    opened = (
        classes.select("source", "class", _before("n", ["source"], "class").alias("first"))
        .alias("c")
        .join(shares.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        .select("c.*", "source_size", "target")
    )
    same = F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b.class") == F.col("o.class"))
    placed = blocks.withColumn("inside", _before("n", ["source", "class"], "block"))
    listed = placed.alias("b").join(opened.alias("o"), same).select(
        F.col("b.source").alias("of_source"), F.col("b.class").alias("of_class"), F.col("b.block").alias("of_block"),
        (F.col("first") + F.col("inside")).alias("before"), "source_size", "target",
    )
    earlier = (
        Window.partitionBy("source", "class", "block")
        .orderBy("digest", F.col("id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.join(
            listed,
            F.col("source").eqNullSafe(F.col("of_source"))
            & (F.col("class") == F.col("of_class"))
            & (F.col("block") == F.col("of_block")),
        )
        .withColumn("rank", F.col("before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .select("*", rate.alias("rate"), _offset(seed, F.col("source")).alias("offset"))
    )


def _copies() -> Column:
    """Whole numbers that the stretch of a rank crosses."""
    crossed = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    return (crossed(F.col("rank") + 1) - crossed(F.col("rank"))).cast("long")


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    Sizes are written once, so that words are not counted again for the ranks.
    """
    counted = _sized(docs, id, text, source).groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("rows"))
    counted, _ = written(counted, "sizes")
    return (
        _groups(counted, weights, share, most, seed)
        .withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("rows") - 1)))
        .withColumn("copies", _copies())
        .select(
            F.col("id").alias(id),
            F.col("source").alias(source),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan says, with its own columns.

    Rows of equal source, id and size are numbered, and each takes the copies of its own rank. The
    numbers are counted inside parts of them, so that many rows with a null id are no single task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Rows with maps cannot be hashed by these; they are told apart by their other columns.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    digest = F.xxhash64(*hashed)
    rows = _sized(docs, id, text, source, whole.alias("row"), digest.alias("digest")).select(
        F.struct("source", "id", "size").alias("of"), F.pmod("digest", F.lit(PARTS)).alias("part"), "digest", "row"
    )
    parts = rows.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n"))
    counted = parts.groupBy("of").agg(F.sum("n").alias("rows")).select("of.*", "rows")
    first = _groups(counted, weights, share, most, seed).select(
        F.struct("source", "id", "size").alias("of"), "rank", "rate", "offset"
    )
    placed = (
        parts.withColumn("inside", _before("n", ["of"], "part"))
        .join(first, "of")
        .select(
            F.col("of").alias("of_rows"), F.col("part").alias("of_part"),
            (F.col("rank") + F.col("inside")).alias("first"), "rate", "offset",
        )
    )
    number = F.row_number().over(Window.partitionBy("of", "part").orderBy("digest")) - 1
    ranked = (
        rows.withColumn("number", number)
        .join(placed, (F.col("of") == F.col("of_rows")) & (F.col("part") == F.col("of_part")))
        .select("row", (F.col("first") + F.col("number")).alias("rank"), "rate", "offset")
        .select("row", _copies().cast("int").alias("copies"))
    )
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return ranked.where(F.col("copies") > 0).select("row", times.alias("time")).select("row.*")
