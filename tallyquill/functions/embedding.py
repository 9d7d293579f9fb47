"""The built-in embedder: a hashed bag of words. It measures shared words, not meaning."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyquill.functions import text as tx

# Name and shape of the built-in embedder.
HASH64 = "hash64"
BUCKETS = 64
DIGITS = 6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bucket(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % BUCKETS


def _unit(counts: Column) -> Column:
    """Counts divided by their Euclidean length, rounded."""
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c))
    return bind(norm, lambda n: F.transform(counts, lambda c: F.rint(c / n * 10**DIGITS) / 10**DIGITS))


def _dense(buckets: Column) -> Column:
    """Only buckets that occur are counted and divided; the others are filled in last."""
    every = F.sequence(F.lit(0), F.lit(BUCKETS - 1))

    def filled(used: Column) -> Column:
        counts = F.transform(used, lambda b: F.size(buckets) - F.size(F.array_remove(buckets, b)))
        values = F.map_from_arrays(used, bind(counts, _unit))
        return bind(values, lambda v: F.transform(every, lambda b: F.coalesce(F.try_element_at(v, b), F.lit(0.0))))

    return bind(F.array_distinct(buckets), filled)


def hash64(text: Column) -> Column:
    """Unit vector of token counts per hash bucket; NULL for a text without tokens."""

    def vector(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, bind(F.transform(tokens, _bucket), _dense))

    return bind(tx.tokens(text), vector)


def hash64_model(texts: Sequence[str]) -> list[list[float] | Exception]:
    """The built-in embedder as a model that is called with a batch of texts, as one outside Spark would
    be. A text without tokens is refused."""
    answers: list[list[float] | Exception] = []
    for text in texts:
        words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
        counts = Counter(int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % BUCKETS for word in words)
        length = sum(count * count for count in counts.values()) ** 0.5
        vector = [round(counts[bucket] / length * 10**DIGITS) / 10**DIGITS for bucket in range(BUCKETS)] if words else None
        answers.append(vector or ValueError("no words"))
    return answers


def scaled(vector: Column, digits: int = DIGITS) -> Column:
    """Vector as comma-separated whole numbers, for comparing and showing."""
    ints = F.transform(vector, lambda x: F.round(x.cast("double") * 10**digits).cast("bigint").cast("string"))
    return F.array_join(ints, ",")
