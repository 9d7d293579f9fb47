import random

import numpy as np
import pytest

from tallyquill.operators import neardup, store


@pytest.fixture(scope="module")
def rows():
    """Near copies in crowds, exact copies, chunks without words, and some without a collection."""
    pick = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    bases = [[pick.choice(words) for _ in range(30)] for _ in range(5)]
    out = []
    for i in range(220):
        text = list(pick.choice(bases))
        for _ in range(pick.randrange(6)):
            text[pick.randrange(30)] = pick.choice(words)
        out.append((i, pick.choice(("a", "b", None)), " ".join(text)))
    out += [(300 + i, "a", out[7][2]) for i in range(20)] + [(400, "a", "?!"), (401, "a", "?!"), (402, "b", "?!"), (403, None, "?")]
    pick.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "n int, collection string, text string").repartition(3)


def by_hand(spark, rows, distance, stored=()):
    embedded = {r.n: (r.collection, r.text, r.embedding) for r in store.embed(frame(spark, [*rows, *stored])).collect()}
    known = {r[0] for r in stored}

    def near(a, b):
        if a[0] != b[0]:
            return False
        if a[2] is None or b[2] is None:
            return a[2] is None and b[2] is None and a[1] == b[1]
        return round(float(((np.array(a[2]) - b[2]) ** 2).sum()), 12) <= distance

    return sorted(
        n for n, a in embedded.items()
        if n not in known and not any((m in known or m < n) and m != n and near(a, b) for m, b in embedded.items())
    )


@pytest.mark.parametrize("distance, tile", [(0.0, 4096), (0.05, 4096), (0.2, 7), (1.0, 50)])
def test_equal_to_all_pairs(spark, rows, distance, tile, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", tile)
    kept = neardup.dedup_near(frame(spark, rows), ["n"], distance)
    assert kept.columns == ["n", "collection", "text"]
    assert sorted(r.n for r in kept.collect()) == by_hand(spark, rows, distance)


def test_against_stored_chunks(spark, rows):
    new, old = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    kept = neardup.dedup_near(frame(spark, new), ["n"], 0.1, store.embed(frame(spark, old)))
    assert sorted(r.n for r in kept.collect()) == by_hand(spark, new, 0.1, old)


def test_nothing(spark, rows):
    none = frame(spark, rows).where("false")
    assert neardup.dedup_near(none, ["n"], 0.1).count() == 0
    assert neardup.dedup_near(none, ["n"], 0.1, store.embed(frame(spark, rows))).count() == 0
    silent = spark.createDataFrame([(1, "a", "?"), (2, "a", "?"), (3, "a", "!")], "n int, collection string, text string")
    assert sorted(r.n for r in neardup.dedup_near(silent, ["n"], 0.1).collect()) == [1, 3]
