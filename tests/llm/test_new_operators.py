"""Centroid clustering, exact top-k search and fill-in-the-middle against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tallyquill.llm import centroid_clusters, fill_middle, maxscore

CLASHING = ("id", "v", "query", "cluster", "n", "of", "place", "part", "form", "h1", "text2")
MORE = ", ".join(f"{c} string" for c in CLASHING)
FILL = ("x",) * len(CLASHING)
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([row + FILL for row in rows], f"vec_id long, embedding array<float>, {MORE}")


def whole(rows, scale, width=None):
    kept = []
    for id, e in rows:
        if e is None or (width and len(e) != width) or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((id, [math.floor(scale * float(np.float32(x))) for x in e]))
    return kept


def clusters_by_hand(rows, k, rounds, width, scale=256):
    points = whole(rows, scale, width)
    key = lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1])
    centres = [p[1] for p in sorted(points, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        home = [min(range(len(centres)), key=lambda c: (apart(p, centres[c]), c)) for _, p in points]
        for c in range(len(centres)):
            own = [p for (_, p), h in zip(points, home, strict=True) if h == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    placed = [(id, *min((apart(p, centre), c) for c, centre in enumerate(centres))) for id, p in points]
    total = sum(d for _, d, _ in placed)
    by = lambda c: sum(d for _, d, own in placed if own == c)
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((i, c, d, by(c), total, digest(c)) for i, d, c in placed), key=repr)


def vectors(seed, n, width):
    pick = random.Random(seed)
    rows = [(i, [round(pick.gauss(i % 3, 1), 1) for _ in range(width)]) for i in range(n)]
    rows += [(3, rows[3][1])] * 4 + [(3, rows[5][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(n + i, rows[0][1]) for i in range(12)]  # copies, so ties
    rows += [(900, None), (901, []), (902, [NAN] * width), (903, [INF] * width), (904, [None] * width), (905, [1.0])]
    rows += [(906, [-7.5] + [0.0] * (width - 1)), (907, [3e30] + [0.0] * (width - 1))]
    return rows


@pytest.mark.parametrize("k, rounds, width", [(7, 3, 4), (40, 5, 8), (500, 2, 3), (1, 1, 2)])
def test_clusters(spark, k, rounds, width):
    rows = vectors(k, 120, width)
    found = centroid_clusters.digests(frame(spark, rows), k=k, rounds=rounds, width=width)
    usable = [row for row in rows if row[0] != 907]  # too large for exact distances
    assert sorted((tuple(r) for r in found.collect()), key=repr) == clusters_by_hand(usable, k, rounds, width)


def test_clusters_of_nothing(spark):
    assert centroid_clusters.digests(frame(spark, [])).count() == 0
    assert centroid_clusters.digests(frame(spark, [(1, [1.0])])).count() == 0


def test_walk_stops_early_and_stays_exact():
    pick = np.random.default_rng(1)
    centres = pick.integers(-1000, 1000, (60, 2))
    points = pick.integers(-1000, 1000, (500, 2))
    found, distance, computed = centroid_clusters.Lists(centres).nearest(points)
    apart = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (found == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert computed < 0.5 * 500 * 60


def top_by_hand(rows, k, scale=1024):
    points = [p for p in whole(rows, scale) if p[0] != 907]
    out = []
    for n, (id, q) in enumerate(points):
        if id is None or id % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, v, strict=False)), other is None, other or 0, other)
            for m, (other, v) in enumerate(points)
            if m != n
        ]
        out += [(id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, width, k, shard", [(1, 6, 10, 1 << 20), (2, 3, 4, 60), (3, 12, 400, 200), (4, 1, 2, 30)])
def test_top_k(spark, monkeypatch, seed, width, k, shard):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "GROUP", 2 * width)  # several groups of queries
    rows = vectors(seed, 160, width)
    rows += [(100, rows[100][1]), (200, [0.0] * width), (300, [-1.0] * (width + 2)), (100, [0.5] * width)]
    rows += [(600, []), (-100, [1.0] * width)]
    table = frame(spark, rows)
    asked = table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = maxscore.search(asked, table, k=k, own=True).collect()
    assert sorted((tuple(r) for r in found), key=repr) == top_by_hand(rows, k)


def test_top_k_of_other_tables_and_of_nothing(spark):
    stored = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 9.0])])
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 1.0])], "query_id long, embedding array<double>")
    found = maxscore.search(asked, stored, k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(1, 1, 1 << 20), (1, 2, 1 << 20), (1, None, 1 << 20)]
    assert maxscore.search(asked.where("false"), stored).count() == 0
    assert maxscore.search(asked, stored.where("false")).count() == 0


def test_essential_terms_leave_most_vectors_out():
    """Most scores are never computed once the bound is known."""
    pick = np.random.default_rng(5)
    points = np.where(pick.random((5000, 40)) < 0.1, pick.integers(1, 50, (5000, 40)), 0)
    shard = maxscore.Shard(np.arange(5000), np.ones(5000, bool), points)
    query = np.zeros(40, dtype=np.int64)
    query[:4] = (90, 40, 5, 1)
    best = maxscore.Best(10)
    shard.search(query, best)
    again = maxscore.Best(10)
    again.add(shard, np.arange(5000), points @ query)
    assert best.id.tolist() == again.id.tolist() and best.score.tolist() == again.score.tolist()
    shard.postings.clear()
    shard.search(query, best)
    assert set(shard.postings) < {(0, True), (1, True), (2, True), (3, True)}


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = ("word", " ", "\n\t", "é", "字字", "😀", "a😀b", "  ", "<", "S>", " ", "x" * 50, "\x1c")


def cut_by_hand(id, text, unit):
    text = text or ""
    parts = TOKEN.findall(text) if unit == "words" else list(text)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'null' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (id, n, "plain", None, None, None, None, text)
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (id, n, form, len(p), len(m), len(p.encode()), len(m.encode()), output)


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(7)
    rows = [(i, "".join(pick.choices(PIECES, k=pick.randrange(40)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, " \n"), (None, "null id é"), (None, None), (703, "a <P> b"), (704, "a<S>"), (705, "<M>")]
    rows += [(5, "again words"), (5, "again words"), (706, "é " * 200_000), (707, "word " * 300_000), (708, "😀" * 90_000)]
    return rows


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_fill_middle(spark, texts, unit):
    docs = spark.createDataFrame([row + FILL for row in texts], f"doc_id long, text string, {MORE}")
    rows = [tuple(r) for r in fill_middle.transform(docs, unit=unit).collect()]
    assert sorted(rows, key=repr) == sorted((cut_by_hand(*row, unit) for row in texts), key=repr)
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    back = fill_middle.digests(docs, unit=unit).collect()
    assert sorted((r["doc_id"], r["restored_sha256"]) for r in back if r["doc_id"]) == sorted((i, digest(t)) for i, t in texts if i)
    assert fill_middle.transform(docs.where("false")).count() == 0


def test_exception_index():
    text = "aé字😀b" * 50 + "plain" * 20
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    index = fill_middle.Exceptions(data)
    places = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert index.bytes(np.arange(len(text) + 1)).tolist() == places
    assert index.chars(np.array(places)).tolist() == list(range(len(text) + 1))
    assert len(index.at) == 150 and len(fill_middle.Exceptions(np.frombuffer(b"ascii", dtype=np.uint8)).at) == 0
