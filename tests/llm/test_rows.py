"""Rows without id, rows of one id, equal rows and the largest ids, against plain Python."""

import hashlib
import math
import pickle
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from conftest import SF_DIR

from tallyquill.llm import decontamination, near_dedup, quality_classifier, substring_dedup

LARGEST = (1 << 63) - 1
LAST = 1 << 63


def words_of(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def texts(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [pick.choice(vocabulary) for _ in range(20)]
    base = [pick.choice(vocabulary) for _ in range(50)]
    out = []
    for i in range(n):
        own = [pick.choice(vocabulary) for _ in range(pick.randrange(3, 40))]
        if i % 4 == 0:
            own += passage
        if i % 5 == 0:
            own = list(base)
            own[pick.randrange(50)] = f"v{i}"
        out.append(" ".join(own))
    return out


def cases(name, n=160):
    listed = texts(3, n)
    pick = random.Random(4)
    if name == "null":
        return [(None, t) for t in listed]
    if name == "half null":
        return [(i, t) for i, t in enumerate(listed)] + [(None, t) for t in listed]
    if name == "one id":
        return [(7, t) for t in listed] + [(9, listed[3]), (8, listed[4])]
    if name == "few ids":
        return [(pick.randrange(5), t) for t in listed]
    if name == "equal rows":
        return [(5, listed[0])] * n + [(6, listed[0]), (6, "other words"), (None, listed[0]), (None, listed[0])] + [(None, listed[4])] * n
    edges = (LARGEST, LARGEST - 1, 1 << 62, -LAST, -1, 0, None)
    return [(edges[i % len(edges)], t) for i, t in enumerate(listed)] + [(LARGEST, None), (None, None), (None, ""), (-1, "")]


NAMES = ("null", "half null", "one id", "few ids", "equal rows", "edges")


def removed_by_hand(rows, size=13):
    place = lambda id: LAST if id is None else id
    first = {}
    for id, text in rows:
        words = words_of(text)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            first[window] = min(first.get(window, LAST), place(id))
    out = []
    for id, text in rows:
        words, gone = words_of(text), set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < place(id):
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_substring_dedup(spark, name, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 200)
    frame = spark.createDataFrame(cases(name), "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substring_dedup.digests(frame).collect()), key=repr) == removed_by_hand(cases(name))


def near_by_hand(rows, size=3, percent=85):
    nodes = [("id", id) if id is not None else ("text", text) for id, text in rows]
    sets = []
    for _, text in rows:
        words = words_of(text, lower=True)
        n = len(words)
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(n - size + 1)) if n >= size else frozenset([tuple(words)] if n else []))
    parent = {node: node for node in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for node, one in zip(nodes, sets, strict=True):
        holders.setdefault(one, []).append(node)
    for one, of in holders.items():
        for node in of if one else []:
            parent[root(node)] = root(of[0])
    for a, b in combinations([s for s in holders if s], 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            parent[root(holders[a][0])] = root(holders[b][0])
    least = {}
    for node in parent:
        if node[0] == "id":
            least[root(node)] = min(least.get(root(node), LARGEST), node[1])
    return [(id, len(own), least.get(root(node))) for (id, _), node, own in zip(rows, nodes, sets, strict=True)], [root(n) for n in nodes]


@pytest.mark.parametrize("name, limit", [*((name, 1 << 20) for name in NAMES), ("few ids", 300)])
def test_near_dedup(spark, name, limit, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", limit)
    rows = cases(name)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.group(frame).collect()
    want, roots = near_by_hand(rows)
    assert sorted((tuple(r)[:3] for r in found), key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["component_id"] is not None)
    # One row is kept of each component, that of its least id.
    kept = near_dedup.keep(frame, size=3, percent=85).collect()
    assert len(kept) == len(set(roots))
    components = dict(zip(rows, roots, strict=True))
    assert len({components[tuple(r)] for r in kept}) == len(kept)
    least = {tuple(row): w[2] for row, w in zip(rows, want, strict=True)}
    assert all(r["doc_id"] == least[tuple(r)] for r in kept)


# --- the classifier, with its hashes written anew ---------------------------------------------

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def grams_by_hand(text):
    base = 0x9E3779B97F4A7C15
    hashed = []
    for word in words_of(text):
        data = word.encode()
        hashed.append(mixed((sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(data)) + len(data)) & MASK))
    pairs = [mixed((a * base + b * pow(base, 2, 1 << 64)) & MASK) for a, b in zip(hashed, hashed[1:])]
    return [h >> 46 for h in hashed] + [(p >> 52) + (1 << 18) for p in pairs]


def gumbel_by_hand(id, seed=1):
    drawn = mixed(mixed(((id or 0) + seed) & MASK) ^ seed)
    if id is None:
        drawn = mixed((drawn + 1) & MASK)
    return -math.log(-math.log(((drawn >> 11) + 0.5) / (1 << 53)))


def chosen_by_hand(rows, labels, prior=20.0):
    votes = {}
    for id, quality in labels:
        if id is not None and quality is not None:
            votes.setdefault(id, []).append(quality == 1)
    target = {id for id, v in votes.items() if all(v)}
    raw, good = Counter(), Counter()
    for id, text in rows:
        raw.update(grams_by_hand(text))
        if id is not None and id in target:
            good.update(grams_by_hand(text))
    scale = sum(good.values()) / sum(raw.values())
    weigh = lambda g: math.log(good[g] + prior) - math.log(raw[g] * scale + prior)
    weights = [sum(map(weigh, grams_by_hand(text))) for _, text in rows]
    scores = [w + gumbel_by_hand(id) for w, (id, _) in zip(weights, rows, strict=True)]
    k = max(1, round(sum(map(all, votes.values())) / len(votes) * len(rows)))
    last = sorted(scores, reverse=True)[k - 1]
    return [(id, len(grams_by_hand(t)), w, s >= last) for (id, t), w, s in zip(rows, weights, scores, strict=True)]


def test_classifier(spark):
    rows = [(i - 2, f"good words here {i} and there" if i % 3 else f"bad ### stuff {i} é") for i in range(60)]
    rows += [(None, "bad ### stuff without an id"), (None, None), (61, ""), (3, "other text of an id")]
    labels = [(i - 2, int(i % 3 > 0)) for i in range(30)] + [(-1, 1), (4, 0), (None, 1), (5, None), (900, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality_classifier.choose(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = chosen_by_hand(rows, labels)
    key = lambda r: (repr(r[0]), r[1], round(r[2], 6), r[3])
    assert sorted(map(key, ((r["doc_id"], r["n_grams"], r["log_weight"], r["kept"]) for r in found))) == sorted(map(key, want))


def test_a_document_without_id_is_not_the_document_of_id_minus_one(spark):
    rows = [(-1, "good words of a document"), (None, "other stuff that has no id"), (2, "bad stuff")]
    labels = spark.createDataFrame([(-1, 1), (2, 0)], "doc_id long, quality int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    weights = {r["doc_id"]: r["log_weight"] for r in quality_classifier.choose(frame, labels).collect()}
    alone = {r["doc_id"]: r["log_weight"] for r in quality_classifier.choose(frame.where("doc_id is not null"), labels).collect()}
    assert weights[-1] > 0 > weights[None]
    assert alone[-1] > 0


def test_blocks_of_windows_are_plain_data():
    """Broadcasts are read by workers without a copy of the package."""
    rows = [{"words": "a b c", "items": ["x"], "n": 3}, {"words": "d", "items": ["y", "z"], "n": 1}]
    assert b"tallyquill" not in pickle.dumps(decontamination.Block.of(rows).parts)


def test_many_blocks_find_what_one_finds(spark):
    docs, items = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "benchmark"))
    windows = decontamination.item_windows(items).count()

    def found(most):
        rows = decontamination.scan(docs, items, most=most).collect()
        return sorted((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in rows)

    whole = found(windows)
    assert len(whole) == docs.count() and any(row[2] for row in whole)
    assert found(windows // (2 * decontamination.AT_ONCE)) == whole
