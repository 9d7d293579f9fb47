"""Operators against plain Python on texts with hot keys, and their unusual ways."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR

from tallyquill.llm import components, html_text, near_dedup, quality_classifier, substring_dedup, tokens


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def crowd():
    """A base text with many one-word variants, chains of variants, passages that
    most texts share, and texts of one repeated word."""
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choice(vocabulary) for _ in range(40)]
    passage = [random.choice(vocabulary) for _ in range(30)]
    texts = []
    for i in range(60):
        words = list(base)
        words[random.randrange(40)] = f"v{i}"
        texts.append(words)
    for _ in range(40):
        words = list(texts[-1])
        words[random.randrange(40)] = random.choice(vocabulary)
        texts.append(words)
    for _ in range(60):
        own = [random.choice(vocabulary) for _ in range(random.randrange(5, 60))]
        at = random.randrange(len(own))
        texts.append(own[:at] + passage[random.randrange(5) : 30 - random.randrange(5)] + own[at:])
    for n in range(1, 40):
        texts.append(["same"] * n)
    texts += [texts[3], texts[100], [], ["a"], ["a", "b"], ["A", "B"], ["a", "b", "c"]]
    random.shuffle(texts)
    return [(i * 3 + 1, " ".join(words)) for i, words in enumerate(texts)]


def near_by_pairs(docs, size, percent):
    sets = {}
    for id, text in docs:
        words = words_of(text, lower=True)
        n = len(words)
        sets[id] = {tuple(words[i : i + size]) for i in range(n - size + 1)} if n >= size else {tuple(words)} if n else set()
    parent = {id: id for id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(id, len(sets[id]), root(id), root(id) == id) for id in sets}


@pytest.mark.parametrize("limits", [None, (400, 8)])
def test_near_dedup(spark, crowd, monkeypatch, limits):
    if limits:  # groups too large for one task, dealt by buckets and blocks
        monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", limits[0])
        monkeypatch.setattr(near_dedup, "GROUP_CLASSES", limits[1])
    frame = spark.createDataFrame(crowd, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        found = {tuple(row) for row in near_dedup.group(frame, size=size, percent=percent).collect()}
        assert found == near_by_pairs(crowd, size, percent)


def removed_by_windows(docs, size=13):
    first = {}
    for id, text in docs:
        words = words_of(text)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            first[window] = min(first.get(window, id), id)
    out = set()
    for id, text in docs:
        words = words_of(text)
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < id:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.add((id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [None, (2, 40)])
def test_substring_dedup(spark, crowd, monkeypatch, limits):
    if limits:  # hashes of hot passages are dealt by window, and shards hold few words
        monkeypatch.setattr(substring_dedup, "HOT", limits[0])
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", limits[1])
    frame = spark.createDataFrame(crowd, "doc_id long, text string")
    assert {tuple(row) for row in substring_dedup.digests(frame).collect()} == removed_by_windows(crowd)


def test_signatures_estimate_similarity():
    random = np.random.default_rng(3)
    shares = []
    for _ in range(60):
        a = random.integers(0, 1 << 63, 300).astype(np.uint64)
        b = np.concatenate([a[:240], random.integers(0, 1 << 63, 60).astype(np.uint64)])
        lines = near_dedup.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 128)
        shares.append((lines[0] == lines[1]).mean())
    true = 240 / 360
    assert abs(np.mean(shares) - true) < 0.02
    assert np.std(shares) < (true * (1 - true) / 128) ** 0.5 * 1.1


def test_signatures_do_not_depend_on_stretches(monkeypatch):
    elements = np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64)
    row = np.repeat([0, 1, 2], [3, 600, 397])
    whole = near_dedup.signatures(row, elements, 3, 64)
    monkeypatch.setattr(near_dedup, "ELEMENTS", 128)
    assert (near_dedup.signatures(row, elements, 3, 64) == whole).all()


def test_components_of_a_long_path(spark):
    links = spark.range(400).selectExpr("(id * 7919) % 400 + 1 as a", "(id * 7919 + 1) % 400 + 1 as b").where("abs(a - b) = 1")
    rows = {(r["a"], r["b"]) for r in components.components(links)[0].collect()}
    assert rows == {(i, 1) for i in range(2, 401)}


def test_words_and_hashes():
    texts = ["One two\tONE", None, "", " é x  日本 ", "x" * 70_000 + " two"]
    split = tokens.words_of(pa.array(texts), tokens.SPACE, lower=True)
    listed = [[split.joined(i, i + 1) for i in range(a, b)] for a, b in zip(split.first, split.first[1:])]
    assert listed == [["one", "two", "one"], [], [], ["é x", "日本"], ["x" * 70_000, "two"]]
    assert split.hash[0] == split.hash[2] and split.hash[1] == split.hash[6]
    assert len(set(split.hash.tolist())) == 5
    row, at, hashed = tokens.windows(split, 2)
    assert row.tolist() == [0, 0, 3, 4] and at.tolist() == [0, 1, 3, 5] and len(set(hashed.tolist())) == 4


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")
    chosen = quality_classifier.choose(docs, labels.where("doc_id % 5 <> 0"))
    held = chosen.join(labels.where("doc_id % 5 = 0"), "doc_id").select("quality", "log_weight", "kept").collect()
    good = [r["log_weight"] for r in held if r["quality"] == 1]
    bad = [r["log_weight"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r["kept"] for r in held if r["quality"] == 1]) > 0.85


def test_kth_highest(spark):
    values = [-(1 << 63), -5, -1, 0, 3, 3, 1 << 40, (1 << 63) - 1]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert quality_classifier.kth_highest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality_classifier.kth_highest(frame, "v", 9) is None


PAGES = [
    ("<p>One\n two<p>Three<br>four <b>bold</b>, end", "One two\n\nThree\nfour bold, end"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>Long header<tr><td>x<td>1</table>", "Name | Long header\nx    | 1"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b<br>c</table>", "wide\na | b\n  | c"),
    ("<table><tr><td><ul><li>in</ul><td><table><tr><td>n<td>m</table></table>", "- in | n | m"),
    ("a<pre>  keep\n   this</pre>b", "a\n\n  keep\n   this\n\nb"),
    ("<title>no</title><script>if (a < b) '</p>'</script>yes<style>p{}</style>", "yes"),
    ("<div hidden>no</div><p style='DISPLAY : none'>no<p>yes", "yes"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
    ("x &lt;b&gt; &amp;amp; &#233;&eacute;&#x65e5; &unknown;", "x <b> &amp; éé日 &unknown;"),
    ("1 < 2 and 3 > 2 <!-- a > b --> end<!doctype x>", "1 < 2 and 3 > 2 end"),
    ("one<div>two</div>three<h2>four</h2>five", "one\ntwo\nthree\n\nfour\n\nfive"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("kept <a href='x>y' title=\"a>b\">link</a> <a href=\"open", "kept link"),
    ("<head><title>t</title><p>body starts", "body starts"),
    ("</p>a</div></span>b<//>c", "ab c".replace(" ", "")),
    ("<blockquote>q<br>r</blockquote>s", "  q\n  r\n\ns"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_html(html, text):
    assert html_text.render(html) == text


def test_html_keeps_every_visible_word(spark):
    """The words of all pages against the standard library's parser, layout aside."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.found = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("title", "style", "script")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("title", "style", "script")

        def handle_data(self, data):
            if not self.hidden:
                self.found += data.split()

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert len(texts) == pages.count()
    for page in pages.collect():
        parser = Words()
        parser.feed(page["html"])
        text = [w for w in texts[page["page_id"]].split() if w not in ("-", "|")]
        assert "".join(text) == "".join(w for w in parser.found if w not in ("-", "|"))
