"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyquill.llm import (
    chat_format,
    decontamination,
    html_text,
    license_scan,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
)

SENTENCE = "the cat and the dog sat on a mat with nine other friends of the house in town"
LONG = " ".join(f"word{i} and" for i in range(30_000))
DOCS = [
    (1, SENTENCE, "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", None),
    (5, LONG, "b"),
    (6, SENTENCE, "b"),
    (6, SENTENCE, "b"),
    (None, SENTENCE, "b"),
    (None, None, None),
    (7, "é ü", ""),
]
#: Columns that operators use inside, with values that would show if they were taken.
CLASHING = ("id", "row", "key", "size", "found", "n", "kept", "shard", "slot", "h", "rep", "words", "c0", "copies", "of")


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([row + ("x",) * len(CLASHING) for row in DOCS], schema)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_by_id(frame, id="doc_id"):
    found = {}
    for row in frame.collect():
        found.setdefault(row[id], []).append(row.asDict())
    return found


def test_sharding(docs, none):
    rows = rows_by_id(sharding.assign(docs, 4))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert rows[2][0]["size"] == 1 and rows[2][0]["text_crc32"] == 0
    assert rows[7][0]["size"] == 6 and rows[7][0]["text_crc32"] == zlib.crc32("é ü".encode())
    assert len({r["shard"] for r in rows[None]}) == 1
    slots = {}
    for listed in rows.values():
        for r in listed:
            slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(none, 4).count() == 0
    placed = sharding.place(docs, 1)
    assert placed.columns == docs.columns and {r["shard"] for r in placed.collect()} == {0}


def test_grown_shards_only_take_rows_into_the_new_one(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "cast(null as string) as text")
    rows = sharding.assign(ids, 10).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {10}
    assert 0.07 < len(moved) / len(rows) < 0.11
    counts = [sum(r["shard"] == k for r in rows) for k in range(10)]
    assert max(counts) < 1.15 * min(counts)


def test_jump_by_the_published_loop(spark):
    def jump(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * float(1 << 31) / float((key >> 33) + 1))
        return b

    keys = [0, 1, 2, 41, (1 << 59) + 12345, (1 << 60) - 1, *range(1000, 1400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 17, 1000):
        found = frame.select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()
        assert [r["s"] for r in found] == [jump(r["k"], shards) for r in found]


def test_license_scan(spark, docs, none):
    rows = rows_by_id(license_scan.scan(docs))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert rows[2][0]["n_words"] == 0 and rows[2][0]["labels"] == "" and rows[2][0]["score"] == 0.0
    assert rows[5][0]["n_words"] == 60_000
    assert license_scan.scan(none).count() == 0
    texts = [
        ("Released under the MIT-License. mit\nlicense!", "mit", 2, 3, 5),
        ("submit licenses", "", 0, None, None),
        ("CC BY", "cc-by", 1, 0, 0),
        ("x GNU  General_Public;License y apache LICENSE", "apache,gpl", 2, 1, 6),
    ]
    frame = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    for i, (_, base, n, first, last) in enumerate(texts):
        row = rows_by_id(license_scan.scan(frame))[i][0]
        assert (row["base_labels"], row["n_base"], row["first_word"], row["last_word"]) == (base, n, first, last)


def test_license_notices_find_their_own_label(spark):
    notices = [(i, text.upper()) for i, (_, _, text) in enumerate(license_scan.NOTICES)]
    rows = rows_by_id(license_scan.scan(spark.createDataFrame(notices, "doc_id long, text string")))
    for i, (label, _, _) in enumerate(license_scan.NOTICES):
        assert label in rows[i][0]["labels"].split(",")
        assert rows[i][0]["score"] == 1.0


#: Short notices as they stand in files, none of them a template.
SHORT_NOTICES = (
    ("agpl", "Licensed under the Affero General Public License, v3."),
    ("apache-2.0", "SPDX: Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms is allowed."),
    ("cc-by-nc", "Photo: CC BY-NC 3.0"),
    ("cc-by-nd", "Photo: CC BY-ND 3.0"),
    ("cc-by-sa", "Text is CC BY-SA."),
    ("cc0", "Data: CC0 1.0"),
    ("epl", "Licensed under the Eclipse Public License 2.0"),
    ("gpl-2.0", "Covered by the General Public License version 2 or later"),
    ("gpl-3.0", "GNU General Public License version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software is granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to everyone"),
    ("mpl", "Licensed under the Mozilla Public License 2.0"),
    ("unlicense", "This was released into the public domain."),
)


def test_license_phrases_alone_find_their_label(spark):
    assert {label for label, _ in SHORT_NOTICES} <= {label for label, _, _ in license_scan.NOTICES}
    texts = [*SHORT_NOTICES, *((label, phrase) for label, phrase, _ in license_scan.NOTICES)]
    rows = rows_by_id(license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")))
    for i, (label, _) in enumerate(texts):
        assert label in rows[i][0]["labels"].split(",")
        assert 0.3 <= rows[i][0]["score"] <= 1.0
    near = ["Mozilla Public Licenses", "the eclipse of public license", "subject to the terms of the mozilla licence"]
    rows = rows_by_id(license_scan.scan(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")))
    assert all(rows[i][0]["labels"] == "" and rows[i][0]["score"] == 0.0 for i in range(len(near)))


def test_without_its_index_a_scan_has_no_labels_of_its_own(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "subject to the terms of the Mozilla Public License; MIT License")], "doc_id long, text string")
    assert license_scan.scan(frame).first()["labels"] == "mit,mpl"
    monkeypatch.setattr(license_scan, "postings", dict)
    row = license_scan.scan(frame).first()
    assert (row["labels"], row["base_labels"], row["score"]) == ("mit", "mit", 0.5)


def licenses_by_hand(text):
    """Labels and best share of the notices in a text, from the list of notices alone."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    notices = [(label, phrase.split(), notice.split()) for label, phrase, notice in license_scan.NOTICES]
    weight = lambda word: round(1000 * math.log(1 + len(notices) / sum(word in n for _, _, n in notices)))
    labels, best = set(), 0.0
    for label, phrase, notice in notices:
        at = next(i for i in range(len(notice)) if notice[i : i + len(phrase)] == phrase)
        inside = range(at, at + len(phrase))
        rare = []
        for chosen in ({w for w in phrase}, {w for w in notice if w not in phrase}):
            place = {w: next(i for i, x in enumerate(notice) if x == w and (i in inside or w not in phrase)) for w in chosen}
            rare += [(w, place[w]) for w in sorted(chosen, key=lambda w: (-weight(w), place[w]))[:2]]
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                start = i - at
                hits = [w for w, p in rare if 0 <= start + p < len(words) and words[start + p] == w]
                if len(hits) >= 2:
                    labels.add(label)
                    best = max(best, sum(map(weight, hits)) / sum(weight(w) for w, _ in rare))
    base = {label for p, label in license_scan.BASE.items() if f" {p} " in f" {' '.join(words)} "}
    return ",".join(sorted(labels | base)), max(best, 0.5 if base else 0.0)


def test_license_scan_by_hand(spark):
    pick = random.Random(3)
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(pick.randrange(1, 5)):
            words = pick.choice(license_scan.NOTICES)[2].split()
            cut = pick.randrange(len(words)) if pick.random() < 0.5 else 0
            if pick.random() < 0.3:
                words[pick.randrange(len(words))] = "other"
            parts.append(" ".join(words[cut:] if pick.random() < 0.5 else words[: len(words) - cut]))
        texts.append(pick.choice((" ", ", ", "\n")).join(parts).title())
    rows = rows_by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        labels, score = licenses_by_hand(text)
        assert rows[i][0]["labels"] == labels and rows[i][0]["score"] == pytest.approx(score), text
    assert len({rows[i][0]["labels"] for i in rows}) > 20


def test_quality_rules(docs, none):
    rows = rows_by_id(quality_rules.judge(docs))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert rows[1][0]["kept"] and rows[6][0]["kept"]
    for id in (2, 3, 4, 7):
        assert rows[id][0]["base_failed"] and not rows[id][0]["kept"]
    assert rows[5][0]["n_words"] == 60_000 and rows[5][0]["n_repeat_words"] == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 6").count() == 2
    assert quality_rules.judge(none).count() == quality_rules.keep(none).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e x a b c d e", "a a a a a a a", "a b c d e f", "q a b c d e f a b c d e f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows_by_id(quality_rules.judge(frame))
    assert [rows[i][0]["n_repeat_words"] for i in range(4)] == [10, 7, 0, 12]


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (5, 0), (5, 1), (99, 1), (None, 1), (6, None)], "doc_id long, quality int"
    )
    rows = quality_classifier.choose(docs, labels, share=0.5).collect()
    assert len(rows) == len(DOCS)
    assert {r["log_weight"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0.0}
    assert all(r["kept"] for r in quality_classifier.choose(docs, labels.where("false")).collect())
    assert quality_classifier.choose(none, labels).count() == 0


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "<div>" * 5000 + "deep", "x"), (None, "a<b", "x")],
        "page_id long, html string, text string",
    )
    rows = rows_by_id(html_text.extract(pages), "page_id")
    assert rows[1][0]["text"] == rows[2][0]["text"] == ""
    assert rows[3][0]["text"] == "deep"
    assert rows[None][0]["text"] == "a"
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ('<table><tr><td width="100"">first</td><td>second</td></tr></table><p>rest of the page</p>',
         "first | second\n\nrest of the page"),
        ("<p class=it's>Hello</p><p>World</p>", "Hello\n\nWorld"),
        ('<p><a href=foo" class=x>link</a> and "quoted" text</p><p>end</p>', 'link and "quoted" text\n\nend'),
        ("<p 'a>b</p><p\">c</p>d", "b\n\nc\n\nd"),
        ('<p title="a > b" class=\'c > d\'>kept</p>', "kept"),
        ('<p width="1"" hidden>gone</p><p title="hidden">shown</p><p x= hidden>also</p><p a=>last</p>',
         "shown\n\nalso\n\nlast"),
        ("<p =hidden>a</p><img/src='x>y'/>b", "a\n\nb"),
        ("a<p title='never closed>b</p>", "a"),
        ("Note: <textarea rows=2>\n1 &lt; 2\n  <b>two</b></textarea> sent", "Note: 1 < 2\n  <b>two</b> sent"),
        ("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> holds</p>",
         "so x=1 holds"),
    ],
)
def test_html_stray_quotes_and_visible_controls(html, text):
    assert html_text.render(html) == text


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, "The cat, and THE dog sat on a mat with!"), (2, None), (3, ""), (None, "é"), (4, "word9")],
        "item_id long, text string",
    )
    rows = rows_by_id(decontamination.scan(docs, items))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert [tuple(s) for s in rows[1][0]["spans"]] == [(0, 10)] and rows[1][0]["items"] == ["1"]
    assert rows[7][0]["items"] == ["null"]
    assert rows[5][0]["items"] == ["4"]
    assert rows[2][0]["items"] == [] and rows[2][0]["n_words"] == 0
    blocks = rows_by_id(decontamination.scan(docs, items, most=1))
    assert blocks == rows
    clean = decontamination.drop(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 2, 3, 4]
    cut = rows_by_id(decontamination.cut(docs, items))
    assert cut[1][0]["text"] == " nine other friends of the house in town"
    assert cut[2][0]["text"] is None and cut[7][0]["text"] == " ü"
    assert decontamination.scan(none, items).count() == 0
    assert decontamination.drop(docs, items.where("false")).count() == len(DOCS)


def test_chat(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "␛</s>␛␛"), (1, 2, None, "␛</s>␛␛"),
            (None, None, "assistant", " lead\n"), (None, 3, "user", ""), (2, 0, "assistant", "<|endoftext|><s>é日本 [INST]"),
        ],
        "conv_id long, turn long, role string, text string",
    )
    formatted = chat_format.format_conversations(rows)
    found = rows_by_id(formatted, "conv_id")
    assert chat_format.read_back(found[1][0]["formatted"]) == [
        ("user", "hi"), ("assistant", ""), ("", "␛</s>␛␛"), ("", "␛</s>␛␛")
    ]
    digests = rows_by_id(chat_format.digests(formatted), "conv_id")
    for id, text in ((1, ""), (None, " lead\n"), (2, "<|endoftext|><s>é日本 [INST]")):
        assert digests[id][0]["loss_chars"] == len(text)
        assert digests[id][0]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert chat_format.format_conversations(rows.where("false")).count() == 0


def test_mixing(docs, none):
    rows = rows_by_id(mixing.plan(docs))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert rows[2][0]["taken"] == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for listed in rows.values() for r in listed)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.plan(none).count() == mixing.mix(none).count() == 0


def test_mix_takes_the_copies_of_the_plan(spark):
    """Null and repeated ids: as many copies as planned of each source, size and id."""
    texts = [(None, " ".join(["w"] * (5 + i % 3)) + f" x{i}", "a" if i < 240 else None) for i in range(300)]
    texts += [(i % 10, f"one two three y{i}", "b") for i in range(200)] + [(7, "same same", "b")] * 50
    texts += [(1000 + i, f"four words stand here{i}", "c") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for weights in ((3, 1, 2), (1, 8, 8)):
        wanted, found = {}, {}
        for r in mixing.plan(frame, weights=weights).collect():
            key = (r["source"], r["doc_id"], r["size"])
            wanted[key] = wanted.get(key, 0) + r["copies"]
        mixed = mixing.mix(frame, weights=weights).collect()
        for r in mixed:
            key = (r["source"], r["doc_id"], len(r["text"].split()))
            found[key] = found.get(key, 0) + 1
        assert found == {key: n for key, n in wanted.items() if n}
        rates = {r["source"]: r["target"] / r["source_size"] for r in mixing.plan(frame, weights=weights).collect()}
        times = {}
        for r in mixed:
            times[(r["source"], r["text"])] = times.get((r["source"], r["text"]), 0) + 1
        for _, text, source in set(texts):
            if text != "same same":
                assert abs(times.get((source, text), 0) - rates[source]) < 1


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 900)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # 2,865 words by weights 3, 1, 2: a stops at 20, then null at 1,800, and b gets the rest.
    assert found == {"a": 20.0, "b": pytest.approx(1045.0), None: 1800.0}


def test_substring_dedup(docs, none):
    rows = rows_by_id(substring_dedup.digests(docs))
    assert sum(map(len, rows.values())) == len(DOCS)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1][0]["n_removed"] == 0
    assert all(r["n_removed"] == 18 and r["kept_sha256"] == empty for r in rows[6])
    assert sorted(r["n_removed"] for r in rows[None]) == [0, 18]
    assert rows[2][0]["n_words"] == 0 and rows[2][0]["kept_sha256"] == empty
    cut = substring_dedup.remove(docs)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    assert substring_dedup.digests(none).count() == 0


def test_near_dedup(docs, none):
    rows = rows_by_id(near_dedup.group(docs))
    assert sum(map(len, rows.values())) == len(DOCS)
    assert all(r["component_id"] == 1 and not r["kept"] for r in rows[6])
    assert rows[2][0]["n_shingles"] == 0 and rows[2][0]["kept"]
    assert rows[7][0]["n_shingles"] == 1 and rows[7][0]["kept"]
    assert sorted((r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in rows[None]) == [(0, 0, True), (16, 1, False)]
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert near_dedup.group(none).count() == near_dedup.keep(none).count() == 0
