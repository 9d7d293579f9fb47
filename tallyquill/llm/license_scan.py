"""Licence scans by a positional index of rare words.

Each licence notice below is a template; a licence has several. The index holds, for the rarest words of every
template, inside its mandatory phrase and around it, their places in it. A document looks its own words up in
this index; each hit is a posting of a template and the place where it would start (document place minus template place).
Postings are intersected: a template is proposed where ``AGREE`` of its rare words at least agree in the start. A
proposal holds if the mandatory phrase stands at its place. Its share is the weight of the rare words
found where they belong. Texts without any of the index's anchors, the rarest word of each phrase, are not split.

Everything happens inside one projection: the index is a constant of the query, and each
document is looked at alone, so there is no shuffle, and no document meets another one.

Defined results. A null or empty text has no words, no labels and score 0. Whole texts are read,
whatever their length. Repeated rows give equal results, an empty table an empty one. Columns
besides id and text are not looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.llm.exprs import MARKS, let, lower_ascii, split_words

#: Phrases that give a base label wherever they stand.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, mandatory phrase, notice. The phrase is a part of the notice.
NOTICES = (
    ("agpl", "affero general public license", "licensed under the gnu affero general public license"),
    ("agpl", "affero general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"
     " as published by the free software foundation"),
    ("agpl", "license identifier agpl", "spdx license identifier agpl 3 0"),
    ("apache-2.0", "apache license version 2 0",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "www apache org licenses license 2 0",
     "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are permitted"
     " provided that the following conditions are met"),
    ("bsd-3", "may be used to endorse or promote products derived from this software",
     "nor the names of its contributors may be used to endorse or promote products derived from this software"
     " without specific prior written permission"),
    ("bsd", "license identifier bsd", "spdx license identifier bsd"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0", "released under cc0 1 0 universal"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("epl", "license identifier epl", "spdx license identifier epl 2 0"),
    ("gpl", "gnu general public license as published by the free software foundation",
     "this program is free software you can redistribute it and or modify it under the terms of the"
     " gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "general public license version 2",
     "this work is licensed under the gnu general public license version 2"),
    ("gpl-2.0", "license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "general public license version 3",
     "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "license identifier isc", "spdx license identifier isc"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("lgpl", "lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"
     " as published by the free software foundation"),
    ("lgpl", "license identifier lgpl", "spdx license identifier lgpl 2 1"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "license identifier mit", "spdx license identifier mit"),
    ("mit-notice", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "license identifier mpl", "spdx license identifier mpl 2 0"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
)

#: Rare words that the index keeps of each template's phrase and of the rest of its notice, and how many must agree.
RARE = 2
AGREE = 2


@dataclass(frozen=True)
class Template:
    label: str
    key: tuple[str, ...]
    key_at: int
    anchor: str
    rare: tuple[tuple[str, int, int], ...]  # word, place, weight

    @property
    def total(self) -> int:
        return sum(weight for _, _, weight in self.rare)


@cache
def templates() -> tuple[Template, ...]:
    """Each notice with its rarest words. A word's weight is its inverse document frequency
    among the notices, in thousandths."""
    texts = [notice.split() for _, _, notice in NOTICES]
    weight = {
        word: round(1000 * math.log(1 + len(texts) / sum(word in text for text in texts)))
        for text in texts
        for word in text
    }
    found = []
    for (label, phrase, _), text in zip(NOTICES, texts, strict=True):
        key = tuple(phrase.split())
        key_at = next(i for i in range(len(text)) if tuple(text[i : i + len(key)]) == key)
        rare = []
        for inside in (True, False):
            # First places of words in the phrase, or of other words around it, the rarest first.
            places = {w: i for i, w in reversed(list(enumerate(text))) if (key_at <= i < key_at + len(key)) is inside}
            chosen = sorted((w for w in places if inside or w not in key), key=lambda w: (-weight[w], places[w]))
            rare += [(w, places[w], weight[w]) for w in chosen[:RARE]]
        anchor = max(key, key=lambda w: (len(w) > 1, weight[w], len(w), w))
        found.append(Template(label, key, key_at, anchor, tuple(rare)))
    return tuple(found)


def anchors() -> list[str]:
    """A word of every mandatory and base phrase, which a text with the phrase must hold."""
    rest = {t.anchor for t in templates()}
    return sorted(rest | {next((w for w in phrase.split() if w in rest), phrase.split()[0]) for phrase in BASE})


def postings() -> dict[str, list[tuple[int, int]]]:
    """The index: for each rare word the templates that hold it, with its place."""
    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates()):
        for word, place, _ in template.rare:
            index.setdefault(word, []).append((number, place))
    return index


def _pattern() -> str:
    """Matches a text, of any case, that holds an anchor."""
    return f"(?i)(?:^|{MARKS})(?:{'|'.join(map(re.escape, anchors()))})(?:$|{MARKS})"


def _stands(words: Column, phrase: tuple[str, ...], at: Column) -> Column:
    here = F.lit(True)
    for k, word in enumerate(phrase):
        here = here & F.coalesce(F.get(words, at + k) == word, F.lit(False))
    return here


def _base_places(words: Column) -> Column:
    """(place, label) of every base phrase, as an array."""
    def at(word: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            parts = tuple(phrase.split())
            label = F.when((word == parts[0]) & _stands(words, parts, i), F.lit(name)).otherwise(label)
        return F.struct(i.cast("long").alias("place"), label.alias("label"))

    return F.filter(F.transform(words, at), lambda x: x["label"].isNotNull())


def _proposals(words: Column) -> Column:
    """(template, start) pairs in which enough postings agree, each as one number: the start
    may lie before the first word, so it is kept with an offset."""
    width = 1 << 20
    index = postings()
    if not index:
        return F.array().cast("array<struct<template:int,start:int>>")
    entries = F.create_map(
        *[
            x
            for word, listed in sorted(index.items())
            for x in (F.lit(word), F.array(*[F.lit(n * (1 << 40) + width - place).cast("long") for n, place in listed]))
        ]
    )
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))),
        lambda x: x["w"].isin(*sorted(index)),
    )
    each = F.transform(hits, lambda x: F.transform(F.element_at(entries, x["w"]), lambda e: e + x["i"]))
    # Equal numbers stand together once sorted; of each that has enough of them, the AGREE-th is taken.
    agreeing = let(
        F.array_sort(F.flatten(each)),
        lambda numbers: F.filter(
            numbers,
            lambda x, i: F.coalesce(F.get(numbers, i - (AGREE - 1)) == x, F.lit(False))
            & ~F.coalesce(F.get(numbers, i - AGREE) == x, F.lit(False)),
        ),
    )
    return F.transform(
        agreeing,
        lambda x: F.struct(
            F.shiftright(x, 40).cast("int").alias("template"),
            (x.bitwiseAND(F.lit((1 << 40) - 1)) - width).cast("int").alias("start"),
        ),
    )


def _verified(words: Column) -> Column:
    """(label, share) of every proposal that holds."""
    def check(x: Column) -> Column:
        share = F.lit(None).cast("double")
        label = F.lit(None).cast("string")
        for number, template in enumerate(templates()):
            weight = F.lit(0)
            for word, place, w in template.rare:
                weight = weight + F.when(F.get(words, x["start"] + place) == word, w).otherwise(0)
            here = (x["template"] == number) & _stands(words, template.key, x["start"] + template.key_at)
            share = F.when(here, weight / F.lit(template.total)).otherwise(share)
            label = F.when(here, F.lit(template.label)).otherwise(label)
        return F.struct(label.alias("label"), share.alias("share"))

    return F.filter(F.transform(_proposals(words), check), lambda x: x["label"].isNotNull())


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, places of base phrases, labels and score.

    ``score`` is the largest share of a template's weight found for it, 0.5 at least for a document
    with base phrases, and 0 without labels.
    """
    column = F.col(text)
    none = F.struct(
        F.array().cast("array<struct<place:bigint,label:string>>").alias("base"),
        F.array().cast("array<struct<label:string,share:double>>").alias("verified"),
    )
    looked = let(
        split_words(lower_ascii(column), MARKS),
        lambda w: F.struct(_base_places(w).alias("base"), _verified(w).alias("verified")),
    )
    found = F.when(F.coalesce(column, F.lit("")).rlike(_pattern()), looked).otherwise(none)
    rows = docs.select(
        F.col(id),
        let(
            F.struct(F.size(split_words(column, MARKS)).cast("long").alias("n_words"), found.alias("found")), _summary
        ).alias("s"),
    )
    return rows.select(F.col(id), "s.*")


def _summary(x: Column) -> Column:
    base, verified = x["found"]["base"], x["found"]["verified"]
    labels = F.transform(base, lambda b: b["label"])
    more = F.transform(verified, lambda v: v["label"])
    places = F.transform(base, lambda b: b["place"])
    best = F.coalesce(F.array_max(F.transform(verified, lambda v: v["share"])), F.lit(0.0))
    return F.struct(
        x["n_words"].alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _joined(labels).alias("base_labels"),
        _joined(F.concat(labels, more)).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
