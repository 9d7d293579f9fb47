"""Rules for text and names, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyquill.functions import naming
from tallyquill.functions import text as tx
from tallyquill.functions.embedding import hash64, scaled


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, stripped, words",
    [
        ("  a b ", "a b", ["a", "b"]),
        (" a b\n", "a b", ["a", "b"]),
        ("\t\n ", "", []),
        ("", "", []),
    ],
)
def test_whitespace_is_unicode(spark, text, stripped, words):
    assert one(spark, tx.strip(F.col("t")), t=text) == stripped == text.strip()
    assert one(spark, tx.words(F.col("t")), t=text) == words == text.split()
    assert one(spark, tx.is_blank(F.col("t")), t=text) == (not text.strip())


def test_sentences(spark):
    text = "One. Two! Three?  Four.Five"
    assert one(spark, tx.sentences(F.col("t")), t=text) == ["One.", "Two!", "Three?", "Four.Five"]


def test_html(spark):
    page = "<!DOCTYPE html><style>p{}</style><script>var t='</p>';</script><p>a &amp;lt; b<br>&quot;c&quot;</p><!-- x -->"
    assert one(spark, tx.html_text(F.col("t")), t=page) == 'a &lt; b"c"'


def test_sentences_may_hold_any_character(spark):
    assert one(spark, tx.sentences(F.col("t")), t="a\x01b. c\x02! d") == ["a\x01b.", "c\x02!", "d"]


def test_entities(spark):
    from html import unescape

    text = "&mdash; &#8217; &#x27; &euro; &#128; &#xD800; &#0; &AMP;lt; &none; & ; &lt &NotEqualTilde; &#x1F600;"
    found = one(spark, tx.unescaped(F.col("t")), t=text)
    # Without a semicolon, an entity stays as it is.
    assert found == unescape(text.replace("&lt &", "&amp;lt &"))


def test_html_tables(spark):
    page = "<table><tr><th>a</th><td>b &amp; c</td></tr><tr><td></td></tr></table><TABLE x=1><tr><td>d</td></tr></TABLE>"
    assert one(spark, tx.table_cells(F.col("t")), t=page) == [[["a", "b & c"], [""]], [["d"]]]


@pytest.mark.parametrize(
    "path, stem, first, suffix",
    [
        ("x/a.b.txt", "a.b", "a", "txt"),
        ("x.y/readme", "readme", "readme", ""),
        ("A.PDF", "A", "A", "pdf"),
        (".hidden", ".hidden", "", ""),
    ],
)
def test_paths(spark, path, stem, first, suffix):
    assert one(spark, naming.stem(F.col("p")), p=path) == stem
    assert one(spark, naming.first_dot_stem(F.col("p")), p=path) == first
    assert one(spark, naming.suffix(F.col("p")), p=path) == suffix


def test_safe_names(spark):
    assert one(spark, naming.safe_name(F.col("n")), n="_my file (1)é_") == "my_file__1"
    assert one(spark, naming.safe_name(F.col("n"), strip_edges=False), n="_a b_") == "_a_b_"
    long = "😀" * 40 + "x" * 40
    assert one(spark, naming.safe_name(F.col("n"), strip_edges=False), n=long) == "_" * 40 + "x" * 23


@pytest.mark.parametrize("micros", [0, 500_000, 1_704_067_207_179_575, 1_704_067_200_000_000])
def test_seconds_print_like_python(spark, micros):
    moment = dt.datetime.fromtimestamp(micros / 1e6, dt.timezone.utc)
    assert one(spark, naming.seconds_text(F.timestamp_micros("m")), m=micros) == str(moment.timestamp())


def test_hash64(spark):
    import hashlib
    import math

    text = "Été été deux, 2 x"
    tokens = ["été", "été", "deux", "2", "x"]
    counts = [0] * 64
    for token in tokens:
        counts[int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % 64] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    assert one(spark, hash64(F.col("t")), t=text) == [round(c / norm, 6) for c in counts]
    assert one(spark, hash64(F.col("t")), t="?! --") is None
    assert one(spark, scaled(F.array(F.lit(0.5), F.lit(-0.25))), t="") == "500000,-250000"
