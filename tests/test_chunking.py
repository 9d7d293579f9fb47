import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyquill.operators import chunking, semantic, splitter
from tallyquill.operators.splitter import SplitPlan, chunks_of, raw_chunks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def texts(frame):
    return [row.text for row in frame.orderBy("doc_id", "page_num", "chunk_index").collect()]


def names(frame):
    return [row.chunk_name for row in frame.orderBy("doc_id", "page_num", "chunk_index").collect()]


def test_pages_and_paragraphs(spark):
    paged = chunking.pages(docs(spark, "a\n \nb\n\n\fc"))
    assert texts(chunking.chunk_pages(paged)) == ["a\n \nb\n\n", "c"]
    found = chunking.chunk_paragraphs(paged)
    assert texts(found) == ["a", "b", "", "c"]
    assert names(found) == ["page_1_paragraph_1", "page_1_paragraph_2", "page_1_paragraph_3", "page_2_paragraph_1"]


def test_fixed_words(spark):
    text = " ".join(f"w{i}" for i in range(205))
    found = chunking.chunk_fixed_words(chunking.pages(docs(spark, text, "  ", "one")))
    assert [len(t.split()) for t in texts(found)] == [100, 100, 5, 1]
    assert names(found) == ["page_1_chunk_1", "page_1_chunk_2", "page_1_chunk_3", "page_1_chunk_1"]


def test_keywords_after_first_occurrence(spark):
    found = chunking.chunk_keywords(chunking.pages(docs(spark, "x Introduction y Introduction z References", "introduction")))
    assert texts(found) == [" y Introduction z References", ""]
    assert names(found) == ["page_1_keyword_Introduction", "page_1_keyword_References"]


@pytest.mark.parametrize("text", ["Section 1 a Section 2Chapter 33", "none", "", " x Chapter 4 "])
def test_sections_keep_headings(spark, text):
    want = [piece.strip() for piece in re.split(r"(Chapter \d+|Section \d+)", text)]
    assert texts(chunking.chunk_sections(docs(spark, text))) == want


def test_tables_and_visuals(spark):
    paged = spark.createDataFrame(
        [(1, 1, [[["a", None], ["b", "c"]]], ["i.png"]), (1, 2, [], [])],
        "doc_id bigint, page_num int, tables array<array<array<string>>>, images array<string>",
    )
    assert texts(chunking.chunk_tables(paged)) == ["a\t\nb\tc"]
    assert texts(chunking.chunk_visual(paged)) == ["i.png", ""]


def char_chunks(text, size):
    """Plain loop over paragraphs."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        starts = list(range(0, max(len(paragraph), 1), size))
        for start in starts:
            piece = paragraph[start : start + size]
            if start != starts[-1] or piece.strip():
                out.append(piece)
    return out


def test_char_chunks(spark):
    samples = ["", " ", "abcde\n\n     \n \nfgh", "a" * 10, "     " + "b" * 6, "x\n\n" + " " * 12, "é😀" * 7]
    found = chunking.chunk_chars(docs(spark, *samples), size=5).orderBy("doc_id", "chunk_index").collect()
    for i, sample in enumerate(samples):
        own = [row for row in found if row.doc_id == i]
        assert [row.text for row in own] == char_chunks(sample, 5)
        assert [row.chunk_index for row in own] == list(range(len(own)))


def test_a_long_paragraph_is_cut_in_one_pass(spark):
    """Two million characters: seconds, where looking for each piece from the start took a minute."""
    text = "é😀\nabcdefg" * 200_000
    frame = docs(spark, text).cache()
    chunking.chunk_chars(docs(spark, "ab")).count()
    began = time.monotonic()
    found = chunking.chunk_chars(frame).collect()
    assert time.monotonic() - began < 8
    assert "".join(row.text for row in found) == text and {len(row.text) for row in found} == {chunking.CHARS_PER_CHUNK}


def test_blank_documents(spark):
    frame = docs(spark, "", " \n", "a", None)
    found = chunking.blank_documents(frame, chunking.char_pieces(F.col("text"), 100))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "blank text"), (1, "blank text"), (3, "blank text")]


WORDS = st.text(alphabet="ab .,\n", max_size=120)


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(1, 20), st.integers(0, 8))
def test_split_properties(text, size, overlap):
    plan = SplitPlan(size, min(overlap, size - 1), ("\n\n", "\n", " ", ""))
    chunks = chunks_of(text, plan)
    assert all(0 < len(chunk) <= size for chunk in chunks)
    assert chunks == chunks_of(text, plan)
    whole = SplitPlan(size, 0, plan.separators)
    assert "".join(raw_chunks(text, whole)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(0, 15))
def test_split_overlap_is_bounded(lengths, overlap):
    """Words are numbered, so shared words of neighbours can be told apart."""
    words = [f"{i:03d}" + "x" * n for i, n in enumerate(lengths)]
    plan = SplitPlan(30, overlap, (" ",))
    chunks = [chunk.split() for chunk in chunks_of(" ".join(words), plan)]
    assert sorted({w for chunk in chunks for w in chunk}) == words
    for before, after in zip(chunks, chunks[1:]):
        shared = [w for w in before if w in after]
        assert before[len(before) - len(shared) :] == shared == after[: len(shared)]
        assert sum(len(w) + 1 for w in shared) <= overlap + 1


def test_char_splitter_keeps_long_pieces(spark):
    plan = SplitPlan(10, 4, ("\n\n",), recursive=False)
    assert chunks_of("aaa\n\nbbb\n\n" + "c" * 15 + "\n\ndd", plan) == ["aaa\n\nbbb", "c" * 15, "dd"]
    assert chunks_of("aaa\n\nbbb\n\nccc", plan) == ["aaa\n\nbbb", "bbb\n\nccc"]


def test_overlap_job_numbers_chunks(spark):
    plan = SplitPlan(5, 0, (" ", ""))
    rows = splitter.chunk_overlap(docs(spark, "aaa bbb ccc", "", "x"), plan).orderBy("doc_id", "chunk_index").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "aaa"), (0, 1, "bbb"), (0, 2, "ccc"), (2, 0, "x")]


def test_clusters():
    points = np.array([[0.0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0]])
    assert semantic.cluster(points, 3).tolist() == [0, 0, 1, 1, 2]
    assert semantic.cluster(points[:1], 3).tolist() == [0]
    same = np.ones((4, 2))
    assert semantic.cluster(same, 3).tolist() == [0, 0, 0, 0]
    assert (same == 1).all()


def test_semantic_covers_all_pieces(spark):
    found = semantic.chunk_semantic(docs(spark, "red apple.green pear.red apple", "one"))
    rows = found.orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_name, r.text) for r in rows] == [
        (0, "cluster_1", "red apple\nred apple"),
        (0, "cluster_2", "green pear"),
        (1, "cluster_1", "one"),
    ]


def test_all_modes_equal_single_modes(spark):
    frame = docs(spark, "A b. C d\fIntroduction x Section 1 y")
    paged = chunking.pages(frame).select(
        "*", F.array(F.array(F.array(F.lit("c")))).alias("tables"), F.array(F.lit("i")).alias("images")
    )
    everything = chunking.chunk_all(paged, frame, semantic.chunk_semantic(frame))
    counts = {r["chunk_type"]: r["count"] for r in everything.groupBy("chunk_type").count().collect()}
    assert counts == {
        "page_chunks": 2, "paragraph_chunks": 2, "sentence_chunks": 3, "table_chunks": 2, "fixed_size_chunks": 2,
        "keyword_chunks": 1, "visual_chunks": 2, "section_chunks": 3, "semantic_chunks": 3,
    }


def test_sections_may_hold_any_character(spark):
    frame = spark.createDataFrame([(1, "a\x01b Section 1 c Chapter 12Section 3")], "doc_id bigint, text string")
    found = [r.text for r in chunking.chunk_sections(frame).orderBy("chunk_index").collect()]
    assert found == ["a\x01b", "Section 1", "c", "Chapter 12", "", "Section 3", ""]


def test_semantic_chunks_of_an_embedder_of_another_width(spark):
    frame = spark.createDataFrame([(1, "aa.bbbb.?!.cc"), (2, "?")], "doc_id bigint, text string")
    embed = lambda text: F.when(text.rlike("[a-z]"), F.array(F.length(text).cast("double"), F.lit(1.0), F.lit(0.0)))
    found = semantic.chunk_semantic(frame, k=2, embed=embed)
    rows = sorted((r.doc_id, r.chunk_index, r.text) for r in found.collect())
    assert [r[0] for r in rows] == [1, 1, 2]
    assert sorted("\n".join(r[2] for r in rows[:2]).split("\n")) == ["?!", "aa", "bbbb", "cc"]


def test_semantic_corpus_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two. three four. five six seven.")], "doc_id long, text string")
    assert semantic.chunk_semantic_corpus(none).columns == semantic.chunk_semantic_corpus(some).columns
    assert semantic.chunk_semantic_corpus(none).count() == 0


def test_few_documents_are_split_at_a_time(spark):
    """A worker holds the texts and chunks of some documents, however many a batch has."""
    rows = [(f"d{i}", "\n\n".join(f"{i} {n} " + "word " * 15 for n in range(30))) for i in range(300)] + [("none", None), ("blank", " \n")]
    plan = splitter.SPLIT_PLANS["recursive_1000_100"]
    expected = {(name, i): chunk for name, text in rows if text is not None for i, chunk in enumerate(splitter.chunks_of(text, plan))}
    keyed = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("struct(doc_id, 1 AS n) AS key", "text").coalesce(1)
    found = splitter.chunk_overlap(keyed, plan, "key").collect()
    assert {(r.key.doc_id, r.chunk_index): r.text for r in found} == expected and len(found) == len(expected)
    schema = pa.schema([("doc_id", pa.string()), ("plan", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string())])
    whole = pa.RecordBatch.from_pylist([{"doc_id": name, "text": text} for name, text in rows if text is not None])
    sent = list(splitter._splitter({"": plan}, schema)([whole]))
    assert max(len(set(batch["doc_id"].to_pylist())) for batch in sent) <= splitter.ROWS
    assert {(r["doc_id"], r["chunk_index"]): r["text"] for batch in sent for r in batch.to_pylist()} == expected


def test_a_task_of_the_fit_over_all_documents_holds_a_bounded_part(spark, monkeypatch):
    """All documents in one split, one of them longer than a part."""
    rows = [(i, ". ".join(f"word{i} and {j}" for j in range(6))) for i in range(30)] + [(99, ".".join("ab cd" for _ in range(150))), (100, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    kept, parts = semantic.checkpointed, []

    def counted(df):
        points = kept(df)
        parts.extend(row["count"] for row in points.groupBy(F.spark_partition_id()).count().collect())
        return points

    monkeypatch.setattr(semantic, "checkpointed", counted)
    for bound in (32_000_000, 64 * 50):
        parts.clear()
        monkeypatch.setattr(semantic, "PART_ELEMENTS", bound, raising=False)
        found = semantic.chunk_semantic_corpus(frame).collect()
        assert sum(parts) == 330 and max(parts) <= bound // 64
        pieces = [(row.doc_id, piece) for row in found for piece in row.text.split("\n")]
        assert sorted(pieces) == sorted((i, piece) for i, text in rows if text for piece in text.split("."))
