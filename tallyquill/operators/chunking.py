"""Chunking strategies. Documents are (doc_id, text) with form feeds between pages, plus
optional ``tables`` and ``images`` per page; every strategy is a projection and an
explode, so no strategy shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyquill.functions import text as tx
from tallyquill.functions.embedding import bind

# Chunk sizes, keywords and cluster count of the strategies.
WORDS_PER_CHUNK = 100
CHARS_PER_CHUNK = 100
KEYWORDS = ("Introduction", "Conclusion", "References")

PAGE_BREAK = "\f"


def pages(docs: DataFrame) -> DataFrame:
    """One row per page, numbered from 1."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode(F.split("text", PAGE_BREAK)).alias("page", "text")).select(
        *others, (F.col("page") + 1).alias("page_num"), "text"
    )


def _named(pieces: Column, label: str) -> Column:
    """Array of (chunk_index, chunk_name, text), named page_{p}_{label}_{i} from 1."""
    page = F.col("page_num").cast("string")
    return F.transform(
        pieces,
        lambda piece, i: F.struct(
            (i + 1).alias("chunk_index"),
            F.concat(F.lit("page_"), page, F.lit(f"_{label}_"), (i + 1).cast("string")).alias("chunk_name"),
            piece.alias("text"),
        ),
    )


def _single(index: Column, ending: str, text: Column) -> Column:
    name = F.concat(F.lit("page_"), F.col("page_num").cast("string"), F.lit(ending))
    return F.array(F.struct(index.alias("chunk_index"), name.alias("chunk_name"), text.alias("text")))


def _page() -> Column:
    return _single(F.lit(1), "", F.col("text"))


def _paragraphs() -> Column:
    return _named(tx.paragraphs(F.col("text")), "paragraph")


def _sentences() -> Column:
    return _named(tx.sentences(F.col("text")), "sentence")


def table_text(cells: Column) -> Column:
    """Rows of cells as lines of tab-separated text; a missing cell is empty."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, "\t", "")), "\n")


def _tables() -> Column:
    return _named(F.transform("tables", table_text), "table")


def _fixed_words(size: int = WORDS_PER_CHUNK) -> Column:
    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size))
        joined = F.transform(starts, lambda start: F.array_join(F.slice(words, start, F.lit(size)), " "))
        return F.when(F.size(words) > 0, joined).otherwise(F.array().cast("array<string>"))

    return _named(bind(tx.words(F.col("text")), windows), "chunk")


def _keywords(keywords: Sequence[str] = KEYWORDS) -> Column:
    page = F.col("page_num").cast("string")
    found = [
        F.when(
            F.contains("text", F.lit(word)),
            F.struct(
                F.lit(i).alias("chunk_index"),
                F.concat(F.lit("page_"), page, F.lit(f"_keyword_{word}")).alias("chunk_name"),
                F.substring(F.col("text"), F.locate(word, F.col("text")) + len(word), F.length("text")).alias("text"),
            ),
        )
        for i, word in enumerate(keywords, start=1)
    ]
    return F.array_compact(F.array(*found))


def _visual() -> Column:
    return _single(F.size("images"), "_visual_info", F.array_join("images", "\n"))


def _exploded(paged: DataFrame, chunks: Column) -> DataFrame:
    return paged.select("doc_id", "page_num", F.inline(chunks))


def chunk_pages(paged: DataFrame) -> DataFrame:
    return _exploded(paged, _page())


def chunk_paragraphs(paged: DataFrame) -> DataFrame:
    """Cut on blank lines; empty pieces are kept."""
    return _exploded(paged, _paragraphs())


def chunk_sentences(paged: DataFrame) -> DataFrame:
    """Cut after sentence marks. The boundary is a rule, not a language model."""
    return _exploded(paged, _sentences())


def chunk_tables(paged: DataFrame) -> DataFrame:
    """One chunk per entry of ``tables``, an array of tables of rows of cells."""
    return _exploded(paged, _tables())


def chunk_fixed_words(paged: DataFrame, size: int = WORDS_PER_CHUNK) -> DataFrame:
    """Windows of ``size`` words joined by single spaces; nothing for an empty page."""
    return _exploded(paged, _fixed_words(size))


def chunk_keywords(paged: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Text after the first occurrence of each keyword on a page, case-sensitive."""
    return _exploded(paged, _keywords(keywords))


def chunk_visual(paged: DataFrame) -> DataFrame:
    """One chunk per page listing its ``images``, also when there are none."""
    return _exploded(paged, _visual())


def chunk_sections(docs: DataFrame, heading: str = tx.SECTION_HEADING) -> DataFrame:
    """Cut whole documents at headings, which stay as chunks of their own. Pieces are
    trimmed; empty ones are kept."""
    joined = F.replace(F.col("text"), F.lit(PAGE_BREAK), F.lit("\n"))
    between, headings = F.split(joined, heading), F.regexp_extract_all(joined, F.lit(heading), F.lit(1))
    pieces = F.flatten(F.zip_with(between, headings, lambda a, b: F.array_compact(F.array(a, b))))
    position = F.col("position") + 1
    return docs.select("doc_id", F.posexplode(pieces).alias("position", "piece")).select(
        "doc_id",
        F.lit(None).cast("int").alias("page_num"),
        position.alias("chunk_index"),
        F.concat(F.lit("section_"), position.cast("string")).alias("chunk_name"),
        tx.strip(F.col("piece")).alias("text"),
    )


def char_pieces(text: Column, size: int) -> Column:
    """Array of the pieces of all paragraphs; a paragraph's last piece must not be blank."""

    def cut(paragraph: Column) -> Column:  # one pass; a substring would be looked for from the start each time
        return F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def kept(parts: Column) -> Column:
        return F.filter(parts, lambda part, i: (i < F.size(parts) - 1) | ~tx.is_blank(part))

    return F.flatten(F.transform(F.transform(tx.paragraphs(text), cut), kept))


def chunk_chars(docs: DataFrame, size: int = CHARS_PER_CHUNK) -> DataFrame:
    """Paragraphs cut into pieces of ``size`` characters, numbered from 0 per document."""
    pieces = char_pieces(F.col("text"), size)
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_index", "text"))


def blank_documents(docs: DataFrame, pieces: Column) -> DataFrame:
    """Documents for which the array of pieces is empty, with the reason. Exploding the
    reason instead of filtering on it evaluates the pieces once."""
    reason = F.when(tx.is_blank(F.col("text")), "blank text").when(F.size(pieces) == 0, "no chunks")
    return docs.select("doc_id", F.explode(F.array_compact(F.array(reason))).alias("reason"))


def with_text(docs: DataFrame) -> DataFrame:
    return docs.where(~tx.is_blank(F.col("text")))


def chunk_all(paged: DataFrame, docs: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Every strategy on the same documents, tagged with its name.

    All page-level strategies are evaluated side by side in one pass over the pages, so
    the input is read once for them and once for the whole-document sections.
    """
    by_type = {
        "page_chunks": _page(),
        "paragraph_chunks": _paragraphs(),
        "sentence_chunks": _sentences(),
        "table_chunks": _tables(),
        "fixed_size_chunks": _fixed_words(),
        "keyword_chunks": _keywords(),
        "visual_chunks": _visual(),
    }
    tagged = F.array(
        *(F.struct(F.lit(name).alias("chunk_type"), chunks.alias("chunks")) for name, chunks in by_type.items())
    )
    grouped = paged.select("doc_id", "page_num", F.inline(tagged))
    parts = [
        grouped.select("doc_id", "page_num", "chunk_type", F.inline("chunks")),
        chunk_sections(docs).withColumn("chunk_type", F.lit("section_chunks")),
    ]
    if semantic is not None:
        parts.append(semantic.withColumn("chunk_type", F.lit("semantic_chunks")))
    return reduce(DataFrame.unionByName, parts)
