"""Registered queries on chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyquill.functions import text as tx
from tallyquill.operators import chunking, semantic, splitter
from tallyquill.plans import tables as t
from tallyquill.plans.registry import Registry, recursive_with, with_

register = Registry()


def documents(spark, sf_dir):
    return t.spread(t.table(spark, sf_dir, "documents").select("doc_id", "text"))


def paged_documents(spark, sf_dir):
    """Documents with a form feed after every third line."""
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when((i > 0) & (i % 3 == 0), F.concat(F.lit("\f"), line)).otherwise(line),
    )
    return documents(spark, sf_dir).withColumn("text", F.array_join(marked, "\n"))


PAGED = r"""paged AS (SELECT doc_id, regexp_replace(text, '((?:[^\n]*\n){3})', '\1' || chr(12), 'g') AS text FROM documents)"""
# A range inside the projection numbers list items without a window.
PAGES = """listed AS (SELECT doc_id, string_split(text, chr(12)) AS parts FROM paged),
pages_text AS (SELECT doc_id, CAST(i AS INTEGER) AS page_num, parts[i] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM listed))"""


def hashed_sql(name, source, columns, text):
    """SQL twin of the built-in embedder."""
    return f"""{name}_tokens AS (SELECT {columns}, [('0x' || substr(md5(w), 1, 4))::INTEGER % 64
    for w in list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')] AS buckets FROM {source}),
{name}_counts AS (SELECT * EXCLUDE (buckets), CASE WHEN len(buckets) > 0 THEN
    [len(list_filter(buckets, lambda b: b = i)) for i in range(64)] END AS counts FROM {name}_tokens),
{name} AS (SELECT * EXCLUDE (counts), [round(c / sqrt(list_sum([x * x for x in counts])), 6) for c in counts] AS embedding
  FROM {name}_counts)"""


def exploded_sql(source, pieces, label):
    return f"""pieces AS (SELECT doc_id, page_num, {pieces} AS parts FROM {source}),
chunks AS (SELECT doc_id, page_num, CAST(i AS INTEGER) AS chunk_index,
  'page_' || page_num || '_{label}_' || i AS chunk_name, parts[i] AS text
  FROM (SELECT doc_id, page_num, parts, unnest(range(1, len(parts) + 1)) AS i FROM pieces))"""


def pages_text(spark, sf_dir):
    return chunking.pages(paged_documents(spark, sf_dir))


def para_pages(spark, sf_dir):
    """Pages whose line ends are blank lines."""
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return pages_text(spark, sf_dir).withColumn("text", spaced)


PARA_PAGES = """para_pages AS (SELECT doc_id, page_num, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM pages_text)"""
PAGE_SQL = "SELECT doc_id, page_num, 1 AS chunk_index, 'page_' || page_num AS chunk_name, text FROM pages_text"


@register("chunk_page", with_(PAGED, PAGES) + PAGE_SQL)
def chunk_page(spark, sf_dir):
    return chunking.chunk_pages(pages_text(spark, sf_dir))


PARAGRAPHS = r"regexp_split_to_array(text, '\n\s*\n')"
SENTENCES = r"""list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: length(regexp_replace(s, '\s+', '', 'g')) > 0)"""
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
WINDOWS = f"""[array_to_string(list_slice({WORDS}, i, i + 99), ' ') for i in range(1, len({WORDS}) + 1, 100)]"""


@register("chunk_paragraph", with_(PAGED, PAGES, PARA_PAGES, exploded_sql("para_pages", PARAGRAPHS, "paragraph")) + "SELECT * FROM chunks")
def chunk_paragraph(spark, sf_dir):
    return chunking.chunk_paragraphs(para_pages(spark, sf_dir))


@register("chunk_sentence", with_(PAGED, PAGES, exploded_sql("pages_text", SENTENCES, "sentence")) + "SELECT * FROM chunks")
def chunk_sentence(spark, sf_dir):
    return chunking.chunk_sentences(pages_text(spark, sf_dir))


def part_tables(spark, sf_dir):
    """Parts as table cells: a page per hundred part keys, a table per brand on it."""
    cells = F.array("p_name", "p_type", F.when(F.col("p_size") >= 10, F.col("p_size").cast("string")))
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("cells")))), lambda row: row["cells"]
    )
    page = F.floor(F.col("p_partkey") / 100).cast("int")
    return (
        t.table(spark, sf_dir, "part")
        .groupBy(F.lit(0).cast("bigint").alias("doc_id"), page.alias("page_num"), "p_brand")
        .agg(rows.alias("cells"))
        .groupBy("doc_id", "page_num")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "cells"))), lambda b: b["cells"]).alias("tables"))
    )


@register(
    "chunk_table",
    with_(
        """brand_tables AS (SELECT CAST(floor(p_partkey / 100) AS INTEGER) AS page_num, p_brand,
          string_agg(concat(p_name, chr(9), p_type, chr(9),
            coalesce(CASE WHEN p_size >= 10 THEN CAST(p_size AS VARCHAR) END, '')), chr(10) ORDER BY p_partkey) AS text
          FROM part GROUP BY ALL)""",
        """numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_num ORDER BY p_brand) AS INTEGER) AS chunk_index
          FROM brand_tables)""",
    )
    + """SELECT 0::BIGINT AS doc_id, page_num, chunk_index,
      'page_' || page_num || '_table_' || chunk_index AS chunk_name, text FROM numbered""",
)
def chunk_table(spark, sf_dir):
    return chunking.chunk_tables(part_tables(spark, sf_dir))


@register(
    "chunk_table_html",
    with_(
        """lists AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS lists FROM pages)""",
        """one AS (SELECT page_id, lists, unnest(range(1, len(lists) + 1)) AS i FROM lists)""",
        """cells AS (SELECT page_id, i, [replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&')
          for c in regexp_extract_all(lists[i], '(?s)<li>(.*?)</li>', 1)] AS cells FROM one)""",
    )
    + """SELECT page_id AS doc_id, 1 AS page_num, CAST(i AS INTEGER) AS chunk_index,
      'page_1_table_' || i AS chunk_name, array_to_string(cells, chr(10)) AS text FROM cells""",
)
def chunk_table_html(spark, sf_dir):
    html = F.col("html")
    for old, new in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    paged = t.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("page_num"), tx.table_cells(html).alias("tables")
    )
    return chunking.chunk_tables(paged)


@register("chunk_fixed_words", with_(PAGED, PAGES, exploded_sql("pages_text", WINDOWS, "chunk")) + "SELECT * FROM chunks")
def chunk_fixed_words(spark, sf_dir):
    return chunking.chunk_fixed_words(pages_text(spark, sf_dir))


def keyword_pages(spark, sf_dir):
    """Pages of even documents whose lines start with a keyword."""
    marked = F.replace(F.col("text"), F.lit("\n"), F.lit("\nIntroduction "))
    text = F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text"))
    return pages_text(spark, sf_dir).withColumn("text", text)


KEYWORD_PAGES = """keyword_pages AS (SELECT doc_id, page_num, CASE WHEN doc_id % 2 = 0
  THEN replace(text, chr(10), chr(10) || 'Introduction ') ELSE text END AS text FROM pages_text)"""
KEYWORD_SQL = """SELECT doc_id, page_num, CAST(i AS INTEGER) AS chunk_index, 'page_' || page_num || '_keyword_' || word AS chunk_name,
  substring(text, strpos(text, word) + length(word)) AS text
  FROM {source}, (VALUES (1, 'Introduction'), (2, 'Conclusion'), (3, 'References')) k(i, word)
  WHERE contains(text, word)"""


@register("chunk_keyword", with_(PAGED, PAGES, KEYWORD_PAGES) + KEYWORD_SQL.format(source="keyword_pages"))
def chunk_keyword(spark, sf_dir):
    return chunking.chunk_keywords(keyword_pages(spark, sf_dir))


def section_documents(spark, sf_dir):
    """Documents whose lines start with a section heading."""
    heading = F.concat(F.lit("\nSection "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" "))
    return paged_documents(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("\n"), heading))


SECTION_DOCS = """section_docs AS (SELECT doc_id,
  replace(text, chr(10), chr(10) || 'Section ' || (doc_id % 9 + 1) || ' ') AS text FROM paged)"""
SECTIONS = r"""section_parts AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(12), chr(10)),
    '(Chapter \d+|Section \d+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM {source}),
section_chunks AS (SELECT doc_id, CAST(NULL AS INTEGER) AS page_num, CAST(i AS INTEGER) AS chunk_index,
  'section_' || i AS chunk_name, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM section_parts))"""


@register("chunk_section", with_(PAGED, SECTION_DOCS, SECTIONS.format(source="section_docs")) + "SELECT * FROM section_chunks")
def chunk_section(spark, sf_dir):
    return chunking.chunk_sections(section_documents(spark, sf_dir))


# The clusters of each document's pieces, one round of the recursion at a time. Equal squares go to
# the first centre or piece, as squares are rounded before they are compared.
WIDTH = 64


def squares_sql(point, centers):
    return f"""[round(list_dot_product(c, c) - 2 * list_dot_product({point}, c) + list_dot_product({point}, {point}), 9)
      for c in {centers}]"""


def farthest_sql(centers):
    """The point farthest from its nearest centre."""
    least = f"[list_min({squares_sql('p', centers)}) for p in points]"
    return f"list_transform([{least}], lambda far: points[list_position(far, list_max(far))])[1]"


def start_sql(k):
    """The first point, then each time the one farthest from those chosen."""
    steps = ["start_1 AS (SELECT doc_id, points, [points[1]] AS centers FROM points)"]
    for n in range(2, k + 1):
        steps.append(
            f"""start_{n} AS (SELECT doc_id, points, CASE WHEN len(points) < {n} THEN centers
            ELSE list_append(centers, {farthest_sql("centers")}) END AS centers FROM start_{n - 1})"""
        )
    return steps


NEAREST = f"[list_transform([{squares_sql('p', 'centers')}], lambda far: list_position(far, list_min(far)))[1] for p in points]"
MEANS = f"""list_transform(centers, lambda old, j: CASE WHEN list_contains(found, j) THEN
    list_transform([list_filter(points, lambda p, i: found[i] = j)], lambda own:
      [list_sum([m[d] for m in own]) / len(own) for d in range(1, {WIDTH + 1})])[1]
    ELSE old END)"""
SEMANTIC = (
    """texts AS (SELECT doc_id, flatten([string_split(page, '.') for page in string_split(text, chr(12))]) AS pieces FROM paged)""",
    "piece_rows AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS place FROM texts)",
    hashed_sql("piece", "piece_rows", "doc_id, place", "piece"),
    f"""points AS MATERIALIZED (SELECT doc_id, list(coalesce(embedding, [0.0::DOUBLE for i in range({WIDTH})]) ORDER BY place) AS points
      FROM piece GROUP BY doc_id)""",
    *start_sql(semantic.CLUSTERS),
    f"""lloyd AS (SELECT doc_id, 0 AS attempt, found AS labels, {MEANS} AS centers, false AS done
        FROM (SELECT doc_id, points, centers, {NEAREST} AS found FROM start_{semantic.CLUSTERS})
      UNION ALL SELECT doc_id, attempt + 1, found, {MEANS}, found = labels
        FROM (SELECT doc_id, attempt, labels, centers, points, {NEAREST} AS found
          FROM lloyd JOIN points USING (doc_id) WHERE NOT done AND attempt < 99))""",
    """labelled AS (SELECT doc_id, pieces, labels, list_sort([list_position(labels, j) for j in list_distinct(labels)]) AS firsts
      FROM (SELECT doc_id, arg_max(labels, attempt) AS labels FROM lloyd GROUP BY doc_id) JOIN texts USING (doc_id))""",
    """semantic_chunks AS (SELECT doc_id, CAST(NULL AS INTEGER) AS page_num, CAST(n AS INTEGER) AS chunk_index,
      'cluster_' || n AS chunk_name,
      array_to_string(list_filter(pieces, lambda w, i: labels[i] = labels[firsts[n]]), chr(10)) AS text
      FROM (SELECT *, unnest(range(1, len(firsts) + 1)) AS n FROM labelled))""",
)


@register("chunk_semantic", recursive_with(PAGED, *SEMANTIC) + "SELECT * FROM semantic_chunks")
def chunk_semantic(spark, sf_dir):
    return semantic.chunk_semantic(paged_documents(spark, sf_dir))


@register("chunk_semantic_corpus")
def chunk_semantic_corpus(spark, sf_dir):
    return semantic.chunk_semantic_corpus(paged_documents(spark, sf_dir))


@register(
    "chunk_visual",
    with_(
        """shown AS (SELECT page_id, regexp_extract_all(replace(html, '<a href=', '<img src='),
          '<img[^>]*src="([^"]*)"', 1) AS images FROM pages)"""
    )
    + """SELECT page_id AS doc_id, 1 AS page_num, CAST(len(images) AS INTEGER) AS chunk_index,
      'page_1_visual_info' AS chunk_name, array_to_string(images, chr(10)) AS text FROM shown""",
)
def chunk_visual(spark, sf_dir):
    shown = F.replace(F.col("html"), F.lit("<a href="), F.lit("<img src="))
    paged = t.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit(1).alias("page_num"), tx.image_sources(shown).alias("images")
    )
    return chunking.chunk_visual(paged)


def para_documents(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return documents(spark, sf_dir).withColumn("text", spaced)


CHAR_CHUNKS = r"""paras AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n') AS ps
  FROM documents),
cut AS (SELECT doc_id, flatten([list_filter([
    {'t': substring(p, i, 100), 'last': i + 100 > length(p)} for i in range(1, greatest(length(p), 1) + 1, 100)],
    lambda x: NOT x.last OR length(regexp_replace(x.t, '\s+', '', 'g')) > 0) for p in ps]) AS parts FROM paras),
char_chunks AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i].t AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut))"""


@register("chunk_para_fixed", with_(CHAR_CHUNKS) + "SELECT * FROM char_chunks")
def chunk_para_fixed(spark, sf_dir):
    return chunking.chunk_chars(para_documents(spark, sf_dir))


# Packs the lines of a document one by one: ``done`` holds finished chunks, ``held`` the
# pieces of the chunk that is being filled.
SEP = "chr(10) || chr(10)"
TAIL = f"length(array_to_string(p.held[j:], {SEP}))"
KEPT = f"""list_filter(range(1, len(p.held) + 2), lambda j: j > len(p.held)
    OR ({TAIL} <= 50 AND {TAIL} + 2 + length(q.held[1]) <= 500))[1]"""
CHAR_OVERLAP = f"""cut AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
packed AS (SELECT doc_id, list_reduce([{{'done': []::VARCHAR[], 'held': [x]}} for x in lines], lambda p, q:
    CASE WHEN length(array_to_string(p.held, {SEP})) + 2 + length(q.held[1]) > 500
      THEN {{'done': list_append(p.done, array_to_string(p.held, {SEP})), 'held': list_concat(p.held[{KEPT}:], q.held)}}
      ELSE {{'done': p.done, 'held': list_concat(p.held, q.held)}} END) AS state FROM cut WHERE len(lines) > 0),
trimmed AS (SELECT doc_id, list_filter([regexp_replace(c, '^\\s+|\\s+$', '', 'g')
    for c in list_append(state.done, array_to_string(state.held, {SEP}))], lambda c: c <> '') AS parts FROM packed)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i] AS text
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM trimmed)"""


@register("chunk_char_overlap", "WITH " + CHAR_OVERLAP)
def chunk_char_overlap(spark, sf_dir):
    return splitter.chunk_overlap(para_double(spark, sf_dir), splitter.SPLIT_PLANS["char_500_50"])


def para_double(spark, sf_dir):
    """Documents whose line ends are empty lines."""
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return documents(spark, sf_dir).withColumn("text", doubled)


def quoted_sql(separator):
    return "'" + separator + "'" if separator.strip() or separator in ("", " ") else " || ".join("chr(10)" for _ in separator)


def split_sql(plan, text, separators, depth=0):
    """Raw chunks of ``text`` as a list: cut at the first separator that occurs, pack the
    pieces, and cut long pieces again with the separators that follow."""
    p, q, j, x = f"p{depth}", f"q{depth}", f"j{depth}", f"q{depth}.held[1]"
    held = f"array_to_string({p}.held, '')"
    tail = f"length(array_to_string({p}.held[{j}:], ''))"
    kept = f"""list_filter(range(1, len({p}.held) + 2), lambda {j}: {j} > len({p}.held)
      OR ({tail} <= {plan.overlap} AND {tail} + length({x}) <= {plan.size}))[1]"""
    branches = []
    for place, separator in enumerate(separators):
        finer = separators[place + 1 :]
        inner = split_sql(plan, x, finer, depth + 1) if finer else f"[{x}]"
        cut = f"string_split({text}, {quoted_sql(separator)})"
        pieces = f"list_concat([{cut}[1]], [{quoted_sql(separator)} || w for w in {cut}[2:]])" if separator else cut
        state = f"""list_reduce([{{'done': []::VARCHAR[], 'held': [w]}} for w in {pieces} if w <> ''], lambda {p}, {q}:
          CASE WHEN length({x}) > {plan.size} THEN {{'done': list_concat({p}.done,
              CASE WHEN len({p}.held) > 0 THEN [{held}] ELSE [] END, {inner}), 'held': []::VARCHAR[]}}
            WHEN len({p}.held) > 0 AND length({held}) + length({x}) > {plan.size}
              THEN {{'done': list_append({p}.done, {held}), 'held': list_concat({p}.held[{kept}:], {q}.held)}}
            ELSE {{'done': {p}.done, 'held': list_concat({p}.held, {q}.held)}} END,
          {{'done': []::VARCHAR[], 'held': []::VARCHAR[]}})"""
        chunks = f"list_transform([{state}], lambda s{depth}: list_concat(s{depth}.done, CASE WHEN len(s{depth}.held) > 0 THEN [array_to_string(s{depth}.held, '')] ELSE [] END))[1]"
        test = f"contains({text}, {quoted_sql(separator)})"
        branches.append(f"WHEN {test} THEN {chunks}" if finer else f"ELSE {chunks}")
    return f"CASE {' '.join(branches)} END" if len(branches) > 1 else branches[0].removeprefix("ELSE ")


def recursive_sql(name, plan):
    raw = split_sql(plan, "text", plan.separators)
    return f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, parts[i] AS text, '{name}' AS plan
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, list_filter([regexp_replace(c, '^\\s+|\\s+$', '', 'g') for c in {raw}], lambda c: c <> '') AS parts FROM documents))"""


RECURSIVE = {name: plan for name, plan in splitter.SPLIT_PLANS.items() if plan.recursive}


@register("chunk_recursive_overlap", "\nUNION ALL ".join(recursive_sql(name, plan) for name, plan in RECURSIVE.items()))
def chunk_recursive_overlap(spark, sf_dir):
    """All recursive plans on the same documents, tagged with the plan."""
    return splitter.chunk_overlap_plans(documents(spark, sf_dir), RECURSIVE)


def blanked_documents(spark, sf_dir):
    """Documents of which the shortest are blank."""
    text = F.when(F.length("text") < 400, F.lit(" \n\t ")).otherwise(F.col("text"))
    return documents(spark, sf_dir).withColumn("text", text)


@register("chunk_empty_guard", "SELECT doc_id, 'blank text' AS reason FROM documents WHERE length(text) < 400")
def chunk_empty_guard(spark, sf_dir):
    pieces = chunking.char_pieces(F.col("text"), chunking.CHARS_PER_CHUNK)
    return chunking.blank_documents(blanked_documents(spark, sf_dir), pieces)


def all_mode_pages(spark, sf_dir):
    """Pages with one table, whose rows are lines and cells are words, and the capitalised
    words as image names."""
    lines = F.split("text", "\n")
    cells = F.transform(lines, lambda line: F.transform(F.split(line, " "), lambda w: F.nullif(w, F.lit("de"))))
    images = F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)[.]"), F.lit(1))
    return chunking.pages(paged_documents(spark, sf_dir)).select(
        "doc_id", "page_num", "text", F.array(cells).alias("tables"), images.alias("images")
    )


def all_mode_sql():
    kinds = [
        ("paragraph", "paragraph_chunks", PARAGRAPHS),
        ("sentence", "sentence_chunks", SENTENCES),
        (
            "table",
            "table_chunks",
            """[array_to_string([array_to_string([CASE WHEN w = 'de' THEN '' ELSE w END
              for w in string_split(line, ' ')], chr(9)) for line in string_split(text, chr(10))], chr(10))]""",
        ),
        ("chunk", "fixed_size_chunks", WINDOWS),
    ]
    ctes, selects = [PAGED, PAGES, SECTIONS.format(source="paged")], []
    for label, kind, pieces in kinds:
        cte = exploded_sql("pages_text", pieces, label)
        ctes.append(cte.replace("pieces AS", f"{label}_pieces AS").replace("FROM pieces", f"FROM {label}_pieces").replace("chunks AS", f"{label}_rows AS"))
        selects.append(f"SELECT *, '{kind}' AS chunk_type FROM {label}_rows")
    selects.append(f"SELECT *, 'page_chunks' FROM ({PAGE_SQL})")
    selects.append(f"SELECT *, 'keyword_chunks' FROM ({KEYWORD_SQL.format(source='pages_text')})")
    selects.append("SELECT *, 'section_chunks' FROM section_chunks")
    images = "regexp_extract_all(text, '([A-Z][a-z]+)[.]', 1)"
    selects.append(
        f"""SELECT doc_id, page_num, CAST(len({images}) AS INTEGER), 'page_' || page_num || '_visual_info',
        array_to_string({images}, chr(10)), 'visual_chunks' FROM pages_text"""
    )
    ctes.extend(SEMANTIC)
    selects.append("SELECT *, 'semantic_chunks' FROM semantic_chunks")
    return recursive_with(*ctes) + "\nUNION ALL ".join(selects)


@register("chunk_all_modes", all_mode_sql())
def chunk_all_modes(spark, sf_dir):
    """All nine strategies."""
    docs = paged_documents(spark, sf_dir)
    return chunking.chunk_all(all_mode_pages(spark, sf_dir), docs, semantic.chunk_semantic(docs))
