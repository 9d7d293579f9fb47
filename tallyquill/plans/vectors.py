"""Registered queries on the vector store, search and question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyquill.functions import naming
from tallyquill.functions.embedding import hash64_model, scaled
from tallyquill.operators import answers, codes, nearest, neardup, splitter, store
from tallyquill.plans import documents as dp
from tallyquill.plans import tables as t
from tallyquill.plans.registry import Registry, with_
from tallyquill.session import fresh_path, written

register = Registry()


# --- tables -------------------------------------------------------------------------


def vectors(spark, sf_dir):
    """The given embeddings as a store: a collection per label."""
    return t.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("collection"),
        F.col("vec_id").alias("id"),
        F.concat(F.lit("doc_"), (F.col("vec_id") % 100).cast("string")).alias("source"),
        F.concat(F.lit("text of vector "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


VECTORS = """vectors AS (SELECT CAST(label AS VARCHAR) AS collection, vec_id AS id,
  'doc_' || (vec_id % 100) AS source, 'text of vector ' || vec_id AS text,
  CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""


def collection_centres(spark, sf_dir):
    """Mean vector of each collection, as queries."""
    axes = vectors(spark, sf_dir).select("collection", F.posexplode("embedding").alias("axis", "x"))
    means = axes.groupBy("collection", "axis").agg(F.round(F.avg("x"), 6).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("axis", "mean")))
    return means.groupBy(F.col("collection").alias("qid")).agg(
        F.transform(ordered, lambda pair: pair["mean"]).alias("embedding")
    )


CENTRES = """axes AS (SELECT collection, i, embedding[i] AS x FROM (
    SELECT collection, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM vectors)),
means AS (SELECT collection, i, round(avg(x), 6) AS mean FROM axes GROUP BY ALL),
centres AS (SELECT collection AS qid, list(mean ORDER BY i) AS embedding FROM means GROUP BY collection)"""


CHUNK_PLAN = "recursive_1000_100"
_CHUNKED: dict[tuple[str, str], str] = {}


def embedded_chunks(spark, sf_dir):
    """Chunks of all documents with their built-in vectors."""
    docs = t.spread(t.table(spark, sf_dir, "documents").select(F.struct("source", "doc_id").alias("key"), "text"))
    pieces = splitter.chunk_overlap(docs, splitter.SPLIT_PLANS[CHUNK_PLAN], "key")
    source = F.concat("key.source", F.lit("/"), F.col("key.doc_id").cast("string"), F.lit(".txt"))
    chunks = pieces.select(
        F.col("key.source").alias("collection"),
        naming.positional_id(source, F.col("chunk_index")).alias("id"),
        source.alias("source"),
        "text",
    )
    return store.embed(chunks)


def document_store(spark, sf_dir):
    """The stored chunks: cut, embedded and written once per session and folder of tables, partitioned by
    collection, and read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir)
    rows = embedded_chunks(spark, sf_dir)
    if key not in _CHUNKED:
        _CHUNKED[key] = stored_at(spark, rows)
    return store.read(spark, _CHUNKED[key], rows.schema)


STORE = dp.hashed_sql(
    "store",
    f"({dp.recursive_sql(CHUNK_PLAN, splitter.SPLIT_PLANS[CHUNK_PLAN])}) JOIN (SELECT doc_id, source AS folder FROM documents) USING (doc_id)",
    "folder AS collection, folder || '/' || doc_id || '.txt_chunk_' || chunk_index AS id, folder || '/' || doc_id || '.txt' AS source, text",
    "text",
)
DOC_STORE = dp.hashed_sql(
    "store",
    "documents",
    "source AS collection, doc_id AS id, source || '/' || doc_id || '.txt' AS source, text",
    "text",
)


def questions(spark, sf_dir):
    """All user turns, the canned and listing phrases, and a question without words."""
    asked = (
        t.table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    )
    phrases = [*answers.REPLIES, *answers.LISTING_PHRASES, " Hello ", "?!"]
    fixed = spark.createDataFrame([(-i, p) for i, p in enumerate(phrases, start=1)], "qid bigint, question string")
    return asked.unionByName(fixed)


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


QUESTIONS = (
    "questions AS (SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'\n"
    + "UNION ALL SELECT * FROM (VALUES "
    + ", ".join(
        f"({-i}, {_quoted(p)})"
        for i, p in enumerate([*answers.REPLIES, *answers.LISTING_PHRASES, " Hello ", "?!"], start=1)
    )
    + ") v(qid, question))"
)
ASKED = "lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))"
ROUTED = (
    f"routed AS (SELECT *, CASE WHEN {ASKED} IN ("
    + ", ".join(map(_quoted, answers.REPLIES))
    + f") THEN 'casual' WHEN {ASKED} IN ("
    + ", ".join(map(_quoted, answers.LISTING_PHRASES))
    + ") THEN 'sources' ELSE 'database' END AS route FROM questions)"
)

L2SQ = "list_sum([(q.embedding[i] - v.embedding[i]) * (q.embedding[i] - v.embedding[i]) for i in range(1, len(v.embedding) + 1)])"
IP = "1 - list_sum([q.embedding[i] * v.embedding[i] for i in range(1, len(v.embedding) + 1)])"
COSINE = (
    "1 - list_sum([q.embedding[i] * v.embedding[i] for i in range(1, len(v.embedding) + 1)])"
    " / (sqrt(list_sum([x * x for x in q.embedding])) * sqrt(list_sum([x * x for x in v.embedding])))"
)


def top_sql(name, queries, stored, k, distance=L2SQ, where="TRUE"):
    return f"""{name}_pairs AS (SELECT q.qid, v.id, round({distance}, 12) AS far FROM {queries} q, {stored} v
  WHERE {where} AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL),
{name} AS (SELECT qid, id, far AS distance,
    CAST(row_number() OVER (PARTITION BY qid ORDER BY far, id) AS INTEGER) AS rank
  FROM {name}_pairs QUALIFY rank <= {k})"""


def shown(found):
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


# --- storing ------------------------------------------------------------------------


@register(
    "embed_chunks",
    with_(STORE)
    + """SELECT id, 'hash64' AS embedder_id,
    array_to_string([CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR) for x in embedding], ',') AS embedding FROM store""",
)
def embed_chunks(spark, sf_dir):
    return embedded_chunks(spark, sf_dir).select("id", "embedder_id", scaled(F.col("embedding")).alias("embedding"))


@register(
    "embed_retry_failures",
    with_(QUESTIONS, dp.hashed_sql("asked", "questions", "qid, question", "question"))
    + """SELECT qid, array_to_string([CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR) for x in embedding], ',') AS embedding,
    CASE WHEN embedding IS NULL THEN 'ValueError: no words' END AS error,
    CAST(CASE WHEN embedding IS NULL THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM asked""",
)
def embed_retry_failures(spark, sf_dir):
    """Questions without a word cannot be embedded: their rows stay, with the error."""
    asked = questions(spark, sf_dir).withColumnRenamed("question", "text")
    called = store.embed_batches(asked, hash64_model, wait_seconds=0.0)
    return called.select("qid", scaled(F.col("embedding")).alias("embedding"), "error", "attempts")


def deliveries(spark, sf_dir):
    """Documents in two deliveries: short ones are stored, then the long ones arrive
    together with a newer version of the very short ones."""
    ids = t.table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") != "de", F.col("source")).alias("collection"),  # some have no collection
        "doc_id",
        F.concat("source", F.lit("/"), F.col("lang")).alias("source"),
        "text",
        "n_chars",
        naming.positional_id(F.col("source"), F.col("doc_id")).alias("id"),
    )
    old = ids.where("n_chars < 2000").withColumn("version", F.lit(1))
    new = ids.where("n_chars >= 2000 OR n_chars < 500").withColumn("version", F.lit(2))
    revised = F.when(F.col("n_chars") < 500, F.concat(F.lit("revised "), "text")).otherwise(F.col("text"))
    return old.drop("n_chars"), new.withColumn("text", revised).drop("n_chars")


def stored_at(spark, rows):
    """Write rows as a new store; its folder."""
    path = fresh_path(spark, "store")
    store.create(rows, path)
    return path


DELIVERIES = """base AS (SELECT CASE WHEN lang <> 'de' THEN source END AS collection, doc_id, source || '/' || lang AS source, text, n_chars,
    source || '_chunk_' || doc_id AS id FROM documents),
old AS (SELECT * EXCLUDE (n_chars), 1 AS version FROM base WHERE n_chars < 2000),
new AS (SELECT collection, doc_id, source, CASE WHEN n_chars < 500 THEN 'revised ' || text ELSE text END AS text, id, 2 AS version
  FROM base WHERE n_chars >= 2000 OR n_chars < 500)"""


@register("vector_append", with_(DELIVERIES) + "SELECT * FROM old UNION ALL SELECT * FROM new")
def vector_append(spark, sf_dir):
    old, new = deliveries(spark, sf_dir)
    path = stored_at(spark, old)
    store.add(new, path)
    return store.read(spark, path, old.schema)


@register(
    "vector_upsert",
    with_(DELIVERIES)
    + """SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""",
)
def vector_upsert(spark, sf_dir):
    old, new = deliveries(spark, sf_dir)
    path = stored_at(spark, old)
    store.upsert_into(store.read(spark, path, old.schema), path, new, ["id"], [F.col("version")])
    return store.read(spark, path, old.schema)


@register(
    "sink_chunks_skip_existing",
    with_(DELIVERIES) + "SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)",
)
def sink_chunks_skip_existing(spark, sf_dir):
    old, new = deliveries(spark, sf_dir)
    return store.add_missing(old, new, ["id"])


@register(
    "vector_delete_source",
    with_(VECTORS)
    + "SELECT collection, id, source, text FROM vectors WHERE source NOT IN (SELECT 'doc_' || s_suppkey FROM supplier WHERE s_acctbal < 0)",
)
def vector_delete_source(spark, sf_dir):
    gone = t.table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    names = gone.select(F.concat(F.lit("doc_"), F.col("s_suppkey").cast("string")).alias("source"))
    rows = vectors(spark, sf_dir)
    path = stored_at(spark, rows)
    store.delete_sources_in(store.read(spark, path, rows.schema), path, names)
    return store.read(spark, path, rows.schema).select("collection", "id", "source", "text")


@register(
    "stale_tail_cleanup",
    with_(DELIVERIES)
    + "SELECT * FROM old WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT * FROM new",
)
def stale_tail_cleanup(spark, sf_dir):
    old, new = deliveries(spark, sf_dir)
    path = stored_at(spark, old)
    store.replace_sources_in(store.read(spark, path, old.schema), path, new)
    return store.read(spark, path, old.schema)


COPIES = """chunks AS (SELECT lang AS collection, doc_id, source, text, md5(text) AS content_id FROM documents)"""


def copies(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("collection"), "doc_id", "source", "text")


@register("chunk_id_md5", "SELECT doc_id, md5(text) AS content_id FROM documents")
def chunk_id_md5(spark, sf_dir):
    return copies(spark, sf_dir).select("doc_id", naming.content_id(F.col("text")).alias("content_id"))


@register(
    "dedup_content",
    with_(COPIES) + "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY collection, content_id ORDER BY doc_id) = 1",
)
def dedup_content(spark, sf_dir):
    return store.dedup_content(copies(spark, sf_dir), ["doc_id"])


@register(
    "dedup_content_stored",
    with_(COPIES)
    + """, stored AS (SELECT lang AS collection, md5(text) AS content_id FROM documents WHERE n_chars < 500)
    SELECT * FROM chunks WHERE (collection, content_id) NOT IN (SELECT (collection, content_id) FROM stored)
    QUALIFY row_number() OVER (PARTITION BY collection, content_id ORDER BY doc_id) = 1""",
)
def dedup_content_stored(spark, sf_dir):
    """New chunks when all short documents are already stored."""
    stored = t.table(spark, sf_dir, "documents").where("n_chars < 500").select(
        F.col("lang").alias("collection"), F.md5("text").alias("content_id")
    )
    return store.dedup_content(copies(spark, sf_dir), ["doc_id"], stored)


@register(
    "dedup_nearest",
    with_(DOC_STORE)
    + """SELECT id AS doc_id, source, collection FROM store
    QUALIFY row_number() OVER (PARTITION BY collection, coalesce(CAST(embedding AS VARCHAR), md5(text)) ORDER BY id) = 1""",
)
def dedup_nearest(spark, sf_dir):
    return store.dedup_nearest(source_chunks(spark, sf_dir), ["doc_id"]).select("doc_id", "source", "collection")


NEAR = 0.05


def near_sql(stored):
    """Chunks without an earlier one, or a stored one, within the distance."""
    far = L2SQ.replace("q.", "a.").replace("v.", "b.")
    return f"""SELECT a.id AS doc_id, a.source, a.collection FROM store a WHERE {"NOT " + stored.replace("store", "a") + " AND " if stored else ""}NOT EXISTS (
    SELECT 1 FROM store b WHERE a.collection IS NOT DISTINCT FROM b.collection AND (b.id < a.id{" OR " + stored.replace("store", "b") if stored else ""})
    AND CASE WHEN a.embedding IS NULL OR b.embedding IS NULL THEN a.embedding IS NULL AND b.embedding IS NULL AND a.text = b.text
      ELSE round({far}, 12) <= {NEAR} END)"""


def source_chunks(spark, sf_dir):
    docs = t.spread(t.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(
        "doc_id", F.col("source").alias("collection"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), "text",
    )


@register("dedup_near", with_(DOC_STORE) + near_sql(""))
def dedup_near(spark, sf_dir):
    return neardup.dedup_near(source_chunks(spark, sf_dir), ["doc_id"], NEAR).select("doc_id", "source", "collection")


@register("dedup_near_stored", with_(DOC_STORE) + near_sql("(store.id % 3 = 0)"))
def dedup_near_stored(spark, sf_dir):
    """A third of the documents is stored; the others arrive."""
    rows = source_chunks(spark, sf_dir)
    stored = store.embed(rows.where("doc_id % 3 = 0"))
    kept = neardup.dedup_near(rows.where("doc_id % 3 <> 0"), ["doc_id"], NEAR, stored)
    return kept.select("doc_id", "source", "collection")


# --- inspecting ---------------------------------------------------------------------


@register("vector_get", with_(VECTORS) + "SELECT id, text, source FROM vectors WHERE collection = '3'")
def vector_get(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    stored = store.read(spark, stored_at(spark, rows), rows.schema)
    return store.get(stored, "3", ["text", "source"])


@register(
    "list_collections",
    with_(VECTORS)
    + "SELECT DISTINCT collection, (SELECT count(DISTINCT collection) FROM vectors) AS total_collections FROM vectors",
)
def list_collections(spark, sf_dir):
    return store.list_collections(vectors(spark, sf_dir))


def ints_sql(vector):
    return f"array_to_string([CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR) for x in {vector}], ',')"


@register(
    "inspect_collection",
    with_(VECTORS)
    + f"""SELECT collection, count(text) AS documents, count(source) AS metadatas, count(embedding) AS embeddings,
    arg_min(substring(text, 1, 50), id) AS sample_document, arg_min(source, id) AS sample_source,
    {ints_sql('arg_min(embedding[1:10], id)')} AS sample_embedding FROM vectors GROUP BY collection""",
)
def inspect_collection(spark, sf_dir):
    report = store.inspect(vectors(spark, sf_dir), "id")
    return report.withColumn("sample_embedding", scaled(F.col("sample_embedding")))


@register(
    "preview_chunks",
    with_(VECTORS)
    + f"""SELECT collection, id, source, substring(text, 1, 10) || '...' AS preview,
    {ints_sql('embedding[1:5]')} AS first_dims FROM vectors""",
)
def preview_chunks(spark, sf_dir):
    report = store.preview(vectors(spark, sf_dir), chars=store.SHORT_CHARS)
    return report.withColumn("first_dims", scaled(F.col("first_dims")))


@register(
    "ingest_metrics",
    with_(STORE)
    + """SELECT collection AS source, count(*) AS chunks, count(embedding) AS embeddings,
    count(*) - count(embedding) AS failures, count(*) - count(DISTINCT md5(text)) AS duplicates FROM store GROUP BY collection""",
)
def ingest_metrics(spark, sf_dir):
    return store.ingest_metrics(document_store(spark, sf_dir).withColumn("source", F.col("collection")))


# --- searching ----------------------------------------------------------------------

CHOSEN = "SELECT qid, id, round(distance, 6) AS distance, rank FROM found"


@register("knn_topk", with_(VECTORS, CENTRES, top_sql("found", "centres", "vectors", 3)) + CHOSEN)
def knn_topk(spark, sf_dir):
    return shown(nearest.nearest(collection_centres(spark, sf_dir), vectors(spark, sf_dir)))


@register(
    "knn_metric",
    with_(
        VECTORS,
        CENTRES,
        top_sql("l2sq", "centres", "vectors", 3),
        top_sql("cosine", "centres", "vectors", 3, COSINE),
        top_sql("ip", "centres", "vectors", 3, IP),
    )
    + "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, qid, id, round(distance, 6) AS distance, rank FROM {m}" for m in nearest.METRICS
    ),
)
def knn_metric(spark, sf_dir):
    centres, stored = collection_centres(spark, sf_dir), vectors(spark, sf_dir)
    found = [
        nearest.nearest(centres, stored, metric=metric).withColumn("metric", F.lit(metric))
        for metric in nearest.METRICS
    ]
    return shown(found[0].unionByName(found[1]).unionByName(found[2]))


@register(
    "knn_filtered",
    with_(VECTORS, CENTRES, top_sql("found", "centres", "vectors", 3, where="v.source = 'doc_7'")) + CHOSEN,
)
def knn_filtered(spark, sf_dir):
    stored = vectors(spark, sf_dir).where("source = 'doc_7'")
    return shown(nearest.nearest(collection_centres(spark, sf_dir), stored))


@register(
    "knn_in_collection",
    with_(VECTORS, CENTRES, top_sql("found", "centres", "vectors", 5, where="q.qid = v.collection")) + CHOSEN,
)
def knn_in_collection(spark, sf_dir):
    """Each query searches only the collection it is the centre of."""
    centres = collection_centres(spark, sf_dir).withColumn("collection", F.col("qid"))
    return shown(nearest.nearest_in_group(centres, vectors(spark, sf_dir), "collection", k=5))


def approx_queries(spark, sf_dir):
    """The centres, and every row whose id is divisible by 100, so that their number grows with the table."""
    stored = vectors(spark, sf_dir).where("id % 100 = 0")
    rows = stored.select(F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("qid"), "embedding")
    return collection_centres(spark, sf_dir).unionByName(rows)


def coded_vectors(spark, sf_dir):
    """The vectors with their codes, written once per session and folder of tables, and the codes' centres."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CODED:
        rows = vectors(spark, sf_dir)
        book = codes.fit(rows)
        _CODED[key] = written(codes.encode(rows, book), "codes")[1], book
    path, book = _CODED[key]
    return spark.read.parquet(path), book


_CODED: dict[tuple[str, str], tuple[str, codes.Codes]] = {}


@register("knn_approx")
def knn_approx(spark, sf_dir):
    """Codes of all rows are scanned; full vectors are read for short lists of six rows per query."""
    coded, book = coded_vectors(spark, sf_dir)
    return shown(codes.nearest_coded(approx_queries(spark, sf_dir), coded, book))


@register("knn_approx_recall")
def knn_approx_recall(spark, sf_dir):
    """Recall of the approximate search over all of its queries, and for how many rows it reads full vectors."""
    coded, book = coded_vectors(spark, sf_dir)
    asked = approx_queries(spark, sf_dir)
    listed = codes.short_lists(asked, coded, book, codes.SHORT * nearest.TOP_K)
    found = codes.nearest_coded(asked, coded, book)
    report = codes.recall(found, asked, vectors(spark, sf_dir))
    full = listed.agg(F.countDistinct("id")).scalar()
    return report.withColumn("full_vectors", full).withColumn("rows", coded.agg(F.count("*")).scalar())


ASKED_VECTORS = dp.hashed_sql("asked", "(SELECT * FROM routed WHERE route = 'database')", "qid, question, route", "question")
HITS = (STORE, QUESTIONS, ROUTED, ASKED_VECTORS, top_sql("found", "asked", "store", 5))


def hits(spark, sf_dir, k=answers.CONTEXT_CHUNKS):
    asked = answers.route(questions(spark, sf_dir)).where("route = 'database'")
    return answers.retrieve(asked, document_store(spark, sf_dir), k)


@register(
    "retrieve_by_text",
    with_(*HITS) + "SELECT qid, id, round(distance, 6) AS distance, rank, source, text FROM found JOIN store USING (id) WHERE rank <= 3",
)
def retrieve_by_text(spark, sf_dir):
    return shown(hits(spark, sf_dir, k=nearest.TOP_K))


# --- answering ----------------------------------------------------------------------


@register("qa_route", with_(QUESTIONS, ROUTED) + "SELECT qid, question, route FROM routed")
def qa_route(spark, sf_dir):
    return answers.route(questions(spark, sf_dir))


REPLY_SQL = "CASE " + " ".join(f"WHEN {ASKED} = {_quoted(p)} THEN {_quoted(r)}" for p, r in answers.REPLIES.items()) + " END"


def greeting_sql(style):
    phrases, text = answers.GREETINGS[style]
    return f"CASE WHEN {ASKED} IN ({', '.join(map(_quoted, phrases))}) THEN {_quoted(text)} END"


@register(
    "qa_canned_answers",
    with_(QUESTIONS)
    + f"SELECT qid, {REPLY_SQL} AS reply, {greeting_sql('short')} AS short_reply, {greeting_sql('long')} AS long_reply FROM questions",
)
def qa_canned_answers(spark, sf_dir):
    question = F.col("question")
    return questions(spark, sf_dir).select(
        "qid",
        answers.canned_reply(question).alias("reply"),
        answers.greeting_reply(question, "short").alias("short_reply"),
        answers.greeting_reply(question, "long").alias("long_reply"),
    )


@register(
    "qa_list_sources",
    with_(VECTORS) + "SELECT DISTINCT '- ' || source AS line FROM vectors",
)
def qa_list_sources(spark, sf_dir):
    return answers.source_listing(vectors(spark, sf_dir))


CONTEXT = """context AS (SELECT qid, count(*) AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM found JOIN store USING (id) GROUP BY qid)"""


@register("qa_context", with_(*HITS, CONTEXT) + "SELECT * FROM context")
def qa_context(spark, sf_dir):
    return answers.context(answers.gather(hits(spark, sf_dir)))


ONE_SOURCE = "source || chr(10) || ' - ' || chr(10) || substring(text, 1, 200) || '...' || chr(10) || chr(10)"


@register(
    "qa_sources",
    with_(*HITS)
    + f"""SELECT qid, string_agg({ONE_SOURCE}, '|' ORDER BY rank) AS sources FROM found JOIN store USING (id)
    WHERE rank <= 3 GROUP BY qid""",
)
def qa_sources(spark, sf_dir):
    return answers.gather(hits(spark, sf_dir)).select("qid", F.array_join("sources", "|").alias("sources"))


BEST = "best AS (SELECT qid, text AS answer FROM found JOIN store USING (id) WHERE rank = 1)"


@register(
    "qa_fallback",
    with_(*HITS, BEST)
    + f"""SELECT qid, coalesce(answer, {_quoted(answers.FALLBACKS['rephrase'])}) AS answer
    FROM (SELECT * FROM routed WHERE route = 'database') LEFT JOIN best USING (qid)""",
)
def qa_fallback(spark, sf_dir):
    asked = answers.route(questions(spark, sf_dir)).where("route = 'database'")
    return answers.answered(asked, answers.gather(hits(spark, sf_dir)), wording="rephrase").select("qid", "answer")


SHOWN = f"""shown AS (SELECT qid, string_agg(rank || '. ' || {ONE_SOURCE} || chr(10), '' ORDER BY rank) AS lines,
  string_agg('- ' || source || chr(10), '' ORDER BY rank) AS bullets
  FROM found JOIN store USING (id) WHERE rank <= 3 GROUP BY qid)"""
REVIEWED = f"""reviewed AS (SELECT qid, route, 'Answer:' || chr(10) || coalesce(answer, {_quoted(answers.UNKNOWN)}) || chr(10) || chr(10)
    || 'Sources:' || chr(10) || coalesce(lines, 'None') AS formatted,
  CASE WHEN bullets IS NOT NULL THEN 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Sources:' || chr(10) || bullets
    ELSE {_quoted(answers.NOTHING_RELEVANT)} END AS bulleted
  FROM (SELECT * FROM routed WHERE route = 'database') LEFT JOIN best USING (qid) LEFT JOIN shown USING (qid))"""


@register("qa_review_format", with_(*HITS, BEST, SHOWN, REVIEWED) + "SELECT qid, formatted, bulleted FROM reviewed")
def qa_review_format(spark, sf_dir):
    asked = answers.route(questions(spark, sf_dir)).where("route = 'database'")
    rows = answers.answered(asked, answers.gather(hits(spark, sf_dir)))
    return rows.select(
        "qid",
        answers.review(F.col("answer"), F.col("sources")).alias("formatted"),
        answers.review_bullets(F.col("answer"), F.col("names")).alias("bulleted"),
    )


@register(
    "qa_personalize",
    """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN string_split(text, chr(10))[1] ELSE text END AS answer FROM conversations""",
)
def qa_personalize(spark, sf_dir):
    preference = F.when(F.col("conv_id") % 2 == 0, "concise").otherwise("detailed")
    rows = t.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", answers.personalize(F.col("text"), preference).alias("answer"))


@register(
    "qa_end_to_end",
    with_(*HITS, BEST, SHOWN, REVIEWED)
    + f"""SELECT qid, route, formatted FROM reviewed
    UNION ALL SELECT qid, route, {REPLY_SQL} FROM routed WHERE route = 'casual'
    UNION ALL SELECT qid, route, {_quoted(answers.LISTING_INTRO)} || (SELECT count(DISTINCT source) FROM store)
    FROM routed WHERE route = 'sources'""",
)
def qa_end_to_end(spark, sf_dir):
    return answers.answer_all(questions(spark, sf_dir), document_store(spark, sf_dir))
