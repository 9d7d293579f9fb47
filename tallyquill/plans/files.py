"""Registered queries on files, names, change detection and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyquill.functions import naming
from tallyquill.functions import text as tx
from tallyquill.functions.embedding import scaled
from tallyquill.operators import arima, chunking, inventory, manifest, store
from tallyquill.plans import documents as dp
from tallyquill.plans import inventory as stock
from tallyquill.plans import tables as t
from tallyquill.plans import vectors as vec
from tallyquill.plans.registry import Registry, with_
from tallyquill.session import fresh_path, written
from tallyquill.sources import files as src
from tallyquill.sources import tables as io

register = Registry()

# --- files derived from the documents ------------------------------------------------

# The file type of each document, by its id.
KINDS = ("txt", "log", "md", "csv", "json", "xml", "html", "pdf", "docx")


def escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def plain_files(spark, sf_dir, edit=None):
    """All documents as files of nine types whose bytes are the text."""
    return files(spark, sf_dir, edit, plain=True)


def files(spark, sf_dir, edit=None, plain=False):
    """Documents as files of nine types, in the shape of Spark's binary file source."""
    docs = t.spread(t.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    if edit is not None:
        docs = edit(docs)
    number = F.col("doc_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    body = (
        F.when(
            kind == "csv",
            F.concat(
                F.lit("doc_id,source,note,text\n"), number, F.lit(","), "source", F.lit(',,"'),
                F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n'),
            ),
        )
        .when(
            kind == "json",
            F.concat(
                F.to_json(F.struct("doc_id", "source", F.hex(F.encode("text", "UTF-8")).alias("body"))),
                F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise("{broken"),
            ),
        )
        .when(kind == "xml", F.concat(F.lit("<doc><id>"), number, F.lit("</id><body>"), escaped(F.col("text")), F.lit("</body></doc>")))
        .when(kind == "html", F.concat(F.lit("<html><body><p>"), escaped(F.col("text")), F.lit("</p></body></html>")))
        .otherwise(F.col("text"))
    )
    content = F.encode(F.col("text") if plain else body, "UTF-8")
    return docs.select(
        F.concat("source", F.lit("/"), number, F.lit(".v1."), kind).alias("path"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("doc_id") * 1_250_000).alias("modificationTime"),
        F.length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


KIND_SQL = "['" + "', '".join(KINDS) + "'][doc_id % 9 + 1]"
FILES = f"""files AS (SELECT doc_id, source, text, {KIND_SQL} AS kind,
  source || '/' || doc_id || '.v1.' || {KIND_SQL} AS path FROM documents)"""
EXTRACTED = """extracted AS (SELECT path, kind AS suffix,
  CASE WHEN kind IN ('txt', 'log', 'md', 'html') THEN text
       WHEN kind = 'csv' THEN 'doc_id' || chr(9) || 'source' || chr(9) || 'note' || chr(9) || 'text' || chr(10)
         || doc_id || chr(9) || source || chr(9) || 'NaN' || chr(9) || text
       WHEN kind = 'json' AND doc_id % 2 = 0 THEN '{' || chr(10) || '    "doc_id": ' || doc_id || ',' || chr(10)
         || '    "source": "' || source || '",' || chr(10) || '    "body": "' || hex(encode(text)) || '"' || chr(10) || '}'
       WHEN kind = 'xml' THEN doc_id || text END AS text,
  CASE WHEN kind IN ('pdf', 'docx') THEN 'no decoder for this type'
       WHEN kind = 'json' AND doc_id % 2 = 1 THEN 'unreadable content' END AS reason FROM files)"""


@register("ingest_dispatch", with_(FILES, EXTRACTED) + "SELECT * FROM extracted")
def ingest_dispatch(spark, sf_dir):
    return src.extract(files(spark, sf_dir))


@register("ingest_quarantine", with_(FILES, EXTRACTED) + "SELECT path, reason FROM extracted WHERE reason IS NOT NULL")
def ingest_quarantine(spark, sf_dir):
    return src.quarantine(src.extract(files(spark, sf_dir)))


@register("ingest_text", with_(FILES) + "SELECT path, text FROM files WHERE kind IN ('txt', 'log', 'md')")
def ingest_text(spark, sf_dir):
    plain = src.with_suffix(files(spark, sf_dir), src.PLAIN_TYPES)
    return plain.select("path", src.utf8_text(F.col("content")).alias("text"))


@register("ingest_text_charset", "SELECT doc_id, text FROM documents")
def ingest_text_charset(spark, sf_dir):
    """Every other document is Latin-1 bytes; the text comes back whole."""
    docs = t.table(spark, sf_dir, "documents")
    latin = F.encode("text", "ISO-8859-1")
    content = F.when(F.col("doc_id") % 2 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", src.any_text(content).alias("text"))


@register("ingest_json_as_text", "SELECT event_id, json_pretty(props) AS text FROM events")
def ingest_json_as_text(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", src.json_text(F.col("props")).alias("text"))


@register("ingest_xml_text", "SELECT doc_id, doc_id || text AS text FROM documents")
def ingest_xml_text(spark, sf_dir):
    body = F.concat(F.lit("<doc><id>"), F.col("doc_id").cast("string"), F.lit("</id><p>"), escaped(F.col("text")), F.lit("</p></doc>"))
    return t.table(spark, sf_dir, "documents").select("doc_id", src.xml_text(body).alias("text"))


HTML_SQL = "html"
for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
    HTML_SQL = f"regexp_replace({HTML_SQL}, '{pattern}', '', 'g')"
# The entities of the given pages, and of the line that every page gets here.
PAGE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
    ("&mdash;", "—"), ("&#8217;", "’"), ("&#x27;", "'"), ("&euro;", "€"), ("&#128;", "€"), ("&#x1F600;", "😀"),
)
for entity, char in (*PAGE_ENTITIES, ("&amp;", "&")):
    HTML_SQL = f"replace({HTML_SQL}, '{entity}', {vec._quoted(char)})"
MORE_HTML = "<p>" + " ".join(entity for entity, _ in PAGE_ENTITIES) + " &amp;lt; &none; & ;</p>"


@register("html_to_text", f"SELECT page_id, {HTML_SQL} AS text FROM (SELECT page_id, html || {vec._quoted(MORE_HTML)} AS html FROM pages)")
def html_to_text(spark, sf_dir):
    """Every page with one more line of entities."""
    html = F.concat("html", F.lit(MORE_HTML))
    return t.table(spark, sf_dir, "pages").select("page_id", tx.html_text(html).alias("text"))


@register("ingest_suffix_filter", with_(FILES) + "SELECT path FROM files WHERE kind IN ('txt', 'pdf', 'docx', 'csv', 'xlsx')")
def ingest_suffix_filter(spark, sf_dir):
    return src.with_suffix(files(spark, sf_dir), src.FIVE_TYPES).select("path")


PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_size")


@register(
    "ingest_csv_as_text",
    """SELECT CAST(floor(p_partkey / 1000) AS BIGINT) AS block,
    concat('p_partkey', chr(9), 'p_name', chr(9), 'p_brand', chr(9), 'p_size', chr(10)) ||
    string_agg(concat(p_partkey, chr(9), p_name, chr(9), p_brand, chr(9),
      CASE WHEN p_size >= 10 THEN CAST(p_size AS VARCHAR) ELSE 'NaN' END), chr(10) ORDER BY p_partkey) AS text
    FROM part GROUP BY ALL""",
)
def ingest_csv_as_text(spark, sf_dir):
    """Parts written as CSV with empty cells, read back and rendered as text."""
    path = fresh_path(spark, "part-csv")
    size = F.when(F.col("p_size") >= 10, F.col("p_size"))
    io.write_csv(t.table(spark, sf_dir, "part").select(*PART_COLUMNS[:3], size.alias("p_size")), path)
    rows = io.read_csv(spark, path, "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT")
    block = F.floor(F.col("p_partkey") / 1000).cast("bigint")
    return src.table_text(rows, PART_COLUMNS, "p_partkey", block)


@register(
    "read_sales",
    with_(t.SALES_SQL) + "SELECT date, product_id, product_name, warehouse, units_sold, stock FROM sales",
)
def read_sales(spark, sf_dir):
    path = fresh_path(spark, "sales-csv")
    columns = ("date", "product_id", "product_name", "warehouse", "units_sold", "stock")
    io.write_csv(t.sales(spark, sf_dir).select(*columns), path)
    return io.read_sales(spark, path)


# --- names and fingerprints ----------------------------------------------------------


@register(
    "collection_name",
    with_(FILES) + "SELECT path, doc_id || '.v1' AS stem, CAST(doc_id AS VARCHAR) AS first_dot_stem FROM files",
)
def collection_name(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir).select(
        "path", naming.stem(path).alias("stem"), naming.first_dot_stem(path).alias("first_dot_stem")
    )


SAFE = "substring(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 63)"


@register(
    "collection_sanitize",
    f"SELECT page_id, trim({SAFE}, '_') AS name, {SAFE} AS unstripped FROM pages",
)
def collection_sanitize(spark, sf_dir):
    url = F.col("url")
    return t.table(spark, sf_dir, "pages").select(
        "page_id", naming.safe_name(url).alias("name"), naming.safe_name(url, strip_edges=False).alias("unstripped")
    )


@register(
    "collection_collisions",
    "SELECT regexp_replace(source || lang, '[^a-zA-Z0-9_-]', '_', 'g') AS name, count(*) AS files, min(doc_id) AS first_doc "
    "FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def collection_collisions(spark, sf_dir):
    """Names that several files share after cleaning."""
    name = naming.safe_name(F.concat("source", "lang"))
    named = t.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_doc")).where("files > 1")


@register(
    "chunk_id_positional",
    "SELECT doc_id, source || '_chunk_' || doc_id AS chunk_id, source || '/' || lang || '_' || doc_id AS path_id FROM documents",
)
def chunk_id_positional(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang")
    return t.table(spark, sf_dir, "documents").select(
        "doc_id",
        naming.positional_id(F.col("source"), F.col("doc_id")).alias("chunk_id"),
        naming.positional_id(path, F.col("doc_id"), "_").alias("path_id"),
    )


# Seconds as Python prints them: every time below is a multiple of a quarter second.
MTIME = """(1704067200 + doc_id * 5 // 4) || '.' || ['0', '25', '5', '75'][(doc_id * 5 % 4) + 1]"""


@register(
    "file_fingerprint",
    with_(FILES)
    + f"""SELECT path, {MTIME} AS by_time, md5(text) AS by_content, md5(text || {MTIME}) AS by_both
    FROM files""",
)
def file_fingerprint(spark, sf_dir):
    plain = plain_files(spark, sf_dir)
    content, mtime = F.col("content"), F.col("modificationTime")
    marks = {"by_time": "mtime", "by_content": "content", "by_both": "both"}
    return plain.select("path", *(naming.fingerprint(content, mtime, mode).alias(name) for name, mode in marks.items()))


def edited(docs):
    """A later state of the folder: very short files are gone, short ones have changed and
    the longest have moved."""
    size = F.length("text")
    text = F.when(size < 1000, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    moved = F.when(size > 5000, F.concat(F.lit("moved/"), "source")).otherwise(F.col("source"))
    return docs.where(size >= 400).select("doc_id", moved.alias("source"), "lang", text.alias("text"))


def plain_states(spark, sf_dir):
    return plain_files(spark, sf_dir), plain_files(spark, sf_dir, edited)


STATES = (
    FILES,
    "before AS (SELECT path, md5(text) AS mark, text FROM files)",
    """edited AS (SELECT CASE WHEN length(text) > 5000 THEN 'moved/' || path ELSE path END AS path,
      CASE WHEN length(text) < 1000 THEN text || ' edited' ELSE text END AS text
      FROM files WHERE length(text) >= 400)""",
    "after AS (SELECT path, md5(text) AS mark, text FROM edited)",
)


@register(
    "changed_files",
    with_(*STATES)
    + """SELECT path, coalesce(a.mark, b.mark) AS fingerprint,
    CASE WHEN b.mark IS NULL THEN 'new' WHEN a.mark IS NULL THEN 'deleted'
         WHEN a.mark <> b.mark THEN 'changed' ELSE 'unchanged' END AS status
    FROM after a FULL JOIN before b USING (path)""",
)
def changed_files(spark, sf_dir):
    """A listing against the manifest that the last pass stored."""
    before, after = plain_states(spark, sf_dir)
    return manifest.changed_files(manifest.snapshot(after), stored_manifest(spark, before))


def stored_manifest(spark, files):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.kept(spark, manifest.keep(manifest.snapshot(files), buckets))


@register(
    "changed_files_by_time",
    with_(FILES)
    + """SELECT path, make_timestamp(1704067200000000 + doc_id * 1250000 + 1000000) AS "modificationTime"
    FROM files WHERE strlen(text) >= 2000""",
)
def changed_files_by_time(spark, sf_dir):
    """Every long file is a second newer than its entry."""
    plain = plain_files(spark, sf_dir)
    before = manifest.snapshot(plain, "mtime")
    moment = F.col("modificationTime") + F.make_dt_interval(secs=F.when(F.col("length") >= 2000, 1).otherwise(0))
    after = manifest.snapshot(plain.withColumn("modificationTime", moment), "mtime")
    changed = manifest.modified_since(after, before)
    return changed.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modificationTime"))


def source_chunks(states):
    docs = states.select(F.col("path").alias("doc_id"), src.utf8_text(F.col("content")).alias("text"))
    return chunking.chunk_chars(docs).withColumnRenamed("doc_id", "source")


@register(
    "stream_modified",
    with_(*STATES)
    + """SELECT path AS source, CAST(i AS INTEGER) AS chunk_index, substring(text, i * 100 + 1, 100) AS text
    FROM (SELECT path, text, unnest(range(0, greatest(CAST(ceil(length(text) / 100) AS INTEGER), 1))) AS i FROM after)
    WHERE (i + 1) * 100 < length(text) OR length(regexp_replace(substring(text, i * 100 + 1, 100), '\\s+', '', 'g')) > 0""",
)
def stream_modified(spark, sf_dir):
    """Chunks after a second pass over the folder: only new and changed files are chunked
    again, changed and deleted ones lose what they had. The status of the files is written once."""
    before, after = plain_states(spark, sf_dir)
    status, _ = written(manifest.changed_files(manifest.snapshot(after), stored_manifest(spark, before)), "status")
    todo = after.join(status.where("status IN ('new', 'changed')"), "path", "left_semi")
    return manifest.refresh(source_chunks(before), source_chunks(todo), status)


# --- writers -------------------------------------------------------------------------


@register(
    "sink_chunks",
    with_(dp.PAGED, dp.PAGES, dp.PARA_PAGES, dp.exploded_sql("para_pages", dp.PARAGRAPHS, "paragraph"))
    + f"""SELECT doc_id, 'page_chunks' AS chunk_type, chunk_name, text FROM ({dp.PAGE_SQL})
    UNION ALL SELECT doc_id, 'paragraph_chunks', chunk_name, text FROM chunks""",
)
def sink_chunks(spark, sf_dir):
    by_page = chunking.chunk_pages(dp.pages_text(spark, sf_dir)).withColumn("chunk_type", F.lit("page_chunks"))
    by_paragraph = chunking.chunk_paragraphs(dp.para_pages(spark, sf_dir)).withColumn("chunk_type", F.lit("paragraph_chunks"))
    path = fresh_path(spark, "chunks")
    io.write_chunks(by_page.unionByName(by_paragraph), path)
    return spark.read.parquet(path).select("doc_id", "chunk_type", "chunk_name", "text")


@register(
    "export_collection",
    with_(vec.VECTORS)
    + f"SELECT id, text, source, {vec.ints_sql('embedding')} AS embedding FROM vectors WHERE collection = '3'",
)
def export_collection(spark, sf_dir):
    path = fresh_path(spark, "export")
    io.export_json(vec.vectors(spark, sf_dir), "3", path)
    exported = spark.read.schema("id BIGINT, text STRING, source STRING, embedding ARRAY<DOUBLE>").json(path)
    return exported.withColumn("embedding", scaled(F.col("embedding")))


ALLOCATED = with_(
    t.SALES_SQL, stock.DEMAND, stock.SHARE, t.WAREHOUSE_SQL, stock.WEIGHT, t.PRODUCT_SQL
)


@register("export_result_csv", ALLOCATED + stock.ALLOCATE)
def export_result_csv(spark, sf_dir):
    path = fresh_path(spark, "allocation-csv")
    io.write_csv(stock.allocate_inventory(spark, sf_dir), path)
    return io.read_csv(spark, path, "product_id BIGINT, warehouse STRING, allocation DOUBLE")


@register(
    "audit_log",
    with_(t.SALES_SQL, stock.REPLENISH)
    + """SELECT 'replenishment' AS module, CAST(json_object('product_id', product_id, 'product_name', product_name,
    'poisson_forecast', poisson_forecast, 'stock', stock, 'restock_needed', poisson_forecast > stock,
    'status', CASE WHEN poisson_forecast > stock THEN '🚨 Restock Needed' ELSE '✅ Stock OK' END) AS VARCHAR) AS data FROM replenish""",
)
def audit_log(spark, sf_dir):
    path = fresh_path(spark, "audit")
    io.append_audit("replenishment", stock.replenishment(spark, sf_dir), path)
    return spark.read.parquet(path).select("module", "data")


@register(
    "inventory_upsert",
    with_(t.SALES_SQL, stock.STATE)
    + """, arrivals AS (SELECT product_id, warehouse, max(product_name) AS product_name, CAST(sum(units_sold) AS BIGINT) AS stock
      FROM sales WHERE date >= DATE '1998-01-01' GROUP BY product_id, warehouse)
    SELECT product_id, warehouse, coalesce(a.product_name, i.product_name) AS product_name, coalesce(a.stock, i.stock) AS stock
    FROM inventory i FULL JOIN arrivals a USING (product_id, warehouse)""",
)
def inventory_upsert(spark, sf_dir):
    """Set the stock of every pair sold in the last year to what was sold."""
    rows = t.sales(spark, sf_dir)
    held = inventory.inventory_state(rows, t.TIEBREAK).drop("last_updated").withColumn("version", F.lit(1))
    arrived = (
        rows.where("date >= DATE'1998-01-01'")
        .groupBy("product_id", "warehouse")
        .agg(F.max("product_name").alias("product_name"), F.sum("units_sold").cast("bigint").alias("stock"))
        .withColumn("version", F.lit(2))
    )
    path = fresh_path(spark, "inventory")
    store.create(held, path, by="warehouse")
    stored = store.read(spark, path, held.schema)
    store.upsert_into(stored, path, arrived, ["product_id", "warehouse"], [F.col("version")], by="warehouse")
    return store.read(spark, path, held.schema).drop("version")


@register(
    "forecast_history_append",
    with_(*stock.ARIMA_CTES, t.HISTORY_SQL)
    + """SELECT product_id, product_name, poisson_forecast, arima_forecast, CAST(created_at AS DATE) AS created_at FROM history
    UNION ALL SELECT product_id, max(s.product_name), CAST(round_even(avg(s.units_sold), 0) AS BIGINT), any_value(arima_forecast),
    DATE '1999-01-01' FROM sales s LEFT JOIN best USING (product_id) GROUP BY product_id""",
)
def forecast_history_append(spark, sf_dir):
    path = fresh_path(spark, "history")
    io.append_history(t.forecast_history(spark, sf_dir), path, F.col("created_at"))
    io.append_history(arima.forecast_demand(t.sales(spark, sf_dir), t.TIEBREAK), path, F.to_date(F.lit("1999-01-01")))
    columns = ("product_id", "product_name", "poisson_forecast", "arima_forecast", "created_at")
    return spark.read.parquet(path).select(*columns)
