"""Registered queries of the operators, each next to its SQL where SQL can express it.

Every query reads its whole table and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyquill.llm import (
    centroid_clusters,
    chat_format,
    decontamination,
    fill_middle,
    html_text,
    license_scan,
    maxscore,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    vectors,
)
from tallyquill.plans.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def split_sql(text: str, between: str = r"[\x20\x09-\x0D]") -> str:
    return f"[w for w in regexp_split_to_array(coalesce({text}, ''), '{between}+') if w <> '']"


ASCII_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# --- 1: sharding -----------------------------------------------------------------------

SHARDS = 16


def jump_sql(shards: int, source: str) -> str:
    """The walk unrolled: one table for each possible step."""
    steps = [
        f"{source}_0 AS (SELECT *, 0::BIGINT AS b, 0::BIGINT AS j, "
        f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::UHUGEINT AS x FROM {source})"
    ]
    for k in range(shards):
        steps.append(f"""{source}_{k}x AS (SELECT * REPLACE (CASE WHEN j < {shards}
            THEN (x * {sharding.MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT ELSE x END AS x) FROM {source}_{k})""")
        steps.append(f"""{source}_{k + 1} AS (SELECT * REPLACE (CASE WHEN j < {shards} THEN j ELSE b END AS b,
            CASE WHEN j < {shards} THEN floor(((j + 1) * 2147483648.0::DOUBLE)
              / ((x // 8589934592::UHUGEINT)::DOUBLE + 1))::BIGINT ELSE j END AS j) FROM {source}_{k}x)""")
    return ",\n".join(steps)


SHARD_SQL = f"""WITH crc_table AS (
  SELECT list(list_reduce([c for k in range(8)], lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS t
  FROM (SELECT n, n::BIGINT AS c FROM range(256) r(n))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce([('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc_table),
grown AS (SELECT DISTINCT doc_id FROM documents),
small AS (SELECT DISTINCT doc_id FROM documents),
{jump_sql(SHARDS, "small")},
{jump_sql(SHARDS + 1, "grown")},
placed AS (
  SELECT s.*, a.b AS shard, g.b AS grown_shard FROM sized s
  JOIN small_{SHARDS} a ON a.doc_id IS NOT DISTINCT FROM s.doc_id
  JOIN grown_{SHARDS + 1} g ON g.doc_id IS NOT DISTINCT FROM s.doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY coalesce(md5(doc_id::VARCHAR), ''), doc_id NULLS LAST, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM placed"""


@query("op1_sharding", SHARD_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


# --- 2: licence scans ------------------------------------------------------------------


def _license_sql() -> str:
    base = "\nUNION ALL ".join(
        f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM places "
        f"WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()!r}"
        for phrase, label in license_scan.BASE.items()
    )
    more = "\nUNION ALL ".join(
        f"SELECT doc_id, '{t.label}' AS label, ("
        + " + ".join(
            f"CASE WHEN i - {t.key_at} + {place} >= 1 AND w[i - {t.key_at} + {place}] = '{word}' THEN {weight} ELSE 0 END"
            for word, place, weight in t.rare
        )
        + f")::DOUBLE / {t.total} AS share FROM places WHERE w[i:i + {len(t.key) - 1}] = {list(t.key)!r}"
        for t in license_scan.templates()
    )
    firsts = sorted({*(phrase.split()[0] for phrase in license_scan.BASE), *(t.key[0] for t in license_scan.templates())})
    return f"""WITH split AS MATERIALIZED (
  SELECT doc_id, {split_sql(LOWER_SQL, ASCII_MARKS)} AS w FROM documents),
places AS MATERIALIZED (SELECT doc_id, w, i FROM (
    SELECT doc_id, w, unnest([i for i in range(1, len(w) + 1) if list_contains({firsts!r}, w[i])]) AS i FROM split
    WHERE list_has_any(w, {license_scan.anchors()!r}))),
base AS ({base}),
more AS ({more}),
based AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi,
  string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY doc_id),
scored AS (SELECT doc_id, max(share) AS s FROM more GROUP BY doc_id),
listed AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM more) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
  coalesce(b.l, '') AS base_labels, coalesce(a.l, '') AS labels,
  greatest(coalesce(s.s, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM split d LEFT JOIN based b USING (doc_id) LEFT JOIN scored s USING (doc_id) LEFT JOIN listed a USING (doc_id)"""


@query("op2_license_scan", _license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


# --- 3: quality rules ------------------------------------------------------------------


def rule_sql(docs: str = "documents", window: int = quality_rules.WINDOW) -> str:
    """CTEs that end in ``judged``: all counts and the verdict for each row of a table."""
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    rules = " AND ".join(
        f"(n_words < {r.words_from} OR (CASE WHEN {r.whole} > 0 THEN {r.part}::DOUBLE / {r.whole} ELSE 0.0 END)"
        f" BETWEEN {r.low} AND {r.high})"
        for r in quality_rules.RULES
    )
    return f"""split AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, {split_sql("text")} AS w,
    [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM {docs}),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + {window - 1}) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM split)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (doc_id, g), range({window}) r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines,
    len([x for x in w if x IN ({stop})])::BIGINT AS n_stop_words,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
failed AS (
  SELECT *, n_words < {quality_rules.LEAST_WORDS}
    OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counted),
judged AS (SELECT *, NOT base_failed AND {rules} AS kept FROM failed)"""


RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_quality_rules", f"WITH {rule_sql()} SELECT doc_id, {', '.join(RULE_COLUMNS)} FROM judged")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *RULE_COLUMNS)


# --- 4: quality classifier -------------------------------------------------------------


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.choose(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# --- 5: HTML extraction ----------------------------------------------------------------


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


# --- 6: benchmark decontamination ------------------------------------------------------


def leak_sql(docs: str = "documents") -> str:
    """CTEs that end in ``leaks``: hits and items for each row of a table."""
    size = decontamination.WINDOW
    return f"""doc_words AS MATERIALIZED (SELECT doc_id, {split_sql(LOWER_SQL, ASCII_MARKS)} AS w FROM {docs}),
item_words AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {split_sql(LOWER_SQL, ASCII_MARKS)} AS w FROM benchmark),
item_windows AS MATERIALIZED (
  SELECT DISTINCT item, w[i:i + {size - 1}] AS g, least(len(w), {size}) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
hits AS (
  SELECT DISTINCT doc_id, i, x.n, item FROM (
    SELECT doc_id, n, i, w[i:i + n - 1] AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes)) x
  JOIN item_windows v ON v.g = x.g AND v.n = x.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM hits GROUP BY doc_id),
leaks AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
    sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
  FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id))"""


@query("op6_decontamination", f"WITH {leak_sql()} SELECT * FROM leaks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(
        table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


# --- 7: chat formatting ----------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"


def _escaped_sql(column: str) -> str:
    """Length of a role or text once it is escaped."""
    single = f"length({column}) - length(replace({column}, '{chat_format.ESCAPE}', ''))"
    marked = " + ".join(
        f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL
    )
    return f"length({column}) + {single} + {marked}"


CHAT_SQL = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_escaped_sql("role")} + {_escaped_sql("text")}
    + {len(chat_format.OPEN + chat_format.HEAD + chat_format.CLOSE)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op7_chat_format", CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return chat_format.digests(chat_format.format_conversations(rows.unionAll(probe)))


# --- 8: mixing -------------------------------------------------------------------------


def mix_sql(docs: str = "documents") -> str:
    """CTEs that end in ``mixed``: the plan for each row of a table."""
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""measured AS (
  SELECT doc_id, source, len({split_sql("text")})::BIGINT AS size FROM {docs}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
  FROM measured GROUP BY source),
summed AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (tight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (tight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources WINDOW tight AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
levels AS (
  SELECT *, ({mixing.SHARE}::DOUBLE * total::DOUBLE - {mixing.MOST}::DOUBLE * stopped::DOUBLE) / open_weight::DOUBLE AS level FROM summed),
targets AS (
  SELECT source, source_size, least({mixing.MOST}::DOUBLE * source_size, coalesce(
    (SELECT arg_min(level, stopped) FROM levels WHERE level * weight <= {mixing.MOST}::DOUBLE * source_size) * weight,
    {mixing.MOST}::DOUBLE * source_size)) AS target FROM levels),
ranked AS (
  SELECT m.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{mixing.SEED}|' || coalesce(m.source, 'null')), 1, 12))::BIGINT / {float(16**12)}::DOUBLE AS off,
    row_number() OVER (PARTITION BY m.source ORDER BY
      length(bin(size)) * 8 + ('0b' || rpad(substr(bin(size), 2, 3), 3, '0'))::BIGINT,
      md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS LAST, size) - 1 AS rank
  FROM measured m JOIN targets t ON t.source IS NOT DISTINCT FROM m.source),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
    (floor((rank + 1) * rate + off) - floor(rank * rate + off))::BIGINT AS copies FROM ranked)"""


@query(
    "op8_mixing",
    f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


# --- 9: substring dedup ----------------------------------------------------------------

SUBSTRING_SQL = f"""WITH split AS MATERIALIZED (
  SELECT row_number() OVER () AS line, doc_id, {split_sql("text")} AS w FROM documents),
places AS MATERIALIZED (
  SELECT line, doc_id, i, w[i:i + {substring_dedup.SIZE - 1}] AS g
  FROM (SELECT line, doc_id, w, unnest(range(1, len(w) - {substring_dedup.SIZE - 2})) AS i FROM split)),
firsts AS (SELECT g, min(doc_id) AS first FROM places GROUP BY g
  HAVING min(doc_id) < max(doc_id) OR 0 < count(doc_id) AND count(doc_id) < count(*)),
removed AS (
  SELECT line, list(DISTINCT p) AS p FROM (
    SELECT line, unnest(range(i, i + {substring_dedup.SIZE})) AS p
    FROM places JOIN firsts USING (g) WHERE first < doc_id OR doc_id IS NULL) GROUP BY line),
kept AS (
  SELECT d.line, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT line, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM split) d
  LEFT JOIN (SELECT line, unnest(p) AS i, true AS gone FROM removed) r USING (line, i)
  WHERE gone IS NULL GROUP BY d.line)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN removed USING (line) LEFT JOIN kept USING (line)"""


@query("op9_substring_dedup", SUBSTRING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


# --- 10: near duplicates ---------------------------------------------------------------


def near_sql(docs: str = "documents", size: int = 3, percent: int = 85) -> str:
    """CTEs that end in ``near``: component of each row of a table of distinct ids."""
    lower = LOWER_SQL
    return f"""near_words AS (SELECT doc_id, {split_sql(lower)} AS w FROM {docs}),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i:i + {size - 1}] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM near_words WHERE len(w) > 0)),
set_sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
near_links AS MATERIALIZED (
  SELECT x, y FROM common c JOIN set_sizes a ON a.doc_id = x JOIN set_sizes b ON b.doc_id = y
  WHERE 100 * c.n >= {percent} * (a.n + b.n - c.n)),
both_ways AS MATERIALIZED (SELECT x, y FROM near_links UNION ALL SELECT y, x FROM near_links),
reached AS (
  SELECT x AS doc_id, y AS other FROM both_ways
  UNION SELECT r.doc_id, l.y FROM reached r JOIN both_ways l ON l.x = r.other),
near AS (
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
    least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id,
    d.doc_id <= coalesce(r.least, d.doc_id) AS kept
  FROM near_words d LEFT JOIN set_sizes s USING (doc_id)
  LEFT JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) r USING (doc_id))"""


@query("op10_near_dedup", f"WITH RECURSIVE {near_sql()} SELECT * FROM near")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


# --- 11: centroid clustering ----------------------------------------------------------------


def integers_sql(scale: int) -> str:
    """Vectors without null or non-finite components as lists of whole numbers."""
    return f"""SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR abs(x::DOUBLE) >= {vectors.LARGEST / scale}::DOUBLE]) = 0"""


def cluster_sql(k: int, rounds: int, width: int, scale: int, salt: int) -> str:
    apart = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])::BIGINT"
    steps = [
        f"points AS MATERIALIZED ({integers_sql(scale)} AND len(embedding) = {width})",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v
  FROM (SELECT sha256('{salt}:' || vec_id) AS h, v FROM points) ORDER BY c LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT p.id, vec_id, p.v, c.c, {apart} AS d FROM (SELECT *, row_number() OVER () AS id FROM points) p, c{n} c) GROUP BY id, vec_id)""")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, {width + 1}) r(i) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, v FROM c{rounds}) f USING (c)"""


CLUSTER_SQL = cluster_sql(
    centroid_clusters.K, centroid_clusters.ROUNDS, centroid_clusters.WIDTH, centroid_clusters.SCALE, centroid_clusters.SALT
)


@query("op11_centroid_clusters", CLUSTER_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digests(table(spark, sf_dir, "embeddings"))


# --- 12: exact top-k search ----------------------------------------------------------------

EVERY = 100

SEARCH_SQL = f"""WITH points AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM ({integers_sql(maxscore.SCALE)})),
scored AS (SELECT q.vec_id AS query_id, q.n, c.vec_id,
  list_sum([coalesce(z[1], 0) * coalesce(z[2], 0) for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM points q JOIN points c ON q.n <> c.n WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {maxscore.K}"""


@query("op12_exact_top_k", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return maxscore.search(asked, rows, own=True)


# --- 13: fill in the middle ----------------------------------------------------------------

FIM_SQL = f"""WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
drawn AS (SELECT doc_id, t, w, len(w)::BIGINT AS n, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM cut),
placed AS (SELECT doc_id, t, n, h4, (t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fill_middle.PLAIN}) AS stays,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, w FROM drawn),
parts AS (SELECT doc_id, t, n, CASE WHEN stays THEN 'plain' WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m,
  coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


@query("op13_fill_middle", FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))
