"""Registered queries over file forms, listings and single reads of the memory, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encode import Encoder
from ..functions import text, vector
from ..operators import fragments as fragment_ops
from ..operators import listing, search
from ..operators import topics as topic_ops
from ..streaming import ingest
from . import derive
from .catalogue import _MD, _TOPIC_MD, K, _md5, _round, query
from .derive import table

_WHITE = "\\x09-\\x0D\\x20\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query(f"""
SELECT p_partkey, regexp_replace(regexp_replace(chr(160) || chr(12288) || p_name || chr(65279) || p_brand || chr(8195) || chr(9), '^[{_WHITE}]+', ''), '[{_WHITE}]+$', '') AS name FROM part
""", base=False)
def unicode_trim(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit(" 　"), F.col("p_name"), F.lit("﻿"), F.col("p_brand"), F.lit(" \t"))
    return table(spark, sf, "part").select("p_partkey", text.trim(name).alias("name"))


_LINE = "turn_id string, role string, content string, agent_id string"


@query("SELECT date, 'turn_' || printf('%04d', seq) AS turn_id, role, md5(content) AS digest, agent_id FROM turns")
def turn_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns written as JSON lines and read back."""
    lines = derive.turns(spark, sf).select("date", F.to_json(F.struct("turn_id", "role", "content", "agent_id")).alias("line"))
    back = lines.select("date", F.from_json("line", _LINE).alias("r"))
    return back.select("date", "r.turn_id", "r.role", _md5("r.content").alias("digest"), "r.agent_id")


@query("SELECT date, 'turn_' || printf('%04d', seq) AS turn_id, md5(content) AS digest FROM turns WHERE date = '2025-06-05'")
def raw_resource(spark: SparkSession, sf: str) -> DataFrame:
    """What memory://raw/2025-06-05 holds, line by line."""
    kind_key = spark.range(1).select(text.uri_parts(F.lit("memory://raw/2025-06-05")).alias("u"))
    rows = derive.turns(spark, sf).join(F.broadcast(kind_key.select(F.col("u.key").alias("date"))), "date")
    return rows.select("date", "turn_id", _md5("content").alias("digest"))


@query("""
SELECT vec_id, len(embedding)::INT AS n, embedding[1]::DOUBLE AS first_value, list_last(embedding)::DOUBLE AS last_value FROM embeddings WHERE vec_id % 5 > 1
""", base=False)
def vector_json(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as JSON arrays and read back; files that are no array of numbers are left out."""
    form = F.when(F.col("vec_id") % 5 == 0, F.lit("oops")).when(F.col("vec_id") % 5 == 1, F.lit('[1, "x"]')).otherwise(F.to_json("embedding"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.from_json(form, "array<double>").alias("v")).where("v is not null and not exists(v, x -> x is null)")
    v = F.col("v").cast("array<float>")
    return rows.select("vec_id", F.size(v).alias("n"), v[0].cast("double").alias("first_value"), F.element_at(v, -1).cast("double").alias("last_value"))


@query("""
SELECT uri, CASE WHEN starts_with(uri, 'memory://') THEN coalesce(nullif(split_part(substr(uri, 10), '/', 1), ''), 'root') END AS kind,
  CASE WHEN starts_with(uri, 'memory://') THEN array_to_string((string_split(substr(uri, 10), '/'))[2:], '/') END AS key
FROM (SELECT 'memory://fragments/' || fragment_id AS uri FROM frags UNION ALL SELECT 'memory://daily/' || date FROM daily UNION ALL SELECT 'http://x/' || date FROM daily UNION ALL SELECT 'memory://')
""")
def uri_parse(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    days = derive.daily(frags)
    uris = frags.select(F.concat(F.lit("memory://fragments/"), "fragment_id").alias("uri")).union(days.select(F.concat(F.lit("memory://daily/"), "date"))).union(days.select(F.concat(F.lit("http://x/"), "date")))
    uris = uris.union(spark.range(1).select(F.lit("memory://")))
    return uris.withColumn("u", text.uri_parts(F.col("uri"))).select("uri", "u.kind", "u.key")


@query("SELECT path FROM (SELECT p_partkey || '/' || p_name || CASE p_partkey % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.db' WHEN 2 THEN '.json.bak' ELSE '.DB' END AS path FROM part) WHERE path LIKE '%.json' OR path LIKE '%.db'", base=False)
def files_by_suffix(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.expr("case p_partkey % 4 when 0 then '.json' when 1 then '.db' when 2 then '.json.bak' else '.DB' end")
    return listing.with_suffix(table(spark, sf, "part").select(F.concat_ws("", F.col("p_partkey"), F.lit("/"), F.col("p_name"), suffix).alias("path")))


@query("""
SELECT c_custkey::VARCHAR AS path, lower(hex(substr('SQLite format 3' || chr(1) || c_name, 1, 16))) AS header_hex, 'CREATE TABLE t' || c_custkey || ' (a DECIMAL(10,2), b TEXT DEFAULT '')'')' AS statement, 2 AS n FROM customer
""", base=False)
def byte_sniff(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    body = F.concat(F.lit("SQLite format 3\x01"), F.col("c_name"), F.lit(" CREATE TABLE t"), key, F.lit(" (a DECIMAL(10,2), b TEXT DEFAULT ')') CREATE INDEX i CREATE TABLE u(x int)"))
    files = table(spark, sf, "customer").select(key.alias("path"), body.cast("binary").alias("content"))
    return listing.sniffed(files).select("path", "header_hex", F.col("create_tables")[0].alias("statement"), F.size("create_tables").alias("n"))


@query("SELECT fragment_id, task_desc, result_desc, length(turns_text)::INT AS turns_length, CASE WHEN e.vec_id IS NULL THEN 0 ELSE len(e.embedding)::INT END AS embedding_dim, 'fallback' AS embedding_mode FROM frags f LEFT JOIN embeddings e ON e.vec_id = f.conv_id")
def fragment_response(spark: SparkSession, sf: str) -> DataFrame:
    """What a created fragment is answered with."""
    frags = derive.fragments(spark, sf)
    vectors = derive.vectors(spark, sf, frags).select("fragment_id", F.size("embedding").alias("dim"))
    rows = frags.join(vectors, "fragment_id", "left")
    return rows.select("fragment_id", "task_desc", "result_desc", F.length("turns_text").alias("turns_length"), F.coalesce("dim", F.lit(0)).alias("embedding_dim"), F.lit(Encoder().mode).alias("embedding_mode"))


@query("SELECT fragment_id, 0.0::DOUBLE AS score, 0 AS rank FROM frags WHERE false")
def top_none(spark: SparkSession, sf: str) -> DataFrame:
    """No hits for k = 0."""
    frags = derive.fragments(spark, sf)
    hits = search.vector_search(derive.vectors(spark, sf, frags), frags, [("q", derive.vector_of(spark, sf, 0))], 0)
    return hits.select("fragment_id", "score", "rank")


@query(f"""
SELECT fragment_id, {_round("s")} AS score, rank FROM (SELECT fragment_id, s, (row_number() OVER (ORDER BY s DESC, fragment_id))::INT AS rank FROM (
  SELECT e.fragment_id, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS s FROM vectors e, vectors q WHERE e.known AND q.vec_id = 3) WHERE s > 0) WHERE rank <= {K}
""")
def top_default(spark: SparkSession, sf: str) -> DataFrame:
    """Ten hits where k is not given."""
    frags = derive.fragments(spark, sf)
    hits = search.vector_search(derive.vectors(spark, sf, frags), frags, [("q", derive.vector_of(spark, sf, 3))])
    return hits.select("fragment_id", vector.round4(F.col("score")).alias("score"), "rank")


@query("SELECT date, (row_number() OVER (ORDER BY date))::INT AS position FROM (SELECT DISTINCT date FROM turns)")
def listed_dates(spark: SparkSession, sf: str) -> DataFrame:
    return listing.ordered(derive.turns(spark, sf).select("date").distinct(), "date")


@query("SELECT topic_slug, (row_number() OVER (ORDER BY topic_slug))::INT AS position FROM (SELECT DISTINCT topic_slug FROM entries)")
def listed_topics(spark: SparkSession, sf: str) -> DataFrame:
    return listing.ordered(derive.topic_entries(derive.fragments(spark, sf)).select("topic_slug").distinct(), "topic_slug")


def _letters():
    return lambda texts: [[float(t.count(c)) for c in "aen"] for t in texts]


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, (length(t) - length(replace(t, 'a', '')))::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e, (length(t) - length(replace(t, 'n', '')))::DOUBLE AS n FROM t
""", base=False)
def encoder_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by an encoder that counts letters, in Arrow batches."""
    rows = table(spark, sf, "documents").select("doc_id", Encoder(_letters).column(F.col("text")).alias("v"))
    return rows.select("doc_id", *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate("aen")])


@query(f"SELECT fragment_id, {_MD} AS md FROM frags WHERE fragment_id IN ('2025-06-03/frag_001', '2025-06-07/frag_002')")
def get_fragment(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive.fragments(spark, sf).where("fragment_id in ('2025-06-03/frag_001', '2025-06-07/frag_002')")
    return rows.select("fragment_id", fragment_ops.markdown().alias("md"))


@query("SELECT date, summary_md FROM daily WHERE date = '2025-06-03'")
def get_daily(spark: SparkSession, sf: str) -> DataFrame:
    return derive.daily(derive.fragments(spark, sf)).where("date = '2025-06-03'")


@query(f"SELECT {_TOPIC_MD} AS md FROM topics WHERE topic_slug = 'topic-1'")
def get_topic(spark: SparkSession, sf: str) -> DataFrame:
    own = derive.topic_entries(derive.fragments(spark, sf)).where(F.col("topic_slug") == text.slug(F.lit(" topic 1 ")))
    return topic_ops.index(own).select(topic_ops.markdown().alias("md"))


@query("SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE created_at END AS created_at, CASE WHEN id % 11 = 0 THEN NULL ELSE content END AS content FROM messages) WHERE created_at IS NULL OR content IS NULL")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive.messages(spark, sf)
    rows = rows.withColumns({"created_at": F.when(F.col("id") % 7 != 0, F.col("created_at")), "content": F.when(F.col("id") % 11 != 0, F.col("content"))})
    return ingest.quarantined(rows).select("id")


@query("SELECT (cid + 1)::INT AS position, name FROM pragma_table_info('customer')", base=False)
def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    return listing.columns_of(table(spark, sf, "customer")).select("position", "name")


@query("SELECT id, coalesce(substr(agent_id, 1, 40), '') AS agent_id FROM sessions ORDER BY sessions.id LIMIT 5")
def sessions_sample(spark: SparkSession, sf: str) -> DataFrame:
    return listing.clipped(derive.sessions(spark, sf).orderBy("id").limit(5), 40)


@query("SELECT id::VARCHAR AS id, session_id, role, substr(coalesce(content, ''), 1, 40) AS content, created_at FROM messages ORDER BY messages.id LIMIT 5")
def messages_sample(spark: SparkSession, sf: str) -> DataFrame:
    return listing.clipped(derive.messages(spark, sf).orderBy("id").limit(5), 40)


_TOKENS = "list_distinct(list_concat(list_concat(h, list_transform(list_zip(h[:-2], h[2:]), lambda p: p[1] || p[2])), list_transform(regexp_extract_all(t, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w))))"


@query(f"""
, k0 AS (SELECT fragment_id, task_desc || ' ' || result_desc || ' ' || substr(turns_text, 1, 2000) AS t FROM frags UNION ALL SELECT '', content FROM turns WHERE conv_id = 7 AND turn = (SELECT min(turn) FROM turns WHERE conv_id = 7)),
k1 AS (SELECT fragment_id, t, regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]') AS h FROM k0), k2 AS (SELECT fragment_id, {_TOKENS} AS w FROM k1),
k3 AS (SELECT a.fragment_id, len(list_intersect(a.w, q.w)) AS i, len(a.w) + len(q.w) AS n FROM k2 a, k2 q WHERE q.fragment_id = '' AND a.fragment_id <> ''),
k4 AS (SELECT fragment_id, i / (n - i) AS s, (row_number() OVER (ORDER BY i / (n - i) DESC, fragment_id))::INT AS rank FROM k3 WHERE i > 0)
SELECT k4.rank, f.fragment_id, {_round("k4.s")} AS score, f.task_desc, f.date, d.summary_md AS daily_summary, t.summary AS topic_summary
FROM k4 JOIN frags f USING (fragment_id) LEFT JOIN daily d ON d.date = f.date LEFT JOIN topics t ON t.topic_slug = f.topic_slug AND f.topic_name <> '' WHERE k4.rank <= {K}
""")
def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Search without an encoder: by keywords, with the context of each hit."""
    frags = derive.fragments(spark, sf)
    asked = table(spark, sf, "conversations").where("conv_id = 7").orderBy("turn").select("text").first()[0]
    hits = search.keyword_search(frags, [("q", asked)])
    rows = search.hydrate(hits, frags, derive.daily(frags), derive.topic_entries(frags), few=True)
    return rows.select("rank", "fragment_id", "score", "task_desc", "date", "daily_summary", "topic_summary")


@query("SELECT 'memory_get_topic' AS tool, string_agg(topic_slug, ', ' ORDER BY topic_slug) AS known FROM (SELECT DISTINCT topic_slug FROM entries)")
def known_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The topics that an answer to an unknown name lists."""
    slugs = derive.topic_entries(derive.fragments(spark, sf)).select("topic_slug").distinct()
    return slugs.agg(F.array_join(F.array_sort(F.collect_list("topic_slug")), ", ").alias("known")).select(F.lit("memory_get_topic").alias("tool"), "known")
