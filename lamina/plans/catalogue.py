"""Registered queries of the memory engine and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import encode
from ..functions import text, vector
from ..operators import daily as daily_ops
from ..operators import fragments as fragment_ops
from ..operators import listing, search
from ..operators import topics as topic_ops
from ..operators import turns as turn_ops
from ..streaming import ingest
from . import derive
from .derive import table

AGENT, QUERY_VEC, K = "agent_1", 450, 10
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name; base: the SQL starts from the derived entities."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (derive.SQL if base else "") + sql
        return f

    return put


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _md5(c):
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


_COS = "CASE WHEN len({a}) = 0 OR len({a}) <> len({b}) THEN 0 ELSE coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0) END"


def _round(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


# ---- search ----------------------------------------------------------------------------------------------


@query(f"""
SELECT printf('%07d', vec_id) AS fragment_id, {_round("s")} AS score, rank FROM (
  SELECT vec_id, s, (row_number() OVER (ORDER BY s DESC, vec_id))::INT AS rank FROM (
    SELECT e.vec_id, {_COS.format(a="e.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE s > 0) WHERE rank <= {K}
""", base=False)
def vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.format_string("%07d", "vec_id").alias("fragment_id"), "embedding")
    hits = search.best(search.vector_scores(vectors, [("q", derive.vector_of(spark, sf, 0))], K), K)
    return hits.select("fragment_id", vector.round4(F.col("score")).alias("score"), "rank")


@query(f"""
SELECT query_id, fragment_id, {_round("s")} AS score, rank FROM (
  SELECT query_id, fragment_id, s, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fragment_id))::INT AS rank FROM (
    SELECT q.vec_id::VARCHAR AS query_id, e.fragment_id, {_COS.format(a="e.v", b="q.v")} AS s FROM vectors e, vectors q WHERE e.known AND q.vec_id % 100 = 0) WHERE s > 0) WHERE rank <= 5
""")
def vec_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    asked = table(spark, sf, "embeddings").where("vec_id % 100 = 0").orderBy("vec_id").toLocalIterator()
    hits = search.vector_search(derive.vectors(spark, sf, frags), frags, [(str(r.vec_id), list(r.embedding)) for r in asked], 5)
    return hits.select("query_id", "fragment_id", vector.round4(F.col("score")).alias("score"), "rank")


@query(f"""
SELECT fragment_id, {_round("s")} AS score, rank FROM (
  SELECT fragment_id, s, (row_number() OVER (ORDER BY s DESC, fragment_id))::INT AS rank FROM (
    SELECT e.fragment_id, {_COS.format(a="e.v", b="q.v")} AS s FROM vectors e, vectors q WHERE e.known AND e.agent_id = '{AGENT}' AND q.vec_id = {QUERY_VEC}) WHERE s > 0) WHERE rank <= {K}
""")
def vec_topk_agent(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    hits = search.vector_search(derive.vectors(spark, sf, frags), frags, [("q", derive.vector_of(spark, sf, QUERY_VEC))], K, AGENT)
    return hits.select("fragment_id", vector.round4(F.col("score")).alias("score"), "rank")


@query(f"""
SELECT vec_id, {_round("s")} AS score FROM (
  SELECT e.vec_id, {_COS.format(a="e.v", b="q.v")} AS s FROM (
    SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_slice(embedding, 1, 32)::DOUBLE[] WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0.0)::DOUBLE[] WHEN vec_id % 11 = 0 THEN []::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings) e,
    (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1) q)
""", base=False)
def vec_dim_guard(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    odd = F.when(F.col("vec_id") % 5 == 0, F.slice(e, 1, 32)).when(F.col("vec_id") % 7 == 0, F.transform(e, lambda x: x * 0)).when(F.col("vec_id") % 11 == 0, F.array().cast("array<float>")).otherwise(e)
    asked = F.array(*[F.lit(x) for x in derive.vector_of(spark, sf, 1)])
    return table(spark, sf, "embeddings").select("vec_id", vector.round4(vector.cosine(odd, asked)).alias("score"))


@query(f"""
SELECT h.rank, f.fragment_id, h.score, f.task_desc, f.result_desc, f.tags, f.date, f.start_turn_id || ' ~ ' || f.end_turn_id AS turns_range, f.agent_id, d.summary_md AS daily_summary, f.topic_name, t.summary AS topic_summary
FROM (SELECT fragment_id, {_round("s")} AS score, (row_number() OVER (ORDER BY s DESC, fragment_id))::INT AS rank FROM (
    SELECT e.fragment_id, {_COS.format(a="e.v", b="q.v")} AS s FROM vectors e, vectors q WHERE e.known AND e.agent_id = '{AGENT}' AND q.vec_id = {QUERY_VEC}) WHERE s > 0) h
JOIN frags f USING (fragment_id) LEFT JOIN daily d ON d.date = f.date LEFT JOIN topics t ON t.topic_slug = f.topic_slug AND f.topic_name <> '' WHERE h.rank <= {K}
""")
def search_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    hits = search.vector_search(derive.vectors(spark, sf, frags), frags, [("q", derive.vector_of(spark, sf, QUERY_VEC))], K, AGENT)
    rows = search.hydrate(hits, frags, derive.daily(frags), derive.topic_entries(frags), few=True)
    return rows.drop("query_id").withColumn("tags", F.concat_ws(",", "tags"))


def _kw_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.format_string("%09d", "doc_id").alias("fragment_id"), F.lit("").alias("task_desc"), F.lit("").alias("result_desc"), F.col("text").alias("turns_text"), F.col("source").alias("agent_id"))


def _words(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({t}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: lower(w)))"


def _kw_sql(where: str) -> str:
    return f"""
WITH t AS (SELECT printf('%09d', doc_id) AS fragment_id, {_words('substr(text, 1, 2000)')} AS w, source FROM documents), q AS (SELECT w FROM t WHERE fragment_id = '000000001'),
s AS (SELECT t.fragment_id, len(list_intersect(t.w, q.w)) AS i, len(t.w) + len(q.w) AS n FROM t, q WHERE {where}),
r AS (SELECT fragment_id, i / (n - i) AS s FROM s WHERE i > 0)
SELECT fragment_id, {_round("s")} AS score, rank FROM (SELECT *, (row_number() OVER (ORDER BY s DESC, fragment_id))::INT AS rank FROM r) WHERE rank <= {K}
"""


def _kw(spark: SparkSession, sf: str, agent: str | None) -> DataFrame:
    asked = table(spark, sf, "documents").where("doc_id = 1").select(F.substring("text", 1, 2000)).first()[0]
    hits = search.keyword_search(_kw_corpus(spark, sf), [("q", asked)], K, agent)
    return hits.select("fragment_id", vector.round4(F.col("score")).alias("score"), "rank")


@query(_kw_sql("true"), base=False)
def kw_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _kw(spark, sf, None)


@query(_kw_sql("source = 'src3'"), base=False)
def kw_topk_agent(spark: SparkSession, sf: str) -> DataFrame:
    return _kw(spark, sf, "src3")


@query(f"""
WITH c AS (SELECT doc_id, translate(text, 'aeiou', '天地人和中') AS t FROM documents),
h AS (SELECT doc_id, regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]') AS h, {_words("t")} AS w FROM c),
d AS (SELECT doc_id, list_distinct(list_concat(list_concat(h, list_transform(list_zip(h[:-2], h[2:]), lambda p: p[1] || p[2])), w)) AS t FROM h)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM d
""", base=False)
def kw_tokens_cjk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", text.tokens(F.translate("text", "aeiou", "天地人和中")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), _md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(f"""
WITH t AS (SELECT doc_id, {_words("text")} AS w FROM documents)
SELECT a.doc_id, {_round("CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END")} AS score FROM t a JOIN t b ON b.doc_id = a.doc_id + 1
""", base=False)
def kw_pairs_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the next."""
    rows = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("x"))
    return rows.join(after, "doc_id").select("doc_id", vector.round4(text.jaccard(F.col("w"), F.col("x"))).alias("score"))


@query(f"SELECT event_id, {_round('value / 7')} AS score FROM events", base=False)
def round_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", vector.round4(F.col("value") / 7).alias("score"))


# ---- turns and fragments -----------------------------------------------------------------------------------


@query("SELECT date, seq, 'turn_' || printf('%04d', seq) AS turn_id, role, agent_id, md5(content) AS digest FROM turns")
def turn_ids(spark: SparkSession, sf: str) -> DataFrame:
    return derive.turns(spark, sf).select("date", "seq", "turn_id", "role", "agent_id", _md5("content").alias("digest"))


@query("""
SELECT date, seq + n AS seq, 'turn_' || printf('%04d', seq + n) AS turn_id, md5(content) AS digest
FROM turns JOIN (SELECT date, count(*)::INT AS n FROM turns GROUP BY date) USING (date)
""")
def turn_append(spark: SparkSession, sf: str) -> DataFrame:
    """The turns once more, after themselves."""
    old = derive.turns(spark, sf)
    out = turn_ops.append_turns(old.withColumn("arrival", F.col("conv_id") * 4096 + F.col("turn")), old, "arrival", F.lit("2025-01-01").cast("timestamp"))
    return out.select("date", "seq", "turn_id", _md5("content").alias("digest"))


@query("SELECT date, start_turn_id, end_turn_id, length(turns_text)::BIGINT AS n_chars, md5(turns_text) AS digest FROM frags")
def turn_range_text(spark: SparkSession, sf: str) -> DataFrame:
    out = turn_ops.range_texts(derive.inputs(spark, sf).select("date", "start_turn_id", "end_turn_id"), derive.turns(spark, sf))
    return out.select("date", "start_turn_id", "end_turn_id", F.length("turns_text").cast("long").alias("n_chars"), _md5("turns_text").alias("digest"))


@query("SELECT date, end_turn_id AS start_turn_id, start_turn_id AS end_turn_id, CASE WHEN a = b THEN turns_text ELSE '' END AS turns_text FROM frags")
def turn_range_inverted(spark: SparkSession, sf: str) -> DataFrame:
    swapped = derive.inputs(spark, sf).select("date", F.col("end_turn_id").alias("start_turn_id"), F.col("start_turn_id").alias("end_turn_id"))
    return turn_ops.range_texts(swapped, derive.turns(spark, sf)).select("date", "start_turn_id", "end_turn_id", "turns_text")


@query("SELECT fragment_id, date, frag_no, start_turn_id, end_turn_id, task_desc, result_desc, tags, topic_name, topic_slug, agent_id, md5(turns_text) AS digest FROM frags")
def fragment_create(spark: SparkSession, sf: str) -> DataFrame:
    f = derive.fragments(spark, sf)
    return f.select("fragment_id", "date", "frag_no", "start_turn_id", "end_turn_id", "task_desc", "result_desc", F.concat_ws(",", "tags").alias("tags"), "topic_name", "topic_slug", "agent_id", _md5("turns_text").alias("digest"))


_MD = """('# 任务：' || task_desc || chr(10) || chr(10) || '**日期**：' || date || chr(10) || '**轮次**：' || start_turn_id || ' ~ ' || end_turn_id || chr(10) ||
  '**标签**：`' || replace(tags, ',', '` `') || '`' || chr(10) || '**主题**：' || topic_name || coalesce(chr(10) || '**Agent**：' || agent_id, '') || chr(10) || chr(10) ||
  '## 摘要' || chr(10) || chr(10) || task_desc || chr(10) || chr(10) || '## 结论' || chr(10) || chr(10) || result_desc || chr(10) || chr(10) || '## 原文' || chr(10) || chr(10) || turns_text || chr(10))"""


@query(f"SELECT fragment_id, md5({_MD}) AS digest FROM frags")
def fragment_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return derive.fragments(spark, sf).select("fragment_id", _md5(fragment_ops.markdown()).alias("digest"))


@query("""
SELECT fragment_id, date, start_turn_id, end_turn_id, trim(split_part(task_desc, chr(10), 1)) AS task_desc, trim(result_desc, ' ' || chr(10)) AS result_desc, tags, topic_name, agent_id, md5(trim(turns_text, ' ' || chr(10))) AS digest
FROM frags WHERE split_part(task_desc, chr(10), 1) <> ''
""")
def fragment_parse(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.fragments(spark, sf).select("fragment_id", fragment_ops.markdown().alias("md"))
    p = fragment_ops.parse_markdown(docs, "md", "fragment_id")
    return p.select("fragment_id", "date", "start_turn_id", "end_turn_id", "task_desc", "result_desc", F.concat_ws(",", "tags").alias("tags"), "topic_name", "agent_id", _md5("turns_text").alias("digest"))


@query("SELECT fragment_id, md5(task_desc || chr(10) || result_desc || chr(10) || turns_text) AS digest FROM frags")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return derive.fragments(spark, sf).select("fragment_id", _md5(text.embed_text(F.col("task_desc"), F.col("result_desc"), F.col("turns_text"))).alias("digest"))


@query("SELECT fragment_id FROM frags WHERE date = '2025-06-03'")
def list_fragments_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return fragment_ops.by_date(derive.fragments(spark, sf), "2025-06-03")


# ---- days and topics ----------------------------------------------------------------------------------------


@query("SELECT date, summary_md FROM daily")
def daily_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each date written twice; the second stays."""
    days = derive.daily(derive.fragments(spark, sf))
    writes = days.select("date", F.lit("draft").alias("summary_md"), F.lit(1).alias("arrival")).union(days.select("date", "summary_md", F.lit(2)))
    return daily_ops.latest(writes, "arrival")


@query("SELECT date, string_agg(topic_name, '|' ORDER BY topic_name) AS topics FROM (SELECT DISTINCT date, topic_name FROM frags WHERE topic_name <> '') GROUP BY date")
def daily_topics(spark: SparkSession, sf: str) -> DataFrame:
    days = derive.daily(derive.fragments(spark, sf).where("topic_name <> ''"))
    return days.select("date", F.array_join(daily_ops.topics(F.col("summary_md")), "|").alias("topics"))


@query("SELECT topic_slug, name, date, fragment_id, summary FROM entries")
def topic_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return derive.topic_entries(derive.fragments(spark, sf)).select("topic_slug", "name", "date", "fragment_id", "summary")


@query("SELECT topic_slug, name, start_date, end_date, n_entries, summary FROM topics")
def topic_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = topic_ops.index(derive.topic_entries(derive.fragments(spark, sf)))
    return rows.select("topic_slug", "name", "start_date", "end_date", F.size("entries").cast("long").alias("n_entries"), topic_ops.summary().alias("summary"))


_TOPIC_MD = """('# 主题：' || name || '（' || start_date || ' ~ ' || end_date || '）' || chr(10) || chr(10) || '**涵盖日期**：' || days || chr(10) || '**状态**：进行中' || chr(10) || chr(10) || '## 各阶段' || chr(10) || chr(10) || lines || chr(10))"""


@query(f"SELECT topic_slug, {_TOPIC_MD} AS md FROM topics")
def topic_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return topic_ops.index(derive.topic_entries(derive.fragments(spark, sf))).select("topic_slug", topic_ops.markdown().alias("md"))


@query("SELECT topic_slug, name, start_date, end_date, n_entries, (SELECT string_agg(date || ' ' || fragment_id, ',' ORDER BY date) FROM entries e WHERE e.topic_slug = t.topic_slug) AS ids FROM topics t WHERE name <> ''")
def topic_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Topics read back from their Markdown."""
    docs = topic_ops.index(derive.topic_entries(derive.fragments(spark, sf)).where("name <> ''")).select(topic_ops.markdown().alias("md"))
    p = topic_ops.parse_markdown(docs, "md")
    ids = F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["date"], e["fragment_id"])), ",")
    return p.select("topic_slug", "name", "start_date", "end_date", F.size("entries").cast("long").alias("n_entries"), ids.alias("ids"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(trim('  ' || p_name || ' / 粒子 系统!' || chr(9) || p_brand || ' ', ' ' || chr(9)), '\\s+', '-', 'g'), '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}\\-_]', '', 'g') AS slug FROM part
""", base=False)
def topic_slug(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.col("p_name"), F.lit(" / 粒子 系统!\t"), F.col("p_brand"), F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", text.slug(name).alias("slug"))


# ---- listings ------------------------------------------------------------------------------------------------


def _late_days(frags: DataFrame) -> DataFrame:
    """Summaries exist for later dates, and for one without turns."""
    spark = frags.sparkSession
    return derive.daily(frags).where("date > '2025-06-10'").unionByName(spark.createDataFrame([("2025-07-09", "x")], "date string, summary_md string"))


@query("""
SELECT date, max(r)::INT AS has_raw, max(d)::INT AS has_daily FROM (SELECT date, 1 AS r, 0 AS d FROM turns UNION ALL SELECT date, 0, 1 FROM daily WHERE date > '2025-06-10' UNION ALL SELECT '2025-07-09', 0, 1) GROUP BY date
""")
def list_dates(spark: SparkSession, sf: str) -> DataFrame:
    return listing.dates(derive.turns(spark, sf), _late_days(derive.fragments(spark, sf)))


@query("""
SELECT string_agg(date, ',' ORDER BY date) AS dates, count(*) AS count, sum(r)::BIGINT AS has_raw, sum(d)::BIGINT AS has_daily FROM (
  SELECT date, max(r) AS r, max(d) AS d FROM (SELECT date, 1 AS r, 0 AS d FROM turns UNION ALL SELECT date, 0, 1 FROM daily WHERE date > '2025-06-10' UNION ALL SELECT '2025-07-09', 0, 1) GROUP BY date)
""")
def date_totals(spark: SparkSession, sf: str) -> DataFrame:
    return listing.date_totals(derive.turns(spark, sf), _late_days(derive.fragments(spark, sf)))


@query("""
SELECT DISTINCT 0 AS kind, 'memory://raw/' || date AS uri, '对话记录 ' || date AS name, 'application/jsonl' AS mime_type FROM turns
UNION ALL SELECT 1, 'memory://fragments/' || fragment_id, '片段 ' || fragment_id, 'text/markdown' FROM frags
UNION ALL SELECT 2, 'memory://daily/' || date, '每日总结 ' || date, 'text/markdown' FROM daily
UNION ALL SELECT DISTINCT 3, 'memory://topics/' || topic_slug, '主题索引 ' || topic_slug, 'text/markdown' FROM entries
""")
def resource_list(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    return listing.resources(derive.turns(spark, sf), frags, derive.daily(frags), derive.topic_entries(frags))


@query("SELECT session_id, count(*) AS cnt FROM messages GROUP BY session_id")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listing.session_counts(derive.messages(spark, sf)).orderBy(F.desc("cnt"), "session_id")


@query("SELECT id, agent_id FROM sessions WHERE agent_id IS NOT NULL")
def sessions_with_agent(spark: SparkSession, sf: str) -> DataFrame:
    return listing.sessions_with_agent(derive.sessions(spark, sf))


@query("SELECT c_custkey::VARCHAR AS c_custkey, substr(c_name, 1, 12) AS c_name, c_nationkey::VARCHAR AS c_nationkey, substr(coalesce(c_mktsegment, ''), 1, 12) AS c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5", base=False)
def table_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").orderBy("c_custkey").limit(5).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return listing.clipped(rows, 12)


# ---- ingest --------------------------------------------------------------------------------------------------


@query("""
SELECT m.id, m.session_id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, content, substr(created_at, 1, 10) AS date, s.agent_id
FROM (SELECT * FROM messages WHERE id > 100 ORDER BY id LIMIT 50) m LEFT JOIN sessions s ON s.id = m.session_id AND s.agent_id IS NOT NULL
""")
def poll_batch(spark: SparkSession, sf: str) -> DataFrame:
    batch = ingest.poll(derive.messages(spark, sf), 100)
    agents = derive.sessions(spark, sf).where("agent_id is not null").withColumnRenamed("id", "session_id")
    return batch.join(agents, "session_id", "left").select("id", "session_id", text.stored_role(F.col("role")).alias("role"), "content", F.substring("created_at", 1, 10).alias("date"), "agent_id")


@query("SELECT max(id) AS last_id FROM (SELECT id FROM messages WHERE id > 100 ORDER BY id LIMIT 50)")
def poll_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.watermark(ingest.poll(derive.messages(spark, sf), 100), 100)


_FORMS = [
    """'{"message":{"role":"assistant","content":"said ' || event_id || ' é"}}'""",
    """'  plain ' || event_id || ' text ' || chr(9)""",
    "props",
    "'null'",
    """'{"message":{"role":"","content":"x' || event_id || '"}}'""",
    """'{"message":{"role":"user","content":["a"]}}'""",
    "'   '",
    "'12'",
]
_FORM = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"


@query(f"""
WITH m AS (SELECT event_id AS id, {_FORM} AS raw FROM events)
SELECT id, CASE WHEN NOT json_valid(raw) OR raw = 'null' THEN nullif(trim(raw, ' ' || chr(9)), '')
  WHEN coalesce(json_extract_string(raw, '$.message.role'), '') <> '' AND json_type(raw, '$.message.content') = 'VARCHAR' THEN nullif(json_extract_string(raw, '$.message.content'), '') END AS content FROM m
""", base=False)
def content_extract(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_FORM.replace("chr(9)", "char(9)"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), text.message_text(raw).alias("content"))


@query(f"""
WITH m AS (SELECT event_id AS id, user_id, event_type AS role, {_FORM} AS raw, ts FROM events),
c AS (SELECT *, CASE WHEN NOT json_valid(raw) OR raw = 'null' THEN nullif(trim(raw, ' ' || chr(9)), '')
  WHEN coalesce(json_extract_string(raw, '$.message.role'), '') <> '' AND json_type(raw, '$.message.content') = 'VARCHAR' THEN nullif(json_extract_string(raw, '$.message.content'), '') END AS content FROM m)
SELECT id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, content, CASE WHEN user_id % 4 <> 0 THEN 'agent_' || (user_id % 4) END AS agent_id FROM c WHERE length(content) >= 2
""", base=False)
def ingest_turns(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").select("event_id", F.expr(_FORM.replace("chr(9)", "char(9)")).alias("content"))
    rows = derive.messages(spark, sf).drop("content").join(raw, F.col("id") == F.col("event_id")).drop("event_id")
    return ingest.transform(rows, derive.sessions(spark, sf))


@query("SELECT CASE WHEN e.vec_id IS NULL THEN 'skipped' ELSE 'ok' END AS status, count(*) AS count FROM frags f LEFT JOIN embeddings e ON e.vec_id = f.conv_id AND e.label <> 3 GROUP BY 1")
def backfill_status(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of one label are withheld, so that some fragments lack theirs."""
    frags = derive.fragments(spark, sf)
    return encode.status(frags, derive.vectors(spark, sf, frags).where("label <> 3")).groupBy("status").count()


@query("SELECT fragment_id FROM frags f WHERE conv_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3)")
def backfill_missing(spark: SparkSession, sf: str) -> DataFrame:
    frags = derive.fragments(spark, sf)
    return encode.missing(frags, derive.vectors(spark, sf, frags).where("label <> 3")).select("fragment_id")
