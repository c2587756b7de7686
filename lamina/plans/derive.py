"""Memory entities derived from the test tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fragments as fragment_ops
from ..operators import topics as topic_ops
from ..operators.numbering import numbered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select(
        F.expr("date_format(date_add(date '2025-06-01', cast(conv_id % 30 as int)), 'yyyy-MM-dd')").alias("date"), "conv_id", "turn",
        text.stored_role(F.col("role")).alias("role"), F.col("text").alias("content"), F.expr("case when conv_id % 3 <> 0 then concat('agent_', conv_id % 3) end").alias("agent_id"),
    )
    return numbered(rows, ["date"], ["conv_id", "turn"], F.col("conv_id"), "seq").withColumn("turn_id", text.turn_id(F.col("seq")))


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Fragment inputs: one per conversation."""
    t = turns(spark, sf)
    said = F.struct("seq", "content")
    rows = t.groupBy("conv_id").agg(
        F.min("date").alias("date"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("agent_id").alias("agent_id"),
        F.min(F.when(F.col("role") == "user", said)).alias("first"), F.max(F.when(F.col("role") == "assistant", said)).alias("last"),
    )
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), "label")
    return rows.join(labels, "conv_id", "left").select(
        "conv_id", "date", text.turn_id(F.col("a")).alias("start_turn_id"), text.turn_id(F.col("b")).alias("end_turn_id"), F.coalesce("first.content", F.lit("")).alias("task_desc"),
        F.coalesce("last.content", F.lit("")).alias("result_desc"), F.array(F.concat(F.lit("conv_"), F.col("conv_id")), F.coalesce(F.concat(F.lit("label_"), F.col("label")), F.lit("none"))).alias("tags"),
        F.coalesce(F.concat(F.lit("topic "), F.col("label")), F.lit("")).alias("topic_name"), "agent_id",
    )


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    return fragment_ops.create_fragments(inputs(spark, sf), turns(spark, sf), None, "conv_id", keep=("conv_id",))


def vectors(spark: SparkSession, sf: str, frags: DataFrame | None = None) -> DataFrame:
    """Vectors of fragments, and under other ids those that have no fragment."""
    ids = (frags if frags is not None else fragments(spark, sf)).select("fragment_id", F.col("conv_id").alias("vec_id"))
    return table(spark, sf, "embeddings").join(ids, "vec_id", "left").select(F.coalesce("fragment_id", F.concat(F.lit("none/"), F.col("vec_id"))).alias("fragment_id"), "embedding", "vec_id", "label")


def vector_of(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def daily(frags: DataFrame) -> DataFrame:
    names = F.array_join(F.transform(F.array_sort(F.collect_set("topic_name")), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    return frags.groupBy("date").agg(F.concat(F.lit("**涉及主题**: "), names).alias("summary_md"))


def topic_writes(frags: DataFrame) -> DataFrame:
    return frags.select(F.col("topic_name").alias("name"), "date", "fragment_id", F.col("task_desc").alias("summary"), F.col("conv_id").alias("arrival"))


def topic_entries(frags: DataFrame) -> DataFrame:
    return topic_ops.upsert(topic_writes(frags))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("role"), F.col("props").alias("content"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(F.col("user_id").cast("string").alias("id"), F.expr("case when user_id % 4 <> 0 then concat('agent_', user_id % 4) end").alias("agent_id"))


SQL = """
WITH turns AS (
  SELECT conv_id, turn, strftime(DATE '2025-06-01' + (conv_id % 30)::INT, '%Y-%m-%d') AS date,
    (row_number() OVER (PARTITION BY conv_id % 30 ORDER BY conv_id, turn))::INT AS seq,
    CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text AS content,
    CASE WHEN conv_id % 3 <> 0 THEN 'agent_' || (conv_id % 3) END AS agent_id
  FROM conversations),
frags0 AS (
  SELECT conv_id, min(date) AS date, min(seq) AS a, max(seq) AS b, min(agent_id) AS agent_id,
    coalesce(arg_min(content, seq) FILTER (WHERE role = 'user'), '') AS task_desc,
    coalesce(arg_max(content, seq) FILTER (WHERE role = 'assistant'), '') AS result_desc,
    string_agg((CASE WHEN role = 'user' THEN '[用户]：' ELSE '[AI]：' END) || content, chr(10) || chr(10) ORDER BY seq) AS turns_text
  FROM turns GROUP BY conv_id),
frags AS (
  SELECT f.*, (row_number() OVER (PARTITION BY date ORDER BY conv_id))::INT AS frag_no,
    date || '/frag_' || printf('%03d', row_number() OVER (PARTITION BY date ORDER BY conv_id)) AS fragment_id,
    'turn_' || printf('%04d', a) AS start_turn_id, 'turn_' || printf('%04d', b) AS end_turn_id,
    'conv_' || conv_id || ',' || coalesce('label_' || e.label, 'none') AS tags,
    coalesce('topic ' || e.label, '') AS topic_name, coalesce('topic-' || e.label, '') AS topic_slug
  FROM frags0 f LEFT JOIN embeddings e ON e.vec_id = f.conv_id),
vectors AS (
  SELECT coalesce(f.fragment_id, 'none/' || e.vec_id) AS fragment_id, e.embedding::DOUBLE[] AS v, f.fragment_id IS NOT NULL AS known, f.agent_id, e.vec_id
  FROM embeddings e LEFT JOIN frags f ON f.conv_id = e.vec_id),
daily AS (
  SELECT date, '**涉及主题**: ' || string_agg('`' || topic_name || '`', ' ' ORDER BY topic_name) AS summary_md
  FROM (SELECT DISTINCT date, topic_name FROM frags) GROUP BY date),
entries AS (
  SELECT topic_slug, topic_name AS name, date, fragment_id, task_desc AS summary, conv_id AS arrival
  FROM frags QUALIFY row_number() OVER (PARTITION BY topic_slug, date ORDER BY conv_id) = 1),
topics AS (
  SELECT topic_slug, arg_min(name, arrival) AS name, min(date) AS start_date, max(date) AS end_date, count(*) AS n_entries,
    string_agg(date || '：' || summary, '；' ORDER BY date) AS summary,
    string_agg(date, ', ' ORDER BY date) AS days,
    string_agg('- ' || date || '：' || summary || '（→ daily/' || date || '.md → ' || fragment_id || '）', chr(10) ORDER BY date) AS lines
  FROM entries GROUP BY topic_slug),
messages AS (
  SELECT event_id AS id, user_id::VARCHAR AS session_id, event_type AS role, props AS content, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events),
sessions AS (
  SELECT DISTINCT user_id::VARCHAR AS id, CASE WHEN user_id % 4 <> 0 THEN 'agent_' || (user_id % 4) END AS agent_id FROM events)
"""
