"""Search: exact top-k by vector or by keywords, joined back to the daily and topic context of every hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vector
from . import topics

DEFAULT_K = 10
#: Queries scored in one pass over the vectors; more are taken in blocks of this size.
QUERY_BLOCK = 256
#: Keyword queries that are scored as literals.
FEW_QUERIES = 8
#: Hits up to which they are broadcast.
FEW_HITS = 100_000


def checked_k(k: float | None) -> int:
    k = DEFAULT_K if k is None else int(k)
    if k < 0:
        raise ValueError("top_k must not be negative")
    return k


def owned_by(rows: DataFrame, agent: str | None) -> DataFrame:
    """Rows of one agent; no or an empty agent takes all, unowned ones too."""
    return rows.where(F.col("agent_id") == agent) if agent else rows


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, fragment_id, score, rank): the k best of each query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fragment_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_scores(vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(query_id, fragment_id, score) that can be among a query's k best, score > 0: each Arrow batch leaves its own k best, so next to nothing is shuffled."""
    asked = [(q, np.asarray(v, np.float64)) for q, v in queries]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for q, v in asked:
                score = vector.batch_cosine(batch.column(1), v)
                hit = np.flatnonzero(score > 0)  # not for NaN
                if len(hit) > k:
                    least = np.partition(score[hit], len(hit) - k)[len(hit) - k] if k else np.inf
                    sure, ties = hit[score[hit] > least], hit[score[hit] == least]
                    if len(sure) + len(ties) > k:  # equal vectors: the smaller ids count, so that a batch leaves k rows at most
                        names = ids.take(pa.array(ties)).to_pylist()
                        ties = ties[sorted(range(len(ties)), key=names.__getitem__)[: k - len(sure)]]
                    hit = np.concatenate([sure, ties])
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(hit), pa.string()), ids.take(pa.array(hit)), pa.array(score[hit])], ["query_id", "fragment_id", "score"])

    return vectors.select("fragment_id", "embedding").mapInArrow(run, "query_id string, fragment_id string, score double")


def vector_search(vectors: DataFrame, fragments: DataFrame, queries: list[tuple[str, list[float]]], k: int | None = None, agent: str | None = None) -> DataFrame:
    """The k best of each (query_id, vector): (query_id, fragment_id, score, rank). Vectors without a fragment are never seen."""
    k = checked_k(k)
    seen = vectors.join(owned_by(fragments, agent).select("fragment_id"), "fragment_id", "left_semi")
    blocks = [queries[i : i + QUERY_BLOCK] for i in range(0, len(queries), QUERY_BLOCK)] or [[]]
    out = vector_scores(seen, blocks[0], k)
    for block in blocks[1:]:
        out = out.union(vector_scores(seen, block, k))
    return best(out, k)


def keyword_search(fragments: DataFrame, queries: list[tuple[str, str]], k: int | None = None, agent: str | None = None) -> DataFrame:
    """As vector_search, by token overlap. A few queries are literals that each fragment is scored against in one projection, without a shuffle but
    for the k best; of more, fragments meet queries on shared tokens, so those without overlap are never paired."""
    k = checked_k(k)
    spark = fragments.sparkSession
    asked = spark.createDataFrame(queries or [], "query_id string, query string").withColumn("_q", text.tokens(F.col("query")))
    own = owned_by(fragments, agent).select("fragment_id", text.tokens(text.keyword_text(F.col("task_desc"), F.col("result_desc"), F.col("turns_text"))).alias("_t"))
    if 0 < len(queries) <= FEW_QUERIES:
        literals = [(r.query_id, r._q) for r in asked.collect() if r._q]
        score = lambda q: text.jaccard(F.col("_t"), F.array(*map(F.lit, q)))
        scored = F.array(*[F.struct(F.lit(i).alias("query_id"), score(q).alias("score")) for i, q in literals]) if literals else F.expr("cast(array() as array<struct<query_id: string, score: double>>)")
        hits = own.select("fragment_id", F.explode(scored).alias("s")).select("s.query_id", "fragment_id", "s.score").where("score > 0")
        return best(hits, k)
    words = asked.select("query_id", F.size("_q").alias("_n"), F.explode("_q").alias("token"))
    pairs = own.select("fragment_id", F.size("_t").alias("_m"), F.explode("_t").alias("token")).join(F.broadcast(words) if len(queries) <= QUERY_BLOCK else words, "token")
    shared = pairs.groupBy("query_id", "fragment_id").agg(F.count(F.lit(1)).alias("_s"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
    return best(shared.select("query_id", "fragment_id", (F.col("_s") / (F.col("_n") + F.col("_m") - F.col("_s"))).alias("score")), k)


def hydrate(hits: DataFrame, fragments: DataFrame, daily: DataFrame, entries: DataFrame, few: bool = False) -> DataFrame:
    """Hits with their fragment's fields, rounded score, turn range, daily summary and topic summary (null without a topic).
    few: the hits are known to be few (k times the queries), so they are broadcast and no fragment's body is shuffled."""
    index = topics.index(entries).select("topic_slug", topics.summary().alias("topic_summary"))
    rows = fragments.join(F.broadcast(hits) if few else hits, "fragment_id").join(daily.select("date", F.nullif("summary_md", F.lit("")).alias("daily_summary")), "date", "left")
    rows = rows.join(index, (rows.topic_slug == index.topic_slug) & (rows.topic_name != ""), "left").drop(index.topic_slug)
    return rows.select(
        "query_id", "rank", "fragment_id", vector.round4(F.col("score")).alias("score"), "task_desc", "result_desc", "tags", "date", F.concat_ws(" ~ ", "start_turn_id", "end_turn_id").alias("turns_range"),
        "agent_id", "daily_summary", "topic_name", "topic_summary",
    )

