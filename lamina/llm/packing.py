"""Packing into optimal length buckets and token-budget batches.

The histogram of lengths over all rows goes through a dynamic program that picks the bucket boundaries
with the least padding when every row is padded to its bucket's boundary; ties take the smaller boundary. Boundaries
are exact for any number of different lengths: the driver holds some 200 bytes for each (m different lengths have a sum of m * m / 2 words at least, so a
million of them mean 500 billion words), and looks at DISTINCT candidates at once. Batches then form inside each bucket: rows are
numbered without gaps and every budget // boundary of them (one at least) make a batch.

Defined results: a null or empty text has length 0; a row longer than the budget is a batch of its own; rows
that tie are numbered in any order among themselves; with fewer distinct lengths than buckets each length is a
bucket; an empty table gives no rows; a key may have any type
that can be sorted and cast to a string; other columns are kept by `pack`, whose bucket, batch, position and padding take the place of input columns of
those names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, gapless, spread

BUCKETS, BUDGET, EXACT, DISTINCT = 8, 8192, 1 << 15, 1 << 18


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space, as a long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rounded(length: Column, exact: int = EXACT) -> Column:
    """Lengths up to `exact` as they are, longer ones rounded up to a multiple of a power of two that keeps exact / 2 steps an octave.
    Nothing here uses it: `pack`, and so op 1 and the pipeline's packing stage, take every length as it is."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(length - 1, F.lit(1)))) - int(np.log2(exact)) + 1, F.lit(0))).cast("long")
    return F.when(length <= exact, length).otherwise(F.ceil(length / step).cast("long") * step)


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper boundaries, ascending, of at most `buckets` buckets with the least total padding. Python integers keep sums exact.

    best[k][j]: least padding of the first j lengths in k buckets. The best split never moves left as j
    grows, so each layer is solved by divide and conquer in O(m log m), many intervals at once."""
    m = len(lengths)
    if not m:
        return []
    kind = object if int(max(lengths)) * sum(map(int, counts)) >= 1 << 62 else np.int64
    size, count = np.array(lengths, kind), np.array(counts, kind)
    n = np.concatenate([np.zeros(1, kind), np.cumsum(count)])
    s = np.concatenate([np.zeros(1, kind), np.cumsum(size * count)])
    buckets = min(buckets, m)
    best = np.concatenate([np.zeros(1, kind), size * n[1:] - s[1:]])
    splits = []
    for k in range(2, buckets + 1):
        new, split = best.copy(), np.zeros(m + 1, np.int32 if m < 1 << 31 else np.int64)
        todo = [np.array([[k], [m], [k - 1], [m - 1]])]
        while todo:
            a, b, lo, hi = todo.pop()
            j = (a + b) // 2
            new[j], at = _least(size, n, s, best, j, lo, np.minimum(hi, j - 1))
            split[j] = at
            below = np.concatenate([np.stack([a, j - 1, lo, at]), np.stack([j + 1, b, at, hi])], axis=1)
            below = below[:, below[0] <= below[1]]
            todo += [below[:, x : x + DISTINCT] for x in range(0, below.shape[1], DISTINCT)]
        best = new
        splits.append(split)
    out, j = [int(size[-1])], m
    for split in reversed(splits):
        j = int(split[j])
        out.append(int(size[j - 1]))
    return out[::-1]


def _least(size: np.ndarray, n: np.ndarray, s: np.ndarray, best: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least cost of a split in [lo, hi] before it and the first split that has it; DISTINCT splits are looked at at once."""
    ends = np.cumsum(hi - lo + 1)
    begins = ends - (hi - lo + 1)
    cost, at = np.zeros(len(j), best.dtype), np.full(len(j), -1)
    for p in range(0, int(ends[-1]), DISTINCT):
        q = min(p + DISTINCT, int(ends[-1]))
        own = np.arange(np.searchsorted(ends, p, "right"), np.searchsorted(ends, q - 1, "right") + 1)
        first = np.maximum(begins[own], p) - p
        each = np.diff(np.r_[first, q - p])
        i = np.arange(p, q) + np.repeat(lo[own] - begins[own], each)
        to = np.repeat(j[own], each)
        costs = best[i] + size[to - 1] * (n[to] - n[i]) - (s[to] - s[i])
        least = np.minimum.reduceat(costs, first)
        hits = np.flatnonzero(costs == np.repeat(least, each))
        hits = hits[np.searchsorted(hits, first)]
        better = (at[own] < 0) | (least < cost[own])
        cost[own[better]], at[own[better]] = least[better], i[hits[better]]
    return cost, at


def pack(df: DataFrame, key: str, length: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """df with bucket (its boundary), batch (from 0 in each bucket), position (from 0 in each batch) and padding."""
    histogram = df.groupBy(F.col(length).cast("long").alias("length")).count().toArrow().sort_by("length")
    if histogram["length"].null_count:
        raise ValueError("a length is null")
    tops = boundaries(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets)
    bucket = F.lit(None).cast("long")
    for top in reversed(tops):
        bucket = F.when(F.col(length) <= top, F.lit(top).cast("long")).otherwise(bucket)
    rows = df.withColumn("bucket", F.coalesce(bucket, F.lit(0).cast("long")))
    rows = gapless(rows, ["bucket"], [key, length], spread(F.col(key)), "_lamina_slot")
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1))), F.lit(1)).cast("long")
    rows = rows.withColumns({"batch": F.floor(F.col("_lamina_slot") / each).cast("long"), "position": F.pmod("_lamina_slot", each).cast("long"), "padding": F.col("bucket") - F.col(length)})
    added = ["bucket", "batch", "position", "padding"]
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *added)


def pack_texts(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, n_tokens, bucket, batch, position, padding) of each row."""
    lengths = cut(docs.select(key, word_count(F.col(text)).alias("n_tokens")))
    return pack(lengths, key, "n_tokens", buckets, budget)


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "n_tokens", "bucket", "batch", "position", "padding")


def _sql() -> str:
    """The dynamic program layer by layer."""
    layers = ["f1 AS (SELECT j, len * n - s AS cost, 0 AS split FROM p)"]
    for k in range(2, BUCKETS + 1):
        layers.append(
            f"f{k} AS (SELECT j, min(cost) AS cost, arg_min(i, (cost, i)) AS split FROM (SELECT b.j, a.j AS i, a.cost + b.len * (b.n - q.n) - (b.s - q.s) AS cost "
            f"FROM f{k - 1} a JOIN p q ON q.j = a.j JOIN p b ON b.j > a.j) GROUP BY j)"
        )
    # Fewer distinct lengths than buckets: the last layer that reaches the last length.
    picks = [f"b{BUCKETS} AS (SELECT max(j) AS j, least({BUCKETS}, max(j)) AS k FROM p)"]
    for k in range(BUCKETS, 1, -1):
        picks.append(f"b{k - 1} AS (SELECT CASE WHEN b.k < {k} THEN b.j ELSE (SELECT split FROM f{k} WHERE f{k}.j = b.j) END AS j, least(b.k, {k - 1}) AS k FROM b{k} b)")
    tops = " UNION ".join(f"SELECT len FROM p JOIN b{k} USING (j)" for k in range(1, BUCKETS + 1))
    return f"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
p AS (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(c) OVER (ORDER BY len))::BIGINT AS n, (sum(c * len) OVER (ORDER BY len))::BIGINT AS s
  FROM (SELECT n_tokens AS len, count(*) AS c FROM t GROUP BY 1)),
{", ".join(layers)}, {", ".join(picks)},
tops AS ({tops}),
r AS (SELECT t.doc_id, t.n_tokens, (SELECT min(len) FROM tops WHERE len >= t.n_tokens) AS bucket FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT, 0), doc_id, n_tokens) - 1 AS slot, greatest({BUDGET} // greatest(bucket, 1), 1) AS each FROM r)
SELECT doc_id, n_tokens, bucket, (slot // each)::BIGINT AS batch, (slot % each)::BIGINT AS position, bucket - n_tokens AS padding FROM o
"""


OP1_SQL = _sql()
