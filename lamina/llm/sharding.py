"""Sharding by weighted rendezvous hashing, in DataFrame functions alone.

Each shard j draws u_j in (0, 1) from XXH64 of (key, j); a row goes to the shard with the least
-ln(u_j) / weight_j. A shard thus gets rows in proportion to its weight, the key and the shards
decide alone, and a further shard takes rows only into itself.

Defined results: a null key is a key like any other (all its rows share a shard); rows that share a
key share a shard; a null text counts 0 bytes; an empty table gives no rows; all input columns stay, but
shard, slot and grown_shard take the place of input columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPREAD, documents, gapless

SHARDS = 40


def _draws(key: Column, weights: list[float]) -> Column:
    """array<struct<score, shard>> of all shards."""

    def draw(weight: Column, j: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, j), 11).cast("double") + 0.5) * 2.0**-53
        return F.struct((-F.ln(u) / weight).alias("score"), j.alias("shard"))

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), draw)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (int, from 0) of a key among shards of these positive weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(_draws(key, weights))["shard"]


def shard(df: DataFrame, key: str, weights: list[float], shard_col: str = "shard") -> DataFrame:
    """df with the shard of each row, in place."""
    return df.withColumn(shard_col, rendezvous(F.col(key), weights))


def sharded_slots(df: DataFrame, key: str, weights: list[float], grown: list[float]) -> DataFrame:
    """df with shard, grown_shard (under the weights `grown`) and slot, gapless from 0 in each shard."""
    placed = shard(df, key, weights).withColumn("grown_shard", rendezvous(F.col(key), grown))
    return gapless(placed, ["shard"], [key, *[c for c in df.columns if c != key]], F.pmod(F.xxhash64(F.col(key)), F.lit(SPREAD)), "slot")


def write_shards(df: DataFrame, path: str, key: str, weights: list[float], files: int = 1) -> None:
    """Write df under path/shard=j/. Each shard is dealt to `files` tasks by the key's hash, so the size of a file is set by `files`."""
    placed = shard(df, key, weights).withColumn("_lamina_file", F.pmod(F.xxhash64(F.col(key)), F.lit(files)))
    placed.repartition(len(weights) * files, "shard", "_lamina_file").drop("_lamina_file").write.partitionBy("shard").parquet(path)


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharded_slots(rows, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
