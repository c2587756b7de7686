import collections
import math
import struct
import zlib

import xxhash

from lamina.llm import sharding


def brute(key, weights):
    seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    draws = [(-math.log(((xxhash.xxh64(struct.pack("<i", j), seed=seed).intdigest() >> 11) + 0.5) * 2.0**-53) / w, j) for j, w in enumerate(weights)]
    return min(draws)[1]


def test_equals_brute_force_and_slots_are_gapless(spark):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(None, None), (None, "x"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, shard int, slot int").drop("shard", "slot")
    weights = [1.0] * 40
    out = sharding.sharded_slots(df, "doc_id", weights, weights + [1.0]).collect()
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        assert r.shard == brute(r.doc_id, weights)
        assert r.grown_shard == brute(r.doc_id, weights + [1.0]) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 40 for r in out) / len(out)
    assert 0.01 < moved < 0.05


def test_weights(spark):
    df = spark.range(8000).withColumnRenamed("id", "doc_id")
    n = collections.Counter(r.shard for r in sharding.shard(df, "doc_id", [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 8000 < 0.8


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, "é", "b")], "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in sharding.op10_rendezvous_shards(spark, str(tmp_path)).collect()}
    assert (out[1].size, out[1].text_crc32) == (16, 0) and (out[2].size, out[2].text_crc32) == (18, zlib.crc32("é".encode()))
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", [1.0] * 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert sharding.op10_rendezvous_shards(spark, str(tmp_path)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op10_rendezvous_shards(spark, str(tmp_path / "none")).count() == 0


def test_many_null_keys_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(None, "x", i) for i in range(2000)] + [(1, "y", 0)], "doc_id long, _file string, slot int")
    out = sharding.sharded_slots(df, "doc_id", [1.0] * 5, [1.0] * 6).collect()
    nulls = [r.slot for r in out if r.doc_id is None]
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len(set(nulls)) == 2000 and max(nulls) <= 2000
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", [1.0] * 5, files=2)
    assert {r._file for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"x", "y"}
