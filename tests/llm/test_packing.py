import itertools
import random

from lamina.llm import packing


def padding(lengths, counts, tops):
    return sum((min(t for t in tops if t >= n) - n) * c for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 10)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)
        got = packing.boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*pick, lengths[-1]]) for pick in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert padding(lengths, counts, got) == best and len(got) == min(k, len(lengths)) and got[-1] == lengths[-1]
    assert packing.boundaries([], [], 3) == []
    assert packing.boundaries([1, 1 << 61], [1 << 10, 1 << 10], 1) == [1 << 61]


def test_long_lengths_are_rounded_up(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 32768, 32769, 40001, 65536, 65537, 10**9, 2**40 + 1]
    for r in spark.createDataFrame([(v,) for v in values], "n long").select("n", packing.rounded(F.col("n")).alias("r")).collect():
        assert r.n <= r.r <= r.n * (1 + 2 / packing.EXACT) + 1 and (r.n > packing.EXACT or r.r == r.n)


def test_batches(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 5, 50, 51, 400])))) for i in range(700)] + [(None, None), (5, "a b"), (5, "a b"), (9001, "w " * 20000), (9002, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    out = packing.pack_texts(df, "doc_id", "text", 4, 1000).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        assert 0 <= r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens
        groups.setdefault((r.bucket, r.batch), []).append(r.position)
    for (bucket, batch), positions in groups.items():
        assert sorted(positions) == list(range(len(positions)))
        assert len(positions) == 1 or bucket * len(positions) <= 1000 or bucket == 0
    for bucket in {b for b, _ in groups}:
        numbers = sorted(n for b, n in groups if b == bucket)
        assert numbers == list(range(len(numbers)))
        full = max(1000 // max(bucket, 1), 1)
        assert all(len(groups[bucket, n]) == full for n in numbers[:-1])
    assert packing.pack_texts(df.limit(0), "doc_id", "text").count() == 0


def test_string_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(f"k{i}", i % 5, "mine", 9) for i in range(100)] + [(None, 2, "mine", 9)], "key string, n long, _slot string, bucket int")
    out = packing.pack(df, "key", "n", 3, 20)
    assert out.columns == ["key", "n", "_slot", "bucket", "batch", "position", "padding"] and {r._slot for r in out.collect()} == {"mine"} and out.count() == 101
    assert max(r.bucket for r in out.collect()) == 4


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join("w" for _ in range(int(rng.expovariate(0.02))))) for i in range(400)] + [(400, None), (512, "")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = packing.op1_length_buckets(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(duck.execute(f"SELECT {', '.join(out.columns)} FROM ({packing.OP1_SQL})").fetchall())
