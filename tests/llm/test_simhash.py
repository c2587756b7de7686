import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from lamina.llm import simhash


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for text in ["", " \t\n", "One", "one TWO", "One two Three", "Éa b\x0bc  d e É", "a b c " * 50, "x" * 5000 + " y z w"]:
        assert simhash.fingerprint(text.encode(), 3) == brute_fp(text)


def test_bit_slices_equal_popcounts():
    rng = random.Random(3)
    fps = np.array([rng.getrandbits(64) for _ in range(70)] + [0, 2**64 - 1], np.uint64)
    near = np.array([int(f) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:40]], np.uint64)
    for radius in range(7):
        got = simhash.within(simhash.planes(fps), near, radius)
        bits = np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
        want = np.bitwise_count(fps[None, :] ^ near[:, None]) <= radius
        assert (bits.astype(bool) == want).all()


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    fps, ids = [], []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            fps.append(f)
            for _ in range(rng.randrange(3)):
                f ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    links = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() >= 1 for u, v in links)
    from lamina.llm.common import components

    found = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2)).collect()}
    want = brute_groups([s & (2**64 - 1) for s in signed])
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(s)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)] + [base]
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    from lamina.llm.common import components

    found = components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long")).collect()
    assert {r.node for r in found} == set(fps) and {r.root for r in found} == {min(fps)}


def test_whole_operator_with_edge_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None, "a"), (2, "", "a"), (3, long_text, "b"), (4, long_text + " extra", "b"), (5, long_text, None), (None, long_text, "c"), (6, "Hello WORLD", "c"), (7, "hello world", "d"), (7, "hello world", "d")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    want_fp = [brute_fp(t) for _, t, _ in rows]
    groups = brute_groups(want_fp)
    want = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None]
        want.append((d if d is not None else -1, want_fp[i], min(ids)))
    assert got == sorted(want)
    kept = simhash.deduplicate(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, f, c in want if d == c)
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0


def test_far_blocks_are_abandoned():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 64 * 200, np.uint64)
    queries = np.concatenate([fps[:1], rng.integers(0, 1 << 64, 7, np.uint64)])
    work: list[int] = []
    got = np.unpackbits(simhash.within(simhash.planes(fps), queries, 2, work).view(np.uint8), axis=1, bitorder="little")
    assert got.sum() == 1 and got[0, 0]
    # All 64 planes are read for the one near block alone; most others go after 16.
    assert work[0] == 8 * 200 and work[-1] == 1 and sum(work) < 0.4 * 64 * 8 * 200
    assert work[16] < 0.3 * work[0]


def test_hot_fingerprint_and_clashing_key(spark):
    rows = [(i, "same text here") for i in range(3000)] + [(5000 + i, f"other text number {i} of many") for i in range(50)]
    df = spark.createDataFrame(rows, "fp long, text string")
    got = simhash.near_duplicates(df, "fp", "text").collect()
    want = brute_groups([brute_fp(t) for _, t in rows[2999:]])
    assert sum(r.component == 0 for r in got) >= 3000 and len(got) == len(rows)
    assert len({r.component for r in got}) == len(set(want))
    assert sorted(r.fp for r in simhash.deduplicate(df, "fp", "text").collect())[0] == 0
