"""Boundaries of lengths above EXACT."""

import random

from lamina.llm import packing


def test_boundaries_of_long_lengths_are_exact(spark, monkeypatch):
    values = [5, 40001, 70003, 100001, 1000003]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, n long")
    assert {r.n: r.bucket for r in packing.pack(df, "k", "n").collect()} == {v: v for v in values}
    monkeypatch.setattr(packing, "DISTINCT", 3)
    for r in packing.pack(df, "k", "n").collect():
        assert r.n <= r.bucket <= r.n * (1 + 2 / packing.EXACT) + 1 and r.padding == r.bucket - r.n


def test_more_lengths_than_are_looked_at_at_once(spark, monkeypatch):
    n = packing.DISTINCT + 10_000
    df = spark.range(n).selectExpr("id AS k", "40001 + 3 * id + id % 2 AS n")
    tops = packing.boundaries([40001 + 3 * i + i % 2 for i in range(n)], [1] * n, 8)
    assert [r.bucket for r in packing.pack(df, "k", "n").select("bucket").distinct().orderBy("bucket").collect()] == tops
    monkeypatch.setattr(packing, "DISTINCT", 3)
    values = [5, 40001, 70003, 100001, 1000003]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, n long")
    assert {r.n: r.bucket for r in packing.pack(df, "k", "n").collect()} == {v: v for v in values}


def test_boundaries_do_not_depend_on_the_steps(monkeypatch):
    rng = random.Random(4)
    cases = [(sorted(rng.sample(range(90), m)), [rng.choice([1, 1, 2, 9]) for _ in range(m)], k) for m in (1, 2, 9, 40) for k in (1, 2, 8)]
    whole = [packing.boundaries(*case) for case in cases]
    for most in (1, 3, 7):
        monkeypatch.setattr(packing, "DISTINCT", most)
        assert [packing.boundaries(*case) for case in cases] == whole


def test_packing_stage_takes_lengths_as_they_are(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "DISTINCT", 3)
    values = [0, 5, 40001, 70003, 100001]
    docs = spark.createDataFrame([(i, "w " * v, "en", "x", 2 * v) for i, v in enumerate(values)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.n_tokens: (r.bucket, r.padding) for r in corpus_pipeline.packing_stage(spark, docs, "").collect()}
    assert got == {v: (v, 0) for v in values}
