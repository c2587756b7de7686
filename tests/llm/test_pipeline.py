"""The pipeline's stages against brute force on a small fixture; its model verdicts come from the operator."""

import random

import pytest
import test_lines
import test_pii
import test_quality
import test_resemblance
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import pii, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(9)
    texts, labels = test_quality.sample(160, 3)
    passage = "\n".join(f"shared line number {i} of a passage" for i in range(9))
    rows = []
    for i, t in enumerate(texts):
        t = t.replace(" ", "\n", 3) if i % 5 == 0 else t
        if i % 7 == 0:
            t += "\n" + passage
        if i % 11 == 0:
            t += f"\nwrite to user{i}@mail.example.com or 10.0.{i % 200}.7 today"
        rows.append((i, t))
    rows += [(200 + i, rows[3 * i + 1][1]) for i in range(20)] + [(300, None), (301, ""), (302, "one two"), (303, "w " * 500)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t or ""), "extra") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "personal_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    out = stages["quality_rules"](spark, docs, folder).cache()
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    rows = {d: t for d, t in rows.items() if verdicts[d]}
    assert {r.doc_id: r.text for r in out.collect()} == rows and out.columns == corpus_pipeline.COLUMNS and 50 < len(rows) < 160

    out = stages["line_dedup"](spark, out, folder).cache()
    brute = test_lines.brute(list(rows.items()))
    rows = {d: t for d, (_, gone, t) in brute.items() if not gone or (t or "").split()}
    assert {r.doc_id: r.text for r in out.collect()} == rows and out.where(F.col("n_chars") != F.length("text")).count() == 0

    out = stages["simhash_near_dedup"](spark, out, folder).cache()
    rows = {d: rows[d] for d in test_resemblance.brute_kept(list(rows.items()))}
    assert {r.doc_id: r.text for r in out.collect()} == rows

    out = stages["personal_data"](spark, out, folder).cache()
    found = {r.doc_id: r.text for r in out.collect()}
    assert found.keys() == rows.keys()
    for d, t in rows.items():
        assert not test_pii.brute(found[d])
        if not any(c.isdigit() or c == "@" for c in t):
            assert found[d] == t
    assert any("<EMAIL>" in t for t in found.values()) and pii.KINDS[0] == "email"

    packed = stages["packing"](spark, out, folder)
    assert {r.doc_id: r.n_tokens for r in packed.collect()} == {d: len(t.encode().split()) for d, t in found.items()}


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 30
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
