import math

import pytest
from pyspark.sql import functions as F

from lamina.functions import text, vector


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_trim_takes_unicode_white_space(spark):
    assert one(spark, text.trim, "\t\n　 ﻿ a b ﻿ ") == "a b"


@pytest.mark.parametrize("name, slug", [(" a/b  c ", "ab-c"), ("粒子 系统!", "粒子-系统"), ("***", ""), ("A", "A"), ("a", "a")])
def test_slug(spark, name, slug):
    assert one(spark, text.slug, name) == slug


@pytest.mark.parametrize("n, want", [(1, "turn_0001"), (9999, "turn_9999"), (10000, "turn_10000")])
def test_turn_id(spark, n, want):
    assert spark.range(1).select(text.turn_id(F.lit(n)).alias("y")).first().y == want


def test_tokens(spark):
    got = one(spark, text.tokens, "粒子x系统 3D café _x A_b")
    assert sorted(got) == sorted(["粒", "子", "系", "统", "粒子", "子系", "系统", "x", "d", "caf", "_x", "a_b"])
    assert one(spark, text.tokens, "") == [] and one(spark, text.tokens, None) == []


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r.y for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("y")).collect()] == [1 / 3, 0.0, 1.0]


MESSAGES = [
    ('{"message":{"role":"user","content":"hi"}}', "hi"), ('{"message":{"role":"","content":"hi"}}', None), ('{"message":{"role":"user","content":["hi"]}}', None),
    ('{"message":{"role":"user","content":""}}', None), ("{}", None), ("123", None), ("null", "null"), ("  not json ", "not json"), ("   ", None), ("x", "x"), (None, None),
]


@pytest.mark.parametrize("raw, want", MESSAGES)
def test_message_text(spark, raw, want):
    assert one(spark, text.message_text, raw) == want


def test_cosine(spark):
    rows = [([], [1.0]), ([1.0, 2.0], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0]), ([3.0, 4.0], [-3.0, -4.0]), (None, [1.0])]
    got = [r.y for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(vector.cosine(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got[:3] == [0, 0, 0] and got[5] == 0 and math.isclose(got[3], 1) and math.isclose(got[4], -1)


def test_batch_cosine_equals_the_expression(spark):
    import numpy as np
    import pyarrow as pa

    column = pa.array([[], [1.0, 2.0], None, [0.0, 0.0], [1.0], [3.0, -1.0], [float("nan"), 1.0]], pa.list_(pa.float32()))
    got = vector.batch_cosine(column, np.array([1.0, 2.0]))
    want = [0, 1, 0, 0, 0, 1 / math.sqrt(50)]
    assert np.allclose(got[:6], want) and not got[6] > 0
    assert np.allclose(vector.batch_cosine(column.slice(1, 3), np.array([1.0, 2.0])), [1, 0, 0])
