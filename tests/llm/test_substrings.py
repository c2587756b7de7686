import hashlib
import random
import re

from pyspark.sql import types as T

from lamina.llm import substrings


def brute(rows, size):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [d if d is not None else 2**63 - 1 for d, _ in rows]
    for d, w in zip(order, words):
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (doc, _), d, w in zip(rows, order, words):
        gone = {j for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < (d, i) for j in range(i, i + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc if doc is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, size, anchor, parts):
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])).repartition(parts)
    got = substrings.remove_repeats(df, "doc_id", "text", size, anchor).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, size)


def corpus(seed, vocabulary, n):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                text += p[a:] if rng.random() < 0.5 else p
            else:
                text += [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        rows.append((i * 3 % n, " ".join(text)))
    return rows + rows[:3]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 500)
    check(spark, corpus(1, [f"w{i}é" for i in range(300)], 100), 20, 6, 5)
    check(spark, corpus(2, ["a", "b", "c"], 80), 8, 3, 4)
    check(spark, corpus(3, ["a", "bb"], 60), 20, 6, 7)


def test_edge_rows(spark):
    run = "x " * 300
    rows = [(1, None), (2, ""), (3, run), (3, run), (None, run), (4, "\t".join(f"w{i}" for i in range(5000))), (5, "\n".join(f"w{i}" for i in range(100, 4000))), (6, " ".join(f"w{i}" for i in range(19)))]
    check(spark, rows, 20, 6, 3)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, doc int, spans int, start int")
    assert substrings.remove_repeats(df, "doc_id", "text").count() == 0


def test_matched_spans_without_equal_words_are_dropped(spark):
    import numpy as np

    columns = {"a": np.array([1, 1, 2, 2, 3], np.uint64), "b": np.array([7, 7, 8, 9, 4], np.uint64), "d": np.array([5, 1, 6, 1, 9]), "t": np.zeros(5, int), "s": np.array([10, 20, 30, 40, 50]), "n": np.array([3, 0, 3, 0, 3])}
    rows = [(b, substrings.DIGESTS, m, p) for b, m, p in substrings._deal(columns, columns["a"], 1)]
    got = substrings.confirmed(spark.createDataFrame([(b, k, m, bytearray(p)) for b, k, m, p in rows], substrings._PACKS_DDL)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 10, 3)]


def test_common_phrase_with_different_neighbours(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "HOT_SAMPLE", 1)
    monkeypatch.setattr(substrings, "HOT_EDGES", 20)
    rng = random.Random(12)
    phrase = " ".join(f"p{k}" for k in range(16))
    rows = []
    for i in range(400):
        around = [f"v{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((i, " ".join([*around[:20], *(phrase.split() if i % 10 else []), *around[20:]])))
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(1000 + i, f"a{i} {phrase} {shared} z{i}") for i in range(5)] + [(2000, rows[7][1]), (2001, rows[8][1] + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(substrings.hot_anchors(df, "doc_id", "text", 20, 6)) >= 1
    check(spark, rows, 20, 6, 4)


def test_other_keys(spark):
    run = " ".join(f"w{i}" for i in range(40))
    rows = [("b", run), ("a", "x " + run), (None, run), ("c", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df, "id", "text").collect()}
    assert got == {"a": (41, 0), "b": (40, 40), None: (40, 40), "c": (0, 0)}


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, (_, t) in enumerate(corpus(7, [f"w{i}é" for i in range(200)], 60))] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = substrings.op9_debruijn_repeats(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(duck.execute(f"SELECT {', '.join(out.columns)} FROM ({substrings.OP9_SQL})").fetchall())
