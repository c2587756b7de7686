import re

import numpy as np
import pyarrow as pa

from lamina.llm import quality
from lamina.llm.tokens import Words, chunks

TEXTS = [None, "", " \n\t ", "one", "a b c d e f a b c d e", "line one\nline one\n\n\nline two\nline one \n", "#x $y | <z> & * é ñ 日本\x0bq", "w " * 40, "É" * 30 + " b" * 3, "a b c d e\na b c d e\nx", "word " * 9 + "end", "\na b\na b\n"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x) and x in seen:
            dup += 1
        seen.add(x)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_counts_equal_brute_force():
    import random

    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string()), 700):
        c = quality.base(data, offsets, Words(data, offsets))
        got += np.stack([c[k] for k in quality._COUNTS], 1).tolist()
    assert got == [brute(t) for t in texts]


def test_scores_equal_features_times_weights():
    weights = np.random.default_rng(0).normal(size=quality.DIM)
    texts = [t or "" for t in TEXTS]
    want = quality.matrix(texts) @ weights
    got = np.concatenate([quality.scores(d, o, Words(d, o), weights) for _, _, d, o in chunks(pa.array(texts), 100)])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def sample(n, seed):
    import random

    rng = random.Random(seed)
    vocabulary = ["the", "of", "river", "stone", "green", "walks", "under", "sing", "north", "paper", "light", "and"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 60))]
        bad = i % 4 == 0
        texts.append(" ".join(w + "###" if bad else w for w in words))
        labels.append(0 if bad else 1)
    return texts, labels


def test_model_on_held_out_rows_and_whole_operator(spark):
    texts, labels = sample(300, 1)
    held, truth = sample(200, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts + held)] + [(None, None, "x"), (9000, "", "x")], "doc_id long, text string, kept string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, labels[0]), (1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    rows = quality.judge(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    right = [(by_id[300 + i].probability >= 0.5) == bool(y) for i, y in enumerate(truth)]
    assert np.mean(right) > 0.95
    assert by_id[None].base_failed and not by_id[None].kept and by_id[9000].n_words == 0
    for i, t in enumerate(held):
        n, _, _, _, repeat = brute(t)
        r = by_id[300 + i]
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and r.kept == (not r.base_failed and r.probability >= quality.KEEP)
    kept = quality.keep_rows(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_without_labels_everything_passes_the_model(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.kept for r in quality.judge(docs, model).collect()] == [True]
    assert quality.judge(docs.limit(0), model).count() == 0
