"""Near duplicates by Jaccard similarity against brute force, and the pipeline's stage over them."""

import random

import corpus_pipeline
import numpy as np
from lamina.llm import resemblance


def brute_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute_kept(rows):
    """Ids that stay, of rows (id, text) with unique ids."""
    sets, root = {d: brute_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (not sets[a] and not sets[b] or len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4 > 0):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in root if find(d) == d)


def sample(seed=11):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 20, 60, 200, 900]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            new = list(words)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(3000)}"
            rows.append(" ".join(new))
    rows += [None, "", " \n", "one two", "One  TWO", "one two three"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in out.collect()) == want and len(want) < 0.6 * len(rows)


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "BLOCK", 5)
    rows = sample(12)
    df = spark.createDataFrame(rows, "k long, t string")
    assert sorted(r.k for r in resemblance.deduplicate(df, "k", "t").collect()) == brute_kept(rows)


def test_null_key_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(None, text), (3, text + " more"), (4, text)], "k long, t string")
    assert [r.k for r in resemblance.deduplicate(df, "k", "t").collect()] == [3]
    assert resemblance.deduplicate(df.limit(0), "k", "t").count() == 0


def test_spread_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(20):
        rows = [t for _, t in sample(rng.randrange(10**6))][:60]
        sets = [resemblance.shingles((t or "").encode()) for t in rows]
        sets = [s for s in sets if len(s)]
        root = np.array([i if rng.random() < 0.9 else rng.randrange(i + 1) for i in range(len(sets))])

        def groups(links):
            at = list(range(len(sets)))

            def find(i):
                while at[i] != i:
                    i = at[i]
                return i

            for a, b in [*links, *((i, int(np.flatnonzero(root == r)[0])) for i, r in enumerate(root))]:
                a, b = find(a), find(b)
                at[max(a, b)] = min(a, b)
            return [find(i) for i in range(len(sets))]

        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if resemblance.similar(sets[i], sets[j])]
        links = resemblance.joined(sets, root)
        assert groups(links) == groups(pairs) and len(links) <= len(sets)
