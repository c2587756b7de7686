import hashlib
import random

from lamina.llm import lines


def brute(rows):
    """rows (doc_id, text) with unique ids."""

    def cuts(text):
        ls = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        out, first = [], 0
        for i in range(len(ls)):
            roll = 0
            if i >= lines.WINDOW - 1:
                for k in range(i - lines.WINDOW + 1, i + 1):
                    roll = (roll * lines._BASE + h[k]) % lines._MOD
            if i == len(ls) - 1 or (i >= lines.WINDOW - 1 and roll % lines.DIVISOR == 0):
                out.append(ls[first : i + 1])
                first = i + 1
        return out

    seen, got = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            got[d] = (0, 0, None)
            continue
        kept, n, gone = [], 0, 0
        for c in cuts(t):
            n += len(c)
            if len(c) >= lines.MIN_LINES and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
                if len(c) >= lines.MIN_LINES:
                    seen.add(tuple(c))
        got[d] = (n, gone, "\n".join(kept))
    return got


def test_equals_brute_force(spark):
    rng = random.Random(2)
    passage = [f"passage line {i} é" for i in range(12)]
    rows = []
    for i in range(60):
        ls = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(8))]
        if rng.random() < 0.6:
            ls += passage[rng.randrange(4) :] if rng.random() < 0.3 else passage
        ls += [f"tail {rng.randrange(400)}" for _ in range(rng.randrange(5))]
        rows.append((i, "\n".join(ls)))
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "\n\n\n\n\n\n"), (104, "x" * 100_000), (None, "\n".join(passage)), (105, "\n".join(f"l{i % 7}" for i in range(3000)))]
    df = spark.createDataFrame([(d, t, "s", 1, 2, 3) for d, t in rows], "doc_id long, text string, body string, first int, doc int, t int")
    got = lines.remove_chunks(df, "doc_id", "text")
    assert got.columns == [*df.columns, "_n_lines", "_n_removed"]
    assert {r.doc_id: (r._n_lines, r._n_removed, r.text) for r in got.collect()} == brute(rows)


def test_hot_chunks_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_COPIES", 7)
    rows = [(i, "\n".join(f"line {k}" for k in range(12)) + f"\nown {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r._n_lines, r._n_removed, r.text) for r in lines.remove_chunks(df, "doc_id", "text").collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = sorted(lines.remove_chunks(df, "doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert [r.text == text for r in rows[:2]] == [True, True] and rows[2]._n_removed > 0
    assert lines.remove_chunks(df.limit(0), "doc_id", "text").count() == 0


def test_boundaries_resist_shifts(spark):
    text = [f"line {i}" for i in range(200)]
    df = spark.createDataFrame([(1, "\n".join(text)), (2, "\n".join(["new", "lines", "first", *text]))], "doc_id long, text string")
    gone = {r.doc_id: r._n_removed for r in lines.remove_chunks(df, "doc_id", "text").collect()}
    assert gone[1] == 0 and gone[2] > 150


def test_long_texts_take_linear_time(spark):
    import time

    def took(n):
        text = "\n".join(f"line {i * 7919 % 1000003}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        start = time.perf_counter()
        assert lines.remove_chunks(df, "doc_id", "text").agg({"_n_removed": "sum"}).first()[0] > 0.5 * n
        return time.perf_counter() - start

    took(1000)
    assert took(300_000) < 10 * took(60_000) + 5
