import os
import random

import numpy as np
import pytest

from lamina.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no public tokenizer")

TEXTS = [None, "", " ", "  ", "a", "Hello world", "a  b\nThe  end ", "\n\n", "tab\there", "Éé日本語テスト 😀 ▁x", "aaaaaaaaaaaa " * 3, "x" * 300 + " " + "ab" * 200, " " * 100 + "y", "don't stop!! (v2.0), 192.168.0.1", "ﬁ① 　​", "</s><s><unk><0x0A>", "\r\n\x00\x0b"]


def texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(["the ", "ing", "er", "on ", "é", "\n", " ", "Q", "1", "., ", "ou", "th"]) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_ids_equal_the_library_and_decode_back(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = list(enumerate(TEXTS + texts(200))) + [(None, "null key"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, pack string").repartition(3)
    out = pieces.encode(df, "doc_id", "text")
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u2").tolist(), r.n_ids) for r in out.collect())
    want = sorted((d if d is not None else -1, e := sp.encode(t or ""), len(e)) for d, t in rows)
    assert got == want
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in pieces.decode(out, "doc_id", "ids").collect())
    assert back == sorted((d if d is not None else -1, (t or "").replace(pieces.MARK, " ")) for d, t in rows)
    assert pieces.encode(df.limit(0), "doc_id", "text").count() == 0


def test_long_words_merge_as_the_library_does():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    m = pieces.load()
    rng = random.Random(1)
    for _ in range(200):
        word = pieces.MARK + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 90)))
        assert pieces._ids_of(m.ids, m.bytes, m.unknown, pieces.merge_long(word, m.scores)) == sp.encode(word[1:])
    pieces.merge_long("ab" * 50_000, m.scores)


def test_viterbi_fold_equals_brute_force(spark):
    rng = random.Random(2)
    table = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.random() * 5 for _ in range(25)}
    table.pop("c", None)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)})

    def best(w):
        found = {0: (0.0, [])}
        for e in range(1, len(w) + 1):
            options = [(found[s][0] + np.float32(table[w[s:e]]), found[s][1] + [w[s:e]]) for s in range(e) if w[s:e] in table]
            options.append((found[e - 1][0] - 20, found[e - 1][1] + [w[e - 1 : e]]))
            found[e] = max(options, key=lambda o: o[0])
        return found[len(w)]

    pieces_df = spark.createDataFrame(list(table.items()), "piece string, score float")
    lattice = pieces.edges(spark.createDataFrame([(w,) for w in words], "word string"), pieces_df, 3, 1)
    got = {r.word: pieces.cut_at(r.word, r.mask) for r in lattice.select("word", pieces.viterbi_fold(-20.0).alias("mask")).collect()}
    cost = lambda parts: sum(float(np.float32(table[p])) if p in table else -20 for p in parts)
    for w, parts in got.items():
        assert "".join(parts) == w and abs(cost(parts) - best(w)[0]) < 1e-4
    assert len(got) > 40


def test_one_pass_equals_pair_by_pair(spark):
    m = pieces.load()
    rng = random.Random(4)
    names = list(m.scores)
    words = {pieces.MARK + "".join(rng.choice(names) for _ in range(rng.randrange(1, 6)))[:60] for _ in range(3000)} | {pieces.MARK * k + "x" for k in range(2, 50)}
    assert 0 < len(m.odd) < 100
    table = spark.createDataFrame([(p, s, p in m.odd) for p, s in m.scores.items()], "piece string, score float, odd boolean")
    lattice = pieces.edges(spark.createDataFrame([(w,) for w in words], "word string"), table, m.longest, 2)
    rows = lattice.select("word", "odd", pieces.merge_fold().alias("one"), pieces.pair_fold().alias("pairs")).collect()
    assert len(rows) > 2500 and any(r.odd for r in rows)
    for r in rows:
        assert r.odd or r.one == r.pairs, r.word
        assert pieces.cut_at(r.word, r.pairs) == pieces.merge_long(r.word, m.scores)


def test_clashing_id_column(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    df = spark.createDataFrame([(1, "some text, here", 5)], "_id long, text string, batch int")
    (r,) = pieces.encode(df, "_id", "text").collect()
    assert r._id == 1 and np.frombuffer(r.ids, "<u2").tolist() == sp.encode("some text, here")


def test_decoding_of_any_ids():
    m = pieces.load()
    rng = random.Random(9)
    rows = [np.array([rng.randrange(len(m.plain)) if rng.random() < 0.7 else rng.choice(list(m.bytes.values())) for _ in range(rng.randrange(9))], m.stored).tobytes() for _ in range(300)] + [None, b""]
    for own in (rows, rows[-2:], [np.array([m.ids["▁the"]], m.stored).tobytes()]):
        got = pieces._texts(own, m.plain, m.stored, m.prefix).to_pylist()
        for data, text in zip(own, got):
            raw = b"".join(m.plain[i] for i in np.frombuffer(data or b"", m.stored))
            assert text == (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def test_query_has_one_python_worker_a_task(spark, tmp_path):
    """The texts made beside the ids are those of `decode`, and no task of the query holds two Python workers."""
    rows = list(enumerate(TEXTS + texts(250)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    query = pieces.op6_piece_lattice(spark, str(tmp_path))
    node, python = query._jdf.queryExecution().optimizedPlan(), 0
    while node.children().size() == 1:
        python += node.nodeName() in ("MapInArrow", "PythonMapInArrow")
        node = node.children().head()
    assert node.nodeName().startswith("FlatMapCoGroups") and python == 0
    out = pieces.encode(df, "doc_id", "text", back="read").cache()
    assert out.columns == ["doc_id", "n_ids", "ids", "check", "read"]
    assert {r.doc_id: r.read for r in out.collect()} == {r.doc_id: r.text for r in pieces.decode(out, "doc_id", "ids").collect()}
    digests = {r.doc_id: (r.n_ids, r.s) for r in out.selectExpr("doc_id", "n_ids", "sha2(ids, 256) AS s").collect()}
    got = query.collect()
    assert {r.doc_id: (r.n_ids, r.ids_sha256) for r in got} == digests and len(got) == len(rows)
    assert {r.doc_id for r in got if not r.round_trip} == {d for d, t in rows if pieces.MARK in (t or "")}
