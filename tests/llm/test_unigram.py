"""A unigram model on long words and closing marks, against the library."""

import io
import random

import numpy as np

from lamina.llm import pieces


def test_unigram_model_encodes_long_words_and_tails(spark, tmp_path):
    import sentencepiece

    rng = random.Random(4)
    lines = [" ".join(rng.choice(["the", "thing", "other", "ring", "url", "read", "wrote!"]) + rng.choice(["", "s", "er", "?!"]) for _ in range(12)) for _ in range(300)]
    out = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_writer=out, model_type="unigram", vocab_size=60, hard_vocab_limit=False, normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "thering" * 30 + "?!?!"), (2, "other rings?!!"), (3, "the " + "".join(rng.choice("theringsu") for _ in range(500))), (4, None), (5, "ring" * 15 + "s")]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", path).collect()}
    m = pieces.load(path)
    cost = lambda ids: sum(sp.get_score(i) for i in ids)
    for d, t in rows:
        want = sp.encode(t or "")
        assert sp.decode(got[d]) == (t or "") and abs(cost(got[d]) - cost(want)) < 1e-3
    table, word = {"a": -1.0, "ab": -1.5, "b": -1.0, "!": -2.0, "!!": -5.0}, "ab" * 60 + "x!!"
    assert pieces.viterbi_long(word, table, 2, -20.0) == ["ab"] * 60 + ["x", "!", "!"] and not m.bpe
