import hashlib
import random
import re

import numpy as np
import pytest

from lamina.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = re.sub(r"[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_patterns_equal_the_plain_expressions():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "0", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "é", "b.c", "4", "\n"]) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text), text
    body = "400000000000000"
    card = body + next(c for c in "0123456789" if pii.luhn(body + c))
    for text in [card, "-".join(card[i : i + 4] for i in range(0, 16, 4)), "a@b@c.de.", "x@y.z@q.r", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713 rest", "001.002.003.0004"]:
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 50_000, "a@" * 50_000]:
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_gradient_of_the_crf():
    rng = np.random.default_rng(0)
    model = {"A": rng.normal(size=(pii._TAGS, pii._TAGS)), "start": rng.normal(size=pii._TAGS)}
    e, y = rng.normal(size=(5, 2, pii._TAGS)), rng.integers(0, pii._TAGS, (2, 5))
    loss, de, da, ds = pii._crf_grad(e, y, model)
    for _ in range(10):
        t, r, k = rng.integers(5), rng.integers(2), rng.integers(pii._TAGS)
        f = e.copy()
        f[t, r, k] += 1e-5
        assert abs((pii._crf_grad(f, y, model)[0] - loss) / 1e-5 - de[t, r, k]) < 1e-3
        i, j = rng.integers(pii._TAGS, size=2)
        a = model["A"].copy()
        a[i, j] += 1e-5
        assert abs((pii._crf_grad(e, y, model | {"A": a})[0] - loss) / 1e-5 - da[i, j]) < 1e-3


def test_viterbi_equals_brute_force(model):
    import itertools

    rng = np.random.default_rng(1)
    e = rng.normal(size=(4, 1, pii._TAGS)).astype(np.float32)
    paths = itertools.product(range(pii._TAGS), repeat=4)
    best = max(paths, key=lambda p: model["start"][p[0]] + e[0][0, p[0]] + sum(model["A"][p[t - 1], p[t]] + e[t][0, p[t]] for t in range(1, 4)))
    assert tuple(pii.viterbi(model, e)[0]) == best


def test_held_out_sentences(model):
    held = pii.generate(300, 99)
    found = pii.tagged_spans([t for t, _ in held], model)
    right = sum(len(set(f) & set(s)) for f, (_, s) in zip(found, held))
    assert right / sum(len(s) for _, s in held) > 0.75
    assert right / sum(map(len, found)) > 0.95


def test_windows_are_reconciled_wherever_a_span_lies(model):
    phone = "(030) 555-1234"
    texts = ["word " * 3 + "x" * k + " call " + phone + " today " * 20 for k in range(0, 120, 7)]
    hits = [("phone", t.index(phone), t.index(phone) + len(phone)) in s for t, s in zip(texts, pii.tagged_spans(texts, model))]
    assert np.mean(hits) > 0.8


def test_whole_operator_with_edge_rows(spark, model):
    text = "Mail ada.b@mail.example.com or +1 (017) 555-7713 from 10.0.0.255, not 10.0.0.256"
    rows = [(1, None, "a"), (2, "", "a"), (3, text, "b"), (3, text, "b"), (None, "x" * 50_000 + " 1.2.3.4", "c"), (4, "no data, version 2.0.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(df, "doc_id", "text", model).collect()
    assert len(got) == 6
    for r, (d, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or 99, r.spans)), sorted(rows, key=lambda r: (r[0] or 99))):
        base = brute(t or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.doc_id == d and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
        assert set(line.split(",")) <= set(r.spans.split(","))
    masked = {r.doc_id: r.text for r in pii.redact(df, "text", model).collect()}
    assert masked[3] == "Mail <EMAIL> or <PHONE> from <IP>, not 10.0.0.256" and masked[1] is None and masked[4] == rows[5][1]
    assert pii.redact(df, "text", model).columns == df.columns
    assert pii.find(df.limit(0), "doc_id", "text", model).count() == 0


def test_addresses_of_any_length(model):
    for n in [1, 2, 3, 10, 30, 47, 48, 49, 60, 80, 96, 120, 200, 333, 500]:
        for name in ("éñ", "ñ", "ßaü"):
            name = (name * n)[:n] if n > 2 else name
            if name[-1:].isascii():
                name += "é"  # else the patterns find a part of it
            text = f"please write to {name}@mail.example.com today"
            assert ("email", 16, 16 + len(name) + 17) in pii.tagged_spans([text], model)[0], n


def test_parts_of_a_long_text_decode_as_the_whole(model, monkeypatch):
    rng = random.Random(6)
    text = " ".join(t + " quiet words" * rng.choice([1, 80]) for t, _ in pii.generate(60, 5))
    whole = pii.tagged_spans([text], model)
    monkeypatch.setattr(pii, "PART", 300)
    parts = list(pii._parts(pii.encode(text)))
    assert len(parts) > 5 and all(a % pii.STRIDE == 0 for a, _ in parts)
    assert pii.tagged_spans([text], model) == whole and len(whole[0]) > 50


def test_paths_are_joined_where_they_score_best(model):
    rng = np.random.default_rng(2)
    n = 3
    e = rng.normal(size=(pii.WINDOW, n, pii._TAGS)).astype(np.float32)
    tags = pii.viterbi(model, e)
    e = e.transpose(1, 0, 2)
    logp = e - np.log(np.exp(e).sum(2, keepdims=True))
    score = np.take_along_axis(logp, tags[:, :, None].astype(int), 2)[:, :, 0]
    a = model["A"]
    score[:, 1:] += a[tags[:, :-1], tags[:, 1:]]
    ks = np.arange(5, 5 + n)
    ((start, got),) = pii._reconciled(ks, tags, score, a, 10**6)
    assert start == 5 * pii.STRIDE - (pii.WINDOW - pii.STRIDE) // 2 and len(got) == (n - 1) * pii.STRIDE + pii.WINDOW

    def value(left, right, c):
        """Score of the joined path over the overlap, going over before its character c."""
        o = pii.WINDOW - pii.STRIDE
        path = np.r_[tags[left, pii.STRIDE : pii.STRIDE + c], tags[right, c:o]]
        lp = np.concatenate([logp[left, pii.STRIDE : pii.STRIDE + c], logp[right, c:o]])
        before = np.r_[tags[left, pii.STRIDE - 1], path[:-1]]
        return sum(float(lp[i, path[i]] + a[before[i], path[i]]) for i in range(o))

    for k in range(n - 1):
        o = pii.WINDOW - pii.STRIDE
        best = max(range(o), key=lambda c: value(k, k + 1, c))
        own = got[(k + 1) * pii.STRIDE : (k + 1) * pii.STRIDE + o]
        path = np.r_[tags[k, pii.STRIDE : pii.STRIDE + best], tags[k + 1, best:o]]
        assert (own == path).all()
