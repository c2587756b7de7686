import random
import re

from lamina.llm import licenses


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_equals_the_full_table_when_edits_fit_the_band():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        template = [rng.randrange(30) for _ in range(rng.randrange(3, 40))]
        text = [w for w in template if rng.random() > 0.05]
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(len(text) + 1), rng.randrange(30))
        got, a, b = licenses.align(np.array(text, np.uint64), np.array(template, np.uint64), 0, 45)
        assert got == lcs(template, text) and lcs(template, text[a:b]) == got


def brute(text, min_coverage=licenses.MIN_COVERAGE):
    """Which templates whole windows of the text match, by exact comparison of words."""
    words = re.findall(r"[A-Za-z0-9]+", text)
    low = [w.lower() for w in words]
    out = set()
    for name, template in licenses.TEMPLATES.items():
        t = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", template)]
        if any(low[i : i + len(t)] == t for i in range(len(low))):
            out.add(name)
    return out


def test_planted_templates_with_spans(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("w" + str(rng.randrange(99)) for _ in range(n))
    rows, spans = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        before = filler(30) + " é\n"
        rows.append((i, before + text + "\n" + filler(20)))
        inner = re.search(r"[A-Za-z0-9].*[A-Za-z0-9]", text)
        spans[i] = (name, len(before) + inner.start(), len(before) + inner.end())
    rows += [(100, None), (101, ""), (102, filler(5000)), (103, "Licensed under"), (None, "All rights reserved. " * 3)]
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, report string"), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, (name, a, b) in spans.items():
        assert got[i].report == f"{name}:1.0000:{a}:{b}"
        assert name in brute(rows[i][1])
    assert [got[d].n_matches for d in (100, 101, 102, 103)] == [0, 0, 0, 0]
    assert got[None].licenses == ",".join(["all-rights-reserved"] * 3)


def test_edited_text_is_still_found_with_its_coverage(spark):
    words = licenses.TEMPLATES["mit"].split()
    edited = [w for i, w in enumerate(words) if i % 12 != 5]
    edited[40:40] = ["some", "extra", "words"]
    r = licenses.find_licenses(spark.createDataFrame([(1, " ".join(edited))], "doc_id long, text string"), "doc_id", "text").first()
    name, coverage, _, _ = r.report.split(":")
    assert name == "mit" and 0.85 < float(coverage) < 1
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def brute_report(text, templates, coverage=licenses.MIN_COVERAGE):
    """Every start in the text against every whole template by the full table; of spans that overlap the best, as the operator says."""
    at = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
    found = []
    for name, template in templates.items():
        t = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", template)]
        band = min(licenses.BAND, len(t) // 4)
        own = []
        for i in range(len(at)):
            window = [w for w, _, _ in at[i : i + len(t) + band]]
            # Row by row: the matches of each prefix of the window.
            best = [0] * (len(t) + 1)
            prefix = [0]
            for w in window:
                new = [0]
                for k, x in enumerate(t):
                    new.append(best[k] + 1 if x == w else max(new[k], best[k + 1]))
                best = new
                prefix.append(best[-1])
            m = prefix[-1]
            if m and m >= coverage * len(t):
                own.append((m, i, prefix.index(m) + i))
        own = [c for c in own if not any(d != c and d[0] >= c[0] and d[1] >= c[1] and d[2] <= c[2] for d in own)]
        found += [(name, m / len(t), m, at[a][1], at[b - 1][2]) for m, a, b in own]
    kept = []
    for c in sorted(found, key=lambda c: (-c[2], -c[1], c[3], c[0])):
        if all(c[4] <= o[3] or o[4] <= c[3] for o in kept):
            kept.append(c)
    return ",".join(f"{n}:{c:.4f}:{a}:{b}" for n, c, _, a, b in sorted(kept, key=lambda c: c[3]))


def test_whole_operator_equals_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"t{i}" for i in range(60)]
    templates = {f"lic{k}": " ".join(rng.sample(vocabulary, rng.randrange(12, 25))) for k in range(5)}
    templates["longer"] = templates["lic0"] + " " + " ".join(rng.sample(vocabulary, 10))
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [f"f{rng.randrange(99)}" for _ in range(rng.randrange(30, 45))]
            words = templates[rng.choice(list(templates))].split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["é" if rng.random() < 0.5 else "changed"], [words[k], "added"]])
            text += words
            if rng.random() < 0.3:
                text += words  # repeated at once
        rows.append((i, " ".join(text) + rng.choice(["", ".", " é"])))
    rows += [(100, None), (101, "")]
    got = {r.doc_id: r.report for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", templates).collect()}
    assert got == {d: brute_report(t or "", templates) for d, t in rows}
    assert sum(bool(r) for r in got.values()) > 30


def test_many_notices_in_one_text_take_linear_time():
    import time

    import numpy as np

    index = licenses.Index(licenses.TEMPLATES)

    def took(n):
        data = np.frombuffer(b"All rights reserved. w x " * n, np.uint8)
        start = time.perf_counter()
        assert len(licenses.scan_rows(data, np.array([0, len(data)]), index, 0.6)[0]) == n
        return time.perf_counter() - start

    took(100)
    assert took(50_000) < 15 * took(5_000) + 2
