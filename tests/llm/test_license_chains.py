"""Templates split by inserted blocks."""

import random

from lamina.llm import licenses


def test_a_template_with_an_inserted_block_is_one_match(spark):
    words = licenses.TEMPLATES["mit"].split()
    for at in (len(words) // 2, len(words) // 3, len(words) - 20):
        for size in (12, 40):
            block = [f"header{k}" for k in range(size)]
            text = " ".join(["before"] * 30 + words[:at] + block + words[at:] + ["after"] * 30)
            r = licenses.find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").first()
            name, coverage, a, b = r.report.split(":")
            start = text.index(words[0], 7 * 30)
            assert r.n_matches == 1 and name == "mit" and float(coverage) == 1
            assert int(a) == start and text[int(b) :].strip(" .").startswith("after")


def test_copies_apart_stay_two_matches(spark):
    rng = random.Random(1)
    text = licenses.TEMPLATES["mit"] + " " + " ".join(f"w{rng.randrange(99)}" for _ in range(300)) + " " + licenses.TEMPLATES["mit"]
    for t in (text, licenses.TEMPLATES["mit"] + " " + licenses.TEMPLATES["mit"]):
        r = licenses.find_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string"), "doc_id", "text").first()
        assert r.licenses == "mit,mit"
