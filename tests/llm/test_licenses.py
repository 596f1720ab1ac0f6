"""License rules: keywords, priorities and suppression against a quadratic version; defined handling."""

import random
import re
from re import _parser as parser

import pytest

from geoloom.llm import licenses
from geoloom.llm.license_rules import RULES


def sample(tree, rng):
    """A string that the parsed pattern may match."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            if str(arg[0][0]) == "NEGATE":
                out.append(rng.choice("x-"))
            else:
                one = rng.choice(arg)
                out.append(chr(one[1]) if str(one[0]) == "LITERAL" else chr(rng.randint(*one[1])) if str(one[0]) == "RANGE" else rng.choice("ab9"))
        elif name == "BRANCH":
            out.append(sample(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(sample(arg[3], rng))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, inner = arg
            out += [sample(inner, rng) for _ in range(rng.randint(lo, min(int(hi), lo + 2)))]
        elif name in ("ANY", "CATEGORY"):
            out.append("q")
    return "".join(out)


def test_hundreds_of_rules_none_twice():
    assert len(RULES) > 250 and len({r[3] for r in RULES}) == len(RULES)
    assert max(len([r for r in RULES if r[0] == label]) for label in {r[0] for r in RULES}) <= 12


@pytest.mark.parametrize("k", range(0, len(RULES)))
def test_every_match_holds_its_keyword(k):
    label, trust, pattern, key = licenses.rules()[k]
    rng = random.Random(k)
    made = [sample(parser.parse(RULES[k][3]), rng) for _ in range(60)]
    good = [t for t in made if pattern.fullmatch(t)]
    assert good, RULES[k]
    for t in good:
        assert key in t, (t, key)
        for gap in ("\n", "\n * ", "  "):  # and so it does across line ends
            m = pattern.search(t.replace(" ", gap))
            assert m and key in m[0]


def quadratic(text):
    """Every rule on the whole text, without prefilter; containment and crossings by comparing all pairs."""
    found = [(m.start(), m.end(), k) for k, r in enumerate(licenses.rules()) for m in r[2].finditer(text) if m.end() > m.start()]

    def within(x, y):
        return y[0] <= x[0] and x[1] <= y[1] and (y[1] - y[0] > x[1] - x[0] or y[2] < x[2])

    alone = [x for x in found if not any(within(x, y) for y in found if y is not x)]
    kept = []
    for x in sorted(alone, key=lambda x: (x[2], x[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
            kept.append(x)
    return sorted((s, e, licenses.rules()[k][0]) for s, e, k in kept)


def test_suppression_equals_the_quadratic_version():
    rng = random.Random(1)
    trees = [parser.parse(r[3]) for r in RULES]
    crossing = 0
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 6)):
            t = sample(rng.choice(trees), rng)
            if rng.random() < 0.4:  # cut, so that what follows crosses or extends it
                t = t[: rng.randint(1, len(t))]
            parts.append(t + rng.choice(["", " ", "\n// ", " and the gnu general public license, version 2 ", " x "]))
        text = "".join(parts)
        got = [x[:3] for x in licenses.detect(text)]
        assert got == quadratic(text), text
        crossing += len(got)
    assert crossing > 300


def test_labels_and_score_by_hand():
    text = "licensed under the apache license, version 2.0. all rights reserved"
    spans = licenses.detect(text)
    # 8 words of a notice (7 and 2, 0) and 3 of a mere name
    words = [len(re.findall(r"[a-z0-9]+", text[s:e])) for s, e, _, _ in spans]
    want = [words[0] / (words[0] + 2), 0.6 * words[1] / (words[1] + 2)]
    assert [x[3] for x in spans] == pytest.approx(want)
    assert licenses.score(spans, ["reserved"]) == pytest.approx(1 - (1 - want[0]) * (1 - want[1]))
    assert licenses.score([], []) == 0 and licenses.score([], ["gpl"]) == pytest.approx(0.3)


def test_defined_handling(spark):
    long = "word " * 300_000 + "licensed under the apache license, version 2.0 " + "word " * 300_000
    rows = [(None, "spdx-license-identifier: mit", "a"), (1, None, "b"), (1, "", "c"), (2, long, "d"), (2, long, "d"), (3, "Apache License" + " " * 100_000 + "x", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == 6 and [r.labels for r in got if r.doc_id is None] == ["mit"]
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in got if r.doc_id == 1] == [(0, 0, None, "", 0.0)] * 2
    assert [(r.n_words, r.labels, r.spans[0].start) for r in got if r.doc_id == 2] == [(600_008, "apache-2.0", 1_500_000)] * 2
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
