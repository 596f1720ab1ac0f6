"""Toxicity: scores recomputed naively, held-out figures, learning that does not depend on partitions, defined handling."""

import math
import random
import re

import pytest

from geoloom.llm import queries, toxicity
from geoloom.llm.common import save


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def hit(model, token):
    """(kind, odds) by comparing the token with every term."""
    best = min(((distance(token, t), -o) for t, o in model.words.items() if abs(len(t) - len(token)) <= 2 and distance(token, t) <= toxicity.edits(t)), default=None)
    if best:
        return (min(best[0], 1), -best[1]) if not (best[0] and token in model.spare) else None
    stem = max((o for t, o in model.stems.items() if token.startswith(t)), default=None)
    return (2, stem) if stem else None


def score(model, text):
    low = (text or "").lower()
    tokens = [(m.start(), m[0]) for m in re.finditer(r"\w[\w@$*]*", low)]
    found = [(i, *h) for i, (_, t) in enumerate(tokens) if (h := hit(model, t))]
    quotes, start = [], 0
    for line in low.split("\n"):
        quotes += [(start + m.start(), start + m.end() - 1) for m in re.finditer(r'"[^"]*"', line)]
        start += len(line) + 1
    x = [1.0] + [0.0] * 6
    if found:
        sums, quoted = [0.0] * 3, 0
        for i, kind, odds in found:
            inside = any(a <= tokens[i][0] < b for a, b in quotes)
            told = sum(model.cues.get(t, 0.0) for _, t in tokens[max(0, i - 12) : i + 13])
            sums[kind] += odds * (0.5 if inside else 1) * math.exp(max(told, -2))
            quoted += inside
        places = [f[0] for f in found]
        densest = max(sum(i - 12 <= j <= i for j in places) for i in places)
        x = [1.0, *map(math.log1p, sums), math.log1p(densest), min(1.0, 30 * len(found) / (len(tokens) + 30)), quoted / len(found)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))


def labelled(seed=6, n=400):
    rng = random.Random(seed)
    plain = "we met near the river and talked about plans for spring when all was calm wretching idea".split()
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=25)
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(25)] = rng.choice(["wretchling", "dolt", "wretchlng", "boorish"])
        elif i % 24 == 1:  # what others said
            w[10:13] = ["he", "reported", '"' + rng.choice(["wretchling", "dolt"]) + '"']
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    return texts, labels


def test_scores_equal_naive_ones(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "wretchling" in model.words and "reported" in model.cues
    assert "wretching" in model.spare and "wretchlingg" not in model.spare
    rng = random.Random(2)
    tests = [*texts[::7], None, "", "He reported: \"wretchling!\"\n\"dolt", "wretchlingg dollt boorishh", *(" ".join(rng.choices(["wretchling", "wretchin", "dolt", "doltt", "near", '"x', 'y"', "reported", "boorissh", "\n"], k=30)) for _ in range(60))]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(tests):
        assert got[i].score == pytest.approx(score(model, t), rel=1e-9), t
        assert got[i].predicted == int(got[i].score >= 0.7)
    # quotation is told from abuse, and misspellings are found
    said = score(model, 'we met near the river and he reported "dolt" when all was calm')
    assert said < 0.5 < score(model, "we met near the river and the dolt was calm") and score(model, "you wretchlingg near the river") > 0.5


def test_learning_does_not_depend_on_partitions(spark):
    texts, labels = labelled(9, 200)
    rows = list(enumerate(texts)) + [(1, "other text of a repeated id"), (5, texts[5])]
    both = labels + [(8, 0), (8, 1), (12, None), (None, 1)]  # id 8 has both labels
    models = []
    for parts in (1, 5):
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        models.append(toxicity.learn(docs, spark.createDataFrame(both, "doc_id long, toxic int").repartition(parts)))
    a, b = models
    assert (a.words, a.stems, a.cues) == (b.words, b.stems, b.cues) and (a.spare.bits == b.spare.bits).all()
    assert a.weights == pytest.approx(b.weights, rel=1e-6)


@pytest.mark.parametrize("sf,recall", [("sf0.01", 0.83), ("sf0.1", 0.9)])
def test_held_out_labels(spark, sf, recall):
    """Held-out toxic documents found and clean ones spared; in sf0.01 three of the 18 toxic ones hold no learnable term."""
    at = f"/root/testdata/{sf}"
    out = save(queries.op1(spark, at)).where("held_out").join(queries.table(spark, at, "labels"), "doc_id").collect()
    toxic, clean = [r.predicted for r in out if r.toxic == 1], [r.predicted for r in out if r.toxic == 0]
    assert sum(toxic) >= recall * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_defined_handling(spark):
    texts, labels = labelled()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    long = "near the river " * 200_000 + "dolt"
    rows = [(None, "dolt dolt wretchling", 1), (1, None, 2), (1, "", 3), (2, long, 4), (2, long, 4), (3, "the river", 5)]
    tests = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.toxicity(tests, model).collect()
    assert len(got) == 6 and [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and [r.predicted for r in got if r.doc_id == 2] == [1, 1]
    kept = toxicity.without_toxic(tests, model)
    assert kept.columns == ["doc_id", "text", "score"] and sorted(r.score for r in kept.collect()) == [2, 3, 5]  # the long ones hold a term
    assert toxicity.without_toxic(tests.limit(0), model).collect() == []
    none = toxicity.learn(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.toxicity(tests, none).collect())
