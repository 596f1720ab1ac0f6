"""Language identification: predictions recomputed word by word, held-out accuracy, defined handling."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from geoloom.llm import language, queries
from geoloom.llm.common import save


def words_of(t):
    low = pc.utf8_lower(pa.array([t or ""]))[0].as_py()
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams(w, n):
    w = f"_{w}_"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Naive:
    """The same model with dictionaries."""

    def __init__(self, rows):
        self.langs = sorted({lang for lang, _ in rows})
        docs = Counter(lang for lang, _ in rows)
        self.prior = {x: math.log(docs[x] / len(rows)) for x in self.langs}
        counts = {s: defaultdict(Counter) for s in (0, *language.LENGTHS)}
        for lang, t in rows:
            for w in words_of(t):
                counts[0][w][lang] += 1
                for s in language.LENGTHS:
                    for g in grams(w, s):
                        counts[s][g][lang] += 1
        self.tables = {}
        for s, table in counts.items():
            kept = {t: {x: c[x] + 0.1 for x in self.langs} for t, c in table.items() if sum(c.values()) >= language.LEAST}
            total = {x: sum(c[x] for c in kept.values()) for x in self.langs}
            self.tables[s] = {t: [math.log(c[x] / total[x]) for x in self.langs] for t, c in kept.items()}

    def word(self, w):
        found = self.tables[0].get(w)
        for s in language.LENGTHS:
            if found is None:
                known = [self.tables[s][g] for g in grams(w, s) if g in self.tables[s]]
                found = [sum(c) / len(known) for c in zip(*known)] if known else None
        if found is None:
            return [0.0] * len(self.langs)
        return [max(v - max(found), language.FLOOR) for v in found]

    def text(self, t):
        own = words_of(t)
        if not own:
            return "und", 0.0
        sums = [self.prior[x] + sum(v) for x, v in zip(self.langs, zip(*(self.word(w) for w in own)))]
        best = max(range(len(sums)), key=lambda k: (round(sums[k], 9), -k))
        return self.langs[best], 1 / sum(math.exp((v - max(sums)) / len(own) ** 0.5) for v in sums)


BASE = {"en": "the of and with from house water who", "de": "und der nicht schön über straße wasser wer", "el": "και το είναι σπίτι νερό", "fr": "le été œuvre à côté maison eau"}


def test_predictions_equal_naive_ones(spark, monkeypatch):
    from geoloom.llm import bytewords

    monkeypatch.setattr(bytewords.chunks, "__defaults__", (300,))
    rng = random.Random(4)
    rows = []
    for i in range(160):
        x = rng.choice(list(BASE))
        w = rng.choices(BASE[x].split(), k=rng.randint(1, 15))
        rows.append((x, " ".join(v.upper() if rng.random() < 0.2 else v + rng.choice(["", ".", "12", "en", "s"]) for v in w)))
    docs = spark.createDataFrame([(i, t, x, "clash") for i, (x, t) in enumerate(rows)] + [(900, None, "de", "c"), (901, "the the", None, "c"), (None, "the the", "de", "c")], "doc_id long, text string, lang string, size string").repartition(3)
    model = language.learn(docs)
    naive = Naive(rows)
    assert model.langs == naive.langs and {s: len(t[0]) for s, t in model.tables.items()} == {s: len(t) for s, t in naive.tables.items()}
    tests = [None, "", "1234 !! ___", "zzz", "ß", "THE water", "schönheit wassers", "日本語", "á é", "İstanbul ΣΑΣ", "x" * 5000, "the " * 20_000 + "und", *(t for _, t in rows[:40])]
    tests += [" ".join(rng.choices([w + rng.choice(["", "x", "ung"]) for v in BASE.values() for w in v.split()], k=rng.randint(1, 12))) for _ in range(150)]
    got = language.identify(spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(tests)] + [(None, "the", 0.1), (5, "THE water", 0.2)], "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(tests) + 2
    for r in got:
        t = "the" if r.doc_id is None else tests[r.doc_id]
        want = naive.text(t)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], rel=1e-4), t


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(none)
    assert model.langs == [] and language.identify(none, model).collect() == []
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, model).collect()] == [("und", 0.0)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    at = f"/root/testdata/{sf}"
    docs = queries.table(spark, at, "documents").select("doc_id", "lang")
    rows = save(queries.op6(spark, at)).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
