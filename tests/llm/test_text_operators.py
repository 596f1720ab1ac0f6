"""Row-wise operators: token counts, language, toxicity, licenses, pieces."""

import random
import re

import pyarrow as pa
import pytest

from geoloom.llm import language, licenses, pieces, tokencount, toxicity
from geoloom.llm.bytewords import WHITE, shingles, words

ODD = [None, "", "   ", "a", "Ünïcode ß 日本 ▁ x", "x" * 3000, "\n\n\t", "don't  we'll 12.5 'RE", "<|endoftext|>a<|endoftext|>"]


def frame(spark, texts, **more):
    rows = [(i, t, t and "clash", *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    extra = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, "doc_id long, text string, id string" + extra)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_and_shingles_match_sets():
    rng = random.Random(1)
    texts = ["".join(rng.choices("aBé \n\t.x", k=rng.randint(0, 60))) for _ in range(300)] + ["a a a a a", "", " "]
    raw = [t.encode() for t in texts]
    import numpy as np

    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    seen = {}
    for k in (3, 5):
        _, _, firsts = shingles(*words((data, offsets), WHITE), k)
        value = shingles(*words((data, offsets), WHITE), k)[0]
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
            got = value[firsts[i] : firsts[i + 1]].tolist()
            assert len(got) == len(want)
            key = (k, frozenset(want))
            assert seen.setdefault(key, got) == got


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokencount.default_path()
    ref = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(list("abcrelvtsdm'   \n\t 12.,!é日ñß  ²Ⅷ😀A") + ["'re", " 's"], k=rng.randint(0, 80))) for _ in range(500)]
    want = [len(e.ids) for e in ref.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = {r.doc_id: r for r in tokencount.token_counts(frame(spark, texts)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (want[i] > 512) for i in got)


def test_prefix_scan_equals_one_walk():
    import numpy as np

    rng = np.random.default_rng(3)
    stream = rng.integers(0, tokencount.CLASSES, 5000).astype(np.uint8)
    stream[::700] = tokencount.RESET
    whole = tokencount.piece_starts(stream)
    go, cut = tokencount.splitter()
    state, want = 0, np.zeros(len(stream), dtype=bool)
    for i, c in enumerate(stream):
        mark = cut[state, c]
        want[i] |= bool(mark & tokencount.CUT_HERE)
        if mark & tokencount.CUT_BEFORE:
            want[i - 1] = True
        if mark & tokencount.CUT_BACK:
            want[i - 1] = False
        state = go[state, c]
    assert (whole == want).all()


def test_language_learns_and_backs_off(spark):
    base = {"en": "the of and with from house water", "de": "und der nicht schön über straße wasser"}
    rng = random.Random(4)
    texts, langs = [], []
    for i in range(80):
        x = "en" if i % 2 else "de"
        texts.append(" ".join(rng.choices(base[x].split(), k=12)))
        langs.append(x)
    model = language.learn(frame(spark, texts, lang=langs))
    tests = ["the water and", "wasser und straße", "schönheit wassers", "1234 !!", None, "", "THE HOUSE"]
    got = {r.doc_id: r for r in language.identify(frame(spark, tests), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(frame(spark, tests), language.Model()).collect()[0].lang_pred == "und"


def test_fuzzy_lexicon_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    terms = {"idiot": 3.0, "worthless": 4.0, "scum": 2.0}
    lex = toxicity.FuzzyLexicon(terms, {"vequ": 5.0})
    rng = random.Random(5)
    for _ in range(3000):
        base = list(rng.choice([*terms, "vequabc", "plain"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(base) + 1)
            base[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "i", "s"])
        w = "".join(base)
        near = [t for t in terms if distance(w, t) <= toxicity.edits(t)]
        got = lex.find(w)
        if w in terms:
            assert got == (0, terms[w])
        elif near:
            assert got[0] == 1
        elif w.startswith("vequ"):
            assert got == (2, 5.0)
        else:
            assert got is None


def test_toxicity_learns_finds_and_spares_quotation(spark):
    rng = random.Random(6)
    plain = "we met near the river and talked about plans for spring".split()
    texts, labels = [], []
    for i in range(120):
        w = rng.choices(plain, k=20)
        if i % 4 == 0:
            w[rng.randrange(20)] = w[rng.randrange(20)] = "wretchling"
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    docs = frame(spark, texts)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "wretchling" in model.words
    tests = ["you are a wretchling and a wretchling", "you are a wretchlinng , wretchling", "we met near the river", None, "", 'he said "wretchling" was the word that she wrote near the river in spring']
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, tests), model).collect()}
    assert [got[i].predicted for i in range(5)] == [1, 1, 0, 0, 0]
    assert got[5].score < got[0].score and got[3].score == got[4].score
    kept = toxicity.without_toxic(frame(spark, tests), model)
    assert kept.columns == ["doc_id", "text", "id"] and {2, 3, 4} <= {r.doc_id for r in kept.collect()}


def test_license_places_against_words(spark):
    rng = random.Random(7)
    texts = ODD + [" ".join(rng.choices(["CC", "by", "cc-BY", "general", "public", "license", "all", "Rights", "reserved.", "x", "ccby", "é"], k=rng.randint(0, 15))) for _ in range(300)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == (min((p[0] for p in places), default=None), max((p[0] for p in places), default=None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_overlaps():
    assert [x[2] for x in licenses.detect("licensed under the apache license, version 2.0. all rights reserved")] == ["apache-2.0", "reserved"]
    assert [x[2] for x in licenses.detect("this is licensed under cc by-nc-sa 4.0")] == ["cc-by-nc-sa"]
    assert [x[2] for x in licenses.detect("this is licensed under cc by-nc-sa 4.0")] == ["cc-by-nc-sa"]
    assert licenses.detect("nothing of note") == []


def test_license_names_across_lines():
    """Names and sentences go on over line ends, indents and comment marks."""
    for gap in (" ", "\n", "\n * ", "\n    ", "\n# ", "\n// ", "\r\n\t"):
        for text, label in [("licensed under the terms of the gnu general public license", "gpl"), ("released under the apache license, version 2.0", "apache-2.0"), ("under the terms of the mozilla public license", "mpl"), ("licensed under the gnu lesser general public license", "lgpl"), ("permission is hereby granted, free of charge, to any person", "mit")]:
            text = text.replace(" ", gap)
            assert [x[:3] for x in licenses.detect(text)] == [(0, len(text), label)], text


def _paths(lattice, s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        for j in range(i + 1, min(len(s), i + 16) + 1):
            p = lattice.piece.get(s[i:j])
            if p:
                go(j, score + p[0], ids + p[1])
        if s[i] not in lattice.piece:
            go(i + 1, score + lattice.lowest, ids + tuple(lattice.byte[b] for b in s[i].encode()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_n_best_paths_equal_all_paths(spark):
    lattice = pieces.lattice(pieces.default_path())
    rng = random.Random(8)
    texts = ["".join(rng.choices("the anded  \n日éß.,x", k=rng.randint(1, 10))) for _ in range(120)]
    got = {r.doc_id: r for r in pieces.encode_texts(frame(spark, texts + ODD)).collect()}
    for i, t in enumerate(texts):
        want = _paths(lattice, pieces.MARK + t.replace(" ", pieces.MARK))[:4]
        assert [round(x, 3) for x in got[i].scores] == [round(x[0], 3) for x in want]
        assert [round(x[0], 3) for x in lattice.encode(t, 4)] == [round(x[0], 3) for x in want]
        assert len({x[1] for x in lattice.encode(t, 4)}) == len(want)
    assert all(r.round_trip for r in got.values())
    for i, t in enumerate(ODD, len(texts)):
        assert (got[i].n_pieces == 0) == (not t)
    encoded = spark.createDataFrame([(r.doc_id, r.pieces) for r in got.values()], "doc_id long, pieces array<int>")
    back = {r.doc_id: r.text for r in pieces.decode_pieces(encoded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts + ODD))


def test_n_best_paths_are_returned(spark):
    """Every one of the n best paths comes out whole: another of each score, and each decodes to the text."""
    lattice = pieces.lattice(pieces.default_path())
    rng = random.Random(9)
    texts = ["".join(rng.choices("the anded  \n日éß.,x", k=rng.randint(1, 10))) for _ in range(60)]
    texts += [" ".join(rng.choices(["the", "sand", "ended", "handed"], k=30)), f"the{pieces.MARK}anded the", ""]
    for group in (texts[:-2], texts[-2:]):  # the mark in a text sends its neighbours another way
        for r in pieces.encode_texts(frame(spark, group)).collect():
            t = group[r.doc_id]
            assert r.round_trip and len(r.others) == max(0, len(r.scores) - 1)
            paths = [tuple(r.pieces), *(tuple(pieces.changed(r.pieces, c)) for c in r.others)]
            assert len(set(paths)) == len(paths) and all(lattice.decode(list(p)) == t for p in paths)
            if len(t) < 11 and pieces.MARK not in t:
                score = {ids: x for x, ids in _paths(lattice, pieces.MARK + t.replace(" ", pieces.MARK))}
                assert not t or [round(score[p], 3) for p in paths] == [round(x, 3) for x in r.scores]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert tokencount.token_counts(none).count() == licenses.scan_licenses(none).count() == pieces.encode_texts(none).count() == 0
    assert language.identify(none, language.learn(frame(spark, [], lang=[]))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, toxicity.learn(none, labels)).count() == 0


def test_chunks_cover_slices():
    from geoloom.llm.bytewords import chunks

    a = pa.array(["ab", None, "", "cde", "f"]).slice(1)
    parts = [(f, e, bytes(d)) for f, e, d, _ in chunks(a, 2)]
    assert parts[0][0] == 0 and parts[-1][1] == 4 and b"".join(p[2] for p in parts) == b"cdef"
