"""Personal data: generated texts against a row-by-row version; check sums; many names; defined handling."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from geoloom.llm import pii


def python_pattern(p):
    return regex.compile(regex.sub(r"\\k<(\w+)>", r"(?P=\1)", regex.sub(r"\(\?<(\w+)>", r"(?P<\1>", p)))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def card(rng, good):
    body = "".join(rng.choices("0123456789", k=15))
    last = next(d for d in "0123456789" if luhn(body + d) == 0)
    return body + (last if good else str((int(last) + rng.randint(1, 9)) % 10))


def iban(rng):
    body = "".join(rng.choices("0123456789ABC", k=rng.choice([12, 16, 18])))
    return next(f"DE{k:02d}{body}" for k in range(2, 99) if mod97(f"DE{k:02d}{body}") == 1)


def entity(rng):
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    c = card(rng, rng.random() < 0.6)
    i = iban(rng)
    return rng.choice(
        [
            f"{rng.choice(['ann', 'Bob.x', 'c-d'])}{rng.randint(0, 9)}@mail{rng.randint(1, 4)}.example.com",
            c,
            "-".join(c[k : k + 4] for k in range(0, 16, 4)),
            i,
            " ".join(i[k : k + 4] for k in range(0, len(i), 4)),
            f"+1 ({d(3)}) {d(3)}-{d(4)}",
            f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 9)}.{rng.randint(0, 255)}",
            f"2001:db8::{d(3)}",
            f"{d(3)}-{d(2)}-{d(4)}",
            f'token = "{d(4)}ab{d(12)}"',
            f"{rng.choice(['Mrs', 'Mr.', 'Dr', 'Frau'])} {rng.choice(['Ann', 'Bob', 'Eva'])} {rng.choice(['Lee', 'Kim', 'Roth'])}",
        ]
    )


def kind_of(text):
    for kind, p in pii.TYPES:
        if kind != "secret" and python_pattern(p).fullmatch(text):
            if kind == "card" and luhn(regex.sub(r"\D", "", text)):
                return None
            if kind == "iban" and mod97(regex.sub("[ -]", "", text)) != 1:
                return None
            return kind
    return "secret"


def test_generated_texts_against_row_by_row(spark):
    """Spans, counts and untouched gaps as a plain search gives them; surrogates consistent, distinct, of their type and format."""
    rng = random.Random(20)
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [rng.choice(["on ", "und 12 ", "x: ", "a 2.0 ", "\n"]), entity(rng), rng.choice([" ", ". ", ", ", "\n"])]
        texts.append("".join(parts) + "end")
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), count_col="n").collect()}
    whole = python_pattern(pii.PATTERN)
    known, kinds = {}, set()
    for i, t in enumerate(texts):
        at, out, n = 0, got[i].text, 0
        gaps = []
        for m in whole.finditer(t):
            kind = kind_of(m[0])
            if kind:
                gaps.append((t[at : m.start()], kind, m[0]))
                at, n = m.end(), n + 1
        assert got[i].n == n, (t, out)
        place = 0
        for k, (gap, kind, old) in enumerate(gaps):
            assert out[place : place + len(gap)] == gap
            place += len(gap)
            after = gaps[k + 1][0] if k + 1 < len(gaps) else t[at:]
            stop = place + len(old) if kind in ("card", "phone", "ssn", "iban", "email", "secret", "ipv6") else out.index(after, place)
            new = out[place:stop]
            kinds.add(kind)
            if kind == "secret":
                assert new != old
            else:
                assert python_pattern(dict(pii.TYPES)[kind]).fullmatch(new), (old, new)
                assert kind_of(new) == kind  # check sums hold
            if kind in ("card", "phone", "ssn", "iban"):  # digits and marks stay where they are
                assert regex.sub(r"[0-9A-Z]", "0", new) == regex.sub(r"[0-9A-Z]", "0", old)
            plain = old.lower() if kind in ("email", "ipv6") else regex.sub(r"\D", "", old) if kind in ("card", "phone", "ssn") else regex.sub(" ", "", old)
            fresh = new.lower() if kind in ("email", "ipv6") else regex.sub(r"\D", "", new) if kind in ("card", "phone", "ssn") else regex.sub(" ", "", new)
            assert known.setdefault((kind, plain), fresh) == fresh
            place = stop
        assert out[place:] == t[at:]
    assert kinds == {"email", "card", "iban", "phone", "ip", "ipv6", "ssn", "secret", "name"}
    for kind in kinds:
        new = [v for (k, _), v in known.items() if k == kind]
        assert len(set(new)) == len(new) and not set(new) & {p for k, p in known if k == kind}


def test_iban_check_digits(spark):
    got = pii.replace_pii(spark.createDataFrame([(1, "pay DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00")], "doc_id long, text string")).first().text
    m = regex.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d), not DE88 3704 0044 0532 0130 00", got)
    assert m and m[1] != "DE89 3704 0044 0532 0130 00" and mod97(m[1].replace(" ", "")) == 1


def test_gender_by_title_or_given_name(spark):
    got = pii.replace_pii(spark.createDataFrame([(1, "Dr. Anna Smith, Mrs Anna Smith, Prof Peter Smith and Mr Peter Ham")], "doc_id long, text string")).first().text
    m = regex.fullmatch(r"Dr\. (\w+) (\w+), Mrs (\w+) (\w+), Prof (\w+) (\w+) and Mr (\w+) (\w+)", got)
    assert m and m[1] == m[3] and m[5] == m[7] and m[2] == m[4] == m[6] != m[8]
    assert regex.search("(?:a|elle)$", m[1]) and not regex.search("(?:a|elle)$", m[5])


def test_two_hundred_thousand_surnames(spark):
    """More names than the shortest surrogates: they grow, and all stay distinct."""
    names = spark.range(200_000).select(F.lit("family").alias("kind"), F.concat(F.lit("N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("plain"))
    out = pii.surrogates(names, "k")
    r = out.agg(F.count("*").alias("n"), F.countDistinct("surrogate").alias("d"), F.max(F.length("surrogate")).alias("w")).first()
    assert (r.n, r.d) == (200_000, 200_000) and r.w < 25


def test_defined_handling(spark):
    long = "word " * 300_000 + "mail joe@a.example.org " + "word " * 300_000
    rows = [(None, "at joe@a.example.org", 1, 2), (1, None, 3, 4), (1, "", 5, 6), (2, long, 7, 8), (2, long, 7, 8), (3, "nothing", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, N int")
    out = pii.replace_pii(docs, count_col="N")
    assert out.columns == ["doc_id", "text", "_row", "N"]  # the count takes the place of the column of its name
    got = out.collect()
    assert len(got) == 6 and sorted(r.N for r in got) == [0, 0, 0, 1, 1, 1]
    new = {regex.search(r"\S+@\S+", r.text)[0] for r in got if r.N}
    assert len(new) == 1 and "joe@a.example.org" not in new
    assert {(r.text, r._row) for r in got if not r.N} == {(None, 3), ("", 5), ("nothing", 9)}
    assert pii.replace_pii(docs.limit(0)).collect() == []
    assert pii.replace_pii(docs).columns == docs.columns


@pytest.mark.parametrize("kind", list(pii.HINTS))
def test_a_hint_is_part_of_every_match(kind):
    rng = random.Random(3)
    hint = python_pattern(pii.HINTS[kind])
    patterns = [python_pattern(p) for g, _, p in pii._GROUPED if g == kind]
    seen = 0
    for _ in range(4000):
        t = "".join([entity(rng)[: rng.randint(4, 40)], rng.choice(["", " "]), entity(rng), rng.choice(["", "x", ". "])])
        for p in patterns:
            for m in p.finditer(t):
                seen += 1
                assert hint.search(t)
    assert seen > 100
