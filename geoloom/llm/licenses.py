"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.bytewords import LOWER, NOT_WORD, chunks, word_spans
from geoloom.llm.common import pick
from geoloom.llm.license_rules import RULES

#: Phrases whose places are always counted, as words of the lower-cased text, and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: How much a detection of each kind is trusted, were it endlessly long.
TRUST = {"tag": 1.0, "text": 1.0, "notice": 1.0, "name": 0.6}
#: Words of a signature that give half of that trust.
HALF = 2
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What may stand for a blank of a pattern: line ends, indents and comment marks.
GAP = r"\s*#/"


def _spread(pattern: str) -> str:
    """The pattern with words joined by runs of ``GAP``: of its blanks, and of its classes that hold a blank."""

    def one(m: re.Match) -> str:
        if " " not in m[1]:
            return m[0]
        own = f"[{GAP}]" if m[1] == " " else m[1].replace(" ", GAP)
        return own + {"": "++", "?": "*+"}.get(m[2], m[2])  # possessive: a long run of blanks is gone through once

    return re.sub(r"(\[[^\]]*\]| )(\{[^}]*\}|[?*+]?)", one, pattern)


@lru_cache(1)
def rules() -> list[tuple[str, float, re.Pattern, str]]:
    """(label, trust, pattern, keyword), most important first."""
    return [(label, TRUST[kind], re.compile(_spread(pattern)), key) for label, kind, key, pattern in RULES]


@lru_cache(1)
def _keywords() -> list[str]:
    return sorted({r[3] for r in rules()})


def strength(trust: float, matched: str) -> float:
    """How strong the evidence of a detection is, measured by the words it covers."""
    n = len(WORD.findall(matched))
    return trust * n / (n + HALF)


def found_by_rules(lowered: str) -> list[tuple[int, int, int]]:
    """(start, end, rule) of everything that a rule whose keyword occurs matches."""
    held = {key: key in lowered for key in _keywords()}
    return [(m.start(), m.end(), k) for k, (_, _, p, key) in enumerate(rules()) if held[key] for m in p.finditer(lowered) if m.end() > m.start()]


def detect(lowered: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, strength) of the detections that stand, by place.

    Of two equal intervals the rule with the higher priority (the earlier one)
    stands, an interval within a longer one falls, and of intervals that cross,
    those of higher priority stand.
    """
    found = sorted((start, -end, k) for start, end, k in found_by_rules(lowered))
    # a container comes before what it holds, and of equal ones the more important
    outer, reach = [], -1
    for x in found:
        if -x[1] > reach:
            outer.append(x)
            reach = -x[1]
    # what is left starts and ends in ascending order, so only neighbours can cross
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for x in sorted(outer, key=lambda x: x[2]):
        i = bisect_left(starts, x[0])
        if (i and -kept[i - 1][1] > x[0]) or (i < len(kept) and starts[i] < -x[1]):
            continue
        kept.insert(i, x)
        starts.insert(i, x[0])
    return [(start, -end, rules()[k][0], strength(rules()[k][1], lowered[start:-end])) for start, end, k in kept]


def score(spans: list[tuple[int, int, str, float]], base: list[str]) -> float:
    """1 less the chance that every label's best detection is wrong; a base label that no detection gives counts 0.3."""
    best: dict[str, float] = dict.fromkeys(base, 0.3)
    for _, _, label, p in spans:
        best[label] = max(best.get(label, 0.0), p)
    return 1.0 - float(np.prod([1.0 - best[label] for label in sorted(best)])) if best else 0.0


_KEY = {b"reserved": ("all", "rights", "reserved"), b"license": ("general", "public", "license"), b"cc": ("cc", "by")}


def _places(low: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase in one lower-cased text."""
    out = []
    for key, phrase in _KEY.items():
        parts = [p.encode() for p in phrase]
        at = parts.index(key)
        i = low.find(key)
        while i >= 0:
            w = int(np.searchsorted(starts, i))
            if w < len(starts) and starts[w] == i and ends[w] == i + len(key):
                first = w - at
                if first >= 0 and first + len(parts) <= len(starts) and all(low[starts[first + j] : ends[first + j]] == p for j, p in enumerate(parts)):
                    out.append((first, BASE[phrase]))
            i = low.find(key, i + 1)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,strength:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, end, data, offsets in chunks(batch.column(1)):
            starts, ends, firsts = word_spans(LOWER[data], offsets, NOT_WORD)
            low_all = data.tobytes().translate(LOWER.tobytes())
            cols: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for i in range(end - first):
                a, b = int(offsets[i]), int(offsets[i + 1])
                low = low_all[a:b]
                places: list[tuple[int, str]] = []
                if b"reserved" in low or b"cc" in low or b"license" in low:
                    own = slice(firsts[i], firsts[i + 1])
                    places = _places(low, data, starts[own] - a, ends[own] - a)
                spans = detect(low.decode("utf-8", "replace"))
                base = sorted({x[1] for x in places})
                cols["n_base"].append(len(places))
                cols["first_word"].append(min((x[0] for x in places), default=None))
                cols["last_word"].append(max((x[0] for x in places), default=None))
                cols["base_labels"].append(",".join(base))
                cols["labels"].append(",".join(sorted({*base, *(x[2] for x in spans)})))
                cols["score"].append(score(spans, base))
                cols["spans"].append([{"start": s, "end": e, "label": t, "strength": p} for s, e, t, p in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("strength", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, end - first), pa.array(np.diff(firsts), pa.int64()), pa.array(cols["n_base"], pa.int64()), pa.array(cols["first_word"], pa.int64()), pa.array(cols["last_word"], pa.int64()), pa.array(cols["base_labels"], pa.string()), pa.array(cols["labels"], pa.string()), pa.array(cols["score"], pa.float64()), pa.array(cols["spans"], kind)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in every whole text: one row per input row, without a shuffle.

    Columns: doc_id, n_words (words of the text with A-Z lower-cased), n_base /
    first_word / last_word / base_labels (places of the phrases in ``BASE``),
    labels (base ones and those of the rules), score (how strong all evidence
    is, by the words it covers; 0 if there is none) and spans (character
    intervals of the detections that stand, with their strength).
    Null and empty texts have 0 words, null places, empty labels and score 0;
    null ids and repeated rows are kept as they are; an empty table gives none.
    """
    return pick(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)
