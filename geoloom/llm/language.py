"""Language identification by word-first backoff.

A known word counts with its log frequency in each language; an unseen one
falls back to its character n-grams, longest first: the n-grams of the first
length of which any is known stand for the word.  Words and n-grams are looked
up by their 64-bit hashes in sorted arrays, a block of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.bytewords import U, _powers, chunks, mix, word_spans
from geoloom.llm.common import drop, pick, save, small_batches

#: At most so many labelled rows are learned from (those of the smallest hash of their id), and so many bytes of their texts.
ROWS, BYTES = 12_000, 64_000_000
#: How often a word or n-gram must occur in them.
LEAST = 3
LENGTHS = (5, 4, 3, 2, 1)
#: What a frequency may lie below the best language's at most, in logarithms.
FLOOR = -8.0
#: The mark at both ends of a word; no letter.
MARK = ord("_")
_GAP = np.zeros(256, dtype=bool)
_GAP[0] = True


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    #: By n-gram length, 0 for whole words: hashes, ascending, and log frequencies in each language.
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Stream:
    """Rolling hashes over code points: that of any stretch in constant time."""

    def __init__(self, points: np.ndarray):
        self.power, self.inverse = _powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, dtype=U)
        np.cumsum(mix(points.astype(U) + U(1)) * self.power[: len(points)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of a block of lower-cased texts: distinct ones, and which stand in which text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        starts, ends, firsts = word_spans(letters()[self.points].astype(np.uint8), begun[offsets], _GAP)
        self.counts = np.diff(firsts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        h = Stream(self.points).hashes(starts, ends)
        self.hash, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]

    def grams(self, size: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of the n-grams of distinct words, which have a mark at both ends; shorter ones have none."""
        stream, begin, length = self._marked(words)
        many = np.maximum(length - size + 1, 0)
        word = np.repeat(np.arange(len(words)), many)
        at = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return stream.hashes(at, at + size), word

    def _marked(self, words: np.ndarray) -> tuple[Stream, np.ndarray, np.ndarray]:
        size = self.ends[words] - self.starts[words]
        length = size + 2
        begin = np.cumsum(length) - length
        marked = np.full(int(length.sum()), MARK, dtype=np.uint32)
        inner = np.repeat(begin + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        source = np.repeat(self.starts[words], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked[inner] = self.points[source]
        return Stream(marked), begin, length


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


_KIND = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of each language in a batch's texts."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, end, data, offsets in chunks(_lowered(batch.column(1))):
            words = Words(data, offsets)
            if not len(words.hash):
                continue
            names, code = np.unique(np.array(langs[first:end], dtype=object).astype(str), return_inverse=True)
            every = np.arange(len(words.hash))
            tables = {0: (words.hash, every), **{size: words.grams(size, every) for size in LENGTHS}}
            for k, name in enumerate(names):
                n = np.bincount(words.place[code[words.doc] == k], minlength=len(every))
                for size, (h, word) in tables.items():
                    unique, inverse = np.unique(h, return_inverse=True)
                    total = np.bincount(inverse, weights=n[word], minlength=len(unique)).astype(np.int64)
                    some = total > 0
                    m = int(some.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * m, pa.string()), pa.array(np.full(m, size, np.int32)), pa.array(unique[some].view(np.int64)), pa.array(total[some])], schema=_KIND)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Model:
    """Learns from at most ``rows`` documents with a language and an id, chosen by a hash of the id.

    Null texts and languages teach nothing; without any row the model knows no
    language.  Rows that repeat an id are chosen together.  The same rows give
    the same model, however they are cut.
    """
    small_batches(docs.sparkSession)
    marked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    ids = marked.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # over ``rows`` rows
    ids = ids.withColumn("before", so_far).where(F.coalesce("before", F.lit(0)) < BYTES).select("doc_id")
    sample = save(marked.join(F.broadcast(ids), "doc_id").select("lang", "text"))
    of = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}  # languages of ``rows`` rows
    langs = sorted(of)
    if not langs:
        return Model()
    total = sum(of.values())
    counted = sample.mapInArrow(_count, "lang string, size int, h long, n long").groupBy("size", "h", "lang").agg(F.sum("n").alias("n"))
    place = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))))[F.col("lang")]
    terms = counted.groupBy("size", "h").agg(F.sum("n").alias("all"), F.collect_list(F.struct(place.alias("i"), "n")).alias("by")).where(F.col("all") >= LEAST)
    flat = save(terms.select("size", "h", F.explode("by").alias("b")).select("size", "h", F.col("b.i").alias("i"), F.col("b.n").alias("n")))
    got = flat.orderBy("size", F.col("h")).toArrow()  # bounded by BYTES and LEAST
    drop(flat)
    drop(sample)
    model = Model(langs, [float(np.log(of[x] / total)) for x in langs], {})
    size, h, i, n = (got.column(c).to_numpy() for c in ("size", "h", "i", "n"))
    for s in (0, *LENGTHS):
        own = size == s
        keys, inverse = np.unique(h[own].view(U), return_inverse=True)
        counts = np.full((len(keys), len(langs)), 0.1)
        np.add.at(counts, (inverse, i[own]), n[own])
        model.tables[s] = (keys, np.log(counts / counts.sum(0)).astype(np.float32))
    return model


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Of each distinct word its log frequency in each language, less the best one's; zeros where nothing is known."""
    out = np.zeros((len(words.hash), len(model.langs)))
    open_ = np.ones(len(words.hash), dtype=bool)
    for size in (0, *LENGTHS):
        keys, logs = model.tables.get(size, (np.zeros(0, dtype=U), None))
        left = np.flatnonzero(open_)
        if not len(keys) or not len(left):
            continue
        h, word = (words.hash[left], np.arange(len(left))) if size == 0 else words.grams(size, left)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        hit = keys[at] == h
        many = np.bincount(word[hit], minlength=len(left))
        known = many > 0
        for k in range(len(model.langs)):
            mean = np.bincount(word[hit], weights=logs[at[hit], k], minlength=len(left))
            out[left[known], k] = mean[known] / many[known]
        open_[left[known]] = False
    out -= out.max(1, keepdims=True) if len(model.langs) else 0
    return np.maximum(out, FLOOR)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: doc_id, lang_pred, score (0 to 1); no shuffle.

    ``und`` with score 0 for null texts and those without a letter, and if the
    model knows no language.  Equal scores go to the language that sorts first.
    Null ids and repeated rows are kept as they are; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BYTES and LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for first, end, data, offsets in chunks(_lowered(batch.column(1))):
                words, m = Words(data, offsets), end - first
                best, score = np.full(m, len(model.langs)), np.zeros(m)
                if model.langs:
                    each = word_scores(model, words)
                    sums = np.stack([p + np.bincount(words.doc, weights=each[words.place, k], minlength=m) for k, p in enumerate(model.prior)], 1)
                    some = words.counts > 0
                    best[some] = np.argmax(sums[some].round(9), 1)
                    # evidence is damped, as words of one text aren't independent
                    damped = (sums - sums.max(1, keepdims=True)) / np.sqrt(np.maximum(words.counts, 1))[:, None]
                    score[some] = (1 / np.exp(damped).sum(1))[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, m), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
