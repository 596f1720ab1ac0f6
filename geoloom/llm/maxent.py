"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, word before).  The
frequent words are classes of their own; other words share a class by their
spelling.  Both factors are softmaxes.  The class factor is a log-linear model
on hashed features of the history: the class before (bigram), the two before
together (trigram) and the one before last alone (skip).  Its sufficient
statistics are counts of (history, class), which every partition gathers for
itself; their sum has one size at any corpus, and one task ascends the
likelihood on it.  The word factor starts
from the counts of the class's words and has a weight for each frequent pair of
words (word bigrams, by their hash); the pairs of one word before and one class
make a softmax of their own, so each is trained where its counts lie.  The word
counts and the weights of pairs are tables that grow with the corpus: they stay
partitioned by hash, and documents ask for their rare words and pairs there, many
documents together, each word or pair once.  What travels is packed: ascending
numbers take two bits more than the logarithm of their mean distance
(``pack_ascending``), and the answers come back in the order of the questions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.bytewords import LOWER, WHITE, U, chunks, mix, span_hashes, word_spans
from geoloom.llm.common import drop, save, small_batches

#: Words that are a class of their own, classes of the other words, and all classes (the end of a text is the last).
OWN, SHARED = 48, 47
CLASSES = OWN + SHARED + 1
BEGIN = CLASSES
HISTORY = CLASSES + 1
#: Buckets for the hashed pair features.
BUCKETS = 4096
#: Gradient steps, and the largest of a weight's change in the first.
STEPS, RATE = 25, 0.9
#: Frequent words whose counts every task holds (16 bytes each).
FREQUENT = 65_536
#: Bytes of texts that are scored at once.
TEXTS = 4_000_000
#: Rare words and pairs, and texts, that are looked up together, about.
ASKED, TOGETHER = 1 << 20, 1 << 16
#: Distinct words that a task holds before it merges them.
MERGE = 2_000_000
#: Pairs of words whose weights every task holds at most (the most frequent ones; others are looked up), and how often one must occur.
PAIRS, LEAST = 1 << 18, 5
#: Bits of the filter over the pairs and groups that are looked up: what it lets through in vain is asked for in vain.
FILTER = 1 << 26
#: Words in a stored cell at most.
CELL = 4_000_000
END = U(0x5EED0FE4D5EED0FE)
START = U(0x57A27C0DE57A27C0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, spelling class, first token of each text and the total): lower-cased words, then one end."""
    starts, ends, firsts = word_spans(data, offsets, WHITE)
    n = len(offsets) - 1
    bounds = firsts + np.arange(n + 1)
    h = np.full(bounds[-1], END, dtype=U)
    kind = np.full(bounds[-1], SHARED, dtype=np.uint8)
    at = np.ones(bounds[-1], dtype=bool)
    at[bounds[1:] - 1] = False
    h[at] = span_hashes(data, starts, ends)
    if len(starts):
        last = LOWER[data[ends - 1]]
        sign = (last < 48) | ((last > 57) & (last < 97))  # ASCII that's neither letter nor digit
        tail = np.maximum(ends - 1 - sign, starts)
        before = np.maximum(tail - 1, starts)
        spelled = LOWER[data[tail]].astype(U) | (LOWER[data[before]].astype(U) << U(8)) | (sign.astype(U) << U(16))
        kind[at] = (mix(spelled + U(1)) % U(SHARED)).astype(np.uint8)
    return h, kind, bounds


def _tally(h: np.ndarray, kind: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with their class and total."""
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return unique, kind[first], np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


def pack_bits(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number: whole bytes by place, then the bits that are left."""
    whole, left = divmod(width, 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    rest = np.packbits(planes[:, whole, None] >> np.arange(left, dtype=np.uint8) & 1) if left else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes[:, :whole].T).tobytes() + rest.tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """What ``pack_bits`` packed of n numbers, from the start of the bytes."""
    whole, left = divmod(width, 8)
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :whole] = data[: whole * n].reshape(whole, n).T
    if left:
        bits = np.unpackbits(data[whole * n :], count=n * left).reshape(n, left)
        planes[:, whole] = (bits << np.arange(left, dtype=np.uint8)).sum(1, dtype=np.uint8)
    return planes.view("<u8").ravel().astype(U)


_HEAD = np.dtype([("n", "<i8"), ("first", "<u8"), ("width", "<i8")])


def pack_ascending(x: np.ndarray) -> bytes:
    """Numbers that never descend, by Elias and Fano: the low bits of each, and the high ones as steps in a row of bits."""
    if not len(x):
        return b""
    x = x.astype(U)
    width = max(0, ((int(x[-1]) - int(x[0])) // len(x)).bit_length() - 1)
    x0, x = x[0], x - x[0]
    at = (x >> U(width)).astype(np.int64) + np.arange(len(x))
    steps = np.zeros(at[-1] + 1, dtype=bool)
    steps[at] = True
    return np.array([(len(x), x0, width)], dtype=_HEAD).tobytes() + pack_bits(x, width) + np.packbits(steps).tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=U)
    n, first, width = np.frombuffer(data, dtype=_HEAD, count=1)[0].tolist()
    body = np.frombuffer(data, dtype=np.uint8, offset=_HEAD.itemsize)
    low = width // 8 * n + (width % 8 * n + 7) // 8
    steps = np.flatnonzero(np.unpackbits(body[low:]))
    return ((steps - np.arange(n)).astype(U) << U(width)) + unpack_bits(body, n, width) + U(first)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, those of 255 and more again behind them."""
    return zlib.compress(np.int64(len(n)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    m = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    n = np.frombuffer(data, dtype=np.uint8, count=m, offset=8).astype(np.int64)
    n[n == 255] = np.frombuffer(data[8 + m :], dtype=np.int64)
    return n


def _join(*parts: bytes) -> bytes:
    return np.array([len(x) for x in parts], dtype=np.int64).tobytes() + b"".join(parts)


def _split(data: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, dtype=np.int64, count=n))])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_PACKED = "p int, h binary, kind binary, n binary"


def _pack(p: int, h: np.ndarray, kind: np.ndarray, n: np.ndarray) -> dict:
    return {"p": p, "h": h.tobytes(), "kind": kind.tobytes(), "n": n.tobytes()}


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_PACKED_ARROW = pa.schema([("p", pa.int32()), ("h", pa.binary()), ("kind", pa.binary()), ("n", pa.binary())])


def _gather(parts: int):
    """Word counts of the training texts of a task, packed by partition of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def packed():
            h, kind, n = _tally(*(np.concatenate([x[j] for x in held]) for j in range(3)))
            part = (h % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    yield _arrow([{"p": p, "h": pack_ascending(h[own] // U(parts)), "kind": zlib.compress(kind[own].tobytes(), 1), "n": pack_counts(n[own])}], _PACKED_ARROW)

        for batch in batches:
            texts = batch.column(1).filter(batch.column(2))
            for _, _, data, offsets in chunks(texts):
                h, kind, _ = tokens(data, offsets)
                held.append(_tally(h, kind))
                size += len(held[-1][0])
                if size > MERGE:
                    held = [_tally(*(np.concatenate([x[j] for x in held]) for j in range(3)))]
                    size = len(held[0][0])
                    if size > MERGE:
                        yield from packed()
                        held, size = [], 0
        if held:
            yield from packed()

    return run


def _merge(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, h, kind, n in _merged(batches, parts):
            for at in range(0, len(h), CELL):
                yield _arrow([_pack(p, h[at : at + CELL], kind[at : at + CELL], n[at : at + CELL])], _PACKED_ARROW)

    return run


def _merged(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """One table of counts a partition, merged as the rows stream by."""
    key, held, size = None, [], 0

    def one():
        return _tally(*(np.concatenate([x[j] for x in held]) for j in range(3)))

    for batch in batches:
        for p, h, kind, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and p != key:
                yield (key, *one())
                held, size = [], 0
            key = p
            held.append((unpack_ascending(h) * U(parts) + U(p), np.frombuffer(zlib.decompress(kind), dtype=np.uint8), unpack_counts(n)))
            size += len(held[-1][0])
            if len(held) > 1 and size > 2 * len(held[0][0]) + MERGE:
                held = [one()]
                size = len(held[0][0])
    if held:
        yield (key, *one())


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition of the counts: totals by class, and its most frequent words."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("v", pa.int64())])
    for batch in batches:
        for _, h, kind, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h, kind, n = np.frombuffer(h, dtype=U), np.frombuffer(kind, dtype=np.uint8), np.frombuffer(n, dtype=np.int64)
            all_n, all_v = np.bincount(kind, weights=n, minlength=SHARED + 1), np.bincount(kind, minlength=SHARED + 1)
            yield _arrow([{"h": None, "n": int(all_n[k]), "kind": k, "v": int(all_v[k])} for k in range(SHARED + 1)], schema)
            top = np.argpartition(-n, FREQUENT)[:FREQUENT] if len(n) > FREQUENT else np.arange(len(n))
            yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top]), pa.array(kind[top].astype(np.int32)), pa.array(np.zeros(len(top), np.int64))], schema=schema)


@dataclass
class Model:
    """What every task needs; its size does not grow with the corpus."""

    #: Whether there are weights of pairs beyond those held here.
    more_pairs: bool = False
    #: A filter over their keys, by partition and then by hash, packed.
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))
    n: int = 0
    v: int = 0
    #: Hashes of frequent words, ascending, with their counts and classes.
    word: np.ndarray = field(default_factory=lambda: np.array([END], dtype=U))
    count: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    group: np.ndarray = field(default_factory=lambda: np.full(1, CLASSES - 1, dtype=np.int16))
    kind: np.ndarray = field(default_factory=lambda: np.full(1, SHARED, dtype=np.uint8))
    #: log10 of the words and tokens of each shared class, plus one.
    weight: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    #: Hashes of weighted pairs of words, ascending, with their weights; of (word before, class), with the logarithm of their sum.
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U))
    pair_weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    group_of_pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U))
    group_sum: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    #: log10 P(class | two classes before).
    table: np.ndarray = field(default_factory=lambda: np.full((HISTORY, HISTORY, CLASSES), -np.log10(CLASSES)))

    def classes(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, count, whether the count is known here) of tokens."""
        place, known = _places(self.word, h)
        return *self.classes_at(place, known, kind), known

    def classes_at(self, place: np.ndarray, known: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of tokens by their places among the frequent words."""
        own = np.where(known, self.group[place], -1)
        return np.where(own >= 0, own, OWN + kind.astype(np.int16)), np.where(known, self.count[place], 0)

    def shared_class(self, place: np.ndarray) -> np.ndarray:
        """The class of frequent words that have none of their own."""
        return OWN + self.kind[place].astype(np.int64)

    def pairs_elsewhere(self, h: np.ndarray, place: np.ndarray, c: np.ndarray, known: np.ndarray, bounds: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(``dense`` numbers of pairs and groups that may have a weight which is not held here, the tokens they belong to)."""
        before, there = places_before(place, known, bounds, len(self.word))
        own = np.flatnonzero(there & (c >= OWN) & (c < CLASSES - 1))
        both = own[known[own]]
        hashes = words_before(h, bounds)
        out = []
        for held, low, at in ((self.pair, place[both], both), (self.group_of_pairs, GROUP + c[own].astype(np.int64), own)):
            number = dense(before[at].astype(np.int64) << 32 | low, len(self.word))
            size = U(len(self.bits) // parts * 8)
            bit = number % U(parts) * size + filter_bit(number, size)
            new = (self.bits[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1
            number, at = number[new], at[new]
            some = ~_held(held, pair_keys(hashes[at], h[at]) if held is self.pair else group_keys(hashes[at], c[at]))
            out.append((number[some], at[some]))
        return tuple(np.concatenate([x[j] for x in out]) for j in range(2))

    def word_factor(self, h: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 of what the word before changes in P(word | class)."""
        before = words_before(h, bounds)
        return _found(self.pair, self.pair_weight, pair_keys(before, h)) - _found(self.group_of_pairs, self.group_sum, group_keys(before, c))


def words_before(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of the word before each token of its text."""
    out = np.empty(len(h), dtype=U)
    out[1:] = h[:-1]
    out[bounds[:-1]] = START
    return out


def places_before(place: np.ndarray, known: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word before each token, ``words`` at the start of a text; whether it is known)."""
    before, there = np.empty_like(place), np.empty_like(known)
    before[1:], there[1:] = place[:-1], known[:-1]
    before[bounds[:-1]], there[bounds[:-1]] = words, True
    return before, there


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(before + U(3)) + h)


def group_keys(before: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(before + U(5)) + c.astype(U))


def filter_size(parts: int) -> int:
    """Bits of the filter for each partition: whole bytes."""
    return max(1, FILTER // parts // 8) * 8


def filter_bit(number: np.ndarray, size: np.uint64) -> np.ndarray:
    return mix(number + U(11)) % size


def _filters(size: int, parts: int):
    """The part of the filter of each partition, whose rows stand together; packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("p", pa.int32()), ("bits", pa.binary())])
        key, bits = None, None
        for batch in batches:
            for p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != key:
                    if key is not None:
                        yield _arrow([{"p": key, "bits": np.packbits(bits, bitorder="little").tobytes()}], schema)
                    key, bits = p, np.zeros(size, dtype=bool)
                bits[filter_bit(unpack_ascending(k) * U(parts) + U(p), U(size)).astype(np.int64)] = True
        if key is not None:
            yield _arrow([{"p": key, "bits": np.packbits(bits, bitorder="little").tobytes()}], schema)

    return run


def _held(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each key is there."""
    if not len(keys):
        return np.zeros(len(asked), dtype=bool)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return keys[at] == asked


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for those without one."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, values[at], 0.0)


_PAIRED = "p int, k binary, n binary"
_PAIRED_ARROW = pa.schema([("p", pa.int32()), ("k", pa.binary()), ("n", pa.binary())])
#: Marks a count of a whole group: the low half of its number is this and the class.
GROUP = 1 << 31


def dense(k: np.ndarray, words: int, parts: int = 1) -> np.ndarray:
    """Numbers of pairs and groups without gaps, in the same order; words before count in steps of ``parts``."""
    low = k & 0xFFFFFFFF
    return ((k >> 32) // parts * (words + CLASSES) + np.where(low >= GROUP, low - GROUP + words, low)).astype(U)


def spread(d: np.ndarray, words: int, parts: int = 1, p: int = 0) -> np.ndarray:
    """The numbers that ``dense`` made d of, those of words before that leave p."""
    high, low = np.divmod(d.astype(np.int64), words + CLASSES)
    return (high * parts + p) << 32 | np.where(low >= words, low - words + GROUP, low)


def _sum_pairs(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(k, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


def _gather_pairs(held, parts: int):
    """Counts of word pairs and groups by partition of the word before.

    A pair's number has the place of the word before among the frequent ones in
    its high half, and that of the word in its low half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        kept: list[tuple] = []
        size = 0

        def packed():
            k, n = _sum_pairs(*(np.concatenate([x[j] for x in kept]) for j in range(2)))
            part = (k >> 32) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    yield _arrow([{"p": p, "k": pack_ascending(dense(k[own], len(model.word), parts)), "n": pack_counts(n[own])}], _PAIRED_ARROW)

        for batch in batches:
            texts = batch.column(1).filter(batch.column(2))
            for _, _, data, offsets in chunks(texts):
                h, kind, bounds = tokens(data, offsets)
                place, known = _places(model.word, h)
                c = model.classes_at(place, known, kind)[0]
                before, there = places_before(place, known, bounds, len(model.word))
                own = there & (c >= OWN) & (c < CLASSES - 1)
                high = before[own].astype(np.int64) << 32
                some = known[own]
                k = np.concatenate([high[some] | place[own][some], high | (GROUP + c[own].astype(np.int64))])
                kept.append(_sum_pairs(k, np.ones(len(k))))
                size += len(kept[-1][0])
                if size > MERGE:
                    kept = [_sum_pairs(*(np.concatenate([x[j] for x in kept]) for j in range(2)))]
                    size = len(kept[0][0])
                    if size > MERGE // 2:
                        yield from packed()
                        kept, size = [], 0
        if kept:
            yield from packed()

    return run


def _places(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the words, whether it is one of them) of hashes."""
    unique, inverse = np.unique(h, return_inverse=True)
    at = np.searchsorted(words, unique)
    at[at == len(words)] = 0
    return at[inverse], (words[at] == unique)[inverse]


def _merged_pairs(batches: Iterator[pa.RecordBatch], words: int, parts: int) -> Iterator[tuple[int, tuple]]:
    """Of each partition all its pairs and groups, summed as the rows stream by."""
    key, kept, size = None, [], 0
    for batch in batches:
        for p, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kept and p != key:
                yield key, _sum_pairs(*(np.concatenate([x[j] for x in kept]) for j in range(2)))
                kept, size = [], 0
            key = p
            kept.append((spread(unpack_ascending(k), words, parts, p), unpack_counts(n)))
            size += len(kept[-1][0])
            if len(kept) > 1 and size > 2 * len(kept[0][0]) + MERGE:
                kept = [_sum_pairs(*(np.concatenate([x[j] for x in kept]) for j in range(2)))]
                size = len(kept[0][0])
    if kept:
        yield key, _sum_pairs(*(np.concatenate([x[j] for x in kept]) for j in range(2)))


def _frequent_pairs(words: int, parts: int):
    """Of each partition the pairs that occur ``LEAST`` times, and the groups of their words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, (k, n) in _merged_pairs(batches, words, parts):
            group = (k & GROUP) > 0
            good = ~group & (n >= LEAST)
            good |= group & np.isin(k >> 32, (k >> 32)[good])
            if good.any():
                yield _arrow([{"p": p, "k": k[good].tobytes(), "n": n[good].tobytes()}], _PAIRED_ARROW)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield np.frombuffer(k, dtype=np.int64), np.frombuffer(n, dtype=np.int64)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs occur how often."""
    for k, n in _cells(batches):
        value, many = np.unique(n[(k & GROUP) == 0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(many, pa.int64())], ["n", "pairs"])


def fit_pairs(q: np.ndarray, n: np.ndarray, group: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sums): ascends the likelihood of n of total[group] words, whose shares start at q, with a slight pull to zero.

    The words of a group without a weight keep their shares, so the softmax's
    sum is 1 + sum of q (exp(weight) - 1): sparse, whatever the class's size.
    """
    w = np.zeros(len(q))
    for _ in range(60):
        z = 1 + np.bincount(group, weights=q * np.expm1(w), minlength=len(total))
        p = q * np.exp(w) / z[group]
        gradient = n - total[group] * p - 0.5 * w
        step = np.clip(gradient / (total[group] * p * (1 - p) + 0.5), -1, 1)
        w += 0.7 * step
        if not len(step) or np.abs(step).max() < 1e-4:
            break
    return w, 1 + np.bincount(group, weights=q * np.expm1(w), minlength=len(total))


_WEIGHTS = "p int, k binary, w binary, g binary, z binary"


def _train_pairs(held, head: int, parts: int):
    """Weights of pairs, group by group where their counts lie: those of pairs that occur ``head`` times in rows of partition -1, the others by partition of their ``dense`` numbers.

    There ``k``, packed, and ``w`` have pairs and groups alike: what each adds to the logarithm.
    """
    schema = pa.schema([("p", pa.int32()), *((x, pa.binary()) for x in "kwgz")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        names = np.append(model.word, START)
        for k, n in _cells(batches):
            whole = (k & GROUP) > 0
            pair = ~whole
            if not pair.any():
                continue
            before, word = k[pair] >> 32, k[pair] & 0xFFFFFFFF
            c = model.shared_class(word)
            groups, group = np.unique((before << 32) | (GROUP + c), return_inverse=True)
            total = n[whole][np.searchsorted(k[whole], groups)].astype(float)  # numbers ascend
            share = (model.count[word] + 1) / 10 ** model.weight[c]
            w, z = fit_pairs(share, n[pair].astype(float), group, total)
            w, z = (w / np.log(10)).astype(np.float32), (np.log(z) / np.log(10)).astype(np.float32)
            key, g = pair_keys(names[before], model.word[word]), group_keys(names[groups >> 32], (groups & 0xFFFFFFFF) - GROUP)
            often = n[pair] >= head
            here = np.zeros(len(groups), dtype=bool)
            here[group[often]] = True
            if often.any():
                yield _arrow([{"p": -1, "k": key[often].tobytes(), "w": w[often].tobytes(), "g": g[here].tobytes(), "z": z[here].tobytes()}], schema)
            numbers, values = dense(np.concatenate([k[pair][~often], groups[~here]]), len(model.word)), np.concatenate([w[~often], -z[~here]])
            part = (numbers % U(parts)).astype(np.int64)
            order = np.lexsort((numbers, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                for at in range(0, len(own), CELL):
                    yield _arrow([{"p": p, "k": pack_ascending(numbers[own[at : at + CELL]] // U(parts)), "w": values[own[at : at + CELL]].tobytes(), "g": b"", "z": b""}], schema)

    return run


def learn_pairs(rows: DataFrame, model: Model, parts: int) -> DataFrame | None:
    """Weights of all word pairs that occur ``LEAST`` times; all training texts are counted.

    The most frequent ones are added to the model; where there are others, they
    are returned by partition of their ``dense`` numbers.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    packed = rows.mapInArrow(_gather_pairs(held, parts), _PAIRED)
    counts = save(packed.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_frequent_pairs(len(model.word), parts), _PAIRED))
    seen = counts.mapInArrow(_histogram, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs"))
    running = F.sum("pairs").over(Window.orderBy(F.desc("n")))
    head = seen.orderBy(F.desc("n")).limit(PAIRS + 1).withColumn("all", running).where(F.col("all") <= PAIRS).agg(F.min("n")).first()[0]
    trained = save(counts.mapInArrow(_train_pairs(held, 1 << 62 if head is None else head, parts), _WEIGHTS))
    drop(counts)
    got = trained.where("p < 0").select("k", "w", "g", "z").collect()  # PAIRS pairs at most
    if got:
        k, w, g, z = (np.concatenate([np.frombuffer(r[j], dtype=t) for r in got]) for j, t in enumerate((U, np.float32, U, np.float32)))
        order, by = np.argsort(k), np.argsort(g)
        model.pair, model.pair_weight, model.group_of_pairs, model.group_sum = k[order], w[order], g[by], z[by]
    rest = trained.where("p >= 0").select("p", "k", "w")
    size = filter_size(parts)
    by_part = rest.select("p", "k").repartition(parts, "p").sortWithinPartitions("p")
    filters = by_part.mapInArrow(_filters(size, parts), "p int, bits binary").collect()  # ``FILTER`` bits in all
    model.more_pairs = bool(filters)
    if not filters:
        return None
    bits = np.zeros((parts, size // 8), dtype=np.uint8)
    for r in filters:
        bits[r.p] = np.frombuffer(r.bits, dtype=np.uint8)
    model.bits = bits.ravel()
    return rest


def histories(c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token, and the one before that, within its text."""
    one = np.full(len(c), BEGIN, dtype=np.int64)
    two = np.full(len(c), BEGIN, dtype=np.int64)
    one[1:] = c[:-1]
    two[2:] = c[:-2]
    first = bounds[:-1]
    one[first] = BEGIN
    two[first] = BEGIN
    second = first[np.diff(bounds) > 1] + 1
    two[second] = BEGIN
    return one, two


def _statistics(model: Model):
    """(class before last, counts by class before and class) of the training texts of a task, as packed matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HISTORY * HISTORY * CLASSES, dtype=np.int64)
        for batch in batches:
            texts = batch.column(1).filter(batch.column(2))
            for _, _, data, offsets in chunks(texts):
                h, kind, bounds = tokens(data, offsets)
                c = model.classes(h, kind)[0].astype(np.int64)
                one, two = histories(c, bounds)
                total += np.bincount((two * HISTORY + one) * CLASSES + c, minlength=len(total))
        rows = total.reshape(HISTORY, -1)
        for i in np.flatnonzero(rows.any(1)):
            yield _arrow([{"two": int(i), "n": pack_counts(rows[i])}], _MATRIX)

    return run


_MATRIX = pa.schema([("two", pa.int32()), ("n", pa.binary())])


def _sum_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the matrices that share their first column, by which the rows are sorted."""
    key, total = None, None
    for batch in batches:
        for two, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = unpack_counts(n)
            if two == key:
                total += n
                continue
            if key is not None:
                yield _arrow([{"two": key, "n": total.tobytes()}], _MATRIX)
            key, total = two, n
    if key is not None:
        yield _arrow([{"two": key, "n": total.tobytes()}], _MATRIX)


class Weights:
    """Weights by feature and class: a bias, the class before, the class before that (skip), the hashed pair."""

    def __init__(self, w: np.ndarray | None = None):
        self.w = np.zeros((1 + 2 * HISTORY + BUCKETS, CLASSES)) if w is None else w

    @staticmethod
    def features(history: np.ndarray) -> np.ndarray:
        two, one = history // HISTORY, history % HISTORY
        pair = (mix(history.astype(U) + U(7)) % U(BUCKETS)).astype(np.int64)
        return np.stack([np.zeros(len(history), dtype=np.int64), 1 + one, 1 + HISTORY + two, 1 + 2 * HISTORY + pair], 1)

    def logs(self, history: np.ndarray) -> np.ndarray:
        z = self.w[self.features(history)].sum(1)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def ascended(history: np.ndarray, n: np.ndarray) -> Weights:
    """Weights that ascend the likelihood of the counts by class of each history.

    A weight moves by its gradient over the larger of its observed and expected
    counts, so that rare and frequent features learn at one pace.
    """
    weights = Weights()
    features = Weights.features(history).T
    total = n.sum(1, keepdims=True)

    def by_feature(x: np.ndarray) -> np.ndarray:
        out = np.zeros(weights.w.shape)
        for f in features:
            np.add.at(out, f, x)
        return out

    seen = by_feature(n)
    for step in range(STEPS):
        expected = by_feature(np.exp(weights.logs(history)) * total)
        move = (seen - expected) / (np.maximum(seen, expected) + 2.0)
        move -= 0.02 * weights.w / (1 + np.maximum(seen, expected))  # a slight pull to zero
        weights.w = weights.w + RATE / (1 + 0.05 * step) * np.where(np.arange(len(move))[:, None] == 0, 1.0, 0.5) * move
    return weights


def _ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all summed counts, whose size is fixed, the weights."""
    matrices = [(two, n) for batch in batches for two, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if matrices:
        n = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, CLASSES) for _, x in matrices]).astype(float)
        history = np.concatenate([two * HISTORY + np.arange(HISTORY) for two, _ in matrices])
        some = n.any(1)
        yield pa.RecordBatch.from_pydict({"w": pa.array([ascended(history[some], n[some]).w.tobytes()], pa.binary())})


def train(statistics: DataFrame, parts: int = 4) -> Weights:
    """The weights, from counts that are summed over partitions; the driver gets nothing but the weights."""
    held = statistics.repartition(parts, "two").sortWithinPartitions("two").mapInArrow(_sum_matrices, "two int, n binary")
    got = held.repartition(1).mapInArrow(_ascend, "w binary").collect()  # one row or none
    return Weights(np.frombuffer(got[0].w, dtype=float).reshape(Weights().w.shape).copy()) if got else Weights()


def learn(rows: DataFrame, parts: int) -> tuple[Model, DataFrame]:
    """The model, and the partitioned counts of all words, from the rows whose ``train`` is true."""
    return learn_all(rows, parts)[:2]


def learn_all(rows: DataFrame, parts: int) -> tuple[Model, DataFrame, DataFrame | None]:
    """``learn``, and the weights of pairs that the model doesn't hold, if there are any."""
    packed = rows.mapInArrow(_gather(parts), _PACKED)
    counts = save(packed.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_merge(parts), _PACKED))
    summary = save(counts.mapInArrow(_summary, "h long, n long, kind int, v long"))
    totals = summary.where("h is null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    top = summary.where("h is not null").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    drop(summary)
    model = Model()
    model.n, model.v = sum(r.n for r in totals), sum(r.v for r in totals)
    if not model.n:
        return model, counts, None
    h, n = top.column("h").to_numpy().view(U), top.column("n").to_numpy()
    kind = top.column("kind").to_numpy()
    group = np.full(len(h), -1, dtype=np.int16)
    words = np.flatnonzero(h != END)[:OWN]
    group[words] = np.arange(len(words))
    group[h == END] = CLASSES - 1
    size = np.zeros(CLASSES)
    for r in totals:
        size[OWN + r.kind] = r.n + r.v + 1
    for i in words:  # no longer in their shared class
        size[OWN + kind[i]] -= n[i] + 1
    size[OWN + SHARED] = 1
    if END not in h:
        ends = next(r.n for r in totals if r.kind == SHARED)
        h, n, group, kind = np.append(h, END), np.append(n, ends), np.append(group, np.int16(CLASSES - 1)), np.append(kind, SHARED)
    order = np.argsort(h)
    model.word, model.count, model.group, model.kind = h[order], n[order], group[order], kind[order].astype(np.uint8)
    size[:OWN] = 1
    model.weight = np.log10(np.maximum(size, 1))
    statistics = rows.mapInArrow(_statistics(model), "two int, n binary")
    weights = train(statistics)
    model.table = (weights.logs(np.arange(HISTORY * HISTORY)) / np.log(10)).reshape(HISTORY, HISTORY, CLASSES).astype(np.float32)
    return model, counts, learn_pairs(rows, model, parts)


_BLOCK = "p int, block long, kind int, a binary, b binary"
_BLOCK_ARROW = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
#: Kinds of rows, in the order in which they are met: counts or weights of a partition, a block of texts, what a block asks for or is told.
TABLE, OWN_ROW, ASKS = 0, 1, 2


def _questions(keys: np.ndarray, doc: np.ndarray, m: int, parts: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """(partition and packed keys that are asked for there, each once; which of the m texts hold each, and how often).

    The second part stays with the block: answers come in the order of the keys.
    """
    unique, inverse = np.unique(keys, return_inverse=True)
    part = (unique % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(unique), dtype=np.int64)
    rank[order] = np.arange(len(unique))
    both, tf = np.unique(rank[inverse] * m + doc, return_counts=True)
    at, of = both // m, both % m
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    unique = unique[order] // U(parts)
    asks = [(p, pack_ascending(unique[cuts[p] : cuts[p + 1]])) for p in np.flatnonzero(np.diff(cuts)).tolist()]
    return asks, _join(pack_ascending(cuts), np.packbits(np.diff(at, prepend=-1).astype(bool)).tobytes(), pack_bits(of, (m - 1).bit_length()), pack_counts(tf))


def _score(held, parts: int):
    """Of each block of texts: a row with what can be said here, and one a partition with the rare words or pairs to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        block = TaskContext.get().partitionId() << 32
        logn = np.log10(model.n + model.v + 1)
        texts, asked, m, size = [], ([], []), 0, 0

        def rows():
            ids, has, sizes = (np.concatenate([x[j] for x in texts]) for j in range(3))
            sums = np.concatenate([x[3] for x in texts], axis=1)
            out, lists = [], []
            for offset, own in zip((0, parts), asked, strict=True):  # those of pairs go to partitions of their own
                keys, doc = (np.concatenate([x[j] for x in own]) if own else np.zeros(0, t) for j, t in enumerate((U, np.int64)))
                asks, where = _questions(keys, doc, m, parts) if len(keys) else ([], b"")
                out += [{"p": offset + p, "block": block, "kind": ASKS, "a": a, "b": b""} for p, a in asks]
                lists.append(where)
            own = _join(ids.tobytes(), has.tobytes(), pack_counts(sizes), sums.tobytes())
            yield _arrow([{"p": int(block + (block >> 32)) % (2 * parts), "block": block, "kind": OWN_ROW, "a": own, "b": _join(*lists)}], _BLOCK_ARROW)
            for i in range(0, len(out), 1000):
                yield _arrow(out[i : i + 1000], _BLOCK_ARROW)

        for batch in batches:
            ids, has = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, end, data, offsets in chunks(batch.column(1), TEXTS):
                h, kind, bounds = tokens(data, offsets)
                place, known = _places(model.word, h)
                c, count = model.classes_at(place, known, kind)
                one, two = histories(c.astype(np.int64), bounds)
                lm = model.table[two, one, c].astype(np.float64) - model.weight[c] + model.word_factor(h, c, bounds)
                word = np.log10(count + 1.0)
                base = np.where(known, word, 0.0) - logn
                lm += np.where(known & (c >= OWN) & (c < CLASSES - 1), word, 0.0)
                doc = np.repeat(np.arange(end - first), np.diff(bounds))
                sums = np.stack([np.bincount(doc, weights=x, minlength=end - first) for x in (base, lm, (count > 0).astype(float))])
                texts.append((ids[first:end].copy(), has[first:end], np.diff(bounds), sums))
                if model.n:
                    asked[0].append((h[~known], m + doc[~known]))
                if model.more_pairs:
                    numbers, at = model.pairs_elsewhere(h, place, c, known, bounds, parts)
                    asked[1].append((numbers, m + doc[at]))
                m += end - first
                size += sum(len(own[-1][0]) for own in asked if own)
                if size >= ASKED or m >= TOGETHER:
                    yield from rows()
                    block += 1
                    texts, asked, m, size = [], ([], []), 0, 0
        if texts:
            yield from rows()

    return run


def _look_up(parts: int):
    """Answers what blocks ask for: counts of words in partitions below ``parts``, weights of pairs in those from it on.

    A partition's counts or weights come first; blocks' own rows pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cells, keys, values = None, [], np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        for batch in batches:
            out = []
            for p, block, kind, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != part:
                    part, cells = p, []
                    keys, values = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64 if p < parts else np.float32)
                if kind == TABLE:
                    cells.append((np.frombuffer(a, dtype=U) // U(parts), np.frombuffer(b, dtype=np.int64)) if p < parts else (unpack_ascending(a), np.frombuffer(b, dtype=np.float32)))
                    continue
                if kind == OWN_ROW:
                    out.append({"p": p, "block": block, "kind": kind, "a": a, "b": b})
                    continue
                if cells:  # in any order
                    keys, values = (np.concatenate([x[j] for x in cells]) for j in range(2))
                    order = np.argsort(keys, kind="stable")
                    keys, values, cells = keys[order], values[order], []
                told = _found(keys, values, unpack_ascending(a))
                some = told != 0
                told = pack_counts(told.astype(np.int64)) if p < parts else _join(np.packbits(some).tobytes(), told[some].astype(np.float32).tobytes())
                out.append({"p": p, "block": block, "kind": kind, "a": told, "b": b""})
            if out:
                yield _arrow(out, _BLOCK_ARROW)

    return run


def _total(parts: int):
    """A block's own row comes first; what was looked up is added."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def opened(a: bytes, b: bytes):
        ids, has, sizes, sums = _split(a, 4)
        ids, sizes = np.frombuffer(ids, dtype=np.int64), unpack_counts(sizes)
        lists = []
        for where in _split(b, 2):
            if not where:
                lists.append(None)
                continue
            cuts, new, of, tf = _split(where, 4)
            cuts, tf = unpack_ascending(cuts).astype(np.int64), unpack_counts(tf)
            at = np.cumsum(np.unpackbits(np.frombuffer(new, dtype=np.uint8), count=len(tf)), dtype=np.int64) - 1
            of = unpack_bits(np.frombuffer(of, dtype=np.uint8), len(tf), (len(ids) - 1).bit_length()).astype(np.int64)
            lists.append((cuts, at, of, tf, np.zeros(cuts[-1])))
        return ids, np.frombuffer(has, dtype=bool), sizes, np.frombuffer(sums, dtype=float).reshape(3, -1).copy(), lists

    def closed(ids, has, sizes, sums, lists):
        words, pairs = lists
        if words:
            _, at, of, tf, n = words
            gain = np.bincount(of, weights=tf * np.log10(n + 1)[at], minlength=len(ids))
            sums += [gain, gain, np.bincount(of, weights=tf * (n > 0)[at], minlength=len(ids))]
        if pairs:
            _, at, of, tf, w = pairs
            sums[1] += np.bincount(of, weights=tf * w[at], minlength=len(ids))
        base, lm, known = sums
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=~has), pa.array(sizes), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(lm)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for p, _, kind, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if kind == OWN_ROW:
                    if held:
                        yield closed(*held)
                    held = opened(a, b)
                    continue
                cuts, *_, told = held[4][p >= parts]
                own = told[cuts[p % parts] : cuts[p % parts + 1]]
                if p < parts:
                    own[:] = unpack_counts(a)
                else:
                    some, w = _split(a, 2)
                    own[np.unpackbits(np.frombuffer(some, dtype=np.uint8), count=len(own)).astype(bool)] = np.frombuffer(w, dtype=np.float32)
        if held:
            yield closed(*held)

    return run


def score_texts(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Learns from the rows where ``train_rows`` (a Column) holds, and scores every whole text.

    Columns: doc_id, n_tokens (words and one end), n_known (tokens that occur in
    the training texts), train_tokens, base_score (log10 probability by add-one
    unigrams) and score (by the model).  Null texts count as empty: one token,
    the end.  Null ids and repeated rows are kept and scored one by one; without
    training rows all words are unknown; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    model, counts, pairs = learn_all(rows, parts)
    held = spark.sparkContext.broadcast(model)
    tables = counts.select("p", F.lit(0).cast("long").alias("block"), F.lit(TABLE).alias("kind"), F.col("h").alias("a"), F.col("n").alias("b"))
    if pairs is not None:
        tables = tables.union(pairs.select(F.col("p") + F.lit(parts), F.lit(0).cast("long"), F.lit(TABLE), F.col("k"), F.col("w")))
    # one pass: a block's own row takes the same way as what it asks for, so that nothing is stored in between
    asked = tables.union(rows.mapInArrow(_score(held, parts), _BLOCK)).repartition(parts, "p").sortWithinPartitions("p", "kind")
    both = asked.mapInArrow(_look_up(parts), _BLOCK).repartition("block").sortWithinPartitions("block", "kind")
    out = both.mapInArrow(_total(parts), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))
