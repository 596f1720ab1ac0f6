"""Vectorised tokenising and hashing of Arrow string columns.

Every operator that looks at words works on the UTF-8 bytes of a whole Arrow
batch: separators are ASCII, so byte classes find word borders, and a
polynomial rolling hash (prefix sums modulo 2**64) gives each word's 64-bit
hash without making a Python object a word.  ``chunks`` cuts a batch at
document borders so that memory stays bounded; a single longer text is cut at
word borders by ``word_hashes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once: small enough for the arrays over them to stay in a core's cache.
BLOCK = 250_000
#: The same for operators whose work on a block has a large constant part.
TEXTS = 1_000_000


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags: True for the bytes in the closed ranges."""
    t = np.zeros(256, dtype=bool)
    for a, b in spans:
        t[a : b + 1] = True
    return t


#: Words are runs of anything but these.
WHITE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: After lower-casing: runs of ASCII letters, digits and everything beyond ASCII.
NOT_WORD = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWBYTE = _BYTE[LOWER]
_R = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, BLOCK + 1024)
        inverse = pow(_R, -1, 1 << 64)
        for base in (_R, inverse):
            p = np.ones(size, dtype=U)
            k = 1
            step = base
            while k < size:
                m = min(k, size - k)
                p[k : k + m] = p[:m] * U(step)
                k, step = k * 2, step * step % (1 << 64)
            _POW.append(p)
        del _POW[:-2]
    return _POW[0], _POW[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    a = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return a, offsets - offsets[0]


def chunks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``block`` bytes."""
    data, offsets = column_bytes(column)
    first, n = 0, len(column)
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total): words never cross document borders."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(sep[data], out=inside[:-1])
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    start[borders] |= inside[borders]
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    inner = borders[borders > 0]
    stop[inner] |= inside[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans, which must ascend."""
    out = np.empty(len(starts), dtype=U)
    table = _LOWBYTE if lower else _BYTE
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + BLOCK, side="right")), first + 1)
        stop = int(ends[last - 1])
        power, inverse = _powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, dtype=U)
        np.cumsum(table[data[base:stop]] * power[: stop - base], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        h = (sums[e] - sums[s]) * inverse[s]
        out[first:last] = mix(h + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        first = last
    return out


def words(column_part: tuple[np.ndarray, np.ndarray], sep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the total)."""
    data, offsets = column_part
    starts, ends, firsts = word_spans(data, offsets, sep)
    return span_hashes(data, starts, ends, lower), firsts


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles: (hash, document) sorted by document then hash, and the first of each document.

    A document with 1 to k-1 words has its whole sequence as one shingle; one
    without words has none.
    """
    n = len(firsts) - 1
    counts = np.diff(firsts)
    doc = np.repeat(np.arange(n), counts)
    left = np.repeat(firsts[1:], counts) - np.arange(len(hashes))  # words from here to the document's end
    value = np.zeros(len(hashes), dtype=U)
    for j in range(k):  # positions beyond the end add nothing, which only short documents use
        m = len(hashes) - j
        if m <= 0:
            break
        part = mix(hashes[j:] + U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        part[left[:m] <= j] = U(0)
        value[:m] += part
    whole = np.repeat(counts < k, counts)
    keep = (left >= k) | (whole & (left == np.repeat(counts, counts)))
    value, doc = mix(value[keep] + left[keep].clip(0, k).astype(U)), doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
    return value, doc, np.searchsorted(doc, np.arange(n + 1))
