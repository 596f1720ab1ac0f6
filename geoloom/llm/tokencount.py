"""Token counts by compiled finite-state transducers.

Two deterministic machines count the tokens of a byte-level BPE:

* a *splitter* over character classes cuts text into the pieces inside which
  merges happen.  A chunk of text is turned into its state map - for every
  state in which the chunk may begin, the state in which it ends and the cuts
  it makes - and the maps compose by a parallel prefix scan, so that chunks
  are independent of each other and no text has to be walked in one piece;
* a *merger* over bytes reads one piece.  Its states are grown when they are
  first met; each transition carries how many tokens the prefix has gained
  (the number may fall: a byte can complete a merge).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.bytewords import TEXTS, U, chunks, column_bytes, span_hashes
from geoloom.llm.common import pick

# Character classes.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, C_S, C_T, C_R, C_E, C_V, C_M, C_L, C_D = range(14)
CLASSES = 14
#: Characters of each contraction after its quote: single ones, and pairs.
_SUFFIX = {"s": C_S, "t": C_T, "r": C_R, "e": C_E, "v": C_V, "m": C_M, "l": C_L, "d": C_D}


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    t = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            t[c] = LETTER
        elif kind[0] == "N":
            t[c] = NUMBER
    # White_Space of the Unicode standard
    for a, b in ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        t[a : b + 1] = BLANK
    t[0x20] = SPACE
    t[ord("'")] = QUOTE
    for c, k in _SUFFIX.items():
        t[ord(c)] = k
    return t


def _is_letter(c: int) -> bool:
    return c == LETTER or c >= C_S


# States of the splitter: what the piece that holds the last character is.
# W1S: one blank character, a space, which may yet start a piece; W1B: one other
# blank; WS / WB: a run of several that ends in a space / in another blank.
START, W1S, W1B, WS, WB, LET, NUM, OTH, QUO, Q_R, Q_V, Q_L, DONE = range(13)
STATES = 13
# What a transition says about cuts, relative to the character read: a piece
# starts at it, or (run of blanks before a word) at the blank before it, or the
# cut at the character before is taken back.
CUT_HERE, CUT_BEFORE, CUT_BACK = 1, 2, 4
#: Class of the mark that stands before each text, and of what fills the last chunk.
RESET, PAD = 14, 15
#: Characters of a chunk.
CHUNK = 512


def _fresh(c: int) -> int:
    """State after the first character of a piece."""
    if c == SPACE:
        return W1S
    if c == BLANK:
        return W1B
    if _is_letter(c):
        return LET
    return {NUMBER: NUM, OTHER: OTH, QUOTE: QUO}[c]


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cuts) for state x class.

    A quote that starts a piece is a contraction if one of the fixed suffixes
    follows; otherwise it is an ordinary sign.  ``'re``, ``'ve`` and ``'ll``
    need two characters: after the first (states Q_R, Q_V, Q_L) a failed match
    has put a letter piece behind a quote piece, so the cut before the letter is
    made when that letter is read and taken back when the match succeeds.
    """
    go = np.zeros((STATES, CLASSES + 2), dtype=np.uint8)  # all but START after RESET are set below
    cut = np.zeros((STATES, CLASSES + 2), dtype=np.uint8)
    go[:, PAD] = np.arange(STATES)
    for s in range(STATES):
        for c in range(CLASSES):
            blank = c in (SPACE, BLANK)
            nxt, mark = _fresh(c), CUT_HERE
            if s in (W1S, W1B, WS, WB):
                if blank:
                    nxt, mark = (WS if c == SPACE else WB), 0
                elif s == W1S:  # an optional space before letters, numbers or signs
                    nxt, mark = (OTH if c == QUOTE else _fresh(c)), 0
                elif s == WS:  # all but the last blank were a piece
                    nxt, mark = (OTH if c == QUOTE else _fresh(c)), CUT_BEFORE
                elif s == WB:  # the last blank is a piece of its own
                    nxt, mark = _fresh(c), CUT_BEFORE | CUT_HERE
            elif s == LET and _is_letter(c):
                nxt, mark = LET, 0
            elif s == NUM and c == NUMBER:
                nxt, mark = NUM, 0
            elif s == OTH and c in (OTHER, QUOTE):
                nxt, mark = OTH, 0
            elif s == QUO:
                if c in (OTHER, QUOTE):
                    nxt, mark = OTH, 0
                elif c in (C_S, C_T, C_M, C_D):
                    nxt, mark = DONE, 0
                elif c in (C_R, C_V, C_L):
                    nxt, mark = {C_R: Q_R, C_V: Q_V, C_L: Q_L}[c], CUT_HERE
            elif s in (Q_R, Q_V, Q_L):
                if (s, c) in ((Q_R, C_E), (Q_V, C_E), (Q_L, C_L)):
                    nxt, mark = DONE, CUT_BACK
                elif _is_letter(c):
                    nxt, mark = LET, 0
            go[s, c], cut[s, c] = nxt, mark
    return go, cut


def state_maps(classes: np.ndarray) -> np.ndarray:
    """(chunks, states): where each chunk of a (chunks, length) matrix ends for every state it may begin in."""
    flat = splitter()[0].T.ravel().copy()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(classes), STATES)).copy()
    rows = classes.astype(np.int16) * STATES
    for j in range(classes.shape[1]):
        maps = flat[rows[:, j : j + 1] + maps]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of each map with all before it, in log2(chunks) rounds of independent compositions."""
    out = maps
    step = 1
    while step < len(out):
        out = np.concatenate([out[:step], np.take_along_axis(out[step:], out[:-step], axis=1)])
        step *= 2
    return out


def piece_starts(stream: np.ndarray) -> np.ndarray:
    """Flags of the elements of a class stream (a RESET before each text) at which pieces start."""
    n = len(stream)
    rows = -(-n // CHUNK)
    classes = np.full(rows * CHUNK, PAD, dtype=np.uint8)
    classes[:n] = stream
    classes = classes.reshape(rows, CHUNK)
    state = np.zeros(rows, dtype=np.uint8)
    if rows > 1:
        state[1:] = prefix_scan(state_maps(classes))[:-1, START]
    go, cut = (x.T.ravel().copy() for x in splitter())
    marks = np.empty((CHUNK, rows), dtype=np.uint8)
    at = np.ascontiguousarray(classes.T).astype(np.int16) * STATES
    for j in range(CHUNK):
        index = at[j] + state
        marks[j] = cut[index]
        state = go[index]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & CUT_HERE) > 0
    starts[:-1] |= (marks[1:] & CUT_BEFORE) > 0
    starts[:-1] &= (marks[1:] & CUT_BACK) == 0
    return starts


class Merger:
    """Deterministic transducer that counts the tokens of a piece, byte by byte.

    After each prefix the encoding has one last token: the one suffix t of the
    prefix such that t and the last token before it stay apart when merged
    together.  What may still matter is the longest suffix that begins some
    token, with the last tokens and relative counts at its places: this is the
    state.  States and transitions are made when first needed; once there are
    ``limit`` of them the machine starts afresh.
    """

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        codes = byte_codes()
        as_bytes = {c: bytes([b]) for b, c in codes.items()}
        decode = lambda s: b"".join(as_bytes[c] for c in s)
        self.special = [x["content"] for x in spec["added_tokens"]]
        added = set(self.special)
        self.tokens = {decode(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(decode(a), decode(b)): k for k, (a, b) in enumerate(merges)}
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.limit = limit
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.info: list[tuple] = []
        self.step: list[dict[int, tuple[int, int]]] = []
        self.state((b"", ((b"", 0),)))

    def state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.info)
            self.info.append(key)
            self.step.append({})
        return self.states[key]

    def encode(self, piece: bytes) -> list[bytes]:
        """The merges applied one by one, the lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        if key not in self.apart:
            if len(self.apart) > self.limit:
                self.apart.clear()
            self.apart[key] = self.encode(a + b) == ([a, b] if a else [b])
        return self.apart[key]

    def grow(self, s: int, byte: int) -> tuple[int, int]:
        """The transition of state s on a byte: next state, and tokens gained."""
        suffix, last = self.info[s]  # last: (last token, count less the state's count) at each place of the suffix
        text = suffix + bytes([byte])
        for i in range(len(text)):
            token = text[i:]
            if token in self.tokens and self.stay_apart(last[i][0], token):
                gained = last[i][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks single bytes")
        keep = next((i for i in range(len(text)) if text[i:] in self.begins), len(text))
        places = (*((t, n - gained) for t, n in last[keep:]), (token, 0))
        self.step[s][byte] = found = (self.state((text[keep:], places)), gained)
        return found

    def count(self, piece: bytes) -> int:
        if len(self.info) > self.limit:
            self.reset()
        s, n = 0, 0
        for byte in piece:
            s, gained = self.step[s].get(byte) or self.grow(s, byte)
            n += gained
        return n


def byte_codes() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


class Counter:
    """Counts of whole texts; remembers pieces by their hash."""

    def __init__(self, path: str, limit: int = 2_000_000):
        self.merger, self.limit = merger(path), limit
        self.known, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = span_hashes(data, starts, ends, lower=False)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        hit = self.known[at] == unique if len(self.known) else np.zeros(len(unique), dtype=bool)
        count = np.empty(len(unique), dtype=np.int64)
        count[hit] = self.counts[at[hit]]
        new = np.flatnonzero(~hit)
        raw = data.tobytes()
        tell = self.merger.count
        count[new] = [tell(raw[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        if len(new):
            if len(self.known) + len(new) > self.limit:
                self.known, self.counts = unique, count
            else:
                both, counts = np.concatenate([self.known, unique[new]]), np.concatenate([self.counts, count[new]])
                order = np.argsort(both, kind="stable")
                self.known, self.counts = both[order], counts[order]
        return count[inverse]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts that lie in ``data`` at ``offsets`` (no special strings inside)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, dtype=np.int64)
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        first_char = np.searchsorted(char_at, offsets)
        stream = np.insert(class_table()[points], first_char[:-1], RESET)
        is_char = np.ones(len(stream), dtype=bool)
        is_char[first_char[:-1] + np.arange(n)] = False
        starts = char_at[piece_starts(stream)[is_char]]
        # a text's first character always starts a piece, so a piece ends where the next one starts
        counts = self.pieces(data, starts, np.append(starts[1:], len(data)))
        total = np.append(0, np.cumsum(counts))
        firsts = np.searchsorted(starts, offsets)
        return total[firsts[1:]] - total[firsts[:-1]]


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of a string column; nulls count as empty."""
    counter = _counter(path)
    out = np.zeros(len(texts), dtype=np.int64)
    for first, end, data, offsets in chunks(texts, TEXTS):
        raw = data.tobytes()
        if not any(x.encode() in raw for x in counter.merger.special):
            out[first:end] = counter.texts(data, offsets)
            continue
        # a special string is one token, and what stands around it is cut apart
        parts, owner = [], []
        for i in range(end - first):
            pieces = [raw[offsets[i] : offsets[i + 1]]]
            for x in counter.merger.special:
                split = [y.split(x.encode()) for y in pieces]
                out[first + i] += sum(len(y) - 1 for y in split)
                pieces = [z for y in split for z in y]
            parts += pieces
            owner += [first + i] * len(pieces)
        sizes = np.append(0, np.cumsum([len(x) for x in parts]))
        np.add.at(out, owner, counter.texts(np.frombuffer(b"".join(parts), dtype=np.uint8), sizes))
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Tokens of every whole text as the byte-level BPE file at ``path`` cuts them; no shuffle.

    One row per input row: doc_id, n_bytes (UTF-8), n_tokens and over_limit
    (n_tokens > limit).  No begin or end tokens are added; a special string
    inside a text is one token.  Null texts count as empty: 0 bytes, 0 tokens.
    Null ids and repeated rows are kept as they are; an empty table gives none.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_tokens(batch.column(1), path)
            size = np.diff(column_bytes(batch.column(1))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
