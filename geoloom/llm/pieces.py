"""SentencePiece encoding and decoding with N-best segmentations.

A forward Viterbi pass over the lattice of pieces gives the best score up to
every position; these scores are the exact heuristic of an A* search that runs
backwards from the end, so that paths come out best first.  Texts fall apart
where no piece spans two neighbouring characters; the segments' paths combine
into those of the whole text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, product
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.bytewords import TEXTS, chunks, span_hashes
from geoloom.llm.common import pick

MARK = "\u2581"
#: Stands for a mark of the text's own.
OWN_MARK = "\0" + MARK
#: Cuts before each mark that follows another character: no piece holds one there.
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Scores of pieces that the model never makes lie below.
UNUSED = -1e8
#: Segments of words whose best paths a worker remembers (twice as many at most).
MEMORY = 120_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces of a model file, and the paths through them.

    Characters that are no piece go in as the pieces of their UTF-8 bytes, at a
    score below all others.  A space becomes the mark, and one mark is put
    before the text; a mark that the text itself holds goes in as bytes, so
    that decoding gives every text back.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.text: list[bytes] = []
        self.byte = [0] * 256
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.piece[p] = (model.get_score(i), (i,))
                self.text.append(p.replace(MARK, " ").encode())
        self.spans = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        # the same by arrays: a class for each character of longer pieces (0: none), and which pairs some piece spans
        letters = sorted({c for pair in self.spans for c in pair})
        self.n_classes = len(letters) + 1
        self.classes = np.zeros(0x110000, dtype=np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, self.n_classes)
        self.classes[32] = self.classes[ord(MARK)]
        self.neighbours = np.zeros(self.n_classes**2, dtype=bool)
        self.neighbours[[int(self.classes[ord(p[0])]) * self.n_classes + int(self.classes[ord(p[1])]) for p in self.spans]] = True
        self.single = {p for p in self.piece if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, (score, ids) in self.piece.items():
            self.automaton.add_word(p, (len(p), score, ids))
        self.automaton.make_automaton()
        self.lowest = min(s for s, _ in self.piece.values() if s > UNUSED) - 10
        self.segments: dict[str, tuple[float, tuple[int, ...], float]] = {}
        # what was remembered before, for another round: frequent words stay, rare ones go
        self.before: dict[str, tuple[float, tuple[int, ...], float]] = {}

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """(start, score, ids) of the pieces that end at each position, found by an Aho-Corasick automaton."""
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for last, (n, score, ids) in self.automaton.iter(s):
            end = last + 1
            into[end].append((end - n, score, ids))
        for i, c in enumerate(s):
            if c not in self.single:
                into[i + 1].append((i, self.lowest, tuple(self.byte[b] for b in c.encode())))
        return into

    def paths(self, s: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """All paths, best first; A* from the end, with the best scores from the beginning as what is still to come."""
        into = self.edges(s)
        best = [0.0]
        for edges in into[1:]:
            best.append(max([best[e[0]] + e[1] for e in edges]))
        push, pop = heapq.heappush, heapq.heappop
        heap: list = [(-best[-1], 0, len(s), 0.0, None)]
        made = 0  # the earlier made of two equal ones comes first
        while heap:
            cost, _, at, behind, link = pop(heap)
            if at == 0:
                ids: tuple[int, ...] = ()
                while link is not None:
                    ids, link = ids + link[0], link[1]
                yield -cost, ids
                continue
            for start, score, own in into[at]:
                made += 1
                total = behind + score
                push(heap, (-(best[start] + total), made, start, total, (own, link)))

    def segment(self, s: str) -> tuple[float, tuple[int, ...], float]:
        """(score and ids of the best path, how much less the second best has)."""
        if len(s) == 1:
            p = self.piece.get(s)
            return (*p, np.inf) if p else (self.lowest, tuple(self.byte[b] for b in s.encode()), np.inf)
        n, into = len(s), self.edges(s)
        best, via = [0.0] * (n + 1), [None] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for e in into[end]:
                v = best[e[0]] + e[1]
                if top is None or v > top:
                    top, pick = v, e
            best[end], via[end] = top, pick
        ids: tuple[int, ...] = ()
        on, at = {}, n
        while at:
            on[at] = e = via[at]
            ids, at = e[2] + ids, e[0]
        # the second best path has a piece that the best has not: the best path through each such piece
        rest: list = [None] * (n + 1)
        rest[n], second = 0.0, -np.inf
        for end in range(n, 0, -1):
            behind, used = rest[end], on.get(end)
            if behind is None:
                continue
            for e in into[end]:
                v = behind + e[1]
                if rest[e[0]] is None or v > rest[e[0]]:
                    rest[e[0]] = v
                if e is not used and best[e[0]] + v > second:
                    second = best[e[0]] + v
        return best[n], ids, best[n] - second

    def remembered(self, s: str) -> tuple[float, tuple[int, ...], float]:
        """A segment's paths, from memory if they are there."""
        found = self.segments.get(s)
        if found is None:
            found = self.before.get(s) or self.segment(s)
            if len(self.segments) > MEMORY:
                self.before, self.segments = self.segments, {}
            self.segments[s] = found
        return found

    def word(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """The same of a word; put together from segments that no piece crosses, which are remembered."""
        if word == OWN_MARK:
            return self.lowest, tuple(self.byte[b] for b in MARK.encode()), np.inf
        spans = self.spans
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in spans]
        found, start = None, 0
        for i in (*cuts, len(word)):
            s = word[start:i]
            part = self.remembered(s)
            found = part if found is None else (found[0] + part[0], found[1] + part[1], min(found[2], part[2]))
            start = i
        return found

    def words(self, text: str) -> list[str]:
        """The marked text in words; its own marks stand alone."""
        first, *rest = text.split(MARK)
        out = WORDS.findall(MARK + first.replace(" ", MARK))
        for part in rest:
            out.append(OWN_MARK)
            out += WORDS.findall(part.replace(" ", MARK))
        return out

    def best(self, text: str | None) -> tuple[list[str], list[tuple[float, tuple[int, ...], float]]]:
        """The words of a text and what is known of each; none for an empty text."""
        parts = self.words(text) if text else []
        known: dict[str, tuple] = {}
        for s in parts:
            if s not in known:
                known[s] = self.word(s)
        return parts, [known[s] for s in parts]

    def alternatives(self, parts: list[str], found: list[tuple[float, tuple[int, ...], float]], n: int) -> list[tuple[int, list[tuple[float, tuple[int, ...]]]]]:
        """(place, up to n paths with their losses) of the words in which the n best paths can differ from the best.

        A path among the n best changes only words that are among the n - 1 of
        smallest loss: each of those changed alone would be better.
        """
        if n == 1 or not found:
            return []
        gaps = np.array([f[2] for f in found])
        few = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) < 4 * n else np.argpartition(gaps, n - 1)[: n - 1]
        out = []
        for k in few.tolist():
            if gaps[k] < np.inf:
                score, ids, _ = found[k]
                others = ((max(0.0, score - w[0]), w[1]) for w in self.paths(parts[k]) if w[1] != ids)
                out.append((k, [(0.0, ids), *islice(others, n - 1)]))
        return out

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a whole text with their scores, best first; none for an empty text."""
        parts, found = self.best(text)
        if not parts:
            return []
        score = float(sum(f[0] for f in found))
        ways = self.alternatives(parts, found, n)
        choices = sorted(product(*(range(len(o)) for _, o in ways)), key=lambda c: (sum(o[i][0] for (_, o), i in zip(ways, c, strict=True)), c))
        out = []
        for c in choices[:n]:
            changed = {k: o[i][1] for (k, o), i in zip(ways, c, strict=True)}
            loss = sum(o[i][0] for (_, o), i in zip(ways, c, strict=True))
            out.append((score - loss, tuple(i for k, f in enumerate(found) for i in changed.get(k, f[1]))))
        return out

    def scores(self, text: str | None, n: int) -> tuple[list[int], list[float], list[list[dict]], bool]:
        """Ids of the best path, the scores of the n best, and what the others change in it (see ``changes``)."""
        parts, found = self.best(text)
        if not parts:
            return [], [], [], True
        score = float(sum([f[0] for f in found]))
        at = np.append(0, np.cumsum([len(f[1]) for f in found]))
        losses, others, good = self.changes([(int(at[k]), w) for k, w in sorted(self.alternatives(parts, found, n))], n)
        return [i for f in found for i in f[1]], [score - x for x in losses], others, good

    def changes(self, ways: list[tuple[int, list[tuple[float, tuple[int, ...]]]]], n: int) -> tuple[list[float], list[list[dict]], bool]:
        """(the n smallest sums of one loss from each list, the changes of each path but the best, whether all stand for the same text).

        ``ways``: the place of a segment's first piece in the best path, and the
        segment's paths.  A change puts ``pieces`` for the ``n`` pieces from ``at`` on.
        """
        tops: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for _, own in ways:
            tops = sorted((a + w[0], (*c, i)) for a, c in tops for i, w in enumerate(own))[:n]
        others = [[{"at": at, "n": len(own[0][1]), "pieces": own[i][1]} for (at, own), i in zip(ways, c, strict=True) if i] for _, c in tops[1:]]
        written = lambda ids: b"".join([self.text[i] for i in ids])
        used = {(k, i) for _, c in tops[1:] for k, i in enumerate(c) if i}
        return [x for x, _ in tops], others, all(written(ways[k][1][i][1]) == written(ways[k][1][0][1]) for k, i in used)

    def batch(self, data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[dict]]], list[bool]]:
        """(ids of the best paths of all texts, their first places, scores of the n best of each, changes of the others, whether these stand for the same text).

        Texts are cut into segments by a table of the neighbours that pieces
        span; each distinct segment is looked at once, the rest is array work.
        """
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        data = np.insert(data, offsets[:-1][some], 32)  # the mark before each text
        firsts = offsets[:-1][some] + np.arange(len(some))
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        classes = self.classes[points].astype(np.int64)
        start = np.ones(len(points), dtype=bool)
        start[1:] = ~self.neighbours[classes[:-1] * self.n_classes + classes[1:]]
        start[np.searchsorted(char_at, firsts)] = True
        starts = char_at[start]
        ends = np.append(starts[1:], len(data))
        _, first, inverse = np.unique(span_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = [self.remembered(w) for w in words]
        score, gap = np.array([f[0] for f in found]), np.array([f[2] for f in found])
        many = np.array([len(f[1]) for f in found], dtype=np.int64)
        flat = np.array([i for f in found for i in f[1]], dtype=np.int32)
        place = np.cumsum(many) - many
        count = many[inverse]
        total = np.append(0, np.cumsum(count))
        ids = flat[np.repeat(place[inverse] - total[:-1], count) + np.arange(total[-1])]
        word_at = np.append(np.searchsorted(starts, firsts), len(starts))
        cuts = np.zeros(len(size) + 1, dtype=np.int64)
        cuts[some + 1] = np.diff(total[word_at])
        tops: list[list[float]] = [[] for _ in size]
        others: list[list[list[dict]]] = [[] for _ in size]
        same = [True for _ in size]
        ways: dict[int, list] = {}
        for k, d in enumerate(some.tolist()):
            own = inverse[word_at[k] : word_at[k + 1]]
            best = float(score[own].sum())
            if n > 1:
                near = np.argpartition(gap[own], n - 1)[: n - 1] if len(own) > n else np.arange(len(own))
                few = [(j, w) for j, w in zip(near.tolist(), own[near].tolist(), strict=True) if gap[w] < np.inf]
                for _, w in few:
                    if w not in ways:
                        ways[w] = self.alternatives([words[w]], [found[w]], n)[0][1]
                at = total[word_at[k] : word_at[k + 1]] - total[word_at[k]]
                losses, others[d], same[d] = self.changes([(int(at[j]), ways[w]) for j, w in sorted(few)], n)
                tops[d] = [best - x for x in losses]
            else:
                tops[d] = [best]
        return ids, np.cumsum(cuts), tops, others, same

    def decode(self, ids: list[int]) -> str:
        """The text of a path; undoes ``encode`` exactly."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Its UTF-8 bytes; without the mark put before the text."""
        return b"".join([self.text[i] for i in ids])[1:]


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


_SCHEMA = "doc_id long, n_pieces long, score double, scores array<double>, round_trip boolean, pieces array<int>, others array<array<struct<at:int,n:int,pieces:array<int>>>>"
_OTHERS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("pieces", pa.list_(pa.int32()))])))


def encode_texts(docs: DataFrame, n_best: int = 4, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes every whole text: doc_id, n_pieces, score, scores (of the n best paths, fewer if there are fewer), round_trip (every one of these paths decodes to the text), pieces (of the best path), others (of each further path the changes against the best; ``changed`` makes its pieces).

    Null and empty texts have no pieces, score 0 and no scores, and round_trip
    holds (null counts as empty).  Null ids and repeated rows are kept as they
    are; an empty table gives none.  No shuffle.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(path)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1), TEXTS):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                if MARK.encode() in raw:  # texts that hold the mark itself go one by one
                    each = [coder.scores(t.decode(), n_best) for t in texts]
                    tops, others, same = ([x[j] for x in each] for j in (1, 2, 3))
                    ids = np.array([i for x in each for i in x[0]], dtype=np.int32)
                    cuts = np.append(0, np.cumsum([len(x[0]) for x in each]))
                else:
                    ids, cuts, tops, others, same = coder.batch(data, offsets, n_best)
                good = [ok and coder.decode_bytes(ids[a:b].tolist()) == t for a, b, t, ok in zip(cuts[:-1], cuts[1:], texts, same, strict=True)]
                pieces = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                score = pa.array([t[0] if t else 0.0 for t in tops], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(cuts), pa.int64()), score, pa.array(tops, pa.list_(pa.float64())), pa.array(good), pieces, pa.array(others, _OTHERS)], ["doc_id", "n_pieces", "score", "scores", "round_trip", "pieces", "others"])
        coder.before = {}  # workers are used again by other stages

    return pick(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def changed(pieces: list[int], changes: list) -> list[int]:
    """The pieces of a further path: those of the best with its changes (rows or dicts of at, n and pieces, in order)."""
    out, done = [], 0
    for c in changes:
        out += [*pieces[done : c["at"]], *c["pieces"]]
        done = c["at"] + c["n"]
    return out + list(pieces[done:])


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded rows; null pieces give null text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lattice(path)
        for batch in batches:
            texts = [None if p is None else coder.decode(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(run, "doc_id long, text string")
