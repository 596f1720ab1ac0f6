"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

The lexicon (words, and stems that many words share) is learned from labelled
documents.  Its trie is intersected with the Levenshtein automaton of each
word, determinised lazily, so that one walk over a token tells whether any term
is within its number of edits.  Ordinary words that happen to lie near a term
are told from misspellings by the documents they stand in, over the whole
corpus.  Hits are scored in their context window - quotation against abuse, by
quotation marks and by words learned from both - and a logistic model on a few
sums gives the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.bytewords import WHITE, U, chunks, mix, shingles, words
from geoloom.llm.common import pick, save, small_batches

#: At most so many labelled rows of each kind are learned from (those of the smallest hash of their id).
TOXIC_ROWS, CLEAN_ROWS = 3000, 6000
#: Terms: in how many toxic documents at least (a number, and a share), and log odds at least.
MIN_ROWS, MIN_SHARE, MIN_ODDS = 3, 0.01, 2.0
#: What a misspelling counts as a share of the term before the labelled rows are looked at, and how hard they move it.
NEAR, PULL = 0.8, 0.02
#: Documents from which on a form near a term is judged by the company it keeps; a rarer one is a misspelling unless clean labelled rows hold it.
JUDGED = 3
#: Bits of the table of ordinary forms (2 MB) and places of each: one in a hundred thousand others is taken for one at 400,000 forms.
FORM_BITS, FORM_PLACES = 24, 4
#: Terms that a task counts before it gives them out.
COUNTED = 20_000
#: Trie nodes in all states that an automaton keeps (about 100 bytes each) before it starts anew.
HELD = 500_000
#: Lengths of stems, and how many different words must share one.
STEM, STEM_WORDS = (4, 8), 4
#: Tokens on either side that make a hit's context.
WINDOW = 12

TOKEN = re.compile(r"\w[\w@$*]*")
_OPEN = {'"': '"', "“": "”", "„": "”", "«": "»"}
def edits(term: str) -> int:
    """Edits allowed for a term: none below 5 letters, 1, and 2 from 9 letters on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Forms:
    """A set of strings of a fixed size in memory: each sets a few bits."""

    def __init__(self, bits: bytes | None = None):
        self.bits = np.zeros(1 << (FORM_BITS - 3), dtype=np.uint8) if bits is None else np.frombuffer(bits, dtype=np.uint8).copy()

    @staticmethod
    def places(form: str) -> np.ndarray:
        digest = blake2b(form.encode("utf-8", "surrogatepass"), digest_size=4 * FORM_PLACES).digest()
        return np.frombuffer(digest, dtype=np.uint32).astype(np.int64) >> (32 - FORM_BITS)

    def add(self, form: str) -> None:
        for p in self.places(form):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, form: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(form))


class FuzzyLexicon:
    """Trie of terms intersected with Levenshtein automata, determinised on demand.

    A state is the set of (trie node, edits so far) that the characters read
    can have reached; states and transitions are kept.  ``find`` gives the best
    hit of a token as (kind, odds): kind 0 an exact word, 1 a word within its
    edits, 2 a stem; or None.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], spare: Forms | frozenset[str] = frozenset(), limit: int = 100_000, held: int = HELD):
        self.child: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some word below allows
        self.ends: list[int] = [-1]  # edits allowed where a word ends
        self.odds = [0.0]  # of the word that ends here
        self.stem = [0.0]  # odds of the stem that ends here
        for term, odds in words.items():
            k = edits(term)
            node = self._walk(term, k)
            self.ends[node], self.odds[node] = k, odds
        for term, odds in stems.items():
            self.stem[self._walk(term, 0)] = odds
        self.limit, self.held = limit, held
        self.spare = spare  # ordinary words that happen to lie near a term
        self.memo: dict[str, tuple[int, float] | None] = {}
        self._reset()

    def _walk(self, term: str, k: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], k)
        for c in term:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.most.append(0)
                self.ends.append(-1)
                self.odds.append(0.0)
                self.stem.append(0.0)
            node = self.child[node][c]
            self.most[node] = max(self.most[node], k)
        return node

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.go: list[dict[str, int]] = []
        self.ending: list[tuple[int, float] | None] = []
        self.weight = 0  # what the states hold
        self.start = self._state({0: 0}, 0.0)

    def _state(self, nodes: dict[int, int], stem: float) -> int:
        """Id of a set of {node: edits}, closed under skipping a term's character."""
        stack = list(nodes.items())
        while stack:
            node, e = stack.pop()
            if e > nodes.get(node, 9):
                continue
            for c in self.child[node].values():
                if e + 1 <= self.most[c] and e + 1 < nodes.get(c, 9):
                    nodes[c] = e + 1
                    stack.append((c, e + 1))
        stem = max([stem, *(self.stem[n] for n, e in nodes.items() if e == 0)])
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.weight += len(nodes) + 4
            self.go.append({})
            best = min(((e, -self.odds[n]) for n, e in nodes.items() if e <= self.ends[n]), default=None)
            self.ending.append((min(best[0], 1), -best[1]) if best else (2, stem) if stem else None)
        return self.ids[key]

    def _step(self, s: int, c: str) -> int:
        nodes, stem = self.sets[s]
        new: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.most[n] and e < new.get(n, 9):
                new[n] = e

        for node, e in nodes:
            put(node, e + 1)
            for x, n in self.child[node].items():
                put(n, e if x == c else e + 1)
        self.go[s][c] = t = self._state(new, stem)
        return t

    def find(self, token: str) -> tuple[int, float] | None:
        if token in self.memo:
            return self.memo[token]
        if len(self.memo) > self.limit:
            self.memo.clear()
        if self.weight > self.held:
            self._reset()
        s = self.start
        for c in token:
            t = self.go[s].get(c)
            s = self._step(s, c) if t is None else t
            if not self.sets[s][0]:  # no word can follow; a stem that was met stays
                break
        found = self.ending[s]
        if found is not None and found[0] == 1 and token in self.spare:
            found = None
        self.memo[token] = found
        return found


@dataclass
class Model:
    #: Terms and their log odds.
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Ordinary forms within a term's edits: no misspellings.
    spare: Forms | frozenset[str] = frozenset()
    #: Words around terms in clean documents, with log odds below zero.
    cues: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-3.0] + [0.0] * (N_FEATURES - 1))


N_FEATURES = 7


def _quoted(text: str) -> list[tuple[int, int]]:
    """Intervals between quotation marks that open and close within one line."""
    out = []
    if not any(c in text for c in _OPEN):
        return out
    start = 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            close = _OPEN.get(line[i])
            j = line.find(close, i + 1) if close else -1
            if j > 0:
                out.append((start + i, start + j))
                i = j
            i += 1
        start += len(line) + 1
    return out


def features(text: str, lexicon: FuzzyLexicon, cues: dict[str, float]) -> list[float]:
    """Constant, sums of exact / near / stem hits (damped), densest window, share of tokens hit, share of hits in quotation.

    A hit counts half between quotation marks, and less the more the words of
    its window speak for a report of what others said.
    """
    low = text.lower()
    found = {t: kind for t in set(TOKEN.findall(low)) if (kind := lexicon.find(t)) is not None}
    if not found:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    tokens = [(m.start(), m[0]) for m in TOKEN.finditer(low)]
    hits = [i for i, (_, t) in enumerate(tokens) if t in found]
    spans = _quoted(low)
    starts = np.array([a for a, _ in spans])
    sums = [0.0, 0.0, 0.0]
    densest = quoted = 0
    lo = 0
    for n, i in enumerate(hits):
        at, token = tokens[i]
        q = int(np.searchsorted(starts, at)) - 1 if spans else -1
        inside = q >= 0 and at < spans[q][1]
        told = sum(cues.get(t, 0.0) for _, t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]) if cues else 0.0
        kind, odds = found[token]
        sums[kind] += odds * (0.5 if inside else 1.0) * float(np.exp(max(told, -2.0)))
        quoted += inside
        while hits[lo] < i - WINDOW:
            lo += 1
        densest = max(densest, n - lo + 1)
    return [1.0, *(float(np.log1p(x)) for x in sums), float(np.log1p(densest)), min(1.0, 30 * len(hits) / (len(tokens) + 30)), quoted / len(hits)]


def _fit(x: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, both classes weighing the same."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the features; hits never speak against toxicity, quotation apart.

    The weight of misspellings is drawn towards ``NEAR`` times that of the terms
    they are near, as they may be too rare among the labelled rows.
    """
    x = x.copy()
    x[:, 1] += NEAR * x[:, 2]
    ridge = np.full(N_FEATURES, 0.05)
    ridge[0], ridge[2] = 1e-3, PULL * len(y)
    active = list(range(N_FEATURES))
    while True:
        w = np.zeros(N_FEATURES)
        w[active] = _fit(x[:, active], y, ridge[active])
        wrong = [i for i in active if 0 < i < N_FEATURES - 1 and i != 2 and w[i] < 0]
        if not wrong:
            w[2] = max(0.0, w[2] + NEAR * w[1])
            return w
        active = [i for i in active if i not in wrong]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, is stem, documents with it) of a batch's texts, given out whenever ``COUNTED`` different ones are held."""
    for batch in batches:
        count: Counter = Counter()
        for text in [*batch.column(0).to_pylist(), None]:  # the null at the end flushes
            if count and (text is None or len(count) > COUNTED):
                keys = list(count)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(list(count.values()), pa.int64())], ["term", "stem", "n"])
                count.clear()
            words = {w for w in TOKEN.findall((text or "").lower()) if not w.isdigit()}
            count.update((w, False) for w in words)
            count.update((s, True) for s in {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)})


def _without_copies(texts: DataFrame) -> DataFrame:
    """Learning rows that share neither of two minima over their five-word shingles: copies of one text are one witness.

    Of those that share one, the row of the smallest id (then text) is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                value, _, firsts = shingles(*words((data, offsets), WHITE), 5)
                keys = np.zeros((2, end - first), dtype=np.int64)
                some = np.flatnonzero(np.diff(firsts))
                if len(some):
                    for k in range(2):
                        keys[k, some] = np.minimum.reduceat(mix(value + U(11 + k)), firsts[some]).view(np.int64)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[0]), pa.array(keys[1])], ["doc_id", "y", "text", "k1", "k2"])

    marked = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, text string, k1 long, k2 long")
    for k in ("k1", "k2"):
        marked = marked.groupBy("y", k).agg(F.min(F.struct("doc_id", "text", "k1", "k2")).alias("r")).select("y", "r.doc_id", "r.text", "r.k1", "r.k2")
    return save(marked.select("y", "text"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: tuple[int, int] = (TOXIC_ROWS, CLEAN_ROWS)) -> Model:
    """Learns the lexicon and the weights from labelled documents, and the ordinary forms near terms from all.

    At most ``rows`` toxic and clean ones are used, chosen by a hash of their
    id.  Null labels, ids and texts teach nothing, nor do ids with both labels;
    without toxic documents the model finds nothing toxic.  The same tables give
    the same model, however they are cut.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most")
    picked = [known.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, rows[0]), (0, rows[1]))]
    ids = [[r.doc_id for r in p.collect()] for p in picked]  # bounded by ``rows``
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i, y) for y, group in ((1, ids[0]), (0, ids[1])) for i in group], "doc_id long, y int")
    texts = pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where("text is not null")
    if not ids[0]:
        return Model()
    texts = _without_copies(texts)
    counts = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic:
        return Model()
    terms = texts.where("y = 1").select("text").mapInArrow(_terms, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))
    whole = terms.where("not stem")
    shared = whole.select(F.explode(F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.greatest(F.lit(STEM[0]), F.length("term") - 1))), lambda k: F.substring("term", 1, k))).alias("term")).groupBy("term").agg(F.count("*").alias("shared"))
    stems = terms.where("stem").join(shared, "term").where(F.col("shared") >= STEM_WORDS).select("term", "stem", "n")
    likely = whole.union(stems).where(F.col("n") >= max(MIN_ROWS, MIN_SHARE * n_toxic)).collect()  # bounded by ``rows`` and MIN_SHARE
    candidates = {(r.term, r.stem): r.n for r in likely}

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _terms(batches):
            count = [(t, s, n) for t, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (t, s) in candidates]
            yield pa.RecordBatch.from_pylist([{"term": t, "stem": s, "n": n} for t, s, n in count], schema=batch.schema)

    clean = {(r.term, r.stem): r.n for r in texts.where("y = 0").select("text").mapInArrow(among, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n")).collect()}
    odds = {k: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(k, 0) + 1) / (n_clean + 1)) - n**-0.5) for k, n in candidates.items()}
    good = sorted(k for k in odds if odds[k] >= MIN_ODDS)
    model = Model({t: odds[t, False] for t, stem in good if not stem}, {t: odds[t, True] for t, stem in good if stem})
    model.spare = _ordinary(pick(docs, id_col, text_col), texts.where("y = 0").select("text"), model)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(model.words, model.stems, model.spare)
        for batch in batches:
            count: Counter = Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(text.lower())
                hits = [i for i, t in enumerate(tokens) if lexicon.find(t) is not None]
                near = {t for i in hits for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1] if lexicon.find(t) is None}
                count.update((y, t) for t in near)
                count[y, None] += bool(hits)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.int32()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["y", "term", "n"])

    windows = save(texts.select("y", "text").mapInArrow(around, "y int, term string, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")))
    whole = windows.where("term is null").first()
    if whole and whole.good >= MIN_ROWS:
        spoken = windows.where("term is not null").where(F.col("good") >= max(MIN_ROWS, MIN_SHARE * whole.good)).collect()  # bounded as the terms are
        cue = {r.term: float(np.log((r.bad + 1) / (whole.bad + 2)) - np.log((r.good + 0.5) / (whole.good + 1)) + r.good**-0.5) for r in spoken}
        model.cues = {t: c for t, c in sorted(cue.items()) if c < -1.0}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(model.words, model.stems, model.spare)
        for batch in batches:
            x = [features(t, lexicon, model.cues) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    data = sorted((r.y, r.x) for r in texts.select("y", "text").mapInArrow(describe, "y int, x array<double>").collect())  # bounded by ``rows``
    model.weights = [float(x) for x in _weights(np.array([x for _, x in data]), np.array([y for y, _ in data]))]
    return model


def _ordinary(docs: DataFrame, clean: DataFrame, model: Model) -> Forms:
    """Forms within a term's edits that are words of their own, judged over all documents.

    A misspelling keeps the company of the terms: documents that hold it hold
    a term far more often than others do.  Forms in at least ``JUDGED`` documents
    are ordinary unless they do that; rarer ones are ordinary if ``clean`` rows
    hold them.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(model.words, model.stems)
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                kinds = {t: hit[0] for t in set(TOKEN.findall((text or "").lower())) if (hit := lexicon.find(t))}
                with_term = any(k == 0 for k in kinds.values())
                count[None, with_term] += 1
                count.update((t, with_term) for t, k in kinds.items() if k == 1)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.bool_()), pa.array(list(count.values()), pa.int64())], ["term", "told", "n"])

    kind = "term string, told boolean, n long"
    met = save(docs.select("text").mapInArrow(near, kind).groupBy("term").agg(F.sum(F.when(F.col("told"), F.col("n")).otherwise(0)).alias("told"), F.sum("n").alias("n")))
    own = clean.mapInArrow(near, kind).where("term is not null").select(F.col("term").alias("_term")).distinct()
    whole = met.where("term is null").first()
    if whole is None:
        return Forms()
    odds = F.log((F.col("told") + 0.5) / (whole.told + 1)) - F.log((F.col("n") - F.col("told") + 0.5) / (whole.n - whole.told + 1))
    judged = met.where("term is not null").join(own, F.col("term") == F.col("_term"), "left")
    spare = judged.where(F.when(F.col("n") >= JUDGED, odds < MIN_ODDS).otherwise(F.col("_term").isNotNull())).select("term")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                forms.add(t)
        yield pa.RecordBatch.from_arrays([pa.array([forms.bits.tobytes()], pa.binary())], ["bits"])

    out = Forms()
    for r in spare.coalesce(8).mapInArrow(marks, "bits binary").collect():  # eight rows at most, of one size
        out.bits |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """Scores every whole text: doc_id, score (0 to 1), predicted (1 if score >= cut); no shuffle.

    Null and empty texts get the score of a text without hits.  Null ids and
    repeated rows are kept as they are; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(model.words, model.stems, model.spare)
        w = np.array(model.weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([features(t or "", lexicon, model.cues) for t in batch.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``cut``; null and empty texts stay. No shuffle.

    Null ids and repeated rows are judged by their text like any other; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(model.words, model.stems, model.spare)
        w = np.array(model.weights)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                x = np.array([features(t or "", lexicon, model.cues) for t in texts])
                p = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
                yield batch.filter(pa.array((p < cut) | np.array([not t for t in texts])))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
