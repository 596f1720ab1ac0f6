"""Benchmark decontamination by size-partitioned containment search.

A short test item inside a long document has a tiny Jaccard similarity to it,
so bands of minhashes over whole documents would need thousands of hashes.  The
search therefore keeps a min-hash sketch on the item's side only.  Items are
partitioned by their number of shingles; from each item come the shingles of
smallest hash, as many as its partition needs: a document that holds at least
num / den of the item's n shingles lacks at most n - ceil(num n / den) of them,
so one of the n - ceil(num n / den) + 1 smallest must be in it.  Documents are
probed with all their shingles against the sketches alone, partition by
partition; only the pairs that meet there are verified, on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geoloom.llm.bytewords import WHITE, U, chunks, mix, shingles, words
from geoloom.llm.common import pick, save, small_batches

#: Up to so many shingles of items the table goes to the executors whole (25 bytes each); beyond, it is joined.
BROADCAST = 2_000_000
#: Bits of the table that turns most shingles away before a join (16 MB, whatever the number of items).
FILTER_BITS = 27


def sketch_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of smallest hash that an item of n shingles needs.

    Partitions are the powers of two; all items of one use the size of its
    largest member, so that one bound holds for the whole partition.
    """
    top = 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.minimum(n, top - -(-num * top // den) + 1)


def _item_shingles(k: int, num: int, den: int):
    """(item, its number of shingles, shingle, whether it is in the sketch) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                value, doc, firsts = shingles(*words((data, offsets), WHITE), k)
                n = np.diff(firsts)
                order = np.lexsort((mix(value), doc))  # each item's shingles by their min-hash order
                value = value[order]
                rank = np.arange(len(value)) - np.repeat(firsts[:-1], n)
                ids = batch.column(0).slice(first, end - first).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(n, n), pa.int64()), pa.array(value.view(np.int64)), pa.array(rank < np.repeat(sketch_size(n, num, den), n))], ["item", "size", "h", "probe"])

    return run


def _ranges(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range, one after the other."""
    return np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class Index:
    """Items' sketches by size partition, sorted by hash, and apart from them their full sets."""

    def __init__(self, item: np.ndarray, size: np.ndarray, h: np.ndarray, probe: np.ndarray):
        self.ids, place = np.unique(item, return_inverse=True)
        order = np.lexsort((h, place))
        place, self.h, probe = place[order], h[order], probe[order]
        self.first = np.searchsorted(place, np.arange(len(self.ids) + 1))
        self.size = np.diff(self.first)
        # a bitmap over the hashes' top bits turns nearly all of a document's shingles away
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.h[probe] >> U(42)] = True
        level = np.ceil(np.log2(np.maximum(self.size, 1))).astype(np.int64)[place]
        self.parts = []
        for x in np.unique(level):
            own = np.flatnonzero(probe & (level == x))
            own = own[np.argsort(self.h[own], kind="stable")]
            keys, first = np.unique(self.h[own], return_index=True)
            self.parts.append((keys, np.append(first, len(own)), place[own]))

    def candidates(self, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item's place) of all pairs that share a shingle of the item's sketch."""
        near = np.flatnonzero(self.bits[value >> U(42)])
        value, doc = value[near], doc[near]
        met = [np.zeros(0, dtype=np.int64)]
        for keys, first, place in self.parts:
            at = np.searchsorted(keys, value)
            at[at == len(keys)] = 0
            hit = keys[at] == value
            at = at[hit]
            many = first[at + 1] - first[at]
            met.append(np.repeat(doc[hit], many) * (len(self.ids) + 1) + place[_ranges(first[at], many)])
        pair = np.unique(np.concatenate(met))
        return pair // (len(self.ids) + 1), pair % (len(self.ids) + 1)

    def search(self, value: np.ndarray, doc: np.ndarray, firsts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item's place, shared shingles) of all pairs whose containment reaches num / den; values ascend within a document."""
        doc, place = self.candidates(value, doc)
        shared = np.zeros(len(doc), dtype=np.int64)
        for k, (d, p) in enumerate(zip(doc, place, strict=True)):
            own, item = value[firsts[d] : firsts[d + 1]], self.h[self.first[p] : self.first[p + 1]]
            at = np.searchsorted(own, item)
            at[at == len(own)] = 0
            shared[k] = (own[at] == item).sum()
        good = den * shared >= num * self.size[place]
        return doc[good], place[good], shared[good]


def _marks(value: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A number for the shingle set of each document."""
    out = np.zeros(len(firsts) - 1, dtype=U)
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(value + U(3)), firsts[some]))
    return out.view(np.int64)


def _items(items: DataFrame, item_col: str, item_text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    own = pick(items, item_col, item_text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    return save(own.mapInArrow(_item_shingles(shingle, num, den), "item long, size long, h long, probe boolean"))


def _held(table: DataFrame):
    """The items' index in every task's reach, if it is small enough; its arrays are 25 bytes a shingle."""
    if table.limit(BROADCAST + 1).count() > BROADCAST:
        return None
    local = table.toArrow()
    arrays = [local.column(c).to_numpy() for c in ("item", "size", "h", "probe")]
    return table.sparkSession.sparkContext.broadcast([arrays[0], arrays[1], arrays[2].view(U), arrays[3].astype(bool)])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds at least num / den of an item's distinct word shingles.

    Words are runs of non-blank characters with A-Z lower-cased; a text with
    fewer words than ``shingle`` has its whole sequence as its one shingle.
    Null or blank texts, and null ids, take no part.  Rows that repeat a doc_id
    are searched one by one, and an item is given once for the id, with the
    largest n_shared.  Of the rows that repeat an item's id, the one of smallest
    text counts.  Other columns, whatever their names, play no part; empty
    tables give no row.
    """
    table = _items(items, item_col, item_text_col, shingle, num, den)
    rows = pick(docs, id_col, text_col).where("doc_id is not null")
    held = _held(table)
    if held is None:
        pairs = _joined(rows, table, shingle, num, den)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*held.value)
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for first, end, data, offsets in chunks(batch.column(1)):
                    value, doc, firsts = shingles(*words((data, offsets), WHITE), shingle)
                    doc, place, shared = index.search(value, doc, firsts, num, den)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first:end][doc]), pa.array(index.ids[place]), pa.array(shared), pa.array(index.size[place])], ["doc_id", "item_id", "n_shared", "n_item"])

        pairs = rows.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, with all their columns, whose own text holds no item; decided row by row, without a shuffle while the items are few.

    Rows with a null id, and null or blank texts, are kept; of rows that repeat
    an id each is judged by itself.
    """
    table = _items(items, item_col, item_text_col, shingle, num, den)
    held = _held(table)
    if held is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*held.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, _, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                    value, doc, firsts = shingles(*words((data, offsets), WHITE), shingle)
                    keep[first + index.search(value, doc, firsts, num, den)[0]] = False
                keep |= batch.column(batch.schema.get_field_index(id_col)).is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(keep))

        small_batches(docs.sparkSession)
        return docs.mapInArrow(run, docs.schema)
    rows = pick(docs, id_col, text_col).where("doc_id is not null")
    bad = save(_joined(rows, table, shingle, num, den).select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct())
    if bad.limit(BROADCAST + 1).count() <= BROADCAST:
        bad = F.broadcast(bad)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(batch.schema.get_field_index(text_col))):
                value, _, firsts = shingles(*words((data, offsets), WHITE), shingle)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_marks(value, firsts))], names=[*part.schema.names, "_mark"])

    small_batches(docs.sparkSession)
    own = docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField("_mark", LongType())]))
    return own.join(bad, (own[id_col].cast("long") == F.col("_bad_id")) & (own["_mark"] == F.col("_bad_mark")), "left_anti").drop("_mark")


def _joined(rows: DataFrame, table: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The same pairs, with the mark of the row's set, for any number of items.

    Of the documents' shingles only those that a fixed-size filter over the
    sketches lets through are joined with the sketches; what meets there is
    verified by joins of the candidates with the items' and their own sets.
    """

    def filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(U) >> U(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (1 << (at & U(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in table.where("probe").select("h").coalesce(8).mapInArrow(filter_bits, "bits binary").toLocalIterator():  # eight rows at most, of one size
        bits |= np.frombuffer(r.bits, dtype=np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def emit(only_near: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for first, end, data, offsets in chunks(batch.column(1)):
                    value, doc, firsts = shingles(*words((data, offsets), WHITE), shingle)
                    mark = _marks(value, firsts)
                    if only_near:
                        at = value >> U(64 - FILTER_BITS)
                        near = (held.value[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1
                        value, doc = value[near], doc[near]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first:end][doc]), pa.array(mark[doc]), pa.array(value.view(np.int64))], ["doc_id", "mark", "h"])

        return run

    kind = "doc_id long, mark long, h long"
    met = rows.mapInArrow(emit(True), kind).join(table.where("probe").select("item", "h"), "h")
    candidates = save(met.select("doc_id", "mark", "item").distinct())
    # what the candidates' items hold, against what their documents hold
    asked = candidates.join(table.select("item", "size", "h"), "item")
    known = rows.join(candidates.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    sets = known.mapInArrow(emit(False), kind).distinct()
    shared = asked.join(sets, ["doc_id", "mark", "h"]).groupBy("doc_id", "mark", "item").agg(F.count("*").alias("n_shared"), F.max("size").alias("n_item"))
    return shared.where(F.col("n_shared") * den >= F.col("n_item") * num).select("doc_id", "mark", F.col("item").alias("item_id"), "n_shared", "n_item")
