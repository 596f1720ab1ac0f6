"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each with its own table.  A search probes the
tables in turn with growing radius; after radius r in the first j + 1 of m
segments (and r - 1 in the others) every code within m r + j bits has been met,
so the search ends when the kth verified distance is not beyond that.  Segments
are about log2(codes) bits wide, so that a bucket holds about one code and even
a search that has to go through all radii probes no more than m times the codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.common import save

#: Codes of a shard at most, shards aimed at while there are few codes, and codes from which one more shard pays.
SHARD, TASKS, LEAST = 500_000, 16, 4_000
#: Bits of a segment at most: a table has one slot for each of its values.
WIDEST = 20


@lru_cache(maxsize=512)
def masks(bits: int, radius: int) -> np.ndarray:
    """All patterns of so many bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], dtype=np.int64)


def _ranges(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each range, one after the other."""
    return np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class MultiIndex:
    """Tables over the distinct codes of a shard; ``ids`` of equal codes are kept together, ascending.

    ``by_bound`` counts the searches that the radius bound ended, ``by_end``
    those that had met every code before (as when there are fewer than k), and
    ``probes`` and ``verified`` the slots looked at and the codes compared.
    """

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        """codes: (rows, bytes) of uint8, whole 64-bit words; ids: of each row."""
        packed = np.ascontiguousarray(codes).view([("", codes.dtype)] * codes.shape[1]).ravel()
        order = np.lexsort((ids, np.unique(packed, return_inverse=True)[1]))
        codes, self.ids = codes[order], ids[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]).any(1)
        first = np.flatnonzero(new)
        self.first = np.append(first, len(codes))
        own = np.ascontiguousarray(codes[first])
        self.words = own.view(np.uint64)
        self.n = len(first)
        width = 8 * codes.shape[1]
        self.m = max(1, math.ceil(width / min(WIDEST, max(1, round(math.log2(max(2, self.n)))))))
        self.cuts = [width * j // self.m for j in range(self.m + 1)]
        self.order, self.starts = [], []
        for j, column in enumerate(self.segments(own)):
            self.order.append(np.argsort(column, kind="stable"))
            self.starts.append(np.searchsorted(column[self.order[j]], np.arange((1 << (self.cuts[j + 1] - self.cuts[j])) + 1)))
        self.by_bound = self.by_end = self.probes = self.verified = 0

    def segments(self, codes: np.ndarray) -> list[np.ndarray]:
        """The value of each segment of each code."""
        bits = np.unpackbits(codes, axis=1, bitorder="little")
        return [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def search(self, code: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows by distance, then id; rows with the id ``skip`` don't count."""
        words, own = code.view(np.uint64), [int(s[0]) for s in self.segments(code[None, :])]
        met = np.zeros(self.n, dtype=bool)
        ids = np.zeros(0, dtype=np.int64)
        distances = np.zeros(0, dtype=np.int64)
        left = self.n
        for radius in range(max(np.diff(self.cuts)) + 1):
            for j in range(self.m):
                slot = own[j] ^ masks(self.cuts[j + 1] - self.cuts[j], radius)
                self.probes += len(slot)
                lo = self.starts[j][slot]
                at = self.order[j][_ranges(lo, self.starts[j][slot + 1] - lo)]
                at = at[~met[at]]
                if len(at):
                    met[at] = True
                    left -= len(at)
                    self.verified += len(at)
                    d = np.bitwise_count(self.words[at] ^ words).sum(1).astype(np.int64)
                    if len(ids) == k:
                        near = d <= distances[-1]
                        at, d = at[near], d[near]
                    many = self.first[at + 1] - self.first[at]
                    found, d = self.ids[_ranges(self.first[at], many)], np.repeat(d, many)
                    if skip is not None:
                        found, d = found[found != skip], d[found != skip]
                    ids, distances = np.append(ids, found), np.append(distances, d)
                    best = np.lexsort((ids, distances))[:k]
                    ids, distances = ids[best], distances[best]
                if len(ids) == k and distances[-1] <= self.m * radius + j:
                    self.by_bound += 1
                    return ids, distances
                if not left:
                    self.by_end += 1
                    return ids, distances
        return ids, distances


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): a bit for each component, 1 if it is positive, padded to whole 64-bit words; null ids and vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().fill_null(0.0).to_numpy()
            bits = np.zeros((batch.num_rows, -(-max(1, int(size.max())) // 64) * 64), dtype=np.uint8)
            row = np.repeat(np.arange(batch.num_rows), size)
            bits[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat > 0
            codes = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(run, "id long, code binary")


def _wide(codes: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in codes), dtype=np.uint8).reshape(len(codes), width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest rows of each query by Hamming distance of sign codes, ties by id.

    A row is no neighbour of a query with its own id.  Vectors of unequal
    lengths are compared as if padded with non-positive components.  Rows
    without an id or a vector take no part; a query has as many neighbours as
    there are other rows, up to k; rows that repeat an id are neighbours of
    their own.  Of rows with one and the same code only the k + 1 smallest ids
    can be needed, so others are dropped before the search, exactly.
    """
    spark = vectors.sparkSession
    codes = save(binary_codes(vectors, id_col, vector_col))
    asked = binary_codes(queries, id_col, vector_col)
    n = codes.count()
    widths = codes.select(F.length("code").alias("w")).union(asked.select(F.length("code").alias("w"))).agg(F.max("w")).first()[0]
    shards = max(1, -(-n // SHARD), min(TASKS, n // LEAST))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    index = codes.withColumn("_r", rank).where(F.col("_r") <= k + 1).drop("_r")
    index = index.select(F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "id", "code")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind, ids, code = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            cuts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
                if place[a] != key:
                    key, held, index = place[a], [], None
                rows = _wide(code.slice(a, b - a).to_pylist(), widths)
                if kind[a] == 0:
                    held.append((rows, ids[a:b]))
                    continue
                if index is None and held:
                    index = MultiIndex(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held = []
                if index is None:
                    continue
                found = [index.search(row, k, int(i)) for row, i in zip(rows, ids[a:b], strict=True)]
                many = [len(f[0]) for f in found]
                if sum(many):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], many)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32))], ["query_id", "neighbor_id", "distance"])

    both = index.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(run, "query_id long, neighbor_id long, distance int")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
