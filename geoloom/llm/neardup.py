"""MinHash near-duplicates with tensored banding and exact verification.

Keys are formed by pairing bands of two small hash collections (t x t keys from
2 t bands), so the number of minhash computations is about the square root of
what as many independent bands would need; a few such tensors are used so that
a pair at the threshold is missed with probability below ``MISS``.  Documents
that meet in a bucket are compared by their short sketches first; what is close
is gathered into candidate clusters.  The close pairs themselves are verified on
the full shingle sets first, so that most of a cluster is linked by as many
comparisons as it has members; only what stays apart is compared with all
others of its cluster, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.bytewords import WHITE, U, chunks, mix, shingles, words
from geoloom.llm.common import components, few, pick, save

#: Hashes a band, bands a collection, and the accepted chance to miss a pair at the threshold.
ROWS, BANDS, MISS = 3, 4, 1e-5
#: Standard deviations that a sketch's estimate may lie below the threshold.
SIGMAS = 5
#: Documents of a bucket, and shingles (and 64 a row) of what is left of a cluster, that one task compares; more are dealt into blocks.
BUCKET, CLUSTER = 4096, 50_000
#: Edges that share a document from which on its text goes to several tasks.
HUB = 256


def tensors(threshold: float) -> int:
    """How many pairs of collections keep the chance of a miss at the threshold below ``MISS``."""
    side = 1 - (1 - threshold**ROWS) ** BANDS
    return max(1, math.ceil(math.log(MISS) / math.log(1 - side * side)))


def signatures(value: np.ndarray, firsts: np.ndarray, n_hashes: int) -> np.ndarray:
    """16 bits of each of ``n_hashes`` minima for each (non-empty) set, as a matrix."""
    seeds = mix(np.arange(2 * n_hashes, dtype=U) + U(12345))
    out = np.empty((len(firsts) - 1, n_hashes), dtype=np.uint16)
    for j in range(n_hashes):
        low = np.minimum.reduceat((value ^ seeds[2 * j]) * (seeds[2 * j + 1] | U(1)), firsts[:-1])
        out[:, j] = (mix(low) >> U(48)).astype(np.uint16)
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """All keys of each signature: every band of one collection with every band of the other, tensor by tensor."""
    n, h = sig.shape
    g = h // (2 * BANDS * ROWS)
    parts = sig.reshape(n, g, 2, BANDS, ROWS).astype(U)
    band = np.zeros((n, g, 2, BANDS), dtype=U)
    for r in range(ROWS):
        band = (band << U(16)) | parts[..., r]
    place = mix(np.arange(g * 2 * BANDS, dtype=U).reshape(1, g, 2, BANDS) + U(77))
    band = mix(band ^ place)
    return mix(band[:, :, 0, :, None] + (band[:, :, 1, None, :] << U(1))).reshape(n, -1).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column whose values are the matrix' rows."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _describe(k: int, n_hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                value, _, firsts = shingles(*words((data, offsets), WHITE), k)
                n = np.diff(firsts)
                some = np.flatnonzero(n)
                ids = batch.column(0).slice(first, end - first)
                f1 = np.zeros(len(n), dtype=U)
                f2 = np.zeros(len(n), dtype=U)
                sig = np.zeros((len(n), n_hashes), dtype=np.uint16)
                if len(some):
                    at = np.append(firsts[some], len(value))
                    f1[some] = np.add.reduceat(mix(value + U(1)), at[:-1])
                    f2[some] = np.bitwise_xor.reduceat(mix(value + U(2)), at[:-1])
                    sig[some] = signatures(value, at, n_hashes)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _binary(sig)], ["doc_id", "n", "f1", "f2", "sig"])

    return run


def _keys(n_hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = bucket_keys(_matrix(batch.column(1), np.uint16, n_hashes))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    return run


def _low(n_hashes: int):
    """The low byte of each of a signature's numbers: the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _matrix(batch.column(2), np.uint16, n_hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary((sig & 255).astype(np.uint8))], ["id", "n", "sk"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Batches of rows that are sorted by their first ``n_keys`` columns, recut so that no group spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for j in range(n_keys):
            c = batch.column(j).to_numpy(zero_copy_only=False)
            same &= c == c[-1]
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            if held and cut < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            if held and any(held[-1].column(j)[-1] != batch.column(j)[0] for j in range(n_keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, n_keys: int) -> np.ndarray:
    """First row of each group, and the number of rows."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for j in range(n_keys):
        c = table.column(j).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x[0] for x in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([x[1] for x in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _least(threshold: float, n_hashes: int) -> float:
    """Equal sketch bytes that a pair at the threshold has but for ``SIGMAS`` standard deviations."""
    return (threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / n_hashes)) * n_hashes


def _close(threshold: float, n_hashes: int):
    """Within each bucket: a spanning forest of the pairs whose sketches are close."""
    least = _least(threshold, n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            starts = _starts(table, 2)
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            sk = _matrix(table.column("sk").combine_chunks(), np.uint8, n_hashes)
            head = np.repeat(starts[:-1], np.diff(starts))
            near = np.empty(len(ids), dtype=bool)
            for i in range(0, len(ids), 65536):  # bounded intermediates
                part, top = slice(i, i + 65536), head[i : i + 65536]
                near[part] = ((sk[part] == sk[top]).sum(1) >= least) & (np.minimum(n[part], n[top]) >= threshold * np.maximum(n[part], n[top]))
            pairs = [(ids[near & (ids != ids[head])], ids[head][near & (ids != ids[head])])]
            far = ~near
            for g in np.unique(np.searchsorted(starts, np.flatnonzero(far), side="right") - 1):
                own = np.arange(starts[g], starts[g + 1])
                label = own.copy()
                label[near[own]] = own[0]
                for x in np.flatnonzero(far[own]):
                    y = np.flatnonzero(label != label[x])
                    hit = y[((sk[own[y]] == sk[own[x]]).sum(1) >= least) & (np.minimum(n[own[y]], n[own[x]]) >= threshold * np.maximum(n[own[y]], n[own[x]]))]
                    for other in np.unique(label[hit]):
                        pairs.append((ids[[own[x]]], ids[[other]]))
                        label[label == other] = label[x]
            yield _edges(pairs)

    return run


def link_sets(ids: np.ndarray, value: np.ndarray, firsts: np.ndarray, num: int, den: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs with den * intersection >= num * union, exactly.

    Prefix filtering on rarest-first shingles gives candidates, each checked on
    the full sets unless the two are already connected; rows of one ``label``
    are so from the start.
    """
    m = len(ids)
    tokens, inverse, df = np.unique(value, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(tokens))
    doc = np.repeat(np.arange(m), np.diff(firsts))
    token = rank[inverse]
    token = token[np.lexsort((token, doc))]
    size = np.diff(firsts)
    prefix = size - -(-num * size // den) + 1
    place = np.arange(len(token)) - np.repeat(firsts[:-1], size)
    in_prefix = place < np.repeat(prefix, size)
    by = np.lexsort((doc[in_prefix], token[in_prefix]))
    post_doc, post_token = doc[in_prefix][by], token[in_prefix][by]
    lo = np.searchsorted(post_token, np.arange(len(tokens)))
    hi = np.append(lo[1:], len(post_token))
    mark = np.zeros(len(tokens), dtype=bool)
    label = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for x in range(m):
        own = token[firsts[x] : firsts[x + 1]]
        lists = [post_doc[lo[t] : hi[t]] for t in own[: prefix[x]] if hi[t] - lo[t] > 1]
        if not lists:
            continue
        y = np.unique(np.concatenate(lists))
        y = y[(y < x) & (label[y] != label[x])]
        y = y[den * np.minimum(size[y], size[x]) >= num * np.maximum(size[y], size[x])]
        if not len(y):
            continue
        mark[own] = True
        for start in range(0, len(y), 512):  # bounded, and what gets connected on the way is skipped
            z = y[start : start + 512]
            z = z[label[z] != label[x]]
            if not len(z):
                continue
            flat = np.concatenate([token[firsts[i] : firsts[i + 1]] for i in z])
            both = np.add.reduceat(mark[flat].astype(np.int64), np.append(0, np.cumsum(size[z]))[:-1])
            for i in z[(den + num) * both >= num * (size[z] + size[x])]:
                if label[i] != label[x]:
                    out.append((x, i))
                    label[label == label[i]] = label[x]
        mark[own] = False
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            starts = _starts(table, 2)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                ids, label = table.column("id").slice(s, e - s).to_numpy(), table.column("label").slice(s, e - s).to_numpy()
                size, value = _sets(table.column("text").slice(s, e - s), k)
                yield _edges([link_sets(ids, value, np.append(0, np.cumsum(size)), num, den, label)])

    return run


def _sets(text: pa.ChunkedArray | pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, shingles) of the texts' sets, one after the other."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    values, sizes = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for _, _, data, offsets in chunks(text):
        value, _, firsts = shingles(*words((data, offsets), WHITE), k)
        values.append(value)
        sizes.append(np.diff(firsts))
    return np.concatenate(sizes), np.concatenate(values)


def _verify_pairs(k: int, num: int, den: int):
    """Those of the pairs (a, b, text of a, text of b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounded intermediates
                part = batch.slice(at, 256)
                (n, x), (m, y) = (_sets(part.column(j), k) for j in (2, 3))
                row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                value = np.concatenate([x, y])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(row[1:][same], minlength=len(n))
                good = (den + num) * both >= num * (n + m)
                yield pa.RecordBatch.from_arrays([part.column(j).filter(pa.array(good)) for j in (0, 1)], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, weight: str, limit: int) -> DataFrame:
    """Adds ``cell``: rows of groups heavier than ``limit`` are dealt into blocks, and each goes to all pairs of its block with another."""
    blocks = F.greatest(F.ceil(F.col(weight) / F.lit(limit)), F.lit(1)).cast("long")
    block = F.pmod(F.xxhash64("id"), F.col("_b"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1), lambda j: F.least(j, F.col("_i")) * F.col("_b") + F.greatest(j, F.col("_i")))
    return rows.withColumn("_b", blocks).withColumn("_i", block).withColumn("cell", F.explode(cells)).drop("_b", "_i", weight)


def _close_pairs(met: DataFrame, threshold: float, n_hashes: int) -> DataFrame:
    """A spanning forest of each bucket's close pairs, from rows (key, id, n, sk, size).

    In buckets of more than ``BUCKET`` rows each is first compared with the
    bucket's head, wherever it is; only rows far from it then meet the others,
    block by block.
    """
    kind = "a long, b long"
    small = met.where(F.col("size") <= BUCKET).select("key", F.lit(0).cast("long").alias("cell"), "id", "n", "sk")
    large = met.where(F.col("size") > BUCKET)
    heads = large.groupBy("key").agg(F.min(F.struct("id", "n", "sk")).alias("h")).select("key", F.col("h.id").alias("hid"), F.col("h.n").alias("hn"), F.col("h.sk").alias("hsk"))
    least = _least(threshold, n_hashes)

    def near_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, hn = batch.column(2).to_numpy(), batch.column(5).to_numpy()
                sk, hsk = _matrix(batch.column(3), np.uint8, n_hashes), _matrix(batch.column(6), np.uint8, n_hashes)
                near = ((sk == hsk).sum(1) >= least) & (np.minimum(n, hn) >= threshold * np.maximum(n, hn))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(near)], ["key", "id", "n", "sk", "hid", "near"])

    if large.limit(1).count() == 0:
        return small.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_close(threshold, n_hashes), kind)
    told = save(large.join(heads, "key").select("key", "id", "n", "sk", "hid", "hn", "hsk").mapInArrow(near_head, "key long, id long, n long, sk binary, hid long, near boolean"))
    star = told.where("near and id <> hid").select(F.col("id").alias("a"), F.col("hid").alias("b"))
    counted = told.groupBy("key").agg(F.count("*").alias("size"), F.sum((~F.col("near")).cast("long")).alias("far")).where("far > 0")
    # the far ones, in blocks, meet all blocks of the bucket
    left = told.join(counted, "key").withColumn("_b", F.ceil(F.col("size") / BUCKET).cast("long")).withColumn("_f", F.ceil(F.col("far") / BUCKET).cast("long"))
    own = F.pmod(F.xxhash64("id"), F.col("_b"))
    as_any = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_f") - 1), lambda j: j * F.col("_b") + own)
    as_far = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1), lambda j: F.pmod(F.xxhash64("id", F.lit(1)), F.col("_f")) * F.col("_b") + j)
    cells = F.when(F.col("near"), as_any).otherwise(F.array_distinct(F.concat(as_any, as_far)))
    dealt = left.select("key", F.explode(cells).alias("cell"), "id", "n", "sk")
    return star.union(small.union(dealt).repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_close(threshold, n_hashes), kind))


def _linked_first(rows: DataFrame, close: DataFrame, verify) -> DataFrame:
    """The close pairs that are links, on the full sets; the text of a document with many pairs goes to several tasks."""
    many = close.groupBy("b").agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select("b", F.ceil(F.col("_n") / HUB).cast("long").alias("_parts"))
    spread = close.join(few(many), "b", "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("a"), F.col("_parts"))).otherwise(F.lit(0)))
    hub = rows.join(spread.select(F.col("b").alias("_id"), "_part").distinct(), F.col("doc_id") == F.col("_id")).select(F.col("_id").alias("b"), "_part", F.col("text").alias("tb"))
    left = rows.join(spread.select("a", "b", "_part"), F.col("doc_id") == F.col("a")).select("a", "b", "_part", F.col("text").alias("ta"))
    return left.join(hub, ["b", "_part"]).select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _rest(members: DataFrame, weight: str = "w") -> DataFrame:
    """Cells of what is not linked yet, from rows (component, id, label, w): (component, cell, id, label).

    Within a cluster all but the heaviest label meet each other and, block by
    block, the heaviest one; if they alone exceed ``CLUSTER``, all pairs of
    blocks of the whole cluster are compared.
    """
    by = members.groupBy("component", "label").agg(F.sum(weight).alias("lw"))
    top = by.groupBy("component").agg(F.max(F.struct("lw", F.col("label"))).alias("_top"), F.sum("lw").alias("_all"), F.count("*").alias("_labels")).where("_labels > 1")
    of = members.join(top, "component").withColumn("_big", F.col("label") == F.col("_top.label"))
    of = of.withColumn("_small", F.col("_all") - F.col("_top.lw")).withColumn("_blocks", F.ceil(F.col("_top.lw") / CLUSTER).cast("long"))
    star = of.where(F.col("_small") <= CLUSTER)
    cells = F.when(F.col("_big"), F.array(F.pmod(F.xxhash64("id"), F.col("_blocks")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    star = star.select("component", F.explode(cells).alias("cell"), "id", "label")
    every = _in_blocks(of.where(F.col("_small") > CLUSTER).select("component", "id", "label", "_all"), "_all", CLUSTER).select("component", "cell", "id", "label")
    return star.union(every)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents linked by word-shingle Jaccard similarity of at least num / den.

    One row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    that links reach, its own included) and kept (doc_id = component_id).
    Words are runs of non-blank characters with A-Z lower-cased; a document with
    fewer words than ``shingle`` has its whole sequence as its one shingle.
    Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat a doc_id all get the result of the one of the smallest text
    that is not null.  A null doc_id is linked with nothing: its component_id is
    null and it is kept.  Other columns, whatever their names, play no part; an
    empty table gives none.
    """
    threshold = num / den
    n_hashes = tensors(threshold) * 2 * BANDS * ROWS
    rows = pick(docs, id_col, text_col)
    repeated = save(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_copies")).where("_copies > 1"))
    again = repeated.limit(1).count() > 0
    if again:
        several = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = rows.join(repeated, "doc_id", "left_anti").unionByName(several)
    base = save(rows.mapInArrow(_describe(shingle, n_hashes), "doc_id long, n long, f1 long, f2 long, sig binary"))
    # equal sets are one: the copies need no comparison
    real = base.where("n > 0 and doc_id is not null")
    reps = save(real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select(F.col("r.doc_id").alias("id"), "f1", "f2", "n", "r.sig"))
    keys = reps.select("id", "sig").mapInArrow(_keys(n_hashes), "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    small = reps.select("id", "n", "sig").mapInArrow(_low(n_hashes), "id long, n long, sk binary")
    met = keys.join(shared, "key").join(small, "id")
    close = save(_close_pairs(met.select("key", "id", "n", "sk", "size"), threshold, n_hashes).distinct())
    ids = close.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    texts = save(rows.join(few(ids), F.col("doc_id") == F.col("_id"), "left_semi"))
    links = save(_linked_first(texts, close, _verify_pairs(shingle, num, den)))
    first = save(components(links))
    members = components(close).join(reps.select("id", "n"), "id").join(first.select("id", F.col("component").alias("label")), "id", "left")
    members = members.select("component", "id", F.coalesce("label", "id").alias("label"), (F.col("n") + 64).alias("w"))
    left = save(_rest(save(members)))
    asked = texts.join(left, F.col("doc_id") == F.col("id")).select("component", "cell", "id", "label", "text")
    links = links.union(asked.repartition("component", "cell").sortWithinPartitions("component", "cell").mapInArrow(_verify(shingle, num, den), "a long, b long"))
    linked = components(links)
    found = reps.join(linked, "id", "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("component", "id").alias("component"))
    same = (base["f1"] == found["f1"]) & (base["f2"] == found["f2"]) & (base["n"] == found["m"])
    out = base.join(found, same, "left")
    if again:
        out = out.join(repeated, "doc_id", "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_copies", F.lit(1)).cast("int"))))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
