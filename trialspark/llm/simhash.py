"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table row: its Hamming distances to many reference fingerprints (pivots), taken over
blocks of bits. By the triangle inequality two fingerprints within `most` bits differ by at most `most` in every
distance, and since the differing bits cannot touch all of `most` + 1 blocks, all their distances over one block are
equal. So rows meet where all distances over a block pair agree, are discarded by the largest difference of their
distances, and what survives is verified bit by bit.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .storage import store
from .text import LOWER, Words, batches, buffer, canonical, mix, slices

SEED = 42
BITS = 64
#: Reference fingerprints, fixed by rule so that every task has the same.
PIVOTS = mix(np.arange(1, 25, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
#: A bucket with more fingerprints than this is dealt anew over smaller blocks.
BUCKET = 2048


def fingerprint(words: Words, shingle: int) -> np.ndarray:
    """The SimHash of each text: bit = 1 if set in over half of the XXH64 values of its shingles, repeats included."""
    data, offsets = canonical(words)
    counts = np.diff(words.first)
    starts = np.flatnonzero(np.r_[True, data[:-1] == 32]) if len(data) else np.zeros(0, np.int64)
    begin = np.unique(np.r_[starts, offsets[:-1][counts > 0]])  # texts follow each other without a space
    stop = np.r_[begin[1:], len(data)]
    gap = np.ones(len(begin), dtype=np.int64)
    first, last = words.first[:-1], words.first[1:] - 1
    gap[last[counts > 0]] = 0
    stop = stop - gap
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    at = np.repeat(first, n) + _ramp(n)
    end = np.minimum(at + shingle - 1, np.repeat(last, n))
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[end].tolist(), strict=True)], dtype=np.uint64)
    out = np.zeros(len(counts), dtype=np.uint64)
    has = np.flatnonzero(n)
    if len(has):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.r_[0, np.cumsum(n[has])[:-1]], axis=0, dtype=np.int64)
        out[has] = np.packbits(2 * sums > n[has][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _ramp(sizes):
    """0 .. size - 1 for each size, one after another."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)


def fingerprints(docs: DataFrame, shingle=3, keep=()) -> DataFrame:
    """(doc_id, fp long) and the columns `keep`, one row per row of `docs`. A text without words (null, empty, blank) has
    fingerprint 0."""
    out = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *[docs.schema[c] for c in keep]])

    def task(parts):
        for part in parts:
            data, offsets = buffer(part.column("text"))
            found = [np.zeros(0, np.uint64)]
            for i, j in slices(offsets):
                found.append(fingerprint(Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]), shingle))
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(found).view(np.int64)), *[part.column(c) for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(task, out)


def _split(bits, parts):
    """Masks of `parts` blocks of a list of bit positions."""
    return [sum(1 << int(b) for b in block) for block in np.array_split(np.array(bits), parts) if len(block)]


def _finer(mask, parts):
    """The mask with each of `parts` blocks of the bits outside it: fingerprints that agree on the mask and differ in
    fewer bits than there are blocks agree on one of these too."""
    return [mask | m for m in _split([b for b in range(BITS) if not mask >> b & 1], parts)]


def _keys(fps, mask):
    """One number for all distances to the pivots over the bits of a mask."""
    key = np.full(len(fps), mask, dtype=np.uint64)
    for pivot in PIVOTS:
        key = mix(key + np.bitwise_count((fps ^ pivot) & np.uint64(mask)))
    return key


def _bucket_links(fps, nodes, most):
    """Links between fingerprints of one bucket that keep its components: each to the smallest node it reaches."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    left, right = [], []
    n = len(fps)
    for i in range(0, n, 256):
        block = slice(i, min(i + 256, n))
        near = np.abs(table[block, None, 0] - table[None, i:, 0]) <= most
        for k in range(1, 4):
            near &= np.abs(table[block, None, k] - table[None, i:, k]) <= most
        a, b = np.nonzero(near)
        a, b = a + i, b + i
        a, b = a[a < b], b[a < b]
        fits = np.abs(table[a] - table[b]).max(1, initial=0) <= most  # the largest difference of a distance
        a, b = a[fits], b[fits]
        same = np.bitwise_count(fps[a] ^ fps[b]) <= most
        left.append(a[same])
        right.append(b[same])
    left, right = np.concatenate(left), np.concatenate(right)
    low = nodes.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, left, before[right])
        np.minimum.at(low, right, before[left])
        if (low == before).all():
            break
    away = low != nodes
    return nodes[away], low[away]


LINK, AGAIN = 0, 1


def links(points: DataFrame, most=3, bucket=BUCKET) -> DataFrame:
    """(a, b) pairs of nodes whose components are those of all pairs of fingerprints within `most` bits.

    points: (fp, node), one row per distinct fingerprint. A bucket above `bucket` rows is never gathered: its rows are
    dealt again over finer blocks, which loses no pair, until few bits are left outside the blocks.
    """
    blocks = most + 1
    masks = [m for coarse in _finer(0, blocks) for m in _finer(coarse, blocks)]
    out_schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])
    key_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("mask", pa.int64())])

    def deal(parts):
        for part in parts:
            fps, nodes = (part.column(c).to_numpy().astype(np.int64) for c in ("fp", "node"))
            from_mask = part.column("mask").to_numpy().view(np.uint64)
            for coarse in np.unique(from_mask):
                own = from_mask == coarse
                for mask in masks if coarse == 0 else _finer(int(coarse), blocks):
                    key = _keys(fps[own].view(np.uint64), mask).view(np.int64)
                    yield from batches(key_schema, [key, fps[own], nodes[own], np.full(own.sum(), mask, np.uint64).view(np.int64)])

    def meet(parts):
        def finish(held):
            key, fps, nodes, mask = (np.concatenate(x) for x in zip(*held, strict=True))
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a, b = [], []
            for i, j in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):
                x, y = _bucket_links(fps[i:j].view(np.uint64), nodes[i:j], most)
                a.append(x)
                b.append(y)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            yield from batches(out_schema, [np.full(len(a), LINK), a, b, np.zeros(len(a), np.int64)])

        held, size, hot = [], 0, None
        for part in parts:
            columns = [part.column(c).to_numpy().astype(np.int64) for c in ("key", "fp", "node", "mask")]
            key = columns[0]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                piece = [c[i:j] for c in columns]
                if key[i] == hot:
                    yield from batches(out_schema, [np.full(j - i, AGAIN), *piece[1:]])
                    continue
                if not held or held[-1][0][0] != key[i]:
                    if size >= 4096:
                        yield from finish(held)
                        held, size = [], 0
                    run = 0
                held.append(piece)
                size, run = size + j - i, run + j - i
                if run > bucket and _open_bits(int(piece[3][0])) > 16:
                    hot = key[i]
                    while held and held[-1][0][0] == hot:
                        again = held.pop()
                        size -= len(again[0])
                        yield from batches(out_schema, [np.full(len(again[0]), AGAIN), *again[1:]])
        if held:
            yield from finish(held)

    found = None
    rows = points.select("fp", "node", F.lit(0).cast("long").alias("mask"))
    while True:
        dealt = rows.mapInArrow(deal, "key long, fp long, node long, mask long")
        met = store(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "kind int, a long, b long, mask long"), "pairs")
        linked = met.where(F.col("kind") == LINK).select("a", "b")
        found = linked if found is None else found.unionByName(linked)
        again = met.where(F.col("kind") == AGAIN)
        if again.isEmpty():
            return found
        rows = again.select(F.col("a").alias("fp"), F.col("b").alias("node"), "mask")


def _open_bits(mask):
    return BITS - (mask & (1 << BITS) - 1).bit_count()


def near_duplicates(docs: DataFrame, shingle=3, most=3, bucket=BUCKET, keep=()) -> DataFrame:
    """(doc_id, fingerprint, component_id) and the columns `keep`, one row per row of `docs`. `keep` cannot hold the names
    doc_id, text and fp or those of the result.

    component_id is the smallest doc_id reachable over links of at most `most` differing bits. Repeated rows fall into one
    component. A row with a null doc_id links nothing; it gets the component of its fingerprint, if that has a doc_id.
    """
    printed = store(fingerprints(docs, shingle, keep), "fingerprints")
    points = store(printed.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "points")
    component = connected_components(links(points, most, bucket))
    of_print = points.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return printed.join(of_print, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)
