"""Exact top lists by inner product from an impact-ordered index, searched score at a time.

The index is cut into blocks of vectors. In a block, the postings of each component are sorted by value and cut into
segments. A query takes the segments of all components by falling impact (the most that a segment can add to a score, above
the least its component adds anyway), adds up scores, and stops once all but a few vectors are proved to stay below its
k-th best; those few are scored again exactly.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store
from .vectors import best_rows, matrix, ranked, usable

BLOCK = 16_384
QUERIES = 256
SEGMENTS = 16
ROUNDS = 12


class ImpactIndex:
    """The postings of one block: per component its vectors by falling value, in segments of like value."""

    def __init__(self, ids, vectors, segments=SEGMENTS):
        self.ids, self.vectors = ids, vectors
        width = vectors.shape[1]
        self.order = np.ascontiguousarray(np.argsort(-vectors, axis=0, kind="stable").T)  # by component
        self.values = np.take_along_axis(vectors.T, self.order, axis=1).astype(np.float64)  # whole numbers, exactly
        cuts = []
        for v in self.values:
            level = (v[0] - v) * segments // (v[0] - v[-1] + 1)  # quantised value, 0 the largest
            cuts.append(np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]))
        self.component = np.repeat(np.arange(width), [len(x) - 1 for x in cuts])
        begin, end = np.concatenate([x[:-1] for x in cuts]), np.concatenate([x[1:] for x in cuts])
        self.size, self.high, self.low = end - begin, self.values[self.component, begin], self.values[self.component, end - 1]

    def search(self, query, own, k):
        """(ids, scores) of the block's `k` best other than `own`; more on ties."""
        n, width = self.vectors.shape
        floor = np.minimum(self.values[:, 0] * query, self.values[:, -1] * query)  # what a component adds at least
        up = query > 0
        impact = np.where(up[self.component], self.high, self.low) * query[self.component] - floor[self.component]
        order = np.argsort(-impact, kind="stable")
        order = order[: np.count_nonzero(impact > 0)]
        sums, seen, used = np.zeros(n), np.zeros(n), np.zeros(width, dtype=np.int64)
        sums[self.ids == own] = -np.inf
        few, members = max(4 * k, n // 64), np.arange(n)
        # The segments are taken in rounds of about equally many postings; the proof is tried after the later rounds.
        upto = np.cumsum(self.size[order])
        rounds = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], ROUNDS + 1)[1:]) + 1) if len(order) else []
        start = 0
        for stop in rounds:
            more = np.bincount(self.component[order[start:stop]], self.size[order[start:stop]], width).astype(np.int64)
            who, add = [], []
            for c in np.flatnonzero(more):
                part = slice(used[c], used[c] + more[c]) if up[c] else slice(n - used[c] - more[c], n - used[c])
                who.append(self.order[c, part])
                add.append(self.values[c, part] * query[c] - floor[c])
            who = np.concatenate(who)
            sums += np.bincount(who, np.concatenate(add), n)
            seen += np.bincount(who, minlength=n)
            used, start = used + more, stop
            # Every vector has its sum at least, and what is still to come adds no more than `left` per component.
            left = impact[order[stop]] if stop < len(order) else 0.0
            if left * width < sums.max() or not left:
                bar = np.partition(sums, n - k)[n - k] if n > k else -np.inf
                members = np.flatnonzero(sums + (width - seen) * left >= bar)
                if len(members) <= few:
                    break
        members = members[self.ids[members] != own]
        return self.ids[members], self.vectors[members] @ query


def highest(vectors: DataFrame, is_query, k=5, scale=256, block=BLOCK, queries=QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the `k` highest integer inner products of floor(scale * vector) for each row
    for which `is_query` holds, against all other rows; ties to the smaller vec_id. Rows that take part: see `usable`, zero
    vectors included. Every block of `block` vectors meets every block of `queries` queries once.
    """
    rows = usable(vectors, allow_zero=True).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))
    blocks = max(1, -(-rows.count() // block))
    packs = max(1, -(-rows.where(is_query).count() // queries))
    spec = "block int, query boolean, ids binary, vectors binary"

    def packed(is_asked):
        def task(parts):
            ids, x, held = [], [], None
            names = ["block", "query", "ids", "vectors"]

            def out():
                return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([is_asked]), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(x).astype(np.int64).tobytes()], pa.binary())], names=names)

            for part in parts:
                place, own, vectors = part.column("block").to_numpy(), part.column("vec_id").to_numpy(), matrix(part.column("vector"))
                edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if held is not None and place[i] != held:
                        yield out()
                        ids, x = [], []
                    held = place[i]
                    ids.append(own[i:j])
                    x.append(vectors[i:j])
            if held is not None:
                yield out()

        return task

    def dealt(table, n):
        placed = table.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        return placed.repartition("block").sortWithinPartitions("block", "vec_id")

    index = store(dealt(rows, blocks).mapInArrow(packed(False), spec), "index")
    asked = store(dealt(rows.where(is_query), packs).mapInArrow(packed(True), spec), "asked")
    each = asked.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", "query", "ids", "vectors")

    def meet(parts):
        held, have = None, None
        for part in parts:
            for row in part.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)
                if not row["query"]:
                    held, have = row["block"], ImpactIndex(ids, vectors)
                elif held == row["block"]:
                    found = [have.search(q, own, k) for own, q in zip(ids, vectors, strict=True)]
                    query = np.repeat(ids, [len(f[0]) for f in found])
                    item, score = (np.concatenate(c) for c in zip(*found, strict=True))
                    query, item, score = best_rows(query, item, -score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(item), pa.array(-score)], names=["query_id", "vec_id", "score"])

    met = index.unionByName(each).repartition("block").sortWithinPartitions("block", "query").mapInArrow(meet, "query_id long, vec_id long, score long")
    return ranked(store(met, "highest"), k, ascending=False)
