"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then sent down every tree to its leaf. A query walks the whole
forest through one priority queue, nearest split first, until the leaves it has reached hold enough vectors; those are
ranked by exact distance.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import columns, store
from .vectors import best_rows, matrix, ranked, usable

#: Vectors of a leaf that are compared at once; larger leaves are dealt over several tasks.
BLOCK = 1024


class Forest:
    """Complete binary trees: node k has children 2k + 1 and 2k + 2, a direction and a threshold."""

    def __init__(self, sample, trees, leaf, seed):
        self.depth = max(0, int(np.log2(max(1, len(sample)) / leaf)))
        self.leaves, self.trees = 1 << self.depth, trees
        random = np.random.default_rng(seed)
        inner, width = self.leaves - 1, sample.shape[1]
        self.ways = random.normal(size=(trees, inner, width))
        self.at = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(self.depth):
                place = np.einsum("ij,ij->i", sample, self.ways[t][node])
                order = np.lexsort((place, node))
                edges = np.searchsorted(node[order], np.arange((1 << level) - 1, (2 << level)))
                for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True), (1 << level) - 1):
                    self.at[t, k] = np.median(place[order[i:j]]) if j > i else 0.0
                node = 2 * node + 1 + (place > self.at[t][node])

    def leaf_of(self, vectors, t):
        """The leaf of each vector in tree `t`, numbered over all trees."""
        node = np.zeros(len(vectors), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", vectors, self.ways[t][node]) > self.at[t][node])
        return t * self.leaves + node - (self.leaves - 1)

    def search(self, query, sizes, enough):
        """Leaves in the order of the shared queue, until they hold `enough` vectors. sizes: vectors by leaf."""
        margins = self.ways @ query - self.at if self.depth else None
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found, held, inner = [], 0, self.leaves - 1
        while queue and held < enough:
            far, t, node = heapq.heappop(queue)
            own = margins[t] if self.depth else None
            while node < inner:
                margin = own[node]
                right = margin > 0
                heapq.heappush(queue, (max(far, abs(margin)), t, 2 * node + (1 if right else 2)))
                node = 2 * node + (2 if right else 1)
            leaf = t * self.leaves + node - inner
            if sizes[leaf]:
                found.append(leaf)
                held += int(sizes[leaf])
        return found


def nearest(vectors: DataFrame, is_query, k=10, trees=8, sample=16_384, leaf=32, share=1.0, least=20_000, seed=7, block=BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found by Euclidean distance of each row for which `is_query` holds.

    sample: about so many vectors, chosen by a hash, fit the trees; leaf: of those in a leaf. A query reaches leaves with
    `share` times as many entries as there are vectors, `least` at least; a vector has an entry in every tree, so that is
    about half of the vectors for share = 1. Vectors without nearer structure need so many for 0.9 recall; with clusters a
    smaller share does. Rows that take part: see `usable`. No row at all gives no result rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, allow_zero=False)
    total = rows.count()
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, total)) * (1 << 30))
    fit_on = matrix(rows.where(chosen).select("vector").orderBy("vector").toArrow().column("vector").combine_chunks())
    forest = spark.sparkContext.broadcast(Forest(fit_on if fit_on.size else np.zeros((1, 1)), trees, leaf, seed))

    entry = pa.schema([("leaf", pa.int64()), ("salt", pa.int32()), ("query", pa.bool_()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
    spec = "leaf long, salt int, query boolean, id long, vector array<double>"

    def leaves_only(parts):
        for part in parts:
            x = matrix(part.column("vector"))
            for t in range(forest.value.trees):
                kinds, n = np.unique(forest.value.leaf_of(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], names=["leaf", "n"])

    counted = columns(rows.select("vector").mapInArrow(leaves_only, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")))
    sizes = np.zeros(trees * forest.value.leaves, dtype=np.int64)
    sizes[counted["leaf"]] = counted["n"]
    salts = np.maximum(1, -(-sizes // block))
    shared = spark.sparkContext.broadcast((sizes, salts))
    enough = max(least, int(share * total))

    def members(parts):
        _, salts = shared.value
        for part in parts:
            x, ids = matrix(part.column("vector")), part.column("vec_id")
            for t in range(forest.value.trees):
                leaf_of = forest.value.leaf_of(x, t)
                salt = (ids.to_numpy() // 64 + ids.to_numpy() * 31) % salts[leaf_of]
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of), pa.array(salt.astype(np.int32)), pa.array(np.zeros(len(x), bool)), ids, part.column("vector")], schema=entry)

    def visits(parts):
        sizes, salts = shared.value
        for part in parts:
            x, ids = matrix(part.column("vector")), part.column("vec_id").to_numpy()
            for i in range(len(x)):
                found = np.array(forest.value.search(x[i], sizes, enough), dtype=np.int64)
                leaf_of = np.repeat(found, salts[found])
                salt = np.concatenate([np.arange(s) for s in salts[found]]) if len(found) else found
                n = len(leaf_of)
                own = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], np.tile(x[i], n))
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of), pa.array(salt.astype(np.int32)), pa.array(np.ones(n, bool)), pa.array(np.full(n, ids[i])), own], schema=entry)

    def compare(parts):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        waiting, size = [], 0
        place, ids, x = None, [], []

        def merged():
            return best_rows(*(np.concatenate(c) for c in zip(kept, *waiting, strict=True)), k)

        for part in parts:
            leaf, salt, query = (part.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "salt", "query"))
            own, vectors = part.column("id").to_numpy(), matrix(part.column("vector"))
            new = (leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1]) | (query[1:] != query[:-1])
            edges = np.flatnonzero(np.r_[True, new, True]) if len(leaf) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if place != (leaf[i], salt[i]):
                    place, ids, x = (leaf[i], salt[i]), [], []
                if not query[i]:
                    ids.append(own[i:j])
                    x.append(vectors[i:j])
                elif ids:
                    ids, x = [np.concatenate(ids)], [np.concatenate(x)]
                    far = np.zeros((j - i, len(ids[0])))
                    for c in range(x[0].shape[1]):  # added up in the order of the components
                        gap = vectors[i:j, c, None] - x[0][None, :, c]
                        far += gap * gap
                    far[own[i:j, None] == ids[0][None, :]] = np.inf
                    most = min(k, far.shape[1]) - 1
                    near = far <= np.partition(far, most, axis=1)[:, most, None]
                    near &= np.isfinite(far)
                    a, b = np.nonzero(near)
                    waiting.append((own[i:j][a], ids[0][b], np.sqrt(far[a, b])))
                    size += len(a)
                    if size > 200_000:
                        kept, waiting = list(merged()), []
                        size = len(kept[0])
                        if size > 150_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["query_id", "vec_id", "score"])
                            kept, size = [c[:0] for c in kept], 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["query_id", "vec_id", "score"])

    asked = rows.where(is_query)
    entries = rows.mapInArrow(members, spec).unionByName(asked.repartition(F.col("vec_id")).mapInArrow(visits, spec))
    found = entries.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "query").mapInArrow(compare, "query_id long, vec_id long, score double")
    return ranked(store(found, "near"), k, ascending=True)
