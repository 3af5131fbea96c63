"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. Of a block of candidates, those that meet a cluster are sorted once by what they can score
at most with any of its members: a candidate's length times the cosine of its angle to the cluster's centre, less the
widest angle of a member. Every member walks this list from the top and stops when the next bound, times its own length,
cannot reach what it already has: from there on nothing can enter its result. All scores are exact whole numbers.

One walk finds each anchor's positives among the rows of its label, a second one the negatives that lie in the range of each
positive's score.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import store
from .vectors import best_rows, matrix

BLOCK, PACK, GROUP = 16_384, 256, 4096
#: Beyond this, sums of products are no longer exact as doubles.
EXACT = float(1 << 53)


def labelled(vectors: DataFrame, label="label", scale=256) -> DataFrame:
    """(vec_id, label, q array<long>): rows that take part, one per vec_id; q = floor(scale * component).

    Left out: null vec_ids, null labels, null or empty vectors, vectors holding null or non-finite components, and vectors of
    another length than most have (the longer on a tie). Of rows with one vec_id the smallest (vector, label) counts.
    """
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & whole)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("_row")).select("vec_id", "_row.label", F.transform("_row.vector", lambda x: F.floor(x * scale)).alias("q"))
    rows = store(rows.withColumn("_n", F.size("q")), "labelled")
    common = rows.groupBy("_n").count().orderBy(F.desc("count"), F.desc("_n")).first()
    return rows.where(F.col("_n") == (common[0] if common else 0)).drop("_n")


def unit(x):
    """Rows of length one; a zero row stays."""
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def centres(sample, clusters, seed=7, rounds=5):
    """Directions of at most `clusters` clusters of the sample, by spherical k-means."""
    directions = unit(sample)
    at = directions[np.random.default_rng(seed).permutation(len(sample))[:clusters]]
    for _ in range(rounds):
        own = (directions @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, directions)
        at = np.where(np.any(sums != 0, axis=1)[:, None], unit(sums), at)
    return at


class SharedList:
    """A block's candidates by falling bound on their score with any member of a cluster of anchors."""

    def __init__(self, ids, labels, q, members):
        x = q.astype(np.float64)
        size = np.sqrt((x * x).sum(1))
        directions = unit(members.astype(np.float64))
        centre = unit(directions.sum(0)[None, :])[0]
        used = directions[np.any(directions != 0, axis=1)]
        widest = np.arccos(np.clip(used @ centre, -1, 1)).max(initial=0.0)
        angle = np.arccos(np.clip(unit(x) @ centre, -1, 1))
        # Room for rounding: angles close to zero carry errors of some 1e-8.
        bound = size * np.minimum(1.0, np.cos(np.maximum(angle - widest, 0.0)) + 1e-6)
        order = np.argsort(-bound, kind="stable")
        self.ids, self.labels, self.q, self.bound = ids[order], labels[order], q[order], bound[order]
        self.exact = float(np.abs(x).max(initial=0)) * float(np.abs(members).max(initial=0)) * x.shape[1] < EXACT

    def walk(self, anchors, q, wanted, most):
        """(row, goal, id, score): for each anchor row and each of its goals the `most` best candidates.

        wanted: (rows x goals) arrays `low` and `high` of the scores that count, and a function that tells from rows and
        places in the list which pairs count at all. Only members that may still find something go on.
        """
        low, high, counts = wanted
        rows, goals = low.shape
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        bar = np.where(low > high, np.inf, low.astype(np.float64))
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        start, step, walked = 0, 128, 0
        while start < len(self.ids):
            live = np.flatnonzero(self.bound[start] * length >= bar.min(1, initial=np.inf))
            if not len(live):
                break
            part = slice(start, start + step)
            if self.exact:
                score = q[live].astype(np.float64) @ self.q[part].astype(np.float64).T
            else:
                score = q[live] @ self.q[part].T
            walked += score.size
            near = score >= bar[live].min(1)[:, None]
            a, b = np.nonzero(near)
            row, place, value = live[a], b + start, score[a, b].astype(np.int64)
            fits = counts(row, place) & (anchors[row] != self.ids[place])
            row, place, value = row[fits], place[fits], value[fits]
            found = []
            for g in range(goals):
                at = np.flatnonzero((value >= low[row, g]) & (value <= high[row, g]) & (value >= bar[row, g]))
                found.append((row[at] * goals + g, self.ids[place[at]], -value[at]))
            if any(len(f[0]) for f in found):
                held = best_rows(*(np.concatenate(c) for c in zip(held, *found, strict=True)), most)
                goal, n = np.unique(held[0], return_counts=True)
                full = goal[n == most]
                last = np.cumsum(n)[n == most] - 1
                bar.reshape(-1)[full] = np.maximum(bar.reshape(-1)[full], -held[2][last])
            start, step = start + step, min(2 * step, 2048)
        return held[0] // max(1, goals), held[0] % max(1, goals), held[1], -held[2], walked


def _walks(items: DataFrame, anchors: DataFrame, most, same_label, block, pack, group) -> DataFrame:
    """(anchor_id, goal, vec_id, score) of every meeting of a pack of anchors with a block of items of its ring.

    items: (ring, vec_id, label, q); anchors: (ring, cluster, vec_id, label, q, lows, highs). A ring is cut into blocks of about
    `block` items, a cluster into packs of about `pack` anchors, and a task takes a block and at most about `group`
    anchors; so no ring, cluster or label is too large for a task.
    """
    number = lambda count, most: F.greatest(F.lit(1), F.ceil(count / most)).cast("int")
    in_ring = items.groupBy("ring").agg(number(F.count(F.lit(1)), block).alias("_blocks"))
    asked = anchors.groupBy("ring").agg(number(F.count(F.lit(1)), group).alias("_groups"))
    shares = store(in_ring.join(asked, "ring"), "rings")
    packs = store(anchors.groupBy("ring", "cluster").agg(number(F.count(F.lit(1)), pack).alias("_packs")), "packs")
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    none = F.array().cast("array<long>")
    each = items.join(shares, "ring").withColumn("pack_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    each = each.select("ring", place(F.col("_blocks"), 1).alias("block"), "pack_group", F.lit(False).alias("anchor"), F.lit(0).cast("long").alias("cluster"), "vec_id", "label", "q", none.alias("lows"), none.alias("highs"))
    dealt = anchors.join(packs, ["ring", "cluster"]).join(shares, "ring").withColumn("_pack", place(F.col("_packs"), 2))
    dealt = dealt.withColumn("cluster", F.col("cluster").cast("long") * (1 << 32) + F.col("_pack")).withColumn("pack_group", F.pmod(F.xxhash64("cluster", "_pack"), F.col("_groups")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("ring", "block", "pack_group", F.lit(True).alias("anchor"), "cluster", "vec_id", "label", "q", "lows", "highs")
    key = ["ring", "block", "pack_group"]
    met = each.unionByName(dealt).repartition(*key).sortWithinPartitions(*key, "anchor", "cluster", "vec_id")

    def task(parts):
        ids, labels, q, where, waiting = [], [], [], None, []

        def finish():
            if not waiting or not ids:
                return
            own, of, vectors, lows, highs = (np.concatenate([w[k] for w in waiting]) for k in range(5))
            shared = SharedList(*(np.concatenate(c) for c in (ids, labels, q)), vectors)
            counts = (lambda row, at: of[row] == shared.labels[at]) if same_label else (lambda row, at: of[row] != shared.labels[at])
            row, goal, item, score, _ = shared.walk(own, vectors, (lows, highs, counts), most)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(goal, pa.int32()), pa.array(item), pa.array(score)], names=["anchor_id", "goal", "vec_id", "score"])

        for part in parts:
            part_keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("ring", "block", "pack_group", "cluster")], axis=1)
            is_anchor = part.column("anchor").to_numpy(zero_copy_only=False)
            new = np.any(part_keys[1:] != part_keys[:-1], axis=1) | (is_anchor[1:] != is_anchor[:-1])
            edges = np.flatnonzero(np.r_[True, new, True]) if len(part_keys) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                here, kind = tuple(part_keys[i, :3]), (bool(is_anchor[i]), part_keys[i, 3])
                if where is None or where[0] != here or where[1] != kind:
                    yield from finish()
                    waiting = []
                    if where is None or where[0] != here:
                        ids, labels, q = [], [], []
                    where = (here, kind)
                rows = part.slice(i, j - i)
                own, of, vectors = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("q"))
                if kind[0]:
                    waiting.append((own, of, vectors, matrix(rows.column("lows")), matrix(rows.column("highs"))))
                else:
                    ids.append(own)
                    labels.append(of)
                    q.append(vectors)
        yield from finish()

    return met.mapInArrow(task, "anchor_id long, goal int, vec_id long, score long")


def hard_negatives(vectors: DataFrame, is_anchor, label="label", positives=5, negatives=3, low=50, high=95, scale=256, clusters=32, sample=4096, block=BLOCK, pack=PACK, group=GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor, of vectors floor(scale * component); higher scores come first,
    ties by smaller vec_id. An anchor's positives are its first `positives` other rows of its label; for each positive the
    first `negatives` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    An anchor without positives, and a positive without such rows, give none. Rows that take part: see `labelled`; so none
    for an empty table. At most about `sample` anchors, chosen by a hash, fit the clusters; that changes cost alone.
    """
    spark = vectors.sparkSession
    rows = labelled(vectors, label, scale)
    anchors = store(rows.where(is_anchor), "anchors")
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, anchors.count())) * (1 << 30))
    fit_on = matrix(anchors.where(chosen).select("q").orderBy("q").toArrow().column("q").combine_chunks()).astype(np.float64)
    middle = spark.sparkContext.broadcast(centres(fit_on, clusters) if fit_on.size else None)

    def cluster_of(parts):
        for part in parts:
            x = unit(matrix(part.column("q")).astype(np.float64))
            own = (x @ middle.value.T).argmax(1) if middle.value is not None and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("q"), pa.array(own.astype(np.int32))], names=["vec_id", "label", "q", "cluster"])

    anchors = store(anchors.select("vec_id", "label", "q").mapInArrow(cluster_of, "vec_id long, label long, q array<long>, cluster int"), "clustered")
    least, most = (F.array(F.lit(x).cast("long")) for x in (-(1 << 62), 1 << 62))
    same = _walks(rows.withColumn("ring", F.col("label")), anchors.withColumns({"ring": F.col("label"), "lows": least, "highs": most}), positives, True, block, pack, group)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = store(store(same, "same").withColumn("goal", F.row_number().over(best) - 1).where(F.col("goal") < positives), "positives")
    goals = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("goal", "score"))).alias("_goals"))
    # Anchors with fewer positives get goals that nothing can reach.
    score = lambda g: F.try_element_at("_goals", F.lit(g + 1))["score"]
    lows = F.array(*[F.coalesce(F.ceil(score(g).cast("decimal(38,0)") * low / 100).cast("long"), F.lit(1).cast("long")) for g in range(positives)])
    highs = F.array(*[F.coalesce(F.floor(score(g).cast("decimal(38,0)") * high / 100).cast("long"), F.lit(0).cast("long")) for g in range(positives)])
    asking = anchors.join(goals, anchors["vec_id"] == goals["anchor_id"]).select(F.lit(0).cast("long").alias("ring"), "cluster", "vec_id", "label", "q", lows.alias("lows"), highs.alias("highs"))
    other = store(_walks(rows.withColumn("ring", F.lit(0).cast("long")), store(asking, "asking"), negatives, False, block, pack, group), "other")
    place = F.row_number().over(Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "vec_id"))
    ranked = other.withColumn("rank", place).where(F.col("rank") <= negatives)
    named = near.select("anchor_id", "goal", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = ranked.select("anchor_id", "goal", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(named, ["anchor_id", "goal"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
