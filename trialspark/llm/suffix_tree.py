"""A probabilistic suffix tree over bytes as a table that grows with the corpus, searched shard by shard.

A run is a symbol after a context of up to `depth` symbols, packed into 63 bits: the context from its last symbol backwards
in the high bits, the symbol in the lowest. So the end of a context is a prefix of its bits, and sorted runs meet the sorted
table in order. A text starts after END and ends with it; before an END there is only END.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .context_tree import BITS, END
from .storage import columns, store
from .text import batches, count_keys

DEPTH = 6  # with the symbol itself 63 bits
ESCAPE = (1 << BITS) - 1  # stands for every symbol that never followed the context
#: Entries of 12 bytes that a task holds at once. A larger tree has more shards, not larger ones.
SHARD_ENTRIES = 6_000_000
#: Contexts with the same last ROUTE symbols are in one shard; shorter ones (few) are in all.
ROUTE = 3
PRIME = 1_000_003


def runs(symbols, depth):
    """Every symbol with the `depth` symbols before it, packed."""
    keys, before = symbols.copy(), np.full(len(symbols), END, dtype=np.int64)
    for back in range(1, depth + 1):
        ended = before == END if back > 1 else np.zeros(len(symbols), dtype=bool)
        before = np.full(len(symbols), END, dtype=np.int64)
        before[back:] = symbols[:-back]
        before[ended] = END
        keys |= before << (BITS * (depth - back + 1))
    return keys


def candidates(counted: DataFrame, depth: int, least: int) -> DataFrame:
    """(d, context, symbol, n, total) of the contexts seen at least `least` times, and of the empty one.

    One shuffle brings together the runs whose contexts end in the same ROUTE symbols; a task then adds up its runs level
    by level. Shorter contexts meet in several tasks, as sums.
    """
    short = min(ROUTE, depth)
    names = ["d", "context", "symbol", "n", "total"]
    schema = pa.schema([(c, pa.int32() if c == "d" else pa.int64()) for c in names])

    def task(parts):
        got = [(p.column("key").to_numpy(), p.column("n").to_numpy()) for p in parts]
        if not got:
            return
        run, n = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        for d in range(depth, -1, -1):
            if d < depth:
                run = run >> (2 * BITS) << BITS | run & ((1 << BITS) - 1)
            run, n = count_keys(run, n)
            context = run >> BITS
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(run) else np.zeros(0, np.int64)
            total = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(run)])) if len(run) else n
            keep = total >= (least if d >= short else 0)
            yield from batches(schema, [np.full(keep.sum(), d), context[keep], run[keep] & ((1 << BITS) - 1), n[keep], total[keep]])

    dealt = counted.repartition(F.shiftright("key", BITS * (depth - short + 1)))
    seen = store(dealt.mapInArrow(task, "d int, context long, symbol long, n long, total long"), "tree-candidates")
    low = seen.where(F.col("d") < short).groupBy("d", "context", "symbol").agg(F.sum("n").alias("n"))
    low = low.withColumn("total", F.sum("n").over(Window.partitionBy("d", "context")))  # at most 257 rows each
    low = store(low.where((F.col("total") >= least) | (F.col("d") == 0)), "tree-short")
    return seen.where(F.col("d") >= short).unionByName(low)


def build(counted: DataFrame, depth: int, least: int, min_gain: float, prior: float) -> tuple[DataFrame, int]:
    """(tree, symbols): the tree as a stored table (d, key, value), and the number of symbols learned from.

    counted: (key, n), the counts of runs of full depth. A context is a candidate if it was seen `least` times, a fixed
    number, so a larger corpus has more of them. value: log10 of the smoothed probability of the run `key`; with ESCAPE as
    symbol, log10 of what is left for the shorter context. Every level is one join with the level before.
    """
    symbols = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = candidates(counted, depth, least)
    size = float(symbols + 257)
    level = seen.where(F.col("d") == 0).withColumns({"shorter": F.lit(1.0 / size), "p": (F.col("n") + 1) / size})
    parts = [level]
    for d in range(1, depth + 1):
        before = level.select(F.col("context").alias("_end"), "symbol", F.col("p").alias("shorter"))
        level = store(
            seen.where(F.col("d") == d)
            .withColumn("_end", F.shiftright("context", BITS))
            .join(before, ["_end", "symbol"])
            .withColumn("p", (F.col("n") + prior * F.col("shorter")) / (F.col("total") + prior))
            .select(*seen.columns, "shorter", "p"),
            "tree-level",
        )
        parts.append(level)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Divergence test; what ends a kept context is kept.
    gain = F.sum(F.col("n") * F.ln(F.col("n") / F.col("total") / F.col("shorter")))
    passed = found.where(F.col("d") > 0).groupBy("d", "context").agg(gain.alias("gain")).where(F.col("gain") >= min_gain)
    ends = F.transform(
        F.sequence(F.lit(0), F.col("d") - 1),
        lambda cut: F.struct((F.col("d") - cut).alias("d"), F.call_function("shiftright", F.col("context"), cut * BITS).alias("context")),
    )
    kept = passed.select(F.explode(ends).alias("end")).select("end.*").distinct()
    low_level = found.where(F.col("d") == 0)
    entries = found.join(kept, ["d", "context"]).select(*found.columns).unionByName(low_level)
    base = F.shiftleft("context", BITS)
    escape = F.when(F.col("d") > 0, F.log10(F.lit(prior) / (F.col("total") + prior)))
    tree = entries.select("d", base.bitwiseOR(F.col("symbol")).alias("key"), F.log10("p").cast("float").alias("value")).unionByName(
        entries.where(F.col("d") > 0)
        .select("d", base.bitwiseOR(F.lit(ESCAPE).cast("long")).alias("key"), escape.cast("float").alias("value"))
        .dropDuplicates(["d", "key"])
    )
    return store(tree, "tree"), int(symbols)


def shard_count(tree: DataFrame) -> int:
    return max(1, -(-tree.count() // SHARD_ENTRIES))


class Shard:
    """The entries of one shard, sorted, and the log10 probabilities of the runs that belong to it."""

    def __init__(self, table, depth, symbols, number, shards):
        self.depth, self.number, self.shards = depth, number, shards
        self.floor = -np.log10(symbols + 257.0)
        self.keys, self.values = [], []
        for d in range(depth + 1):
            here = np.flatnonzero(table["d"] == d)
            here = here[np.argsort(table["key"][here])]
            self.keys.append(table["key"][here])
            self.values.append(table["value"][here])

    def _find(self, d, wanted):
        keys = self.keys[d]
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def score(self, symbols):
        """log10 probability of each symbol after those before it; 0 where another shard has the context."""
        keys, place = np.unique(runs(symbols, self.depth), return_inverse=True)
        symbol = keys & ((1 << BITS) - 1)
        out = np.full(len(keys), self.floor)
        open_ = np.arange(len(keys))
        if self.shards > 1:
            route = keys >> (BITS * (self.depth - min(ROUTE, self.depth) + 1))
            mine = route % PRIME % self.shards == self.number
            out[~mine] = 0.0
            open_ = np.flatnonzero(mine)
        for d in range(self.depth + 1):
            context = (keys[open_] >> (BITS * (self.depth - d + 1))) << BITS
            at = self._find(d, context | symbol[open_])
            seen = at >= 0
            out[open_[seen]] = self.values[d][at[seen]]
            if d:  # a context that is not kept ends no kept one
                rest = np.flatnonzero(~seen)
                at = self._find(d, context[rest] | ESCAPE)
                has = at >= 0
                out[open_[rest[has]]] += self.values[d][at[has]]
                stays = seen
                stays[rest[has]] = True
                open_ = open_[stays]
        return out[place]


def shard(tree: DataFrame, depth: int, symbols: int, number: int, shards: int) -> Shard:
    """Fetch one shard: about SHARD_ENTRIES entries, whatever the size of the tree."""
    if shards > 1:
        short = min(ROUTE, depth)
        # A key holds d + 1 symbols; its first `short` are the last of the context.
        route = F.expr(f"shiftright(key, {BITS} * (d - {short} + 1))")
        tree = tree.where((F.col("d") < short) | (route % PRIME % shards == number))
    return Shard(columns(tree), depth, symbols, number, shards)
