"""Byte context trees as finite automata.

A tree holds contexts (the last few bytes) with a distribution over the next byte. The longest context of the tree that
ends a history is found by an automaton, so a text costs two table reads per byte. A text ends with the symbol END and
starts after END; nothing before an END is ever part of a context.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import columns

BITS = 9  # of a symbol in a packed key: 256 bytes and END
END = 256
MASK = (1 << BITS) - 1


def stream(data, offsets):
    """The symbols of consecutive texts, each followed by END, and where each text ends (the place of its END)."""
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    symbols = np.full(len(data) + len(ends), END, dtype=np.int64)
    at = np.ones(len(symbols), dtype=bool)
    at[ends] = False
    symbols[at] = data
    return symbols, ends


def grams(symbols, depth):
    """Every symbol with the `depth` symbols before it, oldest first, packed into one integer."""
    keys, before = symbols.copy(), np.full(len(symbols), END, dtype=np.int64)
    for back in range(1, depth + 1):
        ended = before == END if back > 1 else np.zeros(len(symbols), dtype=bool)
        shifted = np.full(len(symbols), END, dtype=np.int64)
        shifted[back:] = symbols[:-back]
        shifted[ended] = END
        before = shifted
        keys |= before << (BITS * back)
    return keys


def frequent_contexts(runs: DataFrame, depth: int, least: int, by: str | None = None):
    """What follows each context seen at least `least` times, as columns (by, d, key, n), for contexts of 0 ..
    `depth` symbols. runs: (by, key, n), the counts of runs of `depth` + 1 symbols.

    The shorter runs are summed from the longest. The table is as small as `least` makes it: no more than (bytes of
    `runs`) / `least` contexts of each length, of 257 rows at most.
    """
    group = [by] if by else []
    masks = F.array(*[F.struct(F.lit(d).alias("d"), F.lit((1 << (BITS * (d + 1))) - 1).cast("long").alias("mask")) for d in range(depth + 1)])
    return columns(
        runs.select(*group, "key", "n", F.explode(masks).alias("m"))
        .groupBy(*group, F.col("m.d").alias("d"), F.col("key").bitwiseAND(F.col("m.mask")).alias("key"))
        .agg(F.sum("n").alias("n"))
        .groupBy(*group, "d", F.shiftright("key", BITS).alias("context"))
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("key", "n")).alias("after"))
        .where((F.col("total") >= least) | (F.col("d") == 0))
        .select(*group, "d", F.explode("after").alias("after"))
        .select(*group, "d", "after.key", "after.n")
    )


def by_depth(table, depth, rows=True):
    """(keys, counts) for each context length, of some rows."""
    parts = [(table["d"] == d) & rows for d in range(depth + 1)]
    return [(table["key"][p], table["n"][p].astype(np.float64)) for p in parts]


def escape_blend(counts, shorter):
    """Prediction by partial matching: seen symbols by their count, the rest by the escape probability (method C).

    The escape mass is dealt over the symbols not seen here, in proportion to the shorter context.
    """
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    unseen = np.where(counts > 0, 0.0, shorter)
    mass = unseen.sum(1, keepdims=True)
    escape = np.where(mass > 0, kinds / (total + kinds), 0.0)
    return counts / total * (1 - escape) + escape * unseen / np.where(mass > 0, mass, 1.0)


def prior_blend(weight):
    """Smoothing with the shorter context's distribution as `weight` earlier observations."""
    return lambda counts, shorter: (counts + weight * shorter) / (counts.sum(1, keepdims=True) + weight)


class Model:
    """One tree: per depth its context codes, their distributions, and which of them are kept."""

    def __init__(self, by_depth, alphabet, blend, min_count, min_gain):
        """by_depth: (packed keys, counts) for each depth; min_gain: nats by which a context must beat the shorter one."""
        self.codes, self.kept, self.probs = [], [], []
        a = alphabet.size
        for d, (keys, counts) in enumerate(by_depth):
            next_symbol = alphabet.of[keys & MASK]
            context = np.zeros(len(keys), dtype=np.int64)
            known = np.ones(len(keys), dtype=bool)
            for back in range(d, 0, -1):
                s = alphabet.of[(keys >> (BITS * back)) & MASK]
                known &= s != alphabet.rare
                context = context << BITS | s
            context, next_symbol, counts = context[known], next_symbol[known], counts[known]
            codes, row = np.unique(context, return_inverse=True)
            table = np.bincount(row * a + next_symbol, counts, len(codes) * a).reshape(len(codes), a)
            total = table.sum(1)
            if d == 0:
                if not len(codes):
                    codes, table, total = np.zeros(1, np.int64), np.zeros((1, a)), np.zeros(1)
                probs = (table + 1) / (total[:, None] + a)
                keep = np.ones(1, dtype=bool)
            else:
                often = total >= min_count
                codes, table, total = codes[often], table[often], total[often]
                suffix = self._find(d - 1, codes & ((1 << (BITS * (d - 1))) - 1))
                codes, table, total, suffix = (x[suffix >= 0] for x in (codes, table, total, suffix))
                shorter = self.probs[d - 1][suffix]
                probs = blend(table, shorter)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(table > 0, table * np.log(table / total[:, None] / shorter), 0.0).sum(1)
                keep = gain >= min_gain
            self.codes.append(codes)
            self.probs.append(probs)
            self.kept.append(keep)
        for d in range(len(by_depth) - 1, 0, -1):  # what ends a kept context is kept
            self.kept[d - 1][self._find(d - 1, self.codes[d][self.kept[d]] & ((1 << (BITS * (d - 1))) - 1))] = True

    def _find(self, d, codes):
        have = self.codes[d]
        if not len(have):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
        return np.where(have[at] == codes, at, -1)


class Alphabet:
    """Bytes seen at least `min_count` times have a symbol of their own; the others share one and split it evenly."""

    def __init__(self, totals, min_count):
        own = np.flatnonzero(totals[:256] >= max(1, min_count))
        self.of = np.full(MASK + 1, len(own), dtype=np.int64)
        self.of[own] = np.arange(len(own))
        self.rare, self.end, self.size = len(own), len(own) + 1, len(own) + 2
        self.of[END] = self.end
        self.shared = 256 - len(own)


class Automaton:
    """The trees of one or more models in one automaton: `step` and, per model, the log10 probability of each symbol.

    A state without a context of its own in a model shares the row of the longest one that ends it: `row` tells where in
    `logs` the row of a state and model begins, so a context that only one model has costs no row in the others.
    """

    def __init__(self, models, alphabet):
        depth = len(models[0].codes) - 1
        states = [np.unique(np.concatenate([m.codes[d][m.kept[d]] for m in models])) for d in range(depth + 1)]
        for d in range(depth, 0, -1):  # what begins a context is a state too
            states[d - 1] = np.union1d(states[d - 1], states[d] >> BITS)
        first = np.r_[0, np.cumsum([len(s) for s in states])]
        a, n = alphabet.size, int(first[-1])
        step = np.zeros((n, a), dtype=np.int32)
        row, logs, held = np.zeros((n, len(models)), dtype=np.int32), [], 0
        for d in range(depth + 1):
            rows = slice(first[d], first[d + 1])
            if d:
                fail = first[d - 1] + np.searchsorted(states[d - 1], states[d] & ((1 << (BITS * (d - 1))) - 1))
                step[rows], row[rows] = step[fail], row[fail]
            if d < depth:
                parent = first[d] + np.searchsorted(states[d], states[d + 1] >> BITS)
                step[parent, states[d + 1] & MASK] = first[d + 1] + np.arange(len(states[d + 1]))
            for k, m in enumerate(models):
                at = m._find(d, states[d])
                own = np.flatnonzero((at >= 0) & m.kept[d][np.maximum(at, 0)]) if len(m.codes[d]) else np.zeros(0, np.int64)
                row[first[d] + own, k] = held + np.arange(len(own))
                logs.append(np.log10(m.probs[d][at[own]]).astype(np.float32))
                held += len(own)
        start, code = 0, 0
        for d in range(1, depth + 1):
            code = code << BITS | alphabet.end
            at = np.searchsorted(states[d], code)
            if at == len(states[d]) or states[d][at] != code:
                break
            start = int(first[d] + at)
        step[:, alphabet.end] = start
        logs = np.concatenate(logs)
        if alphabet.shared:
            logs[:, alphabet.rare] -= np.float32(np.log10(alphabet.shared))
        self.depth, self.size, self.start, self.n_states = depth, a, start, n
        self.of = alphabet.of.astype(np.int32)
        self.end = alphabet.end
        self.step, self.row, self.logs = step.ravel(), np.ascontiguousarray(row.T) * np.int32(a), logs.ravel()

    def score(self, data, offsets, with_end=True):
        """log10 probability of each text under each model: (texts, models)."""
        symbols, ends = stream(data, offsets)
        n, k = len(symbols), len(self.row)
        if not n:
            return np.zeros((0, k))
        # Pieces of the stream advance side by side. A state follows from the last `depth` symbols alone, so each piece
        # first reads those of the piece before it.
        columns = int(min(8192, max(1, n // 64)))
        rows = -(-n // columns)
        padded = np.full(self.depth + rows * columns, self.end, dtype=np.int32)
        padded[self.depth : self.depth + n] = self.of[symbols]
        side = np.lib.stride_tricks.as_strided(padded, (columns, rows + self.depth), (padded.itemsize * rows, padded.itemsize))
        side = np.ascontiguousarray(side.T)
        out = np.empty((k, rows, columns), dtype=np.float32)
        state = np.full(columns, self.start, dtype=np.int32)
        at = np.empty(columns, dtype=np.int32)
        for t in range(rows + self.depth):
            if t >= self.depth:
                for own, logs in zip(self.row, out, strict=True):
                    np.take(own, state, out=at, mode="clip")
                    at += side[t]
                    np.take(self.logs, at, out=logs[t - self.depth], mode="clip")
            np.multiply(state, self.size, out=at)
            at += side[t]
            np.take(self.step, at, out=state, mode="clip")
        flat = out.transpose(0, 2, 1).reshape(k, rows * columns)[:, :n]
        if not with_end:
            flat[:, ends] = 0
        return np.add.reduceat(flat, np.r_[0, ends[:-1] + 1], axis=1, dtype=np.float64).T
