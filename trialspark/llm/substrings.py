"""Substring deduplication with suffix automata of reference shards.

A window is `window` consecutive words of a text. A window that starts at two places or more, anywhere, is repeated, and
every word under a repeated window goes. Windows are dealt into shards by their smallest run of `gram` words under a
hash: equal windows have equal runs, so they meet in one shard. The texts of a shard are its reference; a suffix
automaton of them, weighted with how often each occurs, gives the longest repeated match that ends at each word as the
same texts are streamed through it.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import columns, store
from .text import KeyCounter, Words, batches, buffer, mix, slices, spans_hash

#: Bits of the broadcast filter of repeated shard keys. Fixed: a fuller filter only lets more texts through.
FILTER_BITS = 1 << 26
#: A shard key with more different texts than this has its windows counted one by one instead.
SHARD_TEXTS = 256
#: Windows of one reference text at most.
RUN = 64


def _sliding(least_or_most, values, size):
    """Minimum or maximum of each `size` values in a row."""
    have = 1
    while 2 * have <= size:
        values = least_or_most(values[:-have], values[have:])
        have *= 2
    return least_or_most(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def _shard_keys(words: Words, window: int, gram: int):
    """(word hashes, hashes of the runs of words, the shard key of each window, whether the window is in one text)."""
    hashes = words.hashes()
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(len(hashes) - gram + 1)
    runs = spans_hash(hashes, at, at + gram)
    owner = words.owners()
    return hashes, runs, _sliding(np.minimum, runs, window - gram + 1), owner[:n] == owner[window - 1 :]


def key_places(words: Words, window: int, gram: int) -> np.ndarray:
    """The shard key at every place that is the smallest of a window."""
    _, runs, keys, whole = _shard_keys(words, window, gram)
    if not len(keys):
        return keys
    side = np.zeros(window - gram, np.uint64)
    chosen = _sliding(np.maximum, np.r_[side, np.where(whole, keys, np.uint64(0)), side], window - gram + 1)
    return runs[(chosen == runs) & (runs != 0)]


def segments(words: Words, window: int, gram: int):
    """Runs of consecutive windows with one shard key: (key, first word, number of windows, two hashes of the words)."""
    hashes, _, keys, whole = _shard_keys(words, window, gram)
    if not whole.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64)
    owner = words.owners()[: len(keys)]
    cut = np.ones(len(keys) + 1, dtype=bool)
    cut[1:-1] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | ~whole[1:] | ~whole[:-1]
    edges = np.flatnonzero(cut)
    begin, size = edges[:-1], np.diff(edges)
    begin, size = begin[whole[begin]], size[whole[begin]]
    pieces = -(-size // RUN)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(begin, pieces) + place * RUN
    size = np.minimum(np.repeat(size, pieces) - place * RUN, RUN)
    stop = first + size + window - 1
    return keys[first], first, size, spans_hash(hashes, first, stop), spans_hash(mix(hashes + np.uint64(1)), first, stop)


class SuffixAutomaton:
    """All runs of words of some texts, with how often each occurs."""

    def __init__(self):
        self.next, self.link, self.size, self.times = [{}], [-1], [0], [0]

    def _state(self, size, following, link):
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.times.append(0)
        return len(self.size) - 1

    def add(self, text, times):
        last = 0
        for word in text:
            last = self._extend(last, word)
            self.times[last] += times

    def _extend(self, last, word):
        nexts, links, sizes = self.next, self.link, self.size
        if word in nexts[last]:
            return self._split(last, word)
        new = self._state(sizes[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in nexts[at]:
            nexts[at][word] = new
            at = links[at]
        if at >= 0:
            links[new] = self._split(at, word)
        return new

    def _split(self, at, word):
        """The state of the longest run of `at` followed by `word`, apart from longer runs."""
        nexts, links, sizes = self.next, self.link, self.size
        old = nexts[at][word]
        if sizes[old] == sizes[at] + 1:
            return old
        copy = self._state(sizes[at] + 1, dict(nexts[old]), links[old])
        links[old] = copy
        while at >= 0 and nexts[at].get(word) == old:
            nexts[at][word] = copy
            at = links[at]
        return copy

    def finish(self):
        """Let every run count the occurrences of what it ends."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.times[self.link[state]] += self.times[state]

    def repeated(self, text, window):
        """For each window of a text, whether it occurs at two places or more in the texts added."""
        state, length, out = 0, 0, []
        nexts, links, sizes, times = self.next, self.link, self.size, self.times
        for word in text:
            while state and word not in nexts[state]:
                state = links[state]
                length = sizes[state]
            if word in nexts[state]:
                state, length = nexts[state][word], length + 1
            while sizes[links[state]] >= window if state else False:
                state = links[state]
                length = sizes[state]
            out.append(length >= window and times[state] >= 2)
        return out[window - 1 :]


def _covered(flags, window):
    """Word ranges under the marked windows, as a flat list from, to, from, to, .."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.r_[True, np.diff(at) > window]
    return np.c_[at[new], at[np.r_[new[1:], True]] + window].ravel().tolist()


def shard_repeats(texts: list[tuple[list[bytes], int]], window: int) -> list[list[int]]:
    """The covered word ranges of each reference text of a shard, given how often each text occurs."""
    if len(texts) == 1 and texts[0][1] > 1:
        return [[0, len(texts[0][0])]]
    automaton = SuffixAutomaton()
    for text, times in texts:
        automaton.add(text, times)
    automaton.finish()
    return [_covered(automaton.repeated(text, window), window) for text, _ in texts]


def _row_key(docs):
    """Rows are told apart by doc_id and text; repeated rows are alike, so they may share their ranges."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), "k2": F.xxhash64("text", F.col("doc_id").isNull())})


def repeated_keys(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key): shard keys at two places or more in all texts."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def task(parts):
        counter = KeyCounter()
        for part in parts:
            data, offsets = buffer(part.column("text"))
            for i, j in slices(offsets):
                counter.add(key_places(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), window, gram))
                if counter.held > 1 << 21:
                    keys, counts = counter.result()
                    yield from batches(schema, [keys.view(np.int64), counts])
                    counter = KeyCounter()
        keys, counts = counter.result()
        yield from batches(schema, [keys.view(np.int64), counts])

    return docs.select("text").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit filter with two places per key, made by the executors: at most bits / 64 rows reach the driver."""
    places = F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))
    one = F.lit(1).cast("long")
    set_bits = columns(
        keys.select(F.explode(places).alias("p"))
        .select(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(bits // 64, dtype=np.int64)
    table[set_bits["word"]] = set_bits["bits"]
    return table.view(np.uint64)


def _in_filter(table, keys):
    bits = np.uint64(len(table) * 64 - 1)
    out = np.ones(len(keys), dtype=bool)
    for place in (keys & bits, (keys >> np.uint64(32)) & bits):
        out &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def reference_texts(docs: DataFrame, table, window: int, gram: int) -> DataFrame:
    """Rows of two kinds. Places: (k1, k2, h1, h2, start) of every segment whose key may be repeated. Texts: (key, h1, h2,
    n, size, text) of the segments, each text once a task, with the occurrences seen there."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    spec = "k1 long, k2 long, start long, key long, h1 long, h2 long, n long, size int, text binary"
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("text", pa.binary())])

    def task(parts):
        table, seen = shared.value, set()
        for part in parts:
            data, offsets = buffer(part.column("text"))
            k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
            for i, j in slices(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, first, size, h1, h2 = segments(words, window, gram)
                hit = _in_filter(table, key)
                key, first, size, h1, h2 = (x[hit] for x in (key, first, size, h1, h2))
                if not len(key):
                    continue
                owner = words.owners()[first]
                h1, h2, key = h1.view(np.int64), h2.view(np.int64), key.view(np.int64)
                none = pa.nulls(len(key), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k1[i + owner]), pa.array(k2[i + owner]), pa.array(first - words.first[owner]), none, pa.array(h1), pa.array(h2), none, pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())], schema=schema)
                _, at, n = np.unique(h1, return_index=True, return_counts=True)
                if len(seen) > 1 << 19:
                    seen.clear()
                raw, texts = words.data, []
                for p in at.tolist():
                    mark = int(h1[p])
                    if mark in seen:
                        texts.append(None)
                        continue
                    seen.add(mark)
                    a, b = first[p], first[p] + size[p] + window - 2
                    texts.append(raw[words.starts[a] : words.ends[b]].tobytes())
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(key[at]), pa.array(h1[at]), pa.array(h2[at]), pa.array(n), pa.array(size[at].astype(np.int32)), pa.array(texts, pa.binary())], schema=schema)

    return docs.select("k1", "k2", "text").mapInArrow(task, spec)


def _window_rows(parts, window):
    """(w1, w2, h1, h2, at, n): the windows of reference texts, by two hashes of their words."""
    for part in parts:
        at = {c: part.column(c).to_pylist() for c in ("h1", "h2", "n", "text")}
        texts = pa.array([t or b"" for t in at["text"]], pa.binary()).cast(pa.large_binary())
        data, offsets = np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts.to_pylist()])]
        words = Words(data, offsets)
        hashes, size = words.hashes(), np.maximum(np.diff(words.first) - window + 1, 0)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        first = np.repeat(words.first[:-1], size) + place
        own = np.repeat(np.arange(len(size)), size)
        w1, w2 = spans_hash(hashes, first, first + window), spans_hash(mix(hashes + np.uint64(1)), first, first + window)
        yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *[pa.array(np.array(at[c], dtype=np.int64)[own]) for c in ("h1", "h2")], pa.array(place), pa.array(np.array(at["n"], dtype=np.int64)[own])], names=["w1", "w2", "h1", "h2", "at", "n"])


def repeated_ranges(texts: DataFrame, window: int, shard_texts: int) -> DataFrame:
    """(h1, h2, ranges): word ranges of each reference text that repeated windows cover."""
    kinds = texts.groupBy("key", "h1", "h2").agg(F.sum("n").alias("n"), F.count("text").alias("copies"))
    crowded = store(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > shard_texts).select("key"), "crowded")
    spec = "h1 long, h2 long, ranges array<int>"

    def shard(parts):
        def finish(rows):
            merged = {}
            for h1, h2, n, text in rows:
                have = merged.setdefault((h1, h2), [0, None])
                have[0] += n
                have[1] = have[1] or text
            found = shard_repeats([(t.split(), n) for n, t in merged.values()], window)
            return [(h1, h2, r) for (h1, h2), r in zip(merged, found, strict=True) if r]

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int32()))], names=["h1", "h2", "ranges"])

        key, rows, done = None, [], []
        for part in parts:
            for k, *row in zip(*[part.column(c).to_pylist() for c in ("key", "h1", "h2", "n", "text")], strict=True):
                if k != key:
                    done += finish(rows) if rows else []
                    key, rows = k, []
                    if len(done) > 4096:
                        yield batch(done)
                        done = []
                rows.append(row)
        done += finish(rows) if rows else []
        yield batch(done)

    calm = texts.join(crowded, "key", "left_anti").select("key", "h1", "h2", "n", "text")
    by_shard = calm.repartition("key").sortWithinPartitions("key").mapInArrow(shard, spec)
    # Crowded keys: the texts differ but share windows. Each window is counted on its own, by hash.
    busy = texts.join(crowded, "key", "left_semi").select("h1", "h2", "n", "text")
    totals = busy.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    one = busy.where(F.col("text").isNotNull()).select("h1", "h2", "text").dropDuplicates(["h1", "h2"]).join(totals, ["h1", "h2"])
    windows = store(one.mapInArrow(lambda parts: _window_rows(parts, window), "w1 long, w2 long, h1 long, h2 long, at long, n long"), "windows")
    # Stored, so that the join below deals out both sides itself and Spark can split a window that is in very many texts.
    often = store(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "often")
    marked = windows.join(often, ["w1", "w2"], "left_semi").groupBy("h1", "h2").agg(F.sort_array(F.collect_list("at")).alias("at"))
    by_window = marked.select("h1", "h2", F.flatten(F.transform("at", lambda x: F.array(x, x + window))).cast("array<int>").alias("ranges"))
    return by_shard.unionByName(by_window)


def repeated_spans(docs: DataFrame, window=35, gram=12, filter_bits=FILTER_BITS, shard_texts=SHARD_TEXTS) -> DataFrame:
    """`docs` (any columns, with doc_id and text) plus `removed`, the word ranges from, to, from, to, .. of each text that
    repeated windows cover; null if none. Ranges may overlap."""
    keyed = _row_key(docs)
    table = _filter(repeated_keys(docs, window, gram), filter_bits)
    found = store(reference_texts(keyed, table, window, gram), "segments")
    texts = found.where(F.col("key").isNotNull()).select("key", "h1", "h2", "n", "text")
    # Rows that are repeated share a key and have equal places; each is wanted once.
    places = found.where(F.col("key").isNull()).select("k1", "k2", "h1", "h2", "start").distinct()
    ranges = repeated_ranges(texts, window, shard_texts)
    spans = (
        places.join(ranges, ["h1", "h2"])
        .select("k1", "k2", F.transform("ranges", lambda x: x + F.col("start").cast("int")).alias("ranges"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("ranges")).alias("removed"))
    )
    return keyed.join(spans, ["k1", "k2"], "left").drop("k1", "k2")


def _cut(text, removed):
    """(words, words removed, the text that is left)."""
    words = (text or "").encode().split()
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    spans = np.asarray(removed if removed is not None else [], dtype=np.int64).reshape(-1, 2)
    np.add.at(keep, spans[:, 0], 1)
    np.add.at(keep, spans[:, 1], -1)
    gone = np.cumsum(keep)[:-1] > 0
    left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
    return len(words), int(gone.sum()), left


def remove_repeats(docs: DataFrame, window=35, gram=12, filter_bits=FILTER_BITS, shard_texts=SHARD_TEXTS, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` plus n_words, n_removed, kept and kept_sha256, one row per row of `docs`: the texts without the words
    under repeated windows.

    Words are joined by single spaces in `kept`. A null or empty text has no words and an empty `kept`; a text shorter than
    the window stays. Rows that are repeated, doc_id and all, are two places of their windows. A null doc_id stays null.
    """
    kept = docs.select(*keep).schema
    names = [f"_{k}" for k in range(len(kept))]
    named = docs.select("doc_id", "text", *[F.col(f.name).alias(n) for f, n in zip(kept, names, strict=True) if f.name not in ("doc_id", "text")])
    names = [f.name if f.name in ("doc_id", "text") else n for f, n in zip(kept, names, strict=True)]
    spanned = repeated_spans(named, window, gram, filter_bits, shard_texts)
    spec = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_words long, n_removed long, kept string, kept_sha256 string"])

    def task(parts):
        for part in parts:
            for i in range(0, len(part), 256):
                piece = part.slice(i, 256)
                done = [_cut(t, r) for t, r in zip(piece.column("text").to_pylist(), piece.column("removed").to_pylist(), strict=True)]
                out = [pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)]
                out += [pa.array([d[2].decode() for d in done], pa.string()), pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
                yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], *out], names=[*kept.names, "n_words", "n_removed", "kept", "kept_sha256"])

    return spanned.select(*dict.fromkeys(["doc_id", "text", *names, "removed"])).mapInArrow(task, spec)
