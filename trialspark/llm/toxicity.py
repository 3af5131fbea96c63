"""Toxicity scores of texts after noisy-channel deobfuscation.

A suspicious stretch (digits and signs among letters, letters spaced out, letters repeated) becomes a lattice of what it
may stand for; the most probable path under a character model of the corpus replaces it. The restored text is scored by a
logistic model on words and word beginnings, learned from labelled texts.
"""

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import columns, store
from .text import _BYTE_VALUE, LOWER, KeyCounter, batches, buffer, mix, slices, spans_hash

#: What a sign may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
SUBSTITUTE, DROP, KEEP_GAP = -0.4, -0.2, -1.5  # log10 costs of the channel
REMEMBERED = 48  # longer stretches are decoded anew each time
EDGE, OTHER, SYMBOLS = 26, 27, 28  # of the character model: a-z, a gap, any other letter
PREFIXES = (3, 4, 5, 6, 7, 8)

_SIGNS = re.escape("".join(LEET))
_SPACED = re.compile(rf"(?<![A-Za-z{_SIGNS}])[A-Za-z{_SIGNS}](?:[ .\-_*][A-Za-z{_SIGNS}]){{2,}}(?![A-Za-z{_SIGNS}])")
_TOKEN = re.compile(rf"(?=[{_SIGNS}]*[A-Za-z])[A-Za-z{_SIGNS}]*[A-Za-z0-9]")
_ODD = re.compile(rf"[{_SIGNS}][A-Za-z]|[A-Za-z][0-9]|([A-Za-z])\1\1", re.I)

_CODE = np.full(256, EDGE, dtype=np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_CODE[128:] = OTHER
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LEET]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[ord(c) for c in " .-_*"]] = True


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all runs of three symbols over all texts; each task sums its own."""
    def task(parts):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for part in parts:
            data, offsets = buffer(part.column("text"))
            for i, j in slices(offsets):
                codes = _CODE[data[offsets[i] : offsets[j]]]
                codes = np.r_[EDGE, codes, EDGE]
                codes = codes[np.r_[True, (codes[1:] != EDGE) | (codes[:-1] != EDGE)]]
                codes = np.r_[EDGE, codes]
                total += np.bincount(codes[:-2] * SYMBOLS**2 + codes[1:-1] * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["run", "n"])

    counted = columns(docs.select("text").mapInArrow(task, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")))
    out = np.zeros(SYMBOLS**3)
    out[counted["run"]] = counted["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Channel:
    """Viterbi decoding of suspicious stretches under a character model."""

    def __init__(self, counts):
        pairs = counts.sum(0)
        shorter = (pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True)
        self.logs = np.log10((counts + 8 * shorter) / (counts.sum(2, keepdims=True) + 8)).tolist()
        self.known, self.places = {}, {}

    def _steps(self, text):
        """[(string, cost)] for each place of the lattice: what may stand there. Equal places share one list."""
        i = 0
        while i < len(text):
            c = text[i]
            j = i
            while j < len(text) and text[j] == c:
                j += 1
            if c.isalpha() or c in LEET:
                if j - i >= 3:
                    yield self._options(c, True)
                else:
                    for _ in range(j - i):
                        yield self._options(c, False)
            else:
                yield self._options(" ", False)
            i = j

    def _options(self, c, repeated):
        have = self.places.get((c, repeated))
        if have is None:
            have = [("", DROP), (" ", KEEP_GAP)]
            if c != " ":
                have = [(x, SUBSTITUTE) for x in LEET.get(c, "")] or [(c, 0.0)]
            if repeated:
                have = [(x * n, cost + DROP) for x, cost in have for n in (1, 2)]
            self.places[c, repeated] = have
        return have

    def decode(self, text):
        """The most probable reading of a stretch, in lower case; time and memory follow its length.

        Each place keeps for its states a number: which state of the place before led there, and by which option.
        """
        text = text.lower()
        if text in self.known:
            return self.known[text]
        logs = self.logs
        best, places, back, first = {(EDGE, EDGE): 0.0}, [], array("H"), array("q", [0])
        for options in self._steps(text):
            nexts, came = {}, {}
            for k, ((a, b), score) in enumerate(best.items()):
                for o, (string, cost) in enumerate(options):
                    x, y, total = a, b, score + cost
                    for ch in string:
                        z = EDGE if ch == " " else ord(ch) - 97
                        total += logs[x][y][z]
                        x, y = y, z
                    if total > nexts.get((x, y), -np.inf):
                        nexts[x, y], came[x, y] = total, k * 8 + o
            best = nexts
            places.append(options)
            back.extend(came[state] for state in best)
            first.append(len(back))
        k = max((score + logs[a][b][EDGE], k) for k, ((a, b), score) in enumerate(best.items()))[1]
        said = []
        for at in range(len(places) - 1, -1, -1):
            k, o = divmod(back[first[at] + k], 8)
            said.append(places[at][o][0])
        said = "".join(reversed(said))
        if len(text) <= REMEMBERED:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = said
        return said

    def restore(self, text):
        """The text with its suspicious stretches replaced by their best readings."""
        text = _SPACED.sub(lambda m: self.decode(m[0]) if any(c.isalpha() for c in m[0]) else m[0], text)
        return _TOKEN.sub(lambda m: self.decode(m[0]) if _ODD.search(m[0]) else m[0], text)


def suspicious(data, offsets):
    """Which texts hold a stretch worth decoding; a quick test over the whole batch."""
    letter, sign = _LETTER[data], _SIGN[data]
    low = LOWER[data]
    hit = np.zeros(len(data) + 1, dtype=np.int64)
    if len(data) > 1:
        hit[:-2] |= (sign[:-1] & letter[1:]) | (letter[:-1] & _DIGIT[data[1:]])
    if len(data) > 2:
        hit[:-3] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    if len(data) > 4:
        one, gap = letter | sign, _GAP[data]
        hit[:-5] |= one[:-4] & gap[1:-3] & one[2:-2] & gap[3:-1] & one[4:]
    upto = np.r_[0, np.cumsum(hit)]
    return upto[offsets[1:]] > upto[offsets[:-1]]


def restored(texts, channel):
    """(bytes, offsets) of texts in lower case, restored where suspicious; some two megabytes at a time."""
    data, offsets = buffer(texts)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        flagged = np.flatnonzero(suspicious(part, at))
        if len(flagged):
            pieces = [part[at[k] : at[k + 1]] for k in range(j - i)]
            for k in flagged:
                pieces[k] = np.frombuffer(channel.restore(pieces[k].tobytes().decode()).encode(), np.uint8)
            part, at = np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
        yield i, j, LOWER[part], at


def features(data, offsets):
    """(text, key) of every word and word beginning, repeats included. A word is a run of letters; other scripts count by
    their bytes."""
    word = (_CODE[data] != EDGE)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = word[cut]
    stops[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size = end - start
    start, end, size = start[size >= 3], end[size >= 3], size[size >= 3]
    values = _BYTE_VALUE[data]
    own = np.searchsorted(offsets, start, "right") - 1
    starts, ends, owners = [start], [end], [own]
    for n in PREFIXES:
        longer = size > n
        starts.append(start[longer])
        ends.append(start[longer] + n)
        owners.append(own[longer])
    keys = spans_hash(values, np.concatenate(starts), np.concatenate(ends))
    keys[: len(start)] = mix(keys[: len(start)] + np.uint64(1))  # a word as a whole is another feature than as a beginning
    return np.concatenate(owners), keys


class Lookup:
    """Places of keys in a small sorted table, behind a bit filter that rules most of them out."""

    def __init__(self, keys):
        self.keys = np.unique(keys)
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, owners, keys):
        """(owner, place) of the keys that are in the table."""
        may = self.filter[(keys >> np.uint64(42)).astype(np.int64)]
        owners, keys = owners[may], keys[may]
        if not len(self.keys):
            return owners[:0], np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        return owners[same], at[same]


@dataclass
class ToxicityModel:
    channel: Channel
    lookup: Lookup
    weights: np.ndarray
    bias: float


def _sample(docs, labels, per_class):
    """(label, text) of at most about `per_class` labelled texts of each class; the labels sent to the texts are bounded."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_class / max(1, sizes.get(0, 0))))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labels.where(place < share)
    return store(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled"), sizes


def fit(docs: DataFrame, train: DataFrame, labels: DataFrame, per_class=8000, least=3, most_features=4000) -> ToxicityModel:
    """The character model is counted over all of `docs`; labels are learned from `train` (doc_id, text) only.

    per_class: about so many labelled texts of each class at most are used. least: toxic ones that hold a feature.
    """
    channel = Channel(character_counts(docs))
    sample, sizes = _sample(train, labels, per_class)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(channel)

    def presence(parts, table):
        """(label, keys or places) of the distinct features of each text."""
        for part in parts:
            toxic = part.column("toxic").to_numpy()
            for i, j, data, at in restored(part.column("text"), shared.value):
                owners, keys = features(data, at)
                if table is not None:
                    owners, keys = table.find(owners, keys)
                order = np.lexsort((keys, owners))
                owners, keys = owners[order], keys[order]
                new = np.r_[True, (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
                yield toxic[i:j], owners[new], keys[new]

    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def toxic_keys(parts):
        counter = KeyCounter(1 << 19)
        for _, _, keys in presence(parts, None):
            counter.add(keys)
        keys, counts = counter.result()
        yield from batches(schema, [keys.view(np.int64), counts])

    often = sample.where("toxic = 1").mapInArrow(toxic_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    often = columns(often)
    order = np.argsort(often["key"].view(np.uint64))
    keys, in_toxic = often["key"].view(np.uint64)[order], often["n"][order].astype(np.float64)
    table = spark.sparkContext.broadcast(Lookup(keys))

    def clean_counts(parts):
        total = np.zeros(len(table.value.keys), dtype=np.int64)
        for _, _, places in presence(parts, table.value):
            total += np.bincount(places, minlength=len(total))
        at = np.flatnonzero(total)
        yield from batches(schema, [at, total[at]])

    counted = columns(sample.where("toxic = 0").mapInArrow(clean_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    in_clean = np.zeros(len(keys))
    in_clean[counted["key"]] = counted["n"]
    used = sample.groupBy("toxic").count().collect()
    used = {r["toxic"]: r["count"] for r in used}
    n1, n0 = max(1, used.get(1, 0)), max(1, used.get(0, 0))
    odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_clean + 0.5) / (n0 + 1))
    gain = np.where(odds > 1.5, in_toxic * odds, 0.0)
    pick = np.sort(np.argsort(-gain, kind="stable")[:most_features])
    pick = pick[gain[pick] > 0]
    lookup = Lookup(keys[pick])
    chosen = spark.sparkContext.broadcast(lookup)

    def hits(parts):
        for toxic, owners, places in presence(parts, chosen.value):
            bounds = np.searchsorted(owners, np.arange(len(toxic) + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), lists], names=["toxic", "places"])

    rows = sample.mapInArrow(hits, "toxic int, places array<int>").groupBy("toxic", "places").count().orderBy("toxic", "places").toArrow()
    weights, bias = _logistic(rows, len(lookup.keys))
    # The classes were sampled at different rates: the bias is put back to the rate of the labelled rows.
    bias += np.log(max(1, sizes.get(1, 0)) / n1) - np.log(max(1, sizes.get(0, 0)) / n0)
    return ToxicityModel(channel, lookup, weights, bias)


def _logistic(rows, n, rounds=300, ridge=1e-3):
    """Weights >= 0 and bias of a logistic model on the presence of features, by gradient descent with momentum."""
    y, times = rows.column("toxic").to_numpy().astype(np.float64), rows.column("count").to_numpy().astype(np.float64)
    lists = rows.column("places").combine_chunks()
    places = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    w, b, dw, db = np.zeros(n), -1.0, np.zeros(n), 0.0
    if not len(y) or not n:
        return w, b if len(y) else -5.0
    total = times.sum()
    width = max(1.0, (np.bincount(owner, minlength=len(y)) * times).sum() / max(1.0, (times * (np.bincount(owner, minlength=len(y)) > 0)).sum()))
    for _ in range(rounds):
        z = np.bincount(owner, w[places], len(y)) + b
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * times / total
        dw = 0.9 * dw - (4.0 / np.sqrt(width)) * (np.bincount(places, gap[owner], n) + ridge * w / n)
        db = 0.9 * db - 0.5 * gap.sum()
        w, b = np.maximum(0.0, w + dw), b + db
    return w, b


def score(docs: DataFrame, model: ToxicityModel, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` plus score (0 to 1) and predicted (1 from 0.5 on), one row per row of `docs`.

    A null or empty text has no features and gets the score of such a text. Only the text is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema
    names = [f"_{k}" for k in range(len(kept))]
    spec = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double, predicted int"])

    def task(parts):
        model = shared.value
        for part in parts:
            texts = part.column("_text")
            total = np.full(len(texts), model.bias)
            for i, j, data, at in restored(texts, model.channel):
                owners, places = model.lookup.find(*features(data, at))
                pairs = np.unique(owners * (len(model.weights) + 1) + places)
                total[i:j] += np.bincount(pairs // (len(model.weights) + 1), model.weights[pairs % (len(model.weights) + 1)], j - i)
            value = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*kept.names, "score", "predicted"])

    source = docs.select(*[F.col(f.name).alias(n) for f, n in zip(kept, names, strict=True)], F.col("text").alias("_text"))
    return source.mapInArrow(task, spec)
