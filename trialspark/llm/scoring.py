"""Language-model scores of texts from a probabilistic suffix tree, with a word-frequency baseline.

A text is its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, joined by single spaces, and an end. The tree predicts its
bytes: a context is kept where the text after it diverges enough from what the shorter context predicts, each
distribution is smoothed with the shorter context's, and each byte is scored by the longest kept context. The tree is a
table that grows with the corpus (`suffix_tree.py`); texts are read once per shard of it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context_tree import stream
from .storage import columns, store
from .suffix_tree import DEPTH, build, runs, shard, shard_count
from .text import LOWER, KeyCounter, Words, batches, buffer, canonical, slices

WORD, RUN = 0, 1
END_WORD = 0  # the key of a text's end among the word keys


@dataclass
class SuffixModel:
    """A fitted model. `words` (key, n) holds every training word; `common` those seen in at least one of `common_words`
    tokens, which bounds their number by `common_words`. `tree` and `symbols` are those of `suffix_tree.build`."""

    tree: DataFrame
    symbols: int
    depth: int
    words: DataFrame
    common: tuple[np.ndarray, np.ndarray]
    least_common: int
    tokens: int
    kinds: int
    ends: int


def _normal(data, offsets):
    words = Words(LOWER[data], offsets)
    return words, *canonical(words)


def count_corpus(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): counts of all words and of all runs of `depth` + 1 bytes, from one scan.

    Each task sums what it sees; the sums meet in one shuffle, so a word in every text costs one row a task.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def task(parts):
        words_seen, runs_seen, ends_seen = KeyCounter(), KeyCounter(), 0
        for part in parts:
            data, offsets = buffer(part.column("text"))
            for i, j in slices(offsets):
                words, text, at = _normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                words_seen.add(words.hashes())
                ends_seen += j - i
                runs_seen.add(runs(stream(text, at)[0], depth))
        yield from batches(schema, [np.array([WORD]), np.array([END_WORD]), np.array([ends_seen])] if ends_seen else [np.zeros(0, np.int64)] * 3)
        for kind, counter in ((WORD, words_seen), (RUN, runs_seen)):
            keys, counts = counter.result()
            yield from batches(schema, [np.full(len(keys), kind), keys.view(np.int64), counts])

    counted = texts.select("text").mapInArrow(task, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, depth=DEPTH, least=24, min_gain=16.0, prior=16.0, common_words=500_000) -> SuffixModel:
    """Fit on every row of `texts` (column text; null is empty).

    A context of up to `depth` bytes is a candidate if it was seen `least` times, however large the corpus, so the tree
    grows with it; it is kept if its text is `min_gain` nats more likely than under the shorter context. `prior`: weight of
    the shorter context in the smoothing.
    """
    counted = store(count_corpus(texts, depth), "corpus-counts")
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("key").alias("v"), F.coalesce(F.sum(F.when(F.col("key") == END_WORD, F.col("n"))), F.lit(0)).alias("ends")).first()
    tokens, kinds, ends = int(total["n"]), int(total["v"]), int(total["ends"])
    least_common = max(1, -(-tokens // common_words))
    common = columns(words.where((F.col("n") >= least_common) & (F.col("key") != END_WORD)))
    order = np.argsort(common["key"].view(np.uint64), kind="stable")
    common = common["key"][order], common["n"][order]

    tree, symbols = build(counted.where(F.col("kind") == RUN).select("key", "n"), depth, least, min_gain, prior)
    return SuffixModel(tree, symbols, depth, words, common, least_common, tokens, kinds, ends)


def _text_bytes(column):
    """(bytes, offsets) of an Arrow binary array."""
    large = pa.types.is_large_binary(column.type)
    return buffer(column.view(pa.large_string() if large else pa.string()))


def _add_scores(rows: DataFrame, model: SuffixModel) -> DataFrame:
    """Column `score` in place of `_canonical`: log10 probability of these bytes and the end.

    One pass per shard of the tree. Each adds the symbols whose contexts are in its shard; between passes the rows are
    stored, so that a task never holds more than one shard.
    """
    shards = shard_count(model.tree)
    rows = rows.withColumn("score", F.lit(0.0))
    for number in range(shards):
        shared = rows.sparkSession.sparkContext.broadcast(shard(model.tree, model.depth, model.symbols, number, shards))
        out = [f for f in rows.schema if number < shards - 1 or f.name != "_canonical"]

        def task(parts, shared=shared, names=[f.name for f in out]):
            here = shared.value
            for part in parts:
                data, offsets = _text_bytes(part.column("_canonical"))
                total = np.zeros(part.num_rows)
                for i, j in slices(offsets):
                    symbols, ends = stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    total[i:j] = np.add.reduceat(here.score(symbols), np.r_[0, ends[:-1] + 1])
                total += part.column("score").to_numpy()
                part = part.set_column(part.schema.get_field_index("score"), "score", pa.array(total))
                yield part.select(names)

        rows = rows.mapInArrow(task, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out))
        if number < shards - 1:
            rows = store(rows, "scored-part")
    return rows


def score(docs: DataFrame, model: SuffixModel, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` plus n_tokens, n_known, train_tokens, base_score and score, one row per row of `docs`.

    Common words are looked up in the tasks; each other word is a row that meets its count in a join. A null or empty
    text has one token, its end. Repeated rows are scored alike, each on its own.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.common, model.ends))
    kept = docs.select(*keep).schema
    names = [f"_{k}" for k in range(len(kept))]
    spec = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True)], "row long, word long, n_tokens long, n_known long, base double, _canonical binary"])

    def task(parts):
        (keys, counts), ends = shared.value
        keys = keys.view(np.uint64)
        gain = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for part in parts:
            data, offsets = buffer(part.column("_text"))
            for i, j in slices(offsets):
                words, text, at = _normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes, owners = words.hashes(), words.owners()
                place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                found = keys[place] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
                known = np.bincount(owners[found], minlength=j - i)
                base = np.bincount(owners[found], gain[place[found]], j - i) if len(keys) else np.zeros(j - i)
                if ends:
                    known, base = known + 1, base + np.log10(ends + 1.0)
                rows = row + np.arange(j - i)
                out = [part.column(n).slice(i, j - i) for n in names]
                out += [pa.array(rows), pa.nulls(j - i, pa.int64()), pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(base), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)])]
                yield pa.RecordBatch.from_arrays(out, names=[*names, "row", "word", "n_tokens", "n_known", "base", "_canonical"])
                rare = hashes[~found].view(np.int64)
                if len(rare):
                    out = [pa.nulls(len(rare), part.column(n).type) for n in names]
                    out += [pa.array(rows[owners[~found]]), pa.array(rare), *[pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.binary())]]
                    yield pa.RecordBatch.from_arrays(out, names=[*names, "row", "word", "n_tokens", "n_known", "base", "_canonical"])
                row += j - i

    source = docs.select(*[F.col(f.name).alias(n) for f, n in zip(kept, names, strict=True)], F.col("text").alias("_text"))
    # The row numbers exist only in this table: both uses of it read the same files.
    scored = store(source.mapInArrow(task, spec), "scored")
    rare = (
        scored.where(F.col("word").isNotNull())
        .join(model.words.where(F.col("n") < model.least_common).withColumnRenamed("key", "word"), "word")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more"), F.count(F.lit(1)).alias("more_known"))
    )
    unit = F.lit(float(np.log10(model.tokens + model.kinds + 1)))
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return (
        _add_scores(scored.where(F.col("word").isNull()).drop("word"), model)
        .join(rare, "row", "left")
        .select(
            *[F.col(n).alias(f.name) for f, n in zip(kept, names, strict=True)],
            "n_tokens",
            (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + more - F.col("n_tokens") * unit).alias("base_score"),
            "score",
        )
    )
