"""Language identification by prediction by partial matching.

Per language a tree of byte contexts is counted from labelled texts and then frozen. A text's code length under a
language is the sum of -log2 p(byte | longest known context), with escapes to shorter contexts; the shortest code wins.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .context_tree import MASK, Alphabet, Automaton, Model, by_depth, escape_blend, frequent_contexts, grams, stream
from .text import KeyCounter, batches, buffer, slices

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes of evidence at which the score stops growing more certain.
SCORE_BYTES = 64
#: Bytes scored at once: with a number per byte and language, what a worker holds grows by some 60 bytes for each.
SLICE_BYTES = 1 << 17


def training_rows(docs: DataFrame, most_per_lang: int) -> DataFrame:
    """About `most_per_lang` labelled texts of each language at most, picked by a hash of doc_id; whole texts."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most_per_lang / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.where(place < share[F.col("lang")])


def count_grams(texts: DataFrame, depth: int) -> DataFrame:
    """(lang, key, n): how often each run of `depth` + 1 bytes occurs, per language, summed in each task first."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def task(parts):
        counters = {}
        for part in parts:
            data, offsets = buffer(part.column("text"))
            langs = part.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                own = offsets[i : i + 2] - offsets[i]
                symbols, _ = stream(data[offsets[i] : offsets[i + 1]], own)
                counters.setdefault(lang, KeyCounter(1 << 18)).add(grams(symbols, depth))
        for lang, counter in counters.items():
            keys, counts = counter.result()
            yield from batches(schema, [np.full(len(keys), lang, dtype=object), keys.astype(np.int64), counts])

    counted = texts.select("lang", "text").mapInArrow(task, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, depth=4, most_per_lang=1500, min_count=24) -> tuple[list[str], Automaton | None]:
    """The languages, sorted, and one automaton with a tree for each.

    The counts come from a bounded number of texts (`most_per_lang`), so what reaches the driver is bounded too.
    `min_count`: a context seen less often is left to the shorter one.
    """
    runs = count_grams(training_rows(docs, most_per_lang), depth)
    table = frequent_contexts(runs, depth, min_count, "lang")
    langs = sorted(set(table["lang"]))
    if not langs:
        return [], None
    totals, counts = np.zeros(MASK + 1), {}
    for lang in langs:
        counts[lang] = by_depth(table, depth, table["lang"] == lang)
        np.add.at(totals, *counts[lang][0])
    alphabet = Alphabet(totals, 2)
    models = [Model(counts[lang], alphabet, escape_blend, min_count, 0.0) for lang in langs]
    return langs, Automaton(models, alphabet)


def identify(docs: DataFrame, langs: list[str], automaton: Automaton | None, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` plus lang_pred, score (0 to 1) and bits_per_byte of the best language.

    A null text, or one without a letter, gets `und` with score 0, as does every text if no language was learned.
    Equal code lengths go to the language first in order. Every row is predicted, repeated ones alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, automaton))
    kept = docs.select(*keep).schema
    spec = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double, bits_per_byte double"])

    def task(parts):
        langs, automaton = shared.value
        for part in parts:
            texts = part.column(text)
            data, offsets = buffer(texts)
            lettered = np.fromiter((t.is_valid and LETTER.search(t.as_py()) is not None for t in texts), bool, len(texts))
            names, scores, rates = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if automaton is not None:
                for i, j in slices(offsets, SLICE_BYTES):
                    bits = -automaton.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False) / np.log10(2)
                    size = np.maximum(np.diff(offsets[i : j + 1]), 1)
                    best = bits.argmin(1)
                    worse = (bits - bits.min(1, keepdims=True)) * np.minimum(1, SCORE_BYTES / size)[:, None]
                    names[i:j] = np.array(langs, dtype=object)[best]
                    scores[i:j] = 1 / np.exp2(-worse).sum(1)
                    rates[i:j] = bits.min(1) / size
            names[~lettered], scores[~lettered], rates[~lettered] = UNDETERMINED, 0.0, np.nan
            columns = [part.column(f"_{k}") for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rates, from_pandas=True)],
                names=[*kept.names, "lang_pred", "score", "bits_per_byte"],
            )

    columns = [F.col(name).alias(f"_{k}") for k, name in enumerate(kept.names)]
    text = f"_{kept.names.index('text')}" if "text" in kept.names else "_text"
    return docs.select(*columns, *([F.col("text").alias(text)] if text == "_text" else [])).mapInArrow(task, spec)
