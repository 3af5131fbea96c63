"""Grouping of spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a set of pairs (letter, its how-manyth occurrence), a binary vector. Words one inserted, deleted or
replaced letter apart have vectors at a Hamming distance of two at most. PartEnum deals the dimensions over first-level
parts, so that the distance is small in one of them, and these over second-level parts; every choice of as many of those as
must then agree is a signature. Near words share a signature exactly, so an equi-join on signatures finds them all, and
a comparison of the spellings verifies each pair.

Vectors of letters forget their order, so signatures alone bring many words together. The join key therefore also holds the
letters that an edit leaves in place: cut in three by the length of the shorter word, two of the three are untouched. And
a key that still has many words gets finer signatures.
"""

import re
import zlib
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .storage import store

#: Letters that a word may hold.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Words of one join key above which the key gets finer signatures.
CROWDED = 2048


def word_counts(docs: DataFrame, least_length=7, slip=31, merge_at=1 << 17) -> DataFrame:
    """(word, n): how often each word occurs in the whole texts; see `variants` for what a word is.

    Tasks count what they read in a table of at most `merge_at` words at a time, before anything is shuffled.
    """
    def task(parts):
        run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least_length)
        held = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                seed = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for word in run.findall(text.as_buffer().to_pybytes().lower() if text.is_valid else b""):
                    h = zlib.crc32(word, seed)
                    if h % slip == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) <= least_length:
                            continue
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] = held.get(word, 0) + 1
                if len(held) >= merge_at:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(task, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def part_letters(first: int, second: int) -> list[list[str]]:
    """The letters of every first-level and second-level part, dealt in turn; all occurrences of a letter go together."""
    return [[LETTERS[i + first * j :: first * second] for j in range(second)] for i in range(first)]


def signature_masks(first: int, second: int, distance=2) -> list[str]:
    """The letters of each PartEnum signature. Of `first` parts one holds at most distance // first of the differences, so
    all but that many of its `second` parts agree."""
    within = distance // first
    if second <= within:
        raise ValueError("every choice of second-level parts would be empty")
    return ["".join(chosen) for parts in part_letters(first, second) for chosen in combinations(parts, second - within)]


def _projection(letters, mask):
    """A word's sorted letters without those that are not in the mask."""
    gone = "".join(c for c in LETTERS if c not in mask)
    return F.translate(letters, gone, "")


def _untouched(word, length, m):
    """The letters that an edit leaves, for each third that it may touch, of a word whose shorter partner has `m` letters."""
    a, b = F.floor(m / 3).cast("int"), F.floor(m * 2 / 3).cast("int")
    head_a, head_b = F.substring(word, F.lit(1), a), F.substring(word, F.lit(1), b)
    tail_a, tail_b = F.substring(word, length - m + a + 1, m - a), F.substring(word, length - m + b + 1, m - b)
    return [head_b, tail_a, F.concat(head_a, F.lit(" "), tail_b)]


def _sorted_letters(word):
    return F.array_join(F.sort_array(F.split(word, "")), "")


def _keyed(words: DataFrame, masks) -> DataFrame:
    """A row per word and join key; the longer word of a pair meets the shorter one under that one's length.

    Written without functions of functions, whose plans Spark cannot tell to be the same, so that a self-join shuffles once.
    """
    letters = words.withColumn("_letters", _sorted_letters("word")).withColumn("_length", F.length("word"))
    parts = [f"_part{i}" for i in range(len(masks))]
    projected = letters.withColumns({part: _projection(F.col("_letters"), mask) for part, mask in zip(parts, masks, strict=True)})
    rows = projected.withColumn("m", F.explode(F.array(F.col("_length"), F.col("_length") - 1)))
    left = _untouched(F.col("word"), F.col("_length"), F.col("m"))
    rows = rows.withColumns({f"_left{j}": x for j, x in enumerate(left)})
    keys = [F.xxhash64(F.lit(i), part, F.lit(j), f"_left{j}", "m") for i, part in enumerate(parts) for j in range(len(left))]
    return rows.select("word", "n", "m", F.explode(F.array(*keys)).alias("key"))


def near_pairs(words: DataFrame, first=3, second=1, crowded=CROWDED, finer=(1, 6)) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words, a < b, that differ by exactly one inserted, deleted or replaced code point.

    words: (word, n) without repeats. Keys are 64-bit hashes; a pair that shares one by chance fails the comparison.
    Keys with more than `crowded` words are split by the signatures of PartEnum with `finer` parts, which again lose no
    pair; adaptive execution splits what stays large.
    """
    keyed = _keyed(words, signature_masks(first, second))
    heavy = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > crowded).select("key"), "crowded")
    if not heavy.isEmpty():
        marked = lookup_join(keyed, heavy.withColumn("_heavy", F.lit(True)), ["key"], stored=True)
        letters = _sorted_letters("word")
        again = F.array(*[F.xxhash64("key", F.lit(i), _projection(letters, mask)) for i, mask in enumerate(signature_masks(*finer))])
        keyed = marked.withColumn("key", F.explode(F.when(F.col("_heavy"), again).otherwise(F.array("key")))).drop("_heavy")
    # Both sides of the join are one plan, so that its shuffle is made once.
    short = F.least(F.length("a.word"), F.length("b.word"))
    # Two words that are both longer than m meet under their own length as well.
    wanted = (F.col("a.word") < F.col("b.word")) & (short == F.col("a.m")) & (short == F.col("b.m")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    met = keyed.alias("a").join(keyed.alias("b"), F.col("a.key") == F.col("b.key")).where(wanted)
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def variants(docs: DataFrame, least_length=7, least_n=2, slip=31, share=10, crowded=CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. If the crc32 of `<doc_id>:<run>` is a
    multiple of `slip`, the run loses the code point at that number modulo its length. Words have at least `least_length` code
    points and occur at least `least_n` times in all, n. A null text has none; a null doc_id counts as an empty one.

    n_near: how many words are one edit away. form: the most frequent of them (ties: smallest in code-point order), if it is
    at least `share` times as frequent as the word; form_n: its n. root: where forms lead to in the end, the word if it has
    none. An empty table gives no rows.
    """
    words = store(word_counts(docs, least_length, slip).where(F.col("n") >= least_n), "words")
    pairs = near_pairs(words, crowded=crowded)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("_best"))
    taken = -F.col("_best.n") >= share * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(taken, F.col("_best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, -F.col("_best.n")).alias("form_n"),
    )
    found = store(found, "forms")
    return found.join(roots(found.where(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where a chain of forms ends. Every round doubles the steps taken."""
    steps = store(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = store(steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "steps")
        steps = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return steps
