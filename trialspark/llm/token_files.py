"""Token ids of documents in word-aligned files.

The code is Simple-8b with escapes. A 64-bit word is a selector in its upper 4 bits and, in the other 60, as many slots of one
width as fit, the first in the lowest bits. A slot of ones alone stands for an id kept apart, in the escapes of its block,
so that one large id does not widen its neighbours. Selectors 0 and 1 are runs of 240 and 120 zeros without slots.

A file holds whole documents in order, one record each, every record followed by a newline. A record is the blocks of its
document, of at most `BLOCK` ids: the words, 8 bytes each, then the escapes, 4 bytes each. After the records comes an index:

    documents   id int64, 1 if the id is null else 0 uint8, ids int64, blocks int64      one array after another
    blocks      offset int64, ids uint32, words uint32, escapes uint32                   one array after another
    tail        documents int64, blocks int64, ids int64, `MAGIC`

All numbers are little-endian. Any block can be decoded alone from its offset, and many at once without a loop over words.
"""

import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .storage import store
from .text import slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
BLOCK = 4096
MAGIC = b"ids8b\x00\x00\x01"
# Slots and width by selector.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MARK = (np.uint64(1) << WIDTH.astype(np.uint64)) - np.uint64(1)


def block_ends(sizes, block=BLOCK):
    """(ends of all blocks, blocks of each document) for documents of `sizes` ids one after another."""
    blocks = -(-sizes // block)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks)
    turn = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.minimum(first + (turn + 1) * block, np.repeat(np.cumsum(sizes), blocks)), blocks


def encode(ids, ends):
    """(words, words of each block, escapes, escapes of each block); ids: uint32, ends: where each block ends.

    Every position gets the selector with the fewest bits an id, escapes included; the words of all blocks are then laid
    out side by side, the k-th of every block at once.
    """
    n = len(ids)
    starts = np.r_[0, ends[:-1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    best, cheapest = np.zeros(n, dtype=np.int8), np.full(n, np.inf, dtype=np.float32)
    total, large = np.zeros(n + 1, dtype=np.int32), int(ids.max(initial=0))
    zeros = n and int(ids.min()) == 0
    for s in range(0 if zeros else 2, 16):
        slots = int(COUNT[s])
        if s > 2 and large < MARK[s - 1]:
            break  # nothing is left that a wider slot would save
        if WIDTH[s] > 32:
            total[:] = 0
        else:
            np.cumsum(ids >= np.uint32(MARK[s]) if s > 1 else ids != 0, out=total[1:])
        if s > 1 and 4 * total[n] > 3 * n:
            continue  # most slots would be escapes
        cost = np.full(n, np.inf, dtype=np.float32)
        if n >= slots:
            np.subtract(total[slots:], total[: n - slots + 1], out=cost[: n - slots + 1], casting="unsafe")
        if s < 2:
            cost[cost > 0] = np.inf
        cost *= 32
        cost += 64
        cost /= slots
        # The last places of each block have less room.
        short = np.unique(np.maximum(ends[:, None] - np.arange(1, slots), starts[:, None])) if slots > 1 else starts[:0]
        if s < 2:
            cost[short] = np.inf
        elif len(short):
            stop = ends[np.searchsorted(ends, short, "right")]
            cost[short] = (64 + 32 * (total[stop] - total[short])) / (stop - short)
        better = cost < cheapest
        np.copyto(best, s, where=better)
        np.copyto(cheapest, cost, where=better)
    values = ids.astype(np.uint64)
    at, block, places, owners = starts.copy(), np.arange(len(ends)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        places.append(at)
        owners.append(block)
        at = at + COUNT[best[at]]
        open_ = at < ends[block]
        at, block = at[open_], block[open_]
    places, owners = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(places, kind="stable")
    places, owners = places[order], owners[order]
    chosen, words, apart = best[places], np.zeros(len(places), dtype=np.uint64), np.zeros(n, dtype=bool)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        cells = places[rows][:, None] + np.arange(COUNT[s])
        inside = cells < ends[owners[rows]][:, None]
        cells = np.where(inside, cells, 0)
        slots = np.where(inside, np.minimum(values[cells], MARK[s]), np.uint64(0))
        apart[cells[inside & (slots == MARK[s])]] = True
        words[rows] = np.bitwise_or.reduce(slots << (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64), axis=1)
    words |= chosen.astype(np.uint64) << np.uint64(60)
    escaped = np.r_[0, np.cumsum(apart)]
    return words, np.bincount(owners, minlength=len(ends)), ids[apart], escaped[ends] - escaped[starts]


def decode(words, words_of, ids_of, escapes):
    """The ids of blocks one after another, from their words, words a block, ids a block and escapes."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(ids_of)
    owner = np.repeat(np.arange(len(words_of)), words_of)
    upto = np.cumsum(COUNT[selector])
    first = np.cumsum(words_of) - words_of
    before = np.r_[0, upto][first] if len(first) else first  # slots of earlier blocks
    places = upto - COUNT[selector] - before[owner] + (ends - ids_of)[owner]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    apart = np.zeros(len(out), dtype=bool)
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        slots = words[rows][:, None] >> (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64) & MARK[s]
        cells = places[rows][:, None] + np.arange(COUNT[s])
        inside = cells < ends[owner[rows]][:, None]
        out[cells[inside]] = slots[inside]
        apart[cells[inside & (slots == MARK[s])]] = True
    out[apart] = escapes
    return out


def gather(values, ends, chosen):
    """The runs `chosen` of `values`, which end at `ends`, one after another, and the length of each."""
    lengths = np.diff(ends, prepend=0)[chosen]
    upto = np.cumsum(lengths)
    return values[np.repeat(ends[chosen] - upto, lengths) + np.arange(upto[-1] if len(upto) else 0)], lengths


def joined(runs):
    """(values, ends) of several (values, ends) one behind another."""
    before = np.cumsum([0, *(len(values) for values, _ in runs)])
    return np.concatenate([values for values, _ in runs]), np.concatenate([ends + k for (_, ends), k in zip(runs, before, strict=False)])


class Encoder:
    """Ids of whole texts by the tokenizer.

    This kind of tokenizer drops white space, never looks across a space, ignores case, and cuts between a letter and a
    punctuation mark. So the ids of a text are those of its pieces between spaces, and of a word with marks behind it those
    of the word and of the marks. Texts are split by Arrow and every distinct piece of a call is looked at once. Words of
    letters are lower-cased; the last `REMEMBERED` of them are remembered between calls, those in use for longest. New ones
    are tokenized many at once, told apart by the tokens that end a word, without the tokenizer's own normalizing and
    splitting, which change nothing on such words; all other pieces take the tokenizer as it is.
    """

    REMEMBERED, LONG, AT_ONCE = 400_000, 64, 1024
    #: Left out: the apostrophe, which may belong to the word, and the marks of special tokens.
    MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
    #: Letters below U+0100, then marks.
    WORD = "^(?P<word>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[" + re.escape(MARKS) + "]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use all cores
        self.tokenizer, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known, self.known_ids = pa.array([], pa.large_string()), (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    @property
    def young(self) -> list[str]:
        """The words remembered."""
        return self.known.to_pylist()

    def _new(self, words):
        """(ids, where those of each word end) of lower-case words of letters below U+0100."""
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        starts = np.append(np.arange(0, len(words), self.AT_ONCE), len(words))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.cast(pa.string())), " ")
        ids = np.concatenate([np.array(self.of_words.encode_batch_fast([line.as_py()], add_special_tokens=False)[0].ids, "<u4") for line in lines])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError(f"{len(words)} words have {len(ends)} ends")
        return ids, ends

    def _words(self, words):
        """The same of any lower-case words, which differ from each other; the new ones are remembered."""
        at = pc.index_in(words, self.known)
        new = pc.is_null(at)
        fresh = words.filter(new)
        old, place = len(self.known), at.fill_null(0).to_numpy().astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = old + np.arange(len(fresh))
        known, found = pa.concat_arrays([self.known, fresh]), joined([self.known_ids, self._new(fresh)])
        # Those used now go behind the others, and the first are forgotten.
        used = np.zeros(len(known), dtype=bool)
        used[place] = True
        short = pc.less_equal(pc.utf8_length(known), self.LONG).to_numpy(zero_copy_only=False)
        kept = np.concatenate([np.flatnonzero(~used & short), np.flatnonzero(used & short)])[-self.REMEMBERED :]
        self.known = known.take(pa.array(kept))
        ids, lengths = gather(*found, kept)
        self.known_ids = ids, np.cumsum(lengths)
        ids, lengths = gather(*found, place)
        return ids, np.cumsum(lengths)

    def _whole(self, pieces):
        """The same of any pieces."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.cumsum([len(ids) for ids in found], dtype=np.int64)

    def _pieces(self, pieces):
        """The same of distinct pieces: a word and its marks, or the whole."""
        parts = pc.extract_regex(pieces, self.WORD)
        plain = parts.is_valid()
        word, tail = (parts.filter(plain).field(k).dictionary_encode() for k in (0, 1))
        lower = pc.utf8_lower(word.dictionary).dictionary_encode()
        words, tails, rest = self._words(lower.dictionary), self._whole(tail.dictionary), self._whole(pieces.filter(pc.invert(plain)))
        ok, first, n = plain.to_numpy(zero_copy_only=False), len(words[1]), len(words[1]) + len(tails[1])
        # Two runs a piece; the second of a whole one is the empty run at the end.
        both = np.full((len(pieces), 2), n + len(rest[1]), dtype=np.int64)
        both[ok, 0], both[ok, 1] = lower.indices.to_numpy()[word.indices.to_numpy()], first + tail.indices.to_numpy()
        both[~ok, 0] = n + np.arange(len(rest[1]))
        values, ends = joined([words, tails, rest])
        ids, lengths = gather(values, np.append(ends, len(values)), both.ravel())
        return ids, np.cumsum(lengths)[1::2]

    def encode_array(self, texts, closing=()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, a null one empty, each followed by the ids `closing`; and how many each has."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        pieces, sizes = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
        ids, ends = joined([self._pieces(pieces.dictionary), (np.array(closing, "<u4"), np.array([len(closing)]))])
        last = np.cumsum(sizes)
        chosen = np.insert(pieces.indices.to_numpy().astype(np.int64), last, len(ends) - 1)
        ids, lengths = gather(ids, ends, chosen)
        upto = np.append(0, np.cumsum(lengths))
        return ids, np.diff(upto[np.append(0, last + np.arange(1, len(sizes) + 1))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_array(pa.array(texts, pa.large_string()))
        raw, ends = memoryview(ids).cast("B"), np.cumsum(sizes) * 4
        return [bytes(raw[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; the tasks that it runs share what is remembered."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_CODED = "file int, doc_id long, ids_crc32 long, place long, n_tokens long, shape binary, code binary"


def coded(docs: DataFrame, bounds, tokenizer=TOKENIZER, end=END, slice_bytes=1 << 21) -> DataFrame:
    """Each row's ids, `end` behind them, as blocks. file: how many of the sorted `bounds` lie below its doc_id, 0 for a null
    one; rows of a doc_id that is several bounds are dealt over the files between. shape: ids, words and escapes of each
    block as uint32; code: the blocks; place: a number per row. A null text is an empty one."""
    bounds = np.array(bounds, dtype=np.int64)

    def task(parts):
        coder, place = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for part in parts:
            doc_ids, texts = part.column("doc_id").cast(pa.int64()), part.column("text")
            upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)))
            for i, j in slices(upto, slice_bytes):
                ids, sizes = coder.encode_array(texts.slice(i, j - i), [end])
                ends, blocks = block_ends(sizes)
                words, words_of, escapes, escapes_of = encode(ids, ends)
                shape = np.stack([np.diff(ends, prepend=0), words_of, escapes_of], axis=1).astype("<u4")
                word_bytes, escape_bytes = words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()
                w, e = np.r_[0, np.cumsum(words_of)] * 8, np.r_[0, np.cumsum(escapes_of)] * 4
                code = [word_bytes[w[b] : w[b + 1]] + escape_bytes[e[b] : e[b + 1]] for b in range(len(ends))]
                b, raw, stops = np.r_[0, np.cumsum(blocks)], memoryview(ids).cast("B"), np.r_[0, np.cumsum(sizes) * 4].tolist()
                own, places = doc_ids.slice(i, j - i), place + np.arange(j - i)
                number = own.fill_null(np.iinfo(np.int64).min).to_numpy()
                first, last = np.searchsorted(bounds, number), np.searchsorted(bounds, number, "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((first + places * 40_503 // 7 % (last - first + 1)).astype(np.int32)),
                        own,
                        pa.array([zlib.crc32(raw[stops[k] : stops[k + 1]]) for k in range(j - i)], pa.int64()),
                        pa.array(places),
                        pa.array(sizes),
                        pa.array([shape[b[k] : b[k + 1]].tobytes() for k in range(j - i)], pa.binary()),
                        pa.array([b"".join(code[b[k] : b[k + 1]]) for k in range(j - i)], pa.binary()),
                    ],
                    names=["file", "doc_id", "ids_crc32", "place", "n_tokens", "shape", "code"],
                )
                place += j - i

    return docs.select("doc_id", "text").mapInArrow(task, _CODED)


def _records(parts):
    """The records of a file from its sorted rows, then its index."""
    at, doc_ids, null, sizes, blocks, offsets, shapes = 0, [], [], [], [], [], []
    for part in parts:
        code = part.column("code").to_pylist()
        own = [np.frombuffer(x, "<u4").reshape(-1, 3).astype(np.int64) for x in part.column("shape").to_pylist()]
        for shape, record in zip(own, code, strict=True):
            size = 8 * shape[:, 1] + 4 * shape[:, 2]
            offsets.append(at + np.cumsum(size) - size)
            at += len(record) + 1
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.binary())], names=["record"])
        shapes += own
        blocks.append([len(s) for s in own])
        sizes.append(part.column("n_tokens").to_numpy())
        doc_ids.append(part.column("doc_id").fill_null(0).to_numpy())
        null.append(part.column("doc_id").is_null().to_numpy(zero_copy_only=False))
    if sizes and sum(map(len, sizes)):
        shape, offset = np.concatenate(shapes), np.concatenate(offsets)
        columns = [(doc_ids, "<i8"), (null, "u1"), (sizes, "<i8"), (blocks, "<i8"), ([offset], "<i8"), *[([shape[:, k]], "<u4") for k in range(3)]]
        index = b"".join(np.concatenate(c).astype(kind).tobytes() for c, kind in columns)
        tail = np.array([sum(map(len, sizes)), len(offset), shape[:, 0].sum()], "<i8").tobytes() + MAGIC
        yield pa.RecordBatch.from_arrays([pa.array([index + tail], pa.binary())], names=["record"])


def write_ids(docs: DataFrame, path: str, tokenizer=TOKENIZER, end=END, file_bytes=1 << 24, file_docs=1 << 20) -> None:
    """Write the ids of all rows of `docs` in ascending doc_id order to files of about `file_bytes` bytes of text each.

    Rows without a doc_id come first. Rows that share a doc_id follow each other in no promised order, over as many files as
    they need. Texts are tokenized once, by the tasks that read them, and only codes are shuffled: the borders between
    files are approximate quantiles of the doc_ids. The files are written by Spark's own committer: a task that runs again
    leaves no second copy.
    """
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    files = max(1, -(-(size or 0) // file_bytes), -(-n // file_docs))
    # The smallest number stands for null, so that many rows without a doc_id are dealt over several files as well.
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    bounds = docs.agg(F.percentile_approx(number, [k / files for k in range(1, files)], 100 * files)).first()[0] if n and files > 1 else []
    placed = coded(docs, bounds, tokenizer, end).repartitionById(files, F.col("file")).sortWithinPartitions("doc_id", "ids_crc32", "place")
    # Spark's text writer puts the bytes of a string out as they are, and a newline behind each row.
    records = placed.mapInArrow(_records, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("compression", "none").option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, with_ids=False, slice_ids=1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and `ids` if asked for, of every document in the files of a folder, decoded from
    them. start: ids of all documents before it, files in their order."""
    spec = "file int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def task(parts):
        for part in parts:
            for file, content in zip(part.column("file").to_pylist(), part.column("content"), strict=True):
                if len(content.as_buffer()):
                    yield from _documents(file, content.as_buffer(), with_ids, slice_ids)

    files = spark.read.format("binaryFile").load(path)
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("file")
    found = store(files.select(number, "content").mapInArrow(task, spec), "decoded")
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("file")) - F.col("_size")
    start = F.col("at") + F.col("_before")
    joined = found.join(sizes.select("file", before.alias("_before")), "file")
    return joined.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _documents(file, content, with_ids, slice_ids):
    view, n = memoryview(content), len(content)
    if bytes(view[n - 9 : n]) != MAGIC + b"\n":
        raise ValueError(f"file {file} does not end as a file of ids")
    docs, blocks, total = (int(x) for x in np.frombuffer(view[n - 33 : n - 9], "<i8"))
    at = n - 33 - docs * 25 - blocks * 20
    columns = []
    for size, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<i8"), (docs, "<i8"), (blocks, "<i8"), (blocks, "<u4"), (blocks, "<u4"), (blocks, "<u4")):
        columns.append(np.frombuffer(view[at : at + size * np.dtype(kind).itemsize], kind))
        at += columns[-1].nbytes
    doc_id, null, size, blocks_of, offset, ids_of, words_of, escapes_of = columns
    starts, edges = np.cumsum(size) - size, np.r_[0, np.cumsum(blocks_of)]
    i = 0
    while i < docs:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + slice_ids)))
        held = slice(edges[i], edges[j])
        spans = list(zip(offset[held].tolist(), (8 * words_of[held].astype(np.int64)).tolist(), (4 * escapes_of[held].astype(np.int64)).tolist(), strict=True))
        words = np.frombuffer(b"".join(view[o : o + w] for o, w, _ in spans), "<u8")
        escapes = np.frombuffer(b"".join(view[o + w : o + w + e] for o, w, e in spans), "<u4")
        ids = decode(words, words_of[held].astype(np.int64), ids_of[held].astype(np.int64), escapes).astype("<u4").tobytes()
        own = starts[i:j] - starts[i]
        raw = [ids[4 * a : 4 * (a + s)] for a, s in zip(own.tolist(), size[i:j].tolist(), strict=True)]
        columns = [
            pa.array(np.full(j - i, file, np.int32)),
            pa.array(doc_id[i:j], mask=null[i:j] == 1),
            pa.array(starts[i:j]),
            pa.array(size[i:j]),
            pa.array([zlib.crc32(x) for x in raw], pa.int64()),
        ]
        names = ["file", "doc_id", "at", "n_tokens", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        i = j
    if starts[-1] + size[-1] != total:
        raise ValueError(f"file {file} holds other than {total} ids")
