"""Packing token streams into power-of-two sequences.

Each document's tokens are cut into full sequences and, for the rest, one piece per binary digit of its length. Every piece
is a sequence of its own: its length is a power of two, so nothing is padded and no sequence crosses documents. The
sequences of one length form a bucket, from which batches of equal lengths are drawn.
"""

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

SIZE = 1024
END = 0
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(tokenizer: str) -> list[str]:
    """The strings of the tokenizer's added tokens."""
    return [token.content for token in Tokenizer.from_file(tokenizer).get_added_tokens_decoder().values()]


class Encoder:
    """Token ids of whole texts, those of the tokenizer as its file describes it.

    The rank file holds the vocabulary of the tokenizer file, and the ids are the same (the tests compare them); ranks take
    a third of the time. A text that holds the string of one of the tokenizer's added tokens, which the ranks lack, goes to
    the tokenizer itself, and so does one on which the splitting rule gives up (very long blanks). The tokenizer takes more
    memory than the ranks, so it is loaded for the first such text only. `added`: its added tokens, if known already.
    """

    def __init__(self, ranks: str, tokenizer: str, added: list[str] | None = None):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.path, self.tokenizer = tokenizer, None
        self.added = added_tokens(tokenizer) if added is None else added

    def encode(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.added):
            try:
                return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:
                pass
        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, size: int) -> list[int]:
    """Lengths of the pieces of `n` tokens: full sequences, then falling powers of two."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, ranks=RANKS, tokenizer=TOKENIZER, size=SIZE, with_ids=False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and `ids` if asked for; one row per piece.

    A document is its ids and END; a null or empty text is END alone, one piece of one token. Repeated rows are packed each
    on its own. sequence_id is unique: its upper bits hold the length bucket, then the task's partition and the piece's
    number there, so a task that runs again gives the same. `size` is a power of two. Nothing is shuffled.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))
    spec = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    end, added = np.array([END], dtype="<u4").tobytes(), added_tokens(tokenizer)

    def task(parts):
        encoder = Encoder(ranks, tokenizer, added)
        number = TaskContext.get().partitionId() << 34
        for part in parts:
            for i in range(0, len(part), 256):
                ids, texts = (part.column(c).slice(i, 256).to_pylist() for c in ("doc_id", "text"))
                columns = [[] for _ in schema]
                for doc_id, text in zip(ids, texts, strict=True):
                    tokens = encoder.encode(text or "").tobytes() + end
                    n, start = len(tokens) // 4, 0
                    for length in cuts(n, size):
                        piece = tokens[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, zlib.crc32(piece), n, (length.bit_length() - 1) << 57 | number, 0, piece)
                        for column, value in zip(columns, row, strict=False):
                            column.append(value)
                        start, number = start + length, number + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(task, spec)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length."""
    packed.write.partitionBy("length").parquet(path)
