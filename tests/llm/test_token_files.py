"""Token files: exact round trips of the code, the files, and ids equal to the tokenizer's."""

import cProfile
import pstats
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialspark.llm import token_files as tf
from trialspark.llm.queries import QUERIES


def round_trip(ids, sizes, block):
    ids, sizes = np.array(ids, np.uint32), np.array(sizes, np.int64)
    ends, blocks = tf.block_ends(sizes, block)
    words, words_of, escapes, escapes_of = tf.encode(ids, ends)
    assert len(words) == words_of.sum() and len(escapes) == escapes_of.sum() and len(ends) == blocks.sum()
    ids_of = np.diff(ends, prepend=0)
    assert tf.decode(words, words_of, ids_of, escapes).tolist() == ids.tolist()
    first, apart = np.r_[0, np.cumsum(words_of)], np.r_[0, np.cumsum(escapes_of)]
    for b in range(len(ends)):  # every block alone
        own = tf.decode(words[first[b] : first[b + 1]], words_of[b : b + 1], ids_of[b : b + 1], escapes[apart[b] : apart[b + 1]])
        assert own.tolist() == ids[ends[b] - ids_of[b] : ends[b]].tolist()
    return words, escapes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=60), max_size=8), st.integers(1, 50))
def test_code_round_trip(docs, block):
    round_trip([x for d in docs for x in d], [len(d) for d in docs], block)


def test_code_of_runs_borders_and_escapes():
    for ids in ([0] * 1000, [0] * 239 + [1], [2**w - 1 for w in range(33) if 2**w - 1 < 2**32], [2**32 - 1] * 9, list(range(5000))):
        round_trip(ids, [len(ids)], 4096)
    words, escapes = round_trip([0] * 240, [240], 4096)
    assert len(words) == 1 and words[0] == 0
    words, escapes = round_trip([5, 6, 7, 60_000, 9, 10, 11, 12, 13, 14] * 30, [300], 4096)
    assert len(escapes) and 8 * len(words) + 4 * len(escapes) < 300 * 16 / 8  # one large id does not widen the others


def test_encoder_equals_the_tokenizer():
    encoder, plain = tf.Encoder(tf.TOKENIZER), Tokenizer.from_file(tf.TOKENIZER)
    texts = ["", " ", "a  b\n\nc\td", "It's I'LL 's 't", "x\x1cy\x85z\xa0w v", "Café café ́ H̱ İ ΣΑΣ ς", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|end oftext|>", "日本 x1²³½", "👩‍👩‍👧 ١٢٣", "ab" * 20_000, "\x00 \x00a", "no 'v e '  ve", "Straße STRASSE ÀÉÞ ÿ µm ªº ß ſ K µ×÷ İx end. stop!! wow's. a,b c<|endoftext|>. x|> y|. é.. ×. ٣. a≠. it'. &c. Straße, naïve; word'll. "]
    texts.append(" ".join(texts) * 3)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and [encoder.encode([t])[0] for t in texts] == want
    encoder.REMEMBERED = 2
    assert encoder.encode(texts) == want and [encoder.encode([t])[0] for t in texts] == want
    assert all(len(p) <= encoder.LONG for p in encoder.young)


def test_encoder_makes_no_call_per_word():
    """Words are split, told apart and remembered many at once, the words of later texts too."""
    encoder, plain = tf.Encoder(tf.TOKENIZER), Tokenizer.from_file(tf.TOKENIZER)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(30_000)]
    texts = [" ".join(words), ", ".join(w.capitalize() for w in words[::-1])]
    profile = cProfile.Profile()
    found = profile.runcall(lambda: [encoder.encode([t])[0] for t in texts])
    assert pstats.Stats(profile).total_calls < 10_000
    assert found == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(set(encoder.young)) == len(encoder.young) == len(words)


def test_encoder_on_every_small_character():
    encoder, plain = tf.Encoder(tf.TOKENIZER), Tokenizer.from_file(tf.TOKENIZER)
    texts = [f"{a}{chr(c)}{b}" for c in range(256) for a in ("", "x", "É", ".") for b in ("", "Q", ".", "',")]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]


def brute(rows):
    """rows: (doc_id, text); ordered as the files are."""
    plain, out, start = Tokenizer.from_file(tf.TOKENIZER), [], 0
    coded = []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        coded.append((doc_id is not None, doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for known, doc_id, n, crc in sorted(coded, key=lambda r: (r[0], r[1], r[3])):
        out.append((doc_id if known else None, start, n, crc))
        start += n
    return out


def test_op11_by_brute_force(spark, small_dir, table):
    got = QUERIES["op11_token_files"](spark, small_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute([(r["doc_id"], r["text"]) for r in table("documents")])


@pytest.mark.parametrize("file_bytes", [1 << 24, 20_000])
def test_files_of_awkward_rows(spark, awkward, tmp_path, file_bytes):
    path = str(tmp_path / "ids")
    tf.write_ids(awkward, path, file_bytes=file_bytes)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted(tf.read_ids(spark, path, with_ids=True, slice_ids=50).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == brute(rows)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    files = [f for f in (tmp_path / "ids").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert (len(files) > 1) == (file_bytes < 1 << 20)
    for f in files:  # the format, literally
        raw = f.read_bytes()
        assert raw[-9:-1] == tf.MAGIC and raw.endswith(b"\n")


def test_a_doc_id_of_many_rows_is_split(spark, documents, tmp_path):
    rows = [(3, f"same id {i}") for i in range(400)] + [(None, f"none {i}") for i in range(400)] + [(i, "same text") for i in range(100)]
    path = str(tmp_path / "ids")
    tf.write_ids(documents(rows), path, file_bytes=500)
    got = sorted(map(tuple, tf.read_ids(spark, path).collect()), key=lambda r: r[1])
    ids = [-1 if r[0] is None else r[0] for r in got]
    assert ids == sorted(ids) and sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in brute(rows))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    sizes = [f.stat().st_size for f in (tmp_path / "ids").iterdir() if f.name.startswith("part-")]
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3


def test_empty_table_and_damaged_file(spark, awkward, tmp_path):
    path = str(tmp_path / "ids")
    tf.write_ids(awkward.where("doc_id < 0"), path)
    assert tf.read_ids(spark, path).collect() == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-00000").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="does not end"):
        tf.read_ids(spark, str(tmp_path / "bad")).collect()
