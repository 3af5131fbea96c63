"""Operators that learn: context trees, language ID, toxicity; and packing."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trialspark.llm import language, packing, toxicity
from trialspark.llm.context_tree import END, Alphabet, Automaton, BITS, MASK, Model, escape_blend, grams, prior_blend, stream
from trialspark.llm.queries import QUERIES
from trialspark.llm.text import buffer, count_keys, slices

from .conftest import folded

TEXTS = ["abracadabra", "", "abra cadabra cad", "b", "aaaaaaaaaaaaaaaaab" * 40, "zq"]


def tree(texts, depth, blend, least=1, gain=0.0):
    data, offsets = buffer(pa.array(texts))
    keys, counts = np.unique(grams(stream(data, offsets)[0], depth), return_counts=True)
    by_depth = []
    for d in range(depth + 1):
        short, where = np.unique(keys & ((1 << (BITS * (d + 1))) - 1), return_inverse=True)
        by_depth.append((short, np.bincount(where, counts, len(short)).astype(float)))
    totals = np.zeros(MASK + 1)
    np.add.at(totals, *by_depth[0])
    alphabet = Alphabet(totals, 2)
    model = Model(by_depth, alphabet, blend, least, gain)
    return model, alphabet, Automaton([model], alphabet)


def brute_score(model, alphabet, text, depth):
    """Longest kept context by trying them all."""
    symbols = [int(alphabet.of[b]) for b in text.encode()] + [alphabet.end]
    total = 0.0
    for i, s in enumerate(symbols):
        history = ([alphabet.end] * depth + symbols[:i])[-depth:]
        for d in range(depth, -1, -1):
            code = 0
            for x in history[depth - d :]:
                code = code << BITS | x
            at = np.flatnonzero(model.codes[d] == code)
            if len(at) and model.kept[d][at[0]]:
                total += np.log10(model.probs[d][at[0], s]) - (np.log10(alphabet.shared) if s == alphabet.rare else 0)
                break
    return total


@pytest.mark.parametrize("blend", [escape_blend, prior_blend(4.0)])
def test_automaton_finds_the_longest_context(blend):
    model, alphabet, automaton = tree(TEXTS, 3, blend, least=2, gain=0.5)
    for probs in model.probs:
        assert np.allclose(probs.sum(1), 1)
    data, offsets = buffer(pa.array([*TEXTS, "rab\x00é", "caaab"]))
    got = automaton.score(data, offsets)[:, 0]
    want = [brute_score(model, alphabet, t, 3) for t in [*TEXTS, "rab\x00é", "caaab"]]
    assert np.allclose(got, want, rtol=1e-5)
    assert np.allclose(automaton.score(data[: offsets[1]], offsets[:2])[:, 0], got[0])


def test_grams_do_not_look_past_an_end():
    data, offsets = buffer(pa.array(["ab", "c"]))
    keys = grams(stream(data, offsets)[0], 2)
    split = [tuple(int(k) >> (BITS * j) & MASK for j in (2, 1, 0)) for k in keys]
    assert split == [(END, END, 97), (END, 97, 98), (97, 98, END), (END, END, 99), (END, 99, END)]


def test_op10_held_out_accuracy(spark, table):
    truth = {}
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist():
        truth[r["doc_id"]] = r["lang"]
    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (folded(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_of_awkward_rows(documents, awkward):
    train = documents([(i, f"the cat and the dog number {i}", "en", None) for i in range(30)] + [(100 + i, f"le chat et le chien de la rue {i}", "fr", None) for i in range(30)])
    langs, automaton = language.fit(train, min_count=2)
    assert langs == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.identify(awkward, langs, automaton).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert all(r["lang_pred"] in ("en", "fr") for i, r in got.items() if i not in (1, 2, 3))
    checks = documents([(1, "the dog and the cat"), (2, "la rue et le chat"), (3, "12345 !!")])
    assert [r["lang_pred"] for r in language.identify(checks, langs, automaton).orderBy("doc_id").collect()] == ["en", "fr", "und"]
    nothing = language.fit(train.where("doc_id < 0"))
    assert {r["lang_pred"] for r in language.identify(awkward, *nothing).collect()} == {"und"}
    assert language.identify(awkward.where("doc_id < 0"), langs, automaton).collect() == []


def test_restored_stretches():
    words = "stupid idiot moron trash pathetic loser worthless disgusting the cat sat on mat and dog".split()
    text = " ".join(words * 50)
    codes = np.array([26, 26, *[26 if c == " " else ord(c) - 97 for c in text], 26])
    counts = np.bincount(codes[:-2] * 784 + codes[1:-1] * 28 + codes[2:], minlength=28**3).reshape(28, 28, 28).astype(float)
    channel = toxicity.Channel(counts)
    for said, meant in (("you 1d10t", "you idiot"), ("s t u p i d", "stupid"), ("stuuuuupid", "stupid"), ("m0r0n!", "moron!"), ("l.o.s.e.r", "loser"), ("p4th3t1c", "pathetic"), ("in 1990 or 42", "in 1990 or 42"), ("the cat sat", "the cat sat")):
        assert channel.restore(said) == meant
        data, offsets = buffer(pa.array([said]))
        if said != meant:
            assert toxicity.suspicious(data, offsets)[0]
    long = "1a" * 5000  # a stretch of any length is decoded: 1 stands for l
    assert channel.restore(long) == "la" * 5000


def test_long_stretches_are_restored_too(spark, documents):
    words = "you are a stupid idiot moron trash pathetic loser worthless disgusting the cat sat on mat and dog".split()
    docs = documents([(i, " ".join(words) * 3) for i in range(20)])
    channel = toxicity.Channel(toxicity.character_counts(docs))
    said = channel.restore(" ".join("you stupid pathetic worthless loser".replace(" ", "") * 3))
    assert all(said.replace(" ", "").count(w) == 3 for w in ("stupid", "pathetic", "worthless", "loser")) and " " in said
    assert channel.restore("stu" + "u" * 100 + "pid") == "stupid" and channel.restore("s t u p i d " * 10).count("stupid") == 10
    long = " ".join("stupid" * 50_000)
    assert channel.restore(long).replace(" ", "") == "stupid" * 50_000
    docs = documents([(i, f"{'you are a stupid pathetic idiot' if i % 2 else 'have a lovely day'} number {i}") for i in range(60)])
    model = toxicity.fit(docs, docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    checks = documents([(1, " ".join("youareastupidpatheticidiotstupididiot")), (2, "an id" + "i" * 60 + "ot"), (3, "lovely day")])
    assert [r["predicted"] for r in toxicity.score(checks, model).orderBy("doc_id").collect()] == [1, 1, 0]


def test_folds_of_a_missing_id(spark):
    from trialspark.llm.queries import fold

    rows = spark.createDataFrame([(None,), (7,), (12,)], "doc_id long").select("doc_id", fold(5).alias("five"), fold(7).alias("seven")).collect()
    assert [(r["five"], r["seven"]) for r in rows] == [(0, 0), (folded(7, 5), folded(7, 7)), (folded(12, 5), folded(12, 7))]


def test_op8_separates_the_labelled_texts(spark):
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (folded(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    known = [(r["score"], labels[r["doc_id"]], r["predicted"], r["held_out"]) for r in got if r["doc_id"] in labels]
    toxic, clean = (np.array([s for s, y, _, _ in known if y == k]) for k in (1, 0))
    assert np.mean([(clean < s).mean() + 0.5 * (clean == s).mean() for s in toxic]) > 0.9
    assert np.mean([p for _, y, p, _ in known if y == 0]) < 0.03


def test_toxicity_of_awkward_rows(spark, documents, awkward):
    docs = documents([(i, f"{'you are a stupid idiot' if i % 2 else 'have a lovely day'} number {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, docs, labels)
    checks = documents([(1, "what a stup1d 1d10t"), (2, "lovely weather"), (3, "s t u p i d")])
    assert [r["predicted"] for r in toxicity.score(checks, model).orderBy("doc_id").collect()] == [1, 0, 1]
    got = toxicity.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    empty = toxicity.fit(docs.where("doc_id < 0"), docs.where("doc_id < 0"), labels.where("doc_id < 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score(awkward, empty).collect())
    assert toxicity.score(awkward.where("doc_id < 0"), model).collect() == []


def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def check_pieces(rows, ids_of, size=1024):
    """rows of one document, ids with the end: every id once, lengths powers of two or full, right checksums."""
    rows = sorted(rows, key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["doc_tokens"] == len(ids_of) and r["offset"] == 0
        assert r["length"] <= size and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids_of[at : at + r["length"]], "<u4").tobytes())
        at += r["length"]
    assert at == len(ids_of)


def test_op7_pieces(spark, small_dir, table):
    encoder = tokenizer()
    got = QUERIES["op7_packing"](spark, small_dir).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    documents = table("documents")
    assert set(by_doc) == {r["doc_id"] for r in documents}
    for r in documents:
        check_pieces(by_doc[r["doc_id"]], encoder.encode(r["text"] or "", add_special_tokens=False).ids + [0])


def test_packing_of_awkward_rows(spark, awkward, tmp_path):
    got = packing.pack(awkward, with_ids=True)
    rows = got.collect()
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert sum(r["doc_id"] == 9 for r in rows) == 2 * sum(1 for _ in packing.cuts(rows[[r["doc_id"] for r in rows].index(9)]["doc_tokens"], 1024))
    joined = b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["start"]))
    ids = np.frombuffer(joined, "<u4").tolist()
    text = awkward.where("doc_id = 7").first()["text"]
    assert ids[-1] == 0 and tokenizer().decode(ids[:-1]) == text
    packing.write_buckets(got, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(rows)
    assert packing.pack(awkward.where("doc_id < 0")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(awkward, size=1000)


def test_encoder_equals_the_tokenizer():
    encoder, slow = packing.Encoder(packing.RANKS, packing.TOKENIZER), tokenizer()
    for text in ["a\x1cb", "  \n\n x", "it's I'll''d", "²³ 4½ µm", "é\x85  z", "日本 x", "\x00", "<|endoftext|> hi", "hello <|endoftext|> world", "<|endoftext |>", "ab" * 50_000, " " * 1_000_000 + "x", "👩‍👩‍👧 ١٢٣"]:
        assert encoder.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder.encode("hello <|endoftext|> world")


def test_language_scores_in_small_slices():
    """What a worker holds besides the automaton stays small however many texts a batch has."""
    data = np.frombuffer(b"the cat sat on the mat. " * 170_000, np.uint8)
    offsets = np.arange(0, len(data) + 1, 2400)
    symbols, _ = stream(data[:24_000], offsets[:11])
    keys, counts = count_keys(symbols)
    totals = np.bincount(keys, counts, MASK + 1)
    alphabet = Alphabet(totals, 2)
    models = [Model([(keys, counts.astype(float))], alphabet, escape_blend, 24, 0.0) for _ in range(4)]
    automaton = Automaton(models, alphabet)
    tracemalloc.start()
    parts = [automaton.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], False) for i, j in slices(offsets, language.SLICE_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 1 and peak < 60_000_000
    assert np.allclose(np.concatenate(parts), automaton.score(data[: offsets[-1]], offsets, False))


def test_contexts_of_one_language_cost_no_rows_in_the_others():
    """The automaton of unlike languages is little larger than its trees: a worker holds it beside what other stages left."""
    alphabet, models = Alphabet(np.ones(MASK + 1), 1), []
    for k in range(4):
        data, offsets = buffer(pa.array(["".join(chr(97 + 6 * k + (i * i + j * i) % 6) for i in range(300)) for j in range(9)]))
        keys, counts = np.unique(grams(stream(data, offsets)[0], 3), return_counts=True)
        by_depth = []
        for d in range(4):
            short, where = np.unique(keys & ((1 << (BITS * (d + 1))) - 1), return_inverse=True)
            by_depth.append((short, np.bincount(where, counts, len(short)).astype(float)))
        models.append(Model(by_depth, alphabet, escape_blend, 1, 0.0))
    together = Automaton(models, alphabet)
    assert together.logs.size == sum(int(kept.sum()) for model in models for kept in model.kept) * together.size
    data, offsets = buffer(pa.array([*TEXTS, "ghighi mno", "stuvw"]))
    apart = [Automaton([model], alphabet).score(data, offsets)[:, 0] for model in models]
    assert np.allclose(together.score(data, offsets), np.stack(apart, axis=1), rtol=1e-6)


def test_packing_loads_the_tokenizer_only_where_it_is_needed():
    encoder = packing.Encoder(packing.RANKS, packing.TOKENIZER)
    encoder.encode("plain words")
    assert encoder.tokenizer is None and encoder.encode("hello <|endoftext|> world").tolist() == tokenizer().encode("hello <|endoftext|> world").ids
