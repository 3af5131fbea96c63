"""The pipeline against a brute-force version, stage by stage."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from trialspark.llm.queries import QUERIES
from trialspark.llm.storage import store

from .conftest import lower, words
from .test_models import check_pieces, tokenizer
from .test_words import brute_components, brute_fingerprint, brute_targets, removed


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def test_every_stage_by_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    names = docs.columns
    before = as_rows(docs)
    results = []
    for name, stage in cp.STAGES:
        docs = store(stage(spark, docs, small_dir), name)
        results.append(as_rows(docs))
    language, near, cut, mixed, packed = results
    assert all(set(r) == set(names) for rows in results[:4] for r in rows)
    # Language: every text with a letter stays.
    assert {r["doc_id"] for r in language} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    # Near-duplicates: the smallest doc_id of each component.
    component = brute_components({r["doc_id"]: brute_fingerprint(r["text"], 3) for r in language}, 3)
    kept = {r["doc_id"]: r["text"] for r in language if component[r["doc_id"]] == r["doc_id"]}
    assert {r["doc_id"]: r["text"] for r in near} == kept
    # Substrings.
    want = {}
    for r, gone in zip(near, removed([words(r["text"]) for r in near], 35), strict=True):
        left = [w for w, g in zip(words(r["text"]), gone, strict=True) if not g]
        if left:
            want[r["doc_id"]] = b" ".join(left).decode() if any(gone) else r["text"]
    assert {r["doc_id"]: r["text"] for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    # Mixing: words per source near the targets, no document more than twice.
    sizes, taken, per_doc = Counter(), Counter(), Counter()
    for r in cut:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
        per_doc[r["doc_id"]] += len(words(r["text"]))
        assert want[r["doc_id"]].split()[:3] == r["text"].split()[:3]
    assert all(abs(taken[s] - t) < 1 for s, t in brute_targets(sizes).items())
    assert all(n <= 2 * len(words(want[i])) for i, n in per_doc.items())
    # Packing: the tokens of every row.
    encoder = tokenizer()
    texts = {}
    for r in mixed:
        texts.setdefault(r["doc_id"], []).append(encoder.encode(r["text"], add_special_tokens=False).ids + [0])
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts) and len({r["sequence_id"] for r in packed}) == len(packed)
    for doc_id, rows in pieces.items():
        if len(texts[doc_id]) == 1:
            check_pieces(rows, texts[doc_id][0])
        else:
            assert sum(r["length"] for r in rows) == sum(map(len, texts[doc_id]))
    # run() makes the same rows.
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in QUERIES["pipeline"](spark, small_dir).collect()) == Counter(
        (r["doc_id"], r["start"], r["ids_crc32"]) for r in packed
    )


def test_stages_on_awkward_and_empty_documents(spark, awkward, small_dir):
    for docs in (awkward, awkward.where("doc_id < 0")):
        for name, stage in cp.STAGES:
            docs = store(stage(spark, docs, small_dir), name)
            if name != "packing":
                assert docs.columns == list(cp.DOCUMENT)
        docs.count()


def test_repeated_rows_leave_one(spark, documents, small_dir):
    docs = documents([(9, "same text here", "en", "a"), (9, "same text here", "en", "a"), (None, "no id", "en", "a"), (None, "no id", "en", "a")])
    got = [r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, small_dir).collect()]
    assert sorted(map(str, got)) == ["9", "None", "None"]


def test_reused_ids_lose_only_near_copies(spark, documents, small_dir):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(9, one, "en", "a"), (9, two, "en", "a"), (9, two, "en", "a"), (4, two.upper() + " ", "en", "a"), (7, three, "en", "a"), (9, three, "en", "b")]
    for way in (rows, rows[::-1]):
        got = cp.drop_near_duplicates(spark, documents(way), small_dir).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(9, one), (4, two.upper() + " "), (7, three)])


def test_near_copies_by_brute_force_distance(spark, documents, small_dir, table):
    random = np.random.default_rng(5)
    texts = [r["text"] for r in table("documents")]
    for size in (5, 40, 400, 2000):  # near copies on both sides of the border, by words changed here and there
        for _ in range(4):
            base = [f"v{random.integers(10**9)}" for _ in range(size)]
            texts += [" ".join(base)] * 2
            for share in (0.0005, 0.001, 0.005, 0.02):
                texts.append(" ".join(w if random.random() > share else f"u{random.integers(10**9)}" for w in base))
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(300)]
    texts += [" ".join([*passage, *[f"q{k}x{i}" for i in range(30)]]) for k in range(40)]  # one common passage, no copies
    texts += [" ".join([*base[:i], f"n{i}", *base[i + 1 :]]) for i in range(0, 300, 5)]  # one large group
    component = brute_components({k: brute_fingerprint(t, 3) for k, t in enumerate(texts)}, 3)
    sizes = Counter(component.values())
    assert max(sizes.values()) > 20 and sum(n == 1 for n in sizes.values()) > 100
    docs = store(documents([(k, t, "en", "a") for k, t in enumerate(texts)]), "near-copies-test")
    got = cp.drop_near_duplicates(spark, docs, small_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(sizes)


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "substrings", "mixing", "packing"]
    assert lower(b"AbZ\xc3\x89") == b"abz\xc3\x89" and pytest and np
