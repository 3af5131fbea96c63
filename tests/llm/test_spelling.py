"""Spelling variants against comparing all words with all."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from trialspark.llm import spelling
from trialspark.llm.queries import QUERIES


def near(a, b):
    """One inserted, deleted or replaced code point, literally."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows, slip=31):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def brute(n):
    """All pairs, by deletions: words are near if a deletion of one is the other, or the same place deleted leaves the same."""
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    partners = {w: set() for w in n}
    for (head, tail), ws in holes.items():
        for a in ws:
            partners[a].update(b for b in ws if b != a)
            if head + tail in n:
                partners[a].add(head + tail)
                partners[head + tail].add(a)
    form = {}
    for w, ps in partners.items():
        best = min(ps, key=lambda p: (-n[p], p), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(partners[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=str)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op12_by_brute_force(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_spelling"](spark, f"/root/testdata/{folder}")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(counts(rows))


@pytest.mark.parametrize("crowded", [2048, 3])
def test_pairs_with_and_without_finer_signatures(spark, crowded):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcéÿ"), size=rng.integers(7, 11))) for _ in range(60)]
    words = set(base) | {"a" * k for k in range(7, 20)}
    for w in base:
        for _ in range(6):
            i = int(rng.integers(0, len(w) + 1))
            words |= {w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}
    words = {w: k + 2 for k, w in enumerate(sorted(w for w in words if len(w) >= 7))}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((a, words[a], b, words[b]) for a, b in combinations(sorted(words), 2) if near(a, b))
    assert len(want) > 500
    assert sorted(map(tuple, spelling.near_pairs(table, crowded=crowded).collect())) == want
    if crowded > 3:
        for parts in ((1, 4), (2, 3)):
            assert sorted(map(tuple, spelling.near_pairs(table, *parts).collect())) == want


def test_signatures_lose_no_pair_within_two():
    rng = np.random.default_rng(1)
    for parts in ((3, 1), (1, 3), (1, 6), (2, 2), (2, 3)):
        masks = spelling.signature_masks(*parts)
        for _ in range(300):
            a = Counter(rng.choice(list("abcdefé"), size=9).tolist())
            b = a.copy()
            b.subtract([rng.choice(list(a))])
            b.update([rng.choice(list("abcxyzÿ"))])
            seen = [[sorted(x for x in c.elements() if x in mask) for mask in masks] for c in (a, +b)]
            assert any(x == y for x, y in zip(*seen, strict=True))
    with pytest.raises(ValueError):
        spelling.signature_masks(1, 2)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("x", "w036"), ("y", "w036"), ("u", "v")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "v" if w == "u" else "w037" for w, _ in chain}


def test_awkward_rows(spark, awkward, documents):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, spelling.variants(awkward).collect()), key=str) == brute(counts(rows))
    assert spelling.variants(awkward.where("doc_id < 0")).collect() == []
    texts = [(i, "Spelling spelling, SPELLING. Ünlücke ünlücke Ärgerlich×ärgerlich") for i in range(30)] + [(None, "speling spelingg straßen straßen"), (5, "speling spelingg spelinng spelinng naïvetés naivetés" * 2), (6, "x" * 100_000 + " " + "x" * 100_000)]
    got = sorted(map(tuple, spelling.variants(documents(texts)).collect()), key=str)
    assert got == brute(counts(texts))
    assert {r[0]: r[2] for r in got}["speling"] == "spelling"
