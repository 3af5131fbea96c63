"""The suffix tree of op9 against one built with dictionaries, in one shard and in several."""

import math
from collections import Counter, defaultdict

import pytest

from trialspark.llm import scoring, suffix_tree

END = 256


def symbols_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    return [*b" ".join(w for w in words.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w), END]


def runs_of(text, depth):
    """(context, symbol) for each symbol; the context last symbol first."""
    symbols = symbols_of(text)
    before = [END] * depth
    for s in symbols:
        yield tuple(before), s
        before = [s, *before[:-1]]


class BruteTree:
    def __init__(self, texts, depth, least, min_gain, prior):
        self.depth, self.prior, self.counts = depth, prior, defaultdict(Counter)
        for text in texts:
            for context, s in runs_of(text, depth):
                for d in range(depth + 1):
                    self.counts[context[:d]][s] += 1
        self.total = {c: sum(n.values()) for c, n in self.counts.items()}
        self.kept = {()}
        for c, n in self.counts.items():
            if c and self.total[c] >= least:
                gain = sum(k * math.log(k / self.total[c] / self.smooth(c[:-1], s)) for s, k in n.items())
                if gain >= min_gain:
                    self.kept |= {c[:d] for d in range(len(c) + 1)}

    def smooth(self, c, s):
        n, total = self.counts[c][s] if c in self.counts else 0, self.total.get(c, 0)
        if not c:
            return (n + 1) / (total + 257)
        return (n + self.prior * self.smooth(c[:-1], s)) / (total + self.prior)

    def score(self, text):
        out = 0.0
        for context, s in runs_of(text, self.depth):
            d = max(d for d in range(self.depth + 1) if context[:d] in self.kept)
            out += math.log10(self.smooth(context[:d], s))
        return out


@pytest.fixture(scope="module")
def texts(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("entries", [10**6, 500])
def test_scores_by_brute_force(texts, monkeypatch, entries):
    rows = texts.collect()
    brute = BruteTree([r["text"] for r in rows if r["doc_id"] % 3], 4, 12, 6.0, 9.0)
    monkeypatch.setattr(suffix_tree, "SHARD_ENTRIES", entries)
    model = scoring.fit(texts.where("doc_id % 3 != 0"), depth=4, least=12, min_gain=6.0, prior=9.0)
    assert (suffix_tree.shard_count(model.tree) > 3) == (entries == 500)
    assert max(map(len, brute.kept)) > 2
    got = {r["doc_id"]: r["score"] for r in scoring.score(texts, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(brute.score(r["text"]), rel=1e-5), r["doc_id"]


def test_tree_grows_with_the_corpus(texts):
    """More text of the same kind: more contexts are seen often enough."""
    sizes = [scoring.fit(texts.where(f"doc_id % 8 < {n}")).tree.count() for n in (1, 4, 8)]
    assert sizes[0] < sizes[1] < sizes[2]


def test_probabilities_add_up(texts):
    """Behind every kept context the runs and what is left for the shorter context come to 1."""
    tree = defaultdict(dict)
    for r in scoring.fit(texts).tree.collect():
        tree[r["d"], r["key"] >> 9][r["key"] & 511] = 10 ** r["value"]
    for (d, context), after in tree.items():
        if d:
            seen = set(after) - {suffix_tree.ESCAPE}
            shorter = tree[d - 1, context >> 9]
            left = 1 - sum(shorter[s] for s in seen)
            assert sum(after[s] for s in seen) + after[suffix_tree.ESCAPE] * left == pytest.approx(1, abs=1e-4)
