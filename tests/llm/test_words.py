"""Operators on words: substring deduplication, fingerprints, mixing, licenses, scores."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialspark.llm import licenses, mixing, scoring, simhash, substrings
from trialspark.llm.queries import QUERIES
from trialspark.llm.text import Words, buffer, canonical

from .conftest import close, folded, lower, words

import pyarrow as pa


def test_words_and_canonical_form():
    texts = ["a  b\tc", None, "", " x ", "é z\x1cq", "\x0b\x0c"]
    data, offsets = buffer(pa.array(texts))
    found = Words(data, offsets)
    got = [[bytes(data[a:b]) for a, b in zip(found.starts[i:j], found.ends[i:j])] for i, j in zip(found.first[:-1], found.first[1:])]
    assert got == [words(t) for t in texts]
    text, at = canonical(found)
    assert [bytes(text[i:j]) for i, j in zip(at[:-1], at[1:])] == [b" ".join(words(t)) for t in texts]


def removed(texts, window):
    """The rule, literally."""
    places = Counter(tuple(ws[i : i + window]) for ws in texts for i in range(len(ws) - window + 1))
    out = []
    for ws in texts:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if places[tuple(ws[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def check_repeats(got, rows, window):
    want = []
    for (doc_id, ws), gone in zip(rows, removed([ws for _, ws in rows], window), strict=True):
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        want.append((str(doc_id), len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_op2_against_the_rule(spark, small_dir, table):
    rows = [(r["doc_id"], words(r["text"])) for r in table("documents")]
    check_repeats(QUERIES["op2_substrings"](spark, small_dir).collect(), rows, 35)


@pytest.mark.parametrize("shard_texts", [256, 2])
def test_repeats_of_many_kinds(documents, shard_texts):
    """Shared passages at any offset, periodic texts, overlaps, and a passage in many texts; few texts a shard or window by window."""
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(14)]
    texts = [[f"u{x}" for x in rng.integers(0, 400, 40)] for _ in range(30)]
    for k, ws in enumerate(texts):
        at = int(rng.integers(0, 30))
        ws[at:at] = common[: 8 + k % 7]
    texts += [["a"] * 50, ["a", "b"] * 20, texts[3], texts[4][5:25], ["x"] * 9, []]
    df = documents([(i, " ".join(ws)) for i, ws in enumerate(texts)])
    got = substrings.remove_repeats(df, window=9, gram=3, shard_texts=shard_texts).collect()
    check_repeats(got, [(i, [w.encode() for w in ws]) for i, ws in enumerate(texts)], 9)


def test_repeats_on_awkward_rows(spark, awkward):
    rows = [(r["doc_id"], words(r["text"])) for r in awkward.collect()]
    check_repeats(substrings.remove_repeats(awkward).collect(), rows, 35)
    assert substrings.remove_repeats(awkward.where("doc_id < 0")).collect() == []


def test_repeated_rows_ask_for_their_places_once(documents):
    """Rows alike in doc_id and text: as many places of their windows, but one list of ranges."""
    ws = [f"w{i}" for i in range(60)]
    df = documents([(1, " ".join(ws))] * 300 + [(None, " ".join(ws))] * 300 + [(2, " ".join([*ws[10:], "end"]))])
    spans = substrings.repeated_spans(df.select("doc_id", "text")).select("doc_id", F.size("removed").alias("n")).distinct().collect()
    assert len(spans) == 3 and all(0 < r["n"] <= 2 * 60 for r in spans)
    got = {str(r["doc_id"]): (r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect()}
    assert got == {"1": (60, 60), "None": (60, 60), "2": (51, 50)}


def test_suffix_automaton_counts():
    texts = [(list("abcabcab"), 1), (list("bcab"), 3), (list("zz"), 1)]
    automaton = substrings.SuffixAutomaton()
    for text, times in texts:
        automaton.add(text, times)
    automaton.finish()
    joined = [("".join(t), n) for t, n in texts]
    for text, _ in texts:
        for window in (1, 2, 3):
            want = []
            for i in range(len(text) - window + 1):
                part = "".join(text[i : i + window])
                want.append(sum(n * sum(t[j : j + window] == part for j in range(len(t))) for t, n in joined) > 1)
            assert automaton.repeated(text, window) == want


def brute_fingerprint(text, shingle):
    ws = lower((text or "").encode()).split()
    runs = [b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))] if ws else []
    values = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints, most):
    """prints: {node: fingerprint}."""
    root = {n: n for n in prints}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_op4_against_all_pairs(spark, small_dir, table):
    prints = {r["doc_id"]: brute_fingerprint(r["text"], 3) for r in table("documents")}
    component = brute_components(prints, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, small_dir).collect()}
    assert got == {i: (f"{f:016x}", component[i]) for i, f in prints.items()}


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_of_planted_fingerprints(spark, bucket):
    """Chains, dense groups and pairs at 3 and 4 bits, all found; with small buckets nearly every bucket is dealt again."""
    rng = np.random.default_rng(8)
    prints = {}

    def put(x):
        prints.setdefault(int(x) & (1 << 64) - 1, len(prints))

    for _ in range(40):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        put(base)
        for _ in range(int(rng.integers(0, 12))):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                base ^= 1 << int(b)
            put(base)
    for b in range(64):
        put(0xF0F0 ^ 1 << b)
    nodes = {n: f for f, n in prints.items()}
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, n) for n, f in nodes.items()], "fp long, node long")
    from trialspark.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(points, 3, bucket)).collect()}
    want = {n: c for n, c in brute_components(nodes, 3).items()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_near_duplicates_on_awkward_rows(awkward):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()]
    assert len(got) == awkward.count()
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert [c for i, _, c in got if i == 9] == [9, 9] and [c for i, _, c in got if i is None] == [None]
    assert simhash.near_duplicates(awkward.where("doc_id < 0")).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: {source: words}; sources in code point order, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, budget = set(names), share * sum(sizes.values())
    while free:
        time = (budget - sum(most * sizes[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        full = {s for s in free if most * sizes[s] <= time * weight[s]}
        if not full:
            break
        free -= full
    return {s: time * weight[s] if s in free else float(most * sizes[s]) for s in names}


def check_mix(got, rows):
    sizes, text_of = Counter(), {}
    for doc_id, source, text in rows:
        sizes[source] += len(words(text))
        text_of[doc_id] = (source, len(words(text)))
    targets, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        source, n = text_of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[source]) and close(r["target"], targets[source])
        assert 0 <= r["taken"] <= 2 * n
        taken[source] += r["taken"]
    assert all(abs(taken[s] - t) < 1 for s, t in targets.items())


def test_op5_targets_and_takes(spark, small_dir, table):
    df = QUERIES["op5_mixing"](spark, small_dir)
    got = df.collect()
    check_mix(got, [(r["doc_id"], r["source"], r["text"]) for r in table("documents")])
    assert [r["virtual_finish"] for r in got] == sorted(r["virtual_finish"] for r in got)
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op5_mixing"](spark, small_dir).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_of_awkward_rows(documents, awkward):
    rows = [(i, f"{'w ' * (i % 7)}", None, ("é", "b", None, "B", "a")[i * i % 5]) for i in range(200)]
    for block in (2000, 3):
        mixed = mixing.mix(documents([(i, t, None, s) for i, t, _, s in rows]), block=block)
        check_mix(mixed.collect(), [(i, s, t) for i, t, _, s in rows])
    copied = mixing.copies(mixing.mix(documents([(i, t, None, s) for i, t, _, s in rows]), keep=("doc_id", "text"), block=3)).collect()
    assert sum(len(words(r["text"])) for r in copied) == sum(r["taken"] for r in mixed.collect())
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mix(awkward.where("doc_id < 0")).collect() == []
    assert all(r["taken"] == 0 for r in mixing.mix(awkward.where("doc_id <= 3")).collect())


def license_words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))


def check_base(r, text):
    ws, places, labels = license_words(text), [], set()
    for phrase, label in licenses.BASE:
        run = phrase.split()
        found = [i for i in range(len(ws)) if ws[i : i + len(run)] == run]
        places += found
        labels |= {label} if found else set()
    want = (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
    assert labels <= set(r["labels"].split(",")) | {""} - {""} or not labels
    assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_op6_base_columns(spark, small_dir, table):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    got = QUERIES["op6_licenses"](spark, small_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        check_base(r, texts[r["doc_id"]])


def brute_detections(text):
    """All matches of all rules, then those inside no other of the same or a stronger priority."""
    text = " " + " ".join(license_words(text)) + " "
    hits = []
    for label, priority, word, pattern in licenses.signature_rules():
        if f" {word} " in text:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", text):
                start = text[: m.start()].count(" ") - 1
                hits.append((start, start + m[0].count(" ") + 1, priority, label))
    hits.sort(key=lambda h: (h[0], -h[1], h[2], h[3]))
    return [h for k, h in enumerate(hits) if not any(c[2] <= h[2] and c[1] >= h[1] for c in hits[:k])]


def test_licenses_overlaps_and_awkward_texts(documents, awkward):
    texts = [
        "MIT License mit license; the MIT license.",
        "Licensed under the Apache License, Version 2.0 (the License); see the license file for details",
        "GNU Lesser General Public License v 2.1, GNU General Public License, either version 3 or later. GPLv2",
        "cc by, CC BY-NC-SA 4.0 https://creativecommons.org/licenses/by-sa/3.0 cc by cc by",
        "SPDX-License-Identifier: Apache-2.0 SPDX License Identifier MIT",
        "Copyright (c) 2019 Foo. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted",
        "admit licenses apache licensed éapache license",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        check_base(got[i], text)
        found = [(d["start"], d["end"], d["priority"], d["label"]) for d in got[i]["detections"]]
        assert found == brute_detections(text)
    assert "apache-2.0" in got[1]["labels"] and "lgpl-2.1" in got[2]["labels"] and "cc-by-nc-sa-4.0" in got[3]["labels"]
    assert got[6]["labels"] == "" and got[6]["score"] == 0
    rows = {r["doc_id"]: r for r in licenses.scan(awkward).collect()}
    for r in awkward.collect():
        check_base(rows[r["doc_id"]], r["text"])
    assert licenses.scan(awkward.where("doc_id < 0")).collect() == []
    assert len(licenses.signature_rules()) > 200


def test_op9_base_scores(spark, small_dir, table):
    docs = {r["doc_id"]: [*lower((r["text"] or "").encode()).split(), None] for r in table("documents")}
    held = {i: folded(i, 7) == 2 for i in docs}
    counts = Counter(w for i, ws in docs.items() if not held[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = QUERIES["op9_suffix_tree"](spark, small_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = docs[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        assert close(r["base_score"], base) and r["held_out"] == held[r["doc_id"]] and r["score"] < 0
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in counts for w in ws), total)


def test_scores_with_rare_words_joined(documents, awkward):
    """With few common words nearly every word goes through the join; the scores are the same."""
    few, many = (scoring.fit(awkward, common_words=n) for n in (3, 500_000))
    assert len(few.common[0]) < len(many.common[0])
    a, b = ([(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in scoring.score(awkward, m).orderBy("doc_id").collect()] for m in (few, many))
    assert a == b and len(a) == awkward.count()
    empty = scoring.fit(awkward.where("doc_id < 0"))
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in scoring.score(awkward, empty).collect())
    assert scoring.score(awkward.where("doc_id < 0"), many).collect() == []


def branches(tree):
    """Texts that take every branch of a parsed pattern, each optional part once with and once without."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in arg]
        elif name == "BRANCH":
            more = [t for way in arg[1] for t in branches(way)]
        elif name == "SUBPATTERN":
            more = branches(arg[3])
        elif name == "ANY":
            more = ["x"]
        else:
            assert name == "MAX_REPEAT", name
            low, high, inner = arg
            more = sorted({t * n for t in branches(inner) for n in {low, 1 if low <= 1 <= high else low}})
        out = [a + b for a in out for b in more]
    return out


def test_every_branch_of_a_license_rule_passes_its_gate(documents):
    texts = sorted({t for _, _, _, pattern in licenses.signature_rules() for t in branches(re._parser.parse(pattern))})
    for label, _, word, pattern in licenses.signature_rules():
        for text in branches(re._parser.parse(pattern)):
            assert licenses.gate_mark(word) in f" {text} ", (label, text)
    assert {"lgplv3", "agpl3", "gpl2", "gpled", "0bsd", "creative commons cc0"} <= set(texts)
    common = ["lgplv3", "lgplv2", "lgpl2", "agplv3", "agpl3", "gpl2", "gpl3", "gpled", "0bsd", "creative commons cc0"]
    got = {r["doc_id"]: r for r in licenses.scan(documents([(k, f"licensed by {t} here") for k, t in enumerate(common)])).collect()}
    want = ["lgpl", "lgpl", "lgpl", "agpl", "agpl", "gpl-2.0", "gpl-3.0", "gpl", "0bsd", "cc0-1.0"]
    for k, text in enumerate(common):
        assert want[k] in got[k]["labels"] and got[k]["score"] > 0, (text, got[k])
        assert any((d["start"], d["end"]) == (2, 2 + len(text.split())) and d["label"] == want[k] for d in got[k]["detections"])
