from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from evigraph.llm import simhash
from evigraph.llm.common import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Brute force: smallest id reachable by steps of at most four bits."""
    low, changed = {i: i for i, _ in fps}, True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 4 and low[j] > low[i]:
                    low[j], changed = low[i], True
    return low


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{i}é" for i in range(60)]
    texts = ["", None, " \t ", "one", "ONE", "a b c"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(4):
            texts.append(" ".join(w if rng.random() > 0.01 else "x" for w in base))
    texts += texts[:9]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: f for i, (f, _) in got.items()} == dict(fps)
    assert {i: c for i, (_, c) in got.items()} == groups(fps)


def test_long_text_and_chunks(spark, monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    base = np.random.default_rng(1).integers(0, 1 << 62, 8)
    rows = sorted({int(b) ^ (1 << int(k)) ^ (1 << int(m)) for b in base for k in range(20) for m in range(20)})
    fps = spark.createDataFrame([(r,) for r in rows], "fp long")
    got = {r.node: r.root for r in components(simhash.links(fps, bucket_cap=16)).collect()}
    assert got == groups([(r, r) for r in rows])


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c d"), (4, "c d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == [(4, 4), (4, 4), (None, None), (None, None)]
