from __future__ import annotations

import hashlib
import random

import numpy as np

from evigraph.llm import repeats


def brute(texts, length=200):
    """Removed runs of each text, from the places of all its strings."""
    places: dict[bytes, set] = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], set()).add((k, i))
    out = []
    for k, t in enumerate(texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(places[t[i : i + length]]) > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    passages = [noise(n) for n in (150, 178, 185, 195, 200, 201, 263, 400, 900)]
    texts = [None, "", "short", "a" * 1500, "ab" * 400, "x" * 199, "x" * 199, "y" * 200, "y" * 200]
    for _ in range(40):
        parts = [noise(rng.randint(0, 300)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, z = sorted((rng.randint(0, 60), len(p) - rng.randint(0, 60)))
            parts.insert(rng.randrange(4), p[a:z] if rng.random() < 0.6 else p)
        texts.append("".join(parts))
    return texts + texts[10:13] * 2 + [texts[20] + "!"]


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 9 else None, t, b"k") for i, t in enumerate(texts)], "doc_id long, text string, key binary").repartition(5)
    want = sorted(brute([(t or "").encode() for t in texts]))
    assert sorted(tuple(r)[1:] for r in repeats.digest(repeats.repeats(docs)).collect()) == want
    assert sorted(r.doc_id for r in repeats.repeats(docs).collect() if r.doc_id) == [i for i in range(len(texts)) if i % 9]
    assert repeats.repeats(docs.limit(0)).count() == 0


def test_the_sample_synchronises():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(97, 101, n, dtype=np.uint8) for n in (77, 200, 131))
    one, two = (set(repeats.sampled(x)[0].tolist()) for x in (np.concatenate((a, b, c)), np.concatenate((c, b))))
    assert {i - 77 for i in one} & {i - 131 for i in two} & set(range(repeats.REACH))


def test_packed_arrays():
    arrays = {"a": np.arange(5, dtype=np.uint16), "b": np.empty(0, np.uint64)}
    assert all((repeats.unpack(repeats.pack(**arrays))[k] == v).all() for k, v in arrays.items())
