from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evigraph.llm import periods as P


def brute(w, exponent=4, least=6):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] == w[i + p]:
                j = i
                while j + p < n and w[j] == w[j + p]:
                    j += 1
                s, e = i, j + p
                if e - s >= max(least, exponent * p) and not any(all(w[t] == w[t + q] for t in range(s, e - q)) for q in range(1, p)):
                    out.append((s, e - s, p))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


words = st.lists(st.integers(1, 3), max_size=40)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(0, 30), st.integers(1, 5), st.sampled_from([(4, 6), (2, 2), (3, 6), (2, 6)]))
def test_runs(w, a, p, bounds):
    if a + p < len(w):
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    assert [tuple(r) for r in P.runs_of(np.array(w, int), *bounds).tolist()] == brute(w, *bounds)
    # two texts side by side, with the words that no run can hold left out
    both = dict(P.runs_of_texts(np.array(w + w[::-1], int), np.repeat([0, 1], len(w)), *bounds))
    for i, x in enumerate((w, w[::-1])):
        assert [(s - i * len(w), n, q) for s, n, q in both.get(i, np.empty((0, 3), int)).tolist()] == brute(x, *bounds)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_extensions(w):
    e, n = P.Extensions([*w, 0]), len(w)
    pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
    got = e(*np.array(pairs).T)
    for (i, j), k in zip(pairs, got.tolist()):
        assert k == next(k for k in range(n + 1) if i + k >= n or j + k >= n or w[i + k] != w[j + k])
    order = sorted(range(n + 1), key=lambda i: [*w[i:], 0])
    assert [e.rank[i] for i in order] == list(range(n + 1))


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a a", "x\x0ba a\x0ca a a a  y", "é ü " * 5, "a a " * 6, "ha " * 3000]
    texts += [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(30)]
    ids = [None, *range(1, len(texts))]
    rows = [(i, t, 9, "x") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, runs int, collapsed string")
    found = P.periodic_runs(P.planted(docs))
    got = [tuple(r) for r in P.digest(found).collect()]
    assert sorted(got, key=str) == sorted([(i, *expected(i, t)) for i, t in zip(ids + ids[-1:], texts + texts[-1:])], key=str)
    assert sum(r[1] > 0 for r in got) > 5
    plain = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert plain[4].collapsed == "a" and plain[4].n_words == 6 and plain[5].collapsed == "x a y" and plain[1].collapsed == ""
    assert P.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(docs, exponent=1)
