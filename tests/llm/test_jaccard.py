from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from evigraph.llm import jaccard, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """Brute force: smallest id reachable by steps of a similarity of at least 0.8."""
    sets, low, changed = {i: plain_set(t) for i, t in texts}, {i: i for i, _ in texts}, True
    links = [(i, j) for i, a in sets.items() for j, b in sets.items() if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    while changed:
        changed = False
        for i, j in links:
            if low[j] > low[i]:
                low[j], changed = low[i], True
    return low


def planted(seed, bases=14, copies=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = [rng.choice(words) for _ in range(30)]
    texts = ["", None, " \t ", "one", "ONE", "a b c"]
    for k in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(6, 300))] + line * (k % 2)
        texts.append(" ".join(base))
        for c in range(copies):
            texts.append(" ".join(w if rng.random() > 0.01 * (c + 1) / 2 else rng.choice(words) for w in base[: len(base) - rng.randint(0, len(base) // 6)]))
    return list(enumerate(texts + texts[:9]))


@pytest.mark.parametrize(("crowded", "cap"), [(64, 2048), (2, 4)])
def test_against_brute_force(spark, crowded, cap):
    rows = planted(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    assert len(set(want.values())) < len({t for _, t in rows})
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, radius=1, similar=True, crowded=crowded, cap=cap).collect()} == want


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), shingle=5, similar=True).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c d"), (4, "c d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, shingle=5, similar=True).collect()), key=str) == [(4, 4), (4, 4), (None, None), (None, None)]


def test_stage_drops_edited_copies(spark, tmp_path):
    rng = random.Random(1)
    docs = []
    for i in range(20):
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        docs.append((i, " ".join(base)))
        for at in (60, 120, 180)[: i % 4]:
            base[at] = "edited"
        docs.append((100 + i, " ".join(base)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()}
    assert kept == set(range(20))


def test_stage_keeps_different_texts_of_one_id(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4)]
    rows = [(1, texts[0], 1), (1, texts[1], 2), (None, texts[2], 3), (None, texts[2] + " more", 4), (None, texts[1], 5), (7, texts[3], 6), (7, texts[3], 7), (8, None, 8), (9, "", 9)]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got if r.doc_id != 8 and r.text and "more" not in r.text} >= {(1, texts[0]), (1, texts[1]), (7, texts[3])}
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 7 for r in got) == 1 and sum(not r.text for r in got) == 1
    assert corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame([], "doc_id long, text string, n int"), str(tmp_path)).count() == 0


def test_texts_with_repeated_lines_are_linked(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    extra = [" ".join(f"{c}{i}" for i in range(20)) for c in "xy"]
    texts = [" ".join(words) + " " + " ".join([e] * 20) for e in extra] + [" ".join(f"z{rng.randrange(9999)}" for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, similar=True).collect()}
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts[:2]]
    assert bin(fps[0] ^ fps[1]).count("1") > 24 and got == {0: 0, 1: 0, 2: 2}


def test_marks_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (1, 1, 1), (64, 65, 60), (200, 200, 199), (90, 700, 80), (5000, 5600, 4990), (300, 300, 0)):
        values = rng.integers(0, 1 << 64, n + m - both, np.uint64)
        a, b = np.sort(values[:n]), np.sort(values[n - both :])
        x, y = jaccard._mark(a), jaccard._mark(b)
        different = n + m - 2 * both
        assert jaccard._apart(x, y) == jaccard._apart(y, x) <= different and jaccard._apart(x, x) == 0
        # sets of like size that are far from a link are told apart
        assert 9 * jaccard._apart(x, y) > n + m or 9 * different <= 2 * (n + m) or 5 * min(n, m) < 4 * max(n, m)


def test_whole_sets_are_sent_for_likely_pairs_only(spark, monkeypatch):
    rng = random.Random(21)
    texts = []
    for k in range(7):
        base = [f"w{rng.randrange(9999)}" for _ in range(240)]
        # the first pair is a link, the others share three of four parts
        other = [f"v{rng.randrange(9999)}" for _ in range(60 if k else 1)]
        texts += [base, base[:100] + other + base[100 + len(other) :]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sent, verified = [], jaccard._verified

    def counted(pairs, *args):
        sent.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, radius=1, similar=True).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 14)} and sum(sent) <= 1


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (64, 65, 60), (200, 200, 199), (90, 700, 80), (5000, 5600, 4990), (600, 600, 300)):
        values = rng.integers(0, 1 << 64, n + m - both, np.uint64)
        x, y = jaccard._sketch(values[:n]), jaccard._sketch(values[n - both :])
        assert len(x) == jaccard.SKETCH and np.bitwise_count(x ^ y).sum() <= n + m - 2 * both


def test_pairs_ruled_out_by_sketches_are_not_listed(spark, monkeypatch):
    rng = random.Random(22)
    part = [f"w{rng.randrange(9999)}" for _ in range(150)]
    # all share three of four parts; only the last two are a link
    texts = [part + [f"v{rng.randrange(9999)}" for _ in range(50)] for _ in range(24)]
    texts.append([*texts[-1][:-1], "edited"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    listed, allowed = [], jaccard._allowed

    def counted(pairs, *args):
        listed.append(pairs.count())
        return allowed(pairs, *args)

    monkeypatch.setattr(jaccard, "_allowed", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, radius=0, similar=True).collect()}
    assert got == {i: i for i in range(24)} | {24: 23} and sum(listed) <= 2
