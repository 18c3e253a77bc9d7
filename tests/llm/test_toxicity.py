from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.llm import toxicity
from evigraph.llm.decontaminate import words as words_of


def rows(n=900):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(("an", "er", "th", "ou", "st")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 120))]
        for _ in range(max(1, len(words) // 15) * toxic):
            words.insert(rng.randrange(len(words)), "gruz" + "".join(rng.choice("aeioubdk") for _ in range(3)))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(toxicity.toxicity(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    unseen = [(y, got[i]) for i, _, y in data if got[i].held_out or i % 3 == 0]
    right = sum(r.predicted == y for y, r in unseen) / len(unseen)
    assert right > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for _, r in unseen)
    kept = toxicity.accepted(docs.drop("score"), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_probabilities_against_counting():
    """Each class's probability of each byte, counted out from the words of a small sample with dictionaries."""
    sample = [(t.encode(), y) for t, y in (("gruz gruz gruza banana banana", 1), ("banana bandana and gruza", 0), ("and and banana", 0), ("gruz gruz and", 1))]
    order, least = toxicity.ORDER, toxicity.LEAST
    distinct = sorted({w for t, _ in sample for w in t.split()} | {b"other"})
    triples: dict[bytes, int] = {}
    for w in distinct:
        for i in range(len(w)):
            g = (b" " + w + b" ")[i : i + 3]
            triples[g] = triples.get(g, 0) + 1
    codes = np.array(sorted(int.from_bytes(g, "big") for g in triples))
    model = toxicity.fit(sample, codes, np.array([triples[int(c).to_bytes(3, "big")] for c in codes]))

    occurrences: dict[int, list[dict[bytes, float]]] = {order: [{}, {}]}
    for t, y in sample:
        for w in t.split():
            line = b"\0" * (order - 2) + b" " + w + b" "
            for i in range(order, len(line) + 1):
                now = occurrences[order][y]
                now[line[i - order : i]] = now.get(line[i - order : i], 0) + 1
    for k in range(order - 1, least - 1, -1):
        occurrences[k] = [{}, {}]
        for y in (0, 1):
            for g, n in occurrences[k + 1][y].items():
                begins = g[1] <= 32
                if begins or g[0] > 0:
                    occurrences[k][y][g[1:]] = occurrences[k][y].get(g[1:], 0) + (n if begins else 1)

    def probability(gram: bytes, y: int) -> float:
        total = sum(n for g, n in triples.items() if g[:2] == gram[-3:-1])
        p = max(triples[gram[-3:]] / total, toxicity.UNSEEN) if gram[-3:] in triples else toxicity.UNSEEN
        for k in range(least, order + 1):
            own = {g for c in occurrences[k] for g in c if sum(x.get(g, 0) for x in occurrences[k]) >= toxicity.SUPPORT}
            same = [g for g in own if g[:-1] == gram[-k:-1]]
            if not same:
                continue
            less = lambda g: max(occurrences[k][y].get(g, 0) - toxicity.DISCOUNT, 0)
            back = toxicity.DISCOUNT * len(same)
            p = ((less(gram[-k:]) if gram[-k:] in own else 0) + back * p) / (sum(map(less, same)) + back)
        return p

    words = pa.array([b"gruz", b"gruza", b"banana", b"zebra", "\u00e9".encode()], pa.binary())
    code, _ = toxicity.spelt(words)
    want = [[probability(int(c).to_bytes(order, "big"), y) for c in code] for y in (0, 1)]
    assert np.allclose(model.probabilities(code), want)


def test_evidence_is_the_mean_ratio(monkeypatch):
    model = toxicity.fit([(b"one two gruz gruz gruz", 1), (b"one two two two", 0)] * 3, np.empty(0, np.int64), np.empty(0, np.int64))
    texts = [b"", b"Gruz, gruz one!", b"   two  one  ", b"new words"]
    want = [float(np.mean(model.ratios(pa.array(w, pa.binary())))) if w else 0.0 for w in map(words_of, texts)]
    assert np.allclose(model.evidence(pa.array(texts, pa.binary())), want)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 1)
    assert np.allclose(model.evidence(pa.array(["x", *texts], pa.binary()).slice(1)), want)


def test_shared_counts(spark):
    texts = ["b ab", "AB ab, b", None, "", "c-b"]
    triples, n = toxicity.shared_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {int(t).to_bytes(3, "big").decode(): int(c) for t, c in zip(triples, n) if (int(t) >> 8) & 0xFF != 32}
    assert got == {" b ": 1, " ab": 1, "ab ": 1, " c ": 1}


def test_labels_of_held_out_rows_change_nothing(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(toxicity.held_out_col(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.digest(toxicity.toxicity(docs, x)).collect())) for x in (labels, other))
    assert a == b


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, ""), (3, "é " * 100000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.digest(toxicity.toxicity(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_repeated_ids_change_no_score(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    copies = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id")
    many = docs.unionByName(copies.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6)))).drop("n"))
    once, often = ({r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(d, labels, sample_rows=20).collect()} for d in (docs, many))
    assert once == often and {p for _, p in often.values()} == {0, 1}


def test_driver_gives_memory_of_the_fit_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, "gruz word" if i % 2 else "plain word") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.toxicity(docs, labels)
    assert calls
