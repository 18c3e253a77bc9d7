from __future__ import annotations

import hashlib
import random
import re

from evigraph.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, met = plain_words(text), set(), set()
    for item, t in items:
        v = plain_words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            window = v[i : i + 10]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    met.add(str(item))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(5)
    vocabulary = ["The", "of", "ñus", "Zü", "x1", "in", "und", "ça", "q"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(25, None), (26, " -- "), (27, items[3][1]), (100, "The the the the the the the the the the the the")]
    docs = [(1, None), (2, ""), (3, "the " * 40)]
    for i in range(40):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            parts.insert(len(parts) // 2, (items[rng.randrange(25)][1] or "").upper().replace("Ü", "ü").replace("Ñ", "ñ").replace("Ç", "ç"))
        docs.append((10 + i, ", ".join(parts)))
    return items, docs + docs[-2:]


def test_against_brute_force(spark):
    items, docs = cases()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute(t, items)) for i, t in docs)
    for block in (1 << 17, 20):
        got = decontaminate.digest(decontaminate.contamination(d, b, block_windows=block))
        assert sorted(map(tuple, got.collect())) == want
    kept = decontaminate.decontaminate(d.withColumnRenamed("hits", "source"), b)
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[-1]]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.digest(decontaminate.contamination(d, b)).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination(d.limit(0), b).count() == 0
