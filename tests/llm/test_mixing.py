from __future__ import annotations

import re

from pyspark.sql import functions as F

from evigraph.llm import mixing


def plain_targets(sizes):
    """Reshare the excess by weight until no target is over its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        now = {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and now[s] > 2 * sizes[s]}
        if not over:
            return now
        full |= over


def data():
    out = [(i, " ".join(["w"] * (i * 37 % 900)) + "\t", ["b", "a", None, "é", "z", "a"][i % 6], 5, "k") for i in range(240)]
    few = [(500 + n, " ".join(["v"] * n), f"few{n}", 0, "k") for n in (1, 10, 65)]
    return out + [(None, None, "a", 0, "k"), (3, "", "empty", 0, "k"), (-(2**63), "x", "a", 0, "k"), (2**63 - 1, "y z", "a", 0, "k")] + few + out[:2] * 2


SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def test_targets_and_takes(spark):
    docs = spark.createDataFrame(data(), SCHEMA).repartition(3)
    sizes: dict = {}
    for _, t, s, _, _ in data():
        sizes[s] = sizes.get(s, 0) + len(re.findall(mixing.WORD, t or ""))
    want, got = plain_targets(sizes), mixing.taken(docs).collect()
    assert len(got) == len(data()) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(5)).collect()), key=str)
    assert all(r.taken <= 2 * r.size for r in got)
    for s, target in want.items():
        mine = [r for r in got if abs(r.target - target) < 1e-6 and r.source_size == sizes[s]]
        assert mine and abs(sum(r.taken for r in mine) - target) <= mixing.BLOCK and (not sizes[s] or sum(r.taken for r in mine))


def test_permutations(spark):
    sizes = [*range(1, 70), 997, 4096]
    numbers = spark.createDataFrame([(n, x, seed) for n in sizes for x in range(n) for seed in (1, 2)], "n long, x long, seed int")
    rows = numbers.withColumn("y", mixing.permuted(F.col("x"), F.col("n"), *mixing.digits(F.col("n")), F.col("seed"))).collect()
    images: dict = {}
    for r in rows:
        images.setdefault((r.n, r.seed), {})[r.x] = r.y
    assert all(sorted(m.values()) == list(range(n)) for (n, _), m in images.items())
    # a random permutation has about one fixed point, about half of its steps go up, and two seeds agree in about one place
    for n in (997, 4096):
        m, other = images[n, 1], images[n, 2]
        assert sum(x == y for x, y in m.items()) < 9 and sum(m[x] == other[x] for x in m) < 9
        assert abs(sum(m[x] < m[x + 1] for x in range(n - 1)) - n / 2) < 3 * (n / 12) ** 0.5


def test_shard_counts_are_a_draw(spark):
    """Chi-squared over shards and sources, against the multivariate hypergeometric distribution."""
    docs = spark.createDataFrame([(i, "w " * 640, "ab"[i % 2]) for i in range(1600)], "doc_id long, text string, source string")
    _, slots, _ = mixing.mix(docs, block=16, shard_slots=500)
    rows = slots.groupBy("shard", "source").count().collect()
    total, by_source = sum(r["count"] for r in rows), {}
    for r in rows:
        by_source[r.source] = by_source.get(r.source, 0) + r["count"]
    full = [r for r in rows if r.shard < total // 500 and r.source == "a"]
    p, shards = by_source["a"] / total, total // 500
    variance = 500 * p * (1 - p) * (total - 500) / (total - 1)
    chi = sum((r["count"] - 500 * p) ** 2 for r in full) / variance
    assert len(full) == shards and abs(chi - shards) < 4 * (2 * shards) ** 0.5


def test_slots_take_each_block_as_often_as_asked(spark):
    _, slots, _ = mixing.mix(spark.createDataFrame(data(), SCHEMA), block=16, shard_slots=50)
    rows = slots.collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == len({(r.source, r.round, r.index) for r in rows})
    assert all(r.round < mixing.MOST and 0 < r.limit <= 16 for r in rows)


def test_mixed_rows(spark):
    docs = spark.createDataFrame(data(), SCHEMA)
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    got = rows.collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in mixing.taken(docs).collect())
    assert mixing.taken(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0
