from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from evigraph.llm import manifest as M

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in order[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            fold, path = list(r), ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                fold[4] = r[4].replace("\n", "")
            fold = leaf(fold)
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    run, d = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    path += "".join(run[:d] + run[d + 1 :])
                    fold = sha("".join([*run[:d], fold, *run[d + 1 :]]))
                    at //= 3
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, sha(path), fold, fold == root))
    return out


def made(n, source):
    return [(1000 * len(source or "") + i, source, "en", i, f"line {i}\nline", "x", 1) for i in range(n)]


def test_against_brute_force(spark):
    rows = made(1000, "hot") + made(1, "lone") + made(4, "four") + made(3, "thr") + made(28, None) + made(2, "")
    rows += [(None, "four", None, None, None, None, None), (7, "four", "", 0, "", "", 0), (7, "four", "é", 0, "\n" * 5, "", 0), (7, "four", "", 0, "", "", 0), (8, "Ärger", "de", 2, "x" * 200_000 + "\n", "", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = sorted(expected(rows), key=str)
    assert sorted((tuple(r) for r in M.verified(docs).collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}
    for one in (rows[:1], rows[:2], rows[:1] + rows[-1:]):
        assert sorted((tuple(r) for r in M.verified(spark.createDataFrame(one, COLUMNS)).collect()), key=str) == sorted(expected(one), key=str)
    assert M.verified(docs.limit(0)).count() == 0
    assert sorted((tuple(r) for r in M.verified(docs, levels=2).collect()), key=str) == want


def test_requests_and_records(spark):
    docs = spark.createDataFrame(made(100, "a") + made(30, "bb"), COLUMNS)
    m = M.manifest(docs)
    wanted = spark.createDataFrame([("=a", 99), ("=a", 0), ("=a", 99), ("=bb", 17)], "tree string, place long")
    some = {(r.tree, r.place): r for r in M.proofs(m, wanted).collect()}
    every = {(r.tree, r.place): r for r in M.proofs(m).collect()}
    assert set(some) == {("=a", 99), ("=a", 0), ("=bb", 17)} and len(every) == 130
    assert all(some[k].path == every[k].path for k in some)
    # the record under a digest has children that hash to it
    for r in m.records.collect():
        assert sha("".join(c.hex() for c in r.children)) == r.digest.hex()
    folded = M.proofs(m, wanted).select(M.folded(M.text_of(F.col("digest")), F.col("path")).alias("f"), M.text_of(F.col("root")).alias("root"))
    assert all(r.f == r.root for r in folded.collect())


def test_equal_subtrees_are_stored_once_and_proved_each(spark):
    rows = [(1, "a", "en", 1, "same", "", 0)] * 27
    docs = spark.createDataFrame(rows, COLUMNS)
    m = M.manifest(docs)
    assert M.proofs(m).count() == 27
    assert sorted((tuple(r) for r in M.verified(docs).collect()), key=str) == sorted(expected(rows), key=str)
